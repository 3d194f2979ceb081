"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, out of place."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release

UNKNOWN = "und"
#: Labels that profiles are learned for: the most frequent, of equals the first by name.
MOST_LABELS = 10_000
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point: 2 a letter, 1 a combining mark (part of a word, but no letter by itself), 0 anything else."""
    global _LETTERS
    if _LETTERS is None:
        kind = (unicodedata.category(chr(c))[0] for c in range(0x110000))
        _LETTERS = np.fromiter(({"L": 2, "M": 1}.get(k, 0) for k in kind), dtype=np.uint8, count=0x110000)
    return _LETTERS


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (one to three characters of a word with a space at each end) and how often each occurs.

    A gram is a number of 21 bits a character, so that grams of another length never share one. No letter: none.
    """
    empty = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if not text:
        return empty
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters()[c]
    if not (kind == 2).any():
        return empty
    c = np.concatenate([[32], np.where(kind > 0, c, 32), [32]]).astype(np.int64)
    gap = c == 32
    c = c[~(gap & np.concatenate([[False], gap[:-1]]))]
    gap = c == 32
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    codes = np.sort(np.concatenate([c[~gap], two, three[~gap[1:-1]]]))
    start = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[start], np.diff(np.append(start, len(codes)))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent grams (ties: the smaller first) and their ranks; grams as frequent share a mean rank."""
    order = np.argsort(-counts, kind="stable")[:size]
    grams, counts = grams[order], counts[order]
    start = np.nonzero(np.concatenate([[True], counts[1:] != counts[:-1]]))[0]
    n = np.diff(np.append(start, len(counts)))
    return grams, np.repeat(start + (n - 1) / 2, n)


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def learn_profiles(labelled: DataFrame, size: int = 400, sample: int = 1_000, labels: int = MOST_LABELS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Each language's ``size`` most frequent n-grams, most frequent first.

    Fitted on about ``sample`` documents a language, the bound of this classifier, picked by a hash of id and text;
    rows whose label or text is null are left out, and so are those of labels beyond the ``labels`` most frequent. Only
    ``size`` grams a language reach the driver; the texts not picked are dropped where they are read.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = rows.groupBy(lang_col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang_col).limit(labels).collect()
    if not found:
        return {}
    rate = F.create_map(*[x for r in found for x in (F.lit(r[lang_col]), F.lit(sample / r["n"]))])
    draw = F.pmod(F.xxhash64(F.lit(6), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.where(draw < F.element_at(rate, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found = [ngrams(t) for x, t in zip(langs, texts, strict=True) if x == lang]
                g, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([f[1] for f in found]), minlength=len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])
            release()

    counts = picked.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


class Profiles:
    """Profiles side by side: ``grams`` sorted, and each one's rank in each language, ``size`` where it has none."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.empty(0, dtype=np.int64)]))
        self.ranks = np.full((len(self.grams), len(self.langs)), float(size))
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose profile is the least out of place (ties: the first by name), and how near it is, 0 to 1."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        grams, rank = ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[at] == grams
        out = np.abs(rank[known, None] - self.ranks[at[known]])
        out[self.ranks[at[known]] >= self.size] = self.size
        far = out.sum(axis=0) + self.size * (~known).sum()
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(grams)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names.

    Null, empty and letterless texts: ``und``, 0. Whole texts count, of any length. No profiles: all ``und``.
    """
    side = Profiles(profiles, size)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        release()  # what the batch before has left
        return pd.DataFrame([side.predict(t) for t in texts], columns=["lang_pred", "score"])

    told = docs.withColumn("__told", predict(F.col(text_col)))
    return told.select(*[F.col(c) for c in docs.columns if c not in ("lang_pred", "score")], F.col("__told.lang_pred").alias("lang_pred"), F.col("__told.score").alias("score"))


def held_out(id_col: str = "doc_id", of: int = 4) -> Column:
    return F.coalesce(remainder(id_col, of) == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
