"""Document fingerprints, native: SimHash over word shingles, and permuted block tables that find near fingerprints."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized, words

#: One 64-bit hash a term for each; a fingerprint has 64 bits a seed.
SEEDS = (1, 2)
BITS = 64 * len(SEEDS)
LANES = (1 << 32) | 1


def _term(w: Column, i: Column, shingle: int) -> Column:
    """The term of ``shingle`` words from the i-th on: a hash whose low three bits hold its weight less one.

    A term weighs 1 to 8 by its length, so that what a few characters change moves few votes and a run of short,
    frequent words says little.
    """
    grams = [F.get(w, i + j) for j in range(shingle)]
    size = reduce(lambda x, y: x + y, [F.coalesce(F.octet_length(g), F.lit(0)) for g in grams])
    return F.xxhash64(*grams).bitwiseAND(F.lit(-8)).bitwiseOR(F.least(F.lit(7), F.floor(size / 4).cast("int")).cast("bigint"))


def simhash(texts: DataFrame, keys: list[str], text_col: str, shingle: int = 3) -> DataFrame:
    """``keys`` and ``fp`` (array of longs, one a seed) of each distinct value of ``keys``.

    Terms are the distinct shingles of ``shingle`` words (a shorter text: all its words), so that a run of one repeated
    word doesn't outvote the text. A bit is set if the terms that set it outweigh those that don't; no terms: all zero.
    Votes of bits i and i + 32 share a long, 32 bits each, so a term costs 32 additions a seed; sums stay in 32 bits
    for up to 2^28 distinct terms a text.
    """
    n = F.size("__w")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    split = texts.select(*keys, words(F.col(text_col)).alias("__w"))
    terms = split.select(*keys, F.explode_outer(F.array_distinct(F.transform(starts, lambda i: _term(F.col("__w"), i, shingle)))).alias("__t"))
    weight = F.coalesce(F.col("__t").bitwiseAND(F.lit(7)) + 1, F.lit(0).cast("bigint"))
    hashed = terms.select(*keys, weight.alias("__n"), *[F.xxhash64(F.lit(s), "__t").alias(f"__h{s}") for s in SEEDS])
    votes = [F.sum(F.shiftrightunsigned(f"__h{s}", i).bitwiseAND(F.lit(LANES)) * F.col("__n")).alias(f"__v{s}_{i}") for s in SEEDS for i in range(32)]
    v = hashed.groupBy(*keys).agg(F.sum("__n").alias("__n"), *votes)

    def bits(s: int) -> Column:
        low = [F.when(F.col(f"__v{s}_{i}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("__n"), F.lit(1 << i)).otherwise(F.lit(0).cast("bigint")) for i in range(32)]
        high = [F.when(F.shiftrightunsigned(f"__v{s}_{i}", 32) * 2 > F.col("__n"), F.lit((1 << (i + 32)) - ((i == 31) << 64))).otherwise(F.lit(0).cast("bigint")) for i in range(32)]
        return reduce(lambda a, b: a.bitwiseOR(b), low + high)

    return v.select(*keys, F.array(*[bits(s) for s in SEEDS]).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(len(SEEDS))])


def likeness(a: Column, b: Column) -> Column:
    """The cosine of the terms' weights that the share of differing bits stands for, at least 0."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(math.pi / BITS)))


def to_hex(fp: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(fp[i]), 16, "0") for i in range(len(SEEDS))]))


def _blocks(fp: Column, n: int) -> list[Column]:
    """The fingerprint cut into n blocks of nearly equal width, each a long."""
    per = n // len(SEEDS)
    out = []
    for i in range(len(SEEDS)):
        edges = [64 * k // per for k in range(per + 1)]
        out += [F.shiftrightunsigned(fp[i], lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return out


def near_fingerprints(queries: DataFrame, table: DataFrame, radius: int = 3, n_blocks: int = 6) -> DataFrame:
    """``query, fp, distance``: the distinct fingerprints of ``table`` within ``radius`` bits of each query's.

    Both take a column ``fp``; ``queries`` also ``query``. Of ``n_blocks`` blocks, ``radius`` differing bits leave
    ``n_blocks - radius`` untouched: one table for each choice of these, keyed by their bits put first. Fingerprints
    that occur often count once. With 6 blocks a key has 64 of the 128 bits, so chance meetings stay few at any size.
    Queries grow with the table, so neither side is broadcast.
    """
    if not 0 <= radius < n_blocks:
        raise ValueError("radius must be under n_blocks")
    choices = list(combinations(range(n_blocks), n_blocks - radius))

    def keyed(df: DataFrame, fp: str) -> DataFrame:
        b = _blocks(F.col(fp), n_blocks)
        keys = F.array(*[F.xxhash64(F.lit(t), *[b[k] for k in c]) for t, c in enumerate(choices)])
        return df.withColumn("__key", F.explode(keys))

    q = keyed(queries.select("query", F.col("fp").alias("__q")), "__q")
    t = keyed(table.select("fp").where(F.col("fp").isNotNull()).distinct(), "fp")
    met = sized(q).join(sized(t), "__key").withColumn("distance", distance(F.col("__q"), F.col("fp"))).where(F.col("distance") <= radius)
    return met.select("query", "fp", "distance").distinct()


def _boundaries(keys: DataFrame, rows: int) -> list[tuple[int, int]]:
    """The smallest (id, text hash) of each of some ranges of about ``rows`` rows; 65,536 ranges at most."""
    parts = max(1, min(65_536, math.ceil(keys.count() / rows)))
    firsts = keys.repartitionByRange(parts, "__o", "__h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("__o", "__h")).alias("lo")).collect()
    return sorted((r["lo"]["__o"], r["lo"]["__h"]) for r in firsts if r["lo"] is not None)


def _range_of(o: Column, h: Column, los: Column, his: Column, n: int) -> Column:
    """The index of the last of the n pairs of ``los`` and ``his`` that is not above (o, h), by binary search."""
    steps = [1 << k for k in reversed(range(max(1, (n - 1).bit_length())))]

    def step(at: Column, k: Column) -> Column:
        x, y = F.get(los, at + k), F.get(his, at + k)
        return F.when((at + k < n) & ((x < o) | ((x == o) & (y <= h))), at + k).otherwise(at)

    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), step)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id, __text`` (null: empty), and what they are sorted by: the id, null before all, then the text's hash."""
    d = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return d.withColumn("__o", F.coalesce(F.col("__id").cast("bigint"), F.lit(-(2**63)))).withColumn("__h", F.xxhash64("__text"))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows: int = 2_000) -> DataFrame:
    """``__r, __guest, __o, __h, __id, __text, __next``: each text and that of the next id, ascending; after the last, the first's.

    Rows are cut into ranges of id and text hash, so that many rows of one id, or of none, are many ranges; each range's
    first row also goes to the range before it, as a guest, so a window over one range sees the next row of all its own.
    The text is shuffled once. Null ids come first; rows that repeat an id: by text hash; id and text: one row.
    """
    d = _keys(docs, id_col, text_col)
    lows = _boundaries(d.select("__o", "__h"), rows)
    if not lows:
        return d.select(F.lit(0).alias("__r"), F.lit(False).alias("__guest"), "__o", "__h", "__id", "__text", F.lit("").alias("__next"))
    los, his = F.lit([x for x, _ in lows]), F.lit([y for _, y in lows])
    d = d.withColumn("__r", _range_of(F.col("__o"), F.col("__h"), los, his, len(lows)))
    first = (F.get(los, F.col("__r")) == F.col("__o")) & (F.get(his, F.col("__r")) == F.col("__h"))
    own = F.struct(F.col("__r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("__r") - 1, F.lit(len(lows))).alias("r"), F.lit(True).alias("guest"))
    d = d.withColumn("__at", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    d = d.select("__id", "__text", "__o", "__h", F.col("__at.r").alias("__r"), F.col("__at.guest").alias("__guest"))
    w = Window.partitionBy("__r").orderBy("__guest", "__o", "__h")
    again = (F.lag("__guest").over(w) == F.col("__guest")) & (F.lag("__o").over(w) == F.col("__o")) & (F.lag("__h").over(w) == F.col("__h"))
    d = d.withColumn("__again", F.coalesce(again, F.lit(False))).where(~F.col("__again")).drop("__again")
    return d.withColumn("__next", F.lead("__text").over(w)).select("__r", "__guest", "__o", "__h", "__id", "__text", "__next")


def document_fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: its last quarter replaced by the start of the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (hex), ``near_edited``, ``near_next``:
    the likeness of the text's fingerprint to that of the edited text and of the next text.

    Null text: empty. Rows that repeat id and text: one row. Null ids come first. Empty table: no rows. Equal texts have
    equal fingerprints. A very long text is a run of rows like any other: votes are summed before they are shuffled.
    """
    t = with_next(docs, id_col, text_col)
    n = F.char_length("__text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("__text"), F.lit(1), n - cut), F.substr(F.col("__next"), F.lit(1), cut))
    one = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("t"))
    t = t.withColumn("__edited", edited).select(
        "__r",
        "__guest",
        "__o",
        "__h",
        "__id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.when(F.col("__guest"), F.array(one(0, "__text"))).otherwise(F.array(one(0, "__text"), one(1, "__edited")))).alias("__v"),
    )
    # rows lie by range of ids already; with the range among the keys, votes are summed where they are and not shuffled
    keys = ["__r", "__guest", "__o", "__h", "__id", "n_chars", "edited_sha256"]
    fps = simhash(t.select(*keys, F.col("__v.k").alias("__k"), F.col("__v.t").alias("__t")), [*keys, "__k"], "__t", shingle)
    wide = fps.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("fp"))).alias(f"__f{k}") for k in range(2)])
    wide = wide.withColumn("__f2", F.lead("__f0").over(Window.partitionBy("__r").orderBy("__guest", "__o", "__h"))).where(~F.col("__guest"))
    f = [F.col(f"__f{k}") for k in range(3)]
    return wide.select(
        F.col("__id").alias(id_col), "n_chars", "edited_sha256", to_hex(f[0]).alias("fingerprint"), to_hex(f[1]).alias("edited_fingerprint"), likeness(f[0], f[1]).alias("near_edited"), likeness(f[0], f[2]).alias("near_next")
    )


def near_documents(fps: DataFrame, queries: DataFrame, radius: int = 3, id_col: str = "doc_id", fp_col: str = "fingerprint") -> DataFrame:
    """``query, n_near``: how many rows of ``fps`` other than itself have a fingerprint within ``radius`` bits of a row's.

    ``queries`` are rows of ``fps`` (``id_col``, ``fp_col`` in hex). Rows of one fingerprint are counted before they
    meet anything, so copies weigh but do not multiply.
    """
    parts = lambda c: F.array(*[F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(len(SEEDS))])
    counted = fps.groupBy(F.col(fp_col).alias("__hex")).agg(F.count("*").alias("__n")).withColumn("fp", parts(F.col("__hex")))
    met = near_fingerprints(queries.select(F.col(id_col).alias("query"), parts(F.col(fp_col)).alias("fp")), counted, radius)
    return sized(met).join(sized(counted.select(F.col("fp").alias("__fp"), "__n")), F.col("fp") == F.col("__fp")).groupBy("query").agg((F.sum("__n") - 1).alias("n_near"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """``n_near`` is told of every document whose id is divisible by 50, against all documents; null for the others."""
    fps = materialize(document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    near = near_documents(fps, fps.where("doc_id % 50 = 0"))
    return fps.join(sized(near), F.col("doc_id") == F.col("query"), "left").drop("query")
