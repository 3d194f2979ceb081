"""Line dedup, native: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, strip_ws


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z in lower case."""
    return ascii_lower(strip_ws(line))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops lines that many documents share, everywhere but in the largest id that holds them.

    A key (``line_key``) of ``min_chars`` code points or more that ``min_docs`` different ids hold loses all its lines,
    except those in the largest of these ids. Returns the columns of ``docs`` with ``text_col`` rebuilt from the lines
    that stay, and ``n_lines``, ``n_dropped`` (bigint), which replace columns of those names.

    Null or empty text: one empty line, text ``''``. Null ids: not counted as holders, nothing dropped. Rows that
    repeat an id count as one holder; each keeps its own text. Empty table: empty result.

    Keys travel as two independent 64-bit hashes, so shuffles carry 40 bytes a line, never its text; the text itself
    moves once, to meet the positions it loses. A hot key is counted by (key, id) first and its join is split by AQE.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    held = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), text_hash.alias("__th"), F.posexplode(lines).alias("__pos", "__line"))
        .withColumn("__key", line_key(F.col("__line")))
        .where(F.char_length("__key") >= min_chars)
        .select("__id", "__th", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), F.col("__key")).alias("__h2"))
    )
    common = (
        held.groupBy("__h1", "__h2")
        .agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__holder"))
        .where(F.col("__n") >= min_docs)
        .drop("__n")
    )
    # written, so that the join below meets a table of known size: broadcast if small, else both sides are shuffled and
    # AQE can split what a hot line sends to one partition
    common = materialize(common, "common-lines")
    lost = (
        held.join(common, ["__h1", "__h2"])
        .where(F.col("__id") != F.col("__holder"))
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__lost"))
    )
    joined = docs.join(lost, (F.col(id_col) == F.col("__id")) & (text_hash == F.col("__th")), "left")
    none = F.array().cast("array<int>")
    # a one-element array binds the split lines and the kept positions once, so each position is looked up in O(1)
    bound = F.array(F.struct(lines.alias("ls"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lost")).alias("at")))
    rebuilt = F.array_join(F.element_at(F.transform(bound, lambda s: F.transform(s["at"], lambda i: s["ls"][i])), 1), "\n")
    lost_n = F.coalesce(F.size(F.coalesce(F.col("__lost"), none)), F.lit(0))
    out = joined.select(
        *[F.when(lost_n > 0, rebuilt).otherwise(F.coalesce(F.col(text_col), F.lit(""))).alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(lines).cast("bigint").alias("n_lines"),
        lost_n.cast("bigint").alias("n_dropped"),
    )
    return out


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.holder <> k.doc_id AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
