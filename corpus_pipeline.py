"""A training corpus from raw documents: five stages, each one operator of ``spindrift.llm`` over all rows.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import materialize
from spindrift.llm.langid import UNKNOWN, identify, learn_profiles
from spindrift.llm.line_dedup import line_dedup
from spindrift.llm.mixing import mix_sources, mixed_documents
from spindrift.llm.pieces import piece_encode
from spindrift.llm.simhash_dedup import simhash_dedup

#: Texts whose n-grams are less near than this to the nearest profile are in none of the languages.
LEAST_NEARNESS = 0.2


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those near no language's profile; the others stay as they are."""
    told = identify(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), learn_profiles(docs))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_NEARNESS)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*docs.columns)


def drop_shared_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share."""
    return _recounted(line_dedup(docs).select(*docs.columns))


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, null last; of one id, the smallest text hash.

    Null and empty texts are near copies of each other. Of rows that repeat id and text one stays.
    """
    key = lambda h: [F.coalesce("doc_id", F.lit(0)).alias("__i"), F.xxhash64(h, F.col("doc_id").isNull()).alias("__h")]
    by = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    kept = simhash_dedup(docs).groupBy("group").agg(F.min_by(F.struct(*key("text_hash")), by).alias("k")).select("k.*")
    # texts are dealt out once: the join and what it leaves of repeated rows have the same keys
    keyed = docs.select("*", *key(F.xxhash64("text")))
    return keyed.join(kept, ["__i", "__h"], "left_semi").dropDuplicates(["__i", "__h"]).select(*docs.columns)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass over its source.

    Null sources are one source, the last; null and empty texts have no words and go; rows without an id stay rows.
    """
    return _recounted(mixed_documents(docs, mix_sources(docs)))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with merge-dropout that is drawn anew in each of a document's passes.

    Null texts: no ids. Rows that repeat id and text are passes like others. Null ids are told apart by their texts.
    """
    same = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
    return piece_encode(docs.withColumn("__pass", F.row_number().over(same)), pass_col="__pass")


STAGES = [("language_id", language_id), ("line_dedup", drop_shared_lines), ("simhash_dedup", drop_near_copies), ("mix_sources", mix), ("sentencepiece", encode)]

#: Language ID, fingerprints and piece merging are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
