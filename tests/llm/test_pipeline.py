"""The pipeline against its operators run by hand, and its queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from spindrift.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = spark.createDataFrame([(9000, None, None, None, 0), (9001, "123 456", "en", "src0", 7), (9002, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(extra)
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [d.columns for d in stages[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert stages[-1].columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]


def test_language_stage_drops_what_has_no_letters(stages):
    ids = {r.doc_id for r in stages[0].select("doc_id").collect()}
    assert ids.isdisjoint({9000, 9001, 9002}) and len(ids) == 200


def test_line_stage_is_line_dedup(spark, stages):
    from spindrift.llm.line_dedup import line_dedup

    want = {(r.doc_id, r.text) for r in line_dedup(stages[0]).collect()}
    assert {(r.doc_id, r.text) for r in stages[1].collect()} == want
    assert stages[1].where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_near_copy_stage_keeps_one_of_each_group(stages):
    from spindrift.llm.simhash_dedup import simhash_dedup

    keep = {r.component_id for r in simhash_dedup(stages[1]).collect()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(keep)


def test_mix_and_encode(stages):
    assert stages[4].count() == stages[3].count()
    texts = sorted(r.h for r in stages[3].select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).collect())
    assert texts == sorted(r.decoded_sha256 for r in stages[4].collect())


def test_run_is_the_stages(spark):
    n = cp.run(spark, SF).count()
    assert n > 0 and cp.run(spark, SF).count() == n


def test_queries_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = sorted(map(tuple, queries.queries()[name](spark, SF).collect()))
        assert got == sorted(con.execute(sql).fetchall()), name


def test_near_copy_stage_edges(spark):
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "A B C D", "en", "s", 7), (None, "x y z", "en", "s", 5)]
    rows += [(None, "x y z", "en", "s", 5), (1, "of the same id, another text", "en", "s", 28), (None, "A b c D", "en", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((str(r.doc_id), r.text) for r in cp.drop_near_copies(spark, df, SF).collect()) == [("1", "a b c d"), ("1", "of the same id, another text"), ("None", "x y z")]
    for name, stage in cp.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0, name
