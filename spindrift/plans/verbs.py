"""Queries of the plain verbs over rows, each as operators here use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import common
from .registry import query
from .views import view


def contacts(spark, d) -> DataFrame:
    return view(spark, d, "contacts")


def targets(spark, d) -> DataFrame:
    return view(spark, d, "targets")


@query("V1_filter", "SELECT _seq FROM contacts WHERE confidence_score >= 50 AND matched_role IS NOT NULL AND email <> ''")
def keep_where(spark, d) -> DataFrame:
    return contacts(spark, d).where((F.col("confidence_score") >= 50) & F.col("matched_role").isNotNull() & (F.col("email") != "")).select("_seq")


@query("V2_semi", "SELECT _seq, institution_name FROM contacts WHERE institution_name IN (SELECT name FROM targets)")
def semi(spark, d) -> DataFrame:
    t = targets(spark, d).select("name").distinct()
    return contacts(spark, d).join(t, F.col("institution_name") == F.col("name"), "left_semi").select("_seq", "institution_name")


@query("V3_anti", "SELECT _seq, institution_name FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.name = c.institution_name)")
def anti(spark, d) -> DataFrame:
    t = targets(spark, d).select("name").distinct()
    return contacts(spark, d).join(t, F.col("institution_name") == F.col("name"), "left_anti").select("_seq", "institution_name")


@query("V5_top_values", "SELECT title AS value, count(*) AS n FROM contacts WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 7")
def top_values(spark, d) -> DataFrame:
    return common.value_counts(contacts(spark, d), "title", 7)


@query("V6_first_and_size", "SELECT institution_name, arg_min(title, _seq) AS first_title, count(*) AS n FROM contacts GROUP BY 1")
def first_and_size(spark, d) -> DataFrame:
    return contacts(spark, d).groupBy("institution_name").agg(F.min_by("title", "_seq").alias("first_title"), F.count("*").alias("n"))


@query("V7_distinct_counts", "SELECT state, count(DISTINCT institution_name) AS institutions, count(DISTINCT matched_role) AS roles FROM contacts GROUP BY 1")
def distinct_counts(spark, d) -> DataFrame:
    return contacts(spark, d).groupBy("state").agg(F.count_distinct("institution_name").alias("institutions"), F.count_distinct("matched_role").alias("roles"))


@query("V8_moments", "SELECT state, round(avg(confidence_score), 6) AS mean, median(confidence_score) AS median, min(confidence_score) AS least, max(confidence_score) AS most FROM contacts GROUP BY 1")
def moments(spark, d) -> DataFrame:
    s = "confidence_score"
    return contacts(spark, d).groupBy("state").agg(F.round(F.avg(s), 6).alias("mean"), F.median(s).alias("median"), F.min(s).alias("least"), F.max(s).alias("most"))


@query("V10_sort", "SELECT _seq, row_number() OVER (PARTITION BY state ORDER BY program_type, confidence_score DESC, _seq) AS place FROM contacts")
def sort(spark, d) -> DataFrame:
    """The place of each row of a state in a sort with ascending and descending keys."""
    from pyspark.sql import Window

    w = Window.partitionBy("state").orderBy("program_type", F.desc("confidence_score"), "_seq")
    return contacts(spark, d).select("_seq", F.row_number().over(w).cast("bigint").alias("place"))


@query("V11_head", "SELECT _seq, full_name FROM contacts ORDER BY _seq LIMIT 20")
def head(spark, d) -> DataFrame:
    return contacts(spark, d).orderBy("_seq").limit(20).select("_seq", "full_name")


@query("V12_concat", "SELECT _seq, state, email, NULL AS url FROM contacts UNION ALL SELECT _seq, state, NULL, url FROM targets")
def concat(spark, d) -> DataFrame:
    return contacts(spark, d).select("_seq", "state", "email").unionByName(targets(spark, d).select("_seq", "url", "state"), allowMissingColumns=True)


STATUS_NOTE = {"valid": "ok", "catch-all": "perhaps", "invalid": "no"}


@query("V13_map", "SELECT _seq, coalesce(CASE email_status WHEN 'valid' THEN 'ok' WHEN 'catch-all' THEN 'perhaps' WHEN 'invalid' THEN 'no' END, 'unknown') AS note FROM contacts")
def map_values(spark, d) -> DataFrame:
    table = spark.createDataFrame(list(STATUS_NOTE.items()), "k string, note string")  # a few constants
    c = contacts(spark, d).join(F.broadcast(table), F.col("email_status") == F.col("k"), "left")
    return c.select("_seq", F.coalesce("note", F.lit("unknown")).alias("note"))


@query("V14_apply", "SELECT _seq, CASE WHEN email IS NULL OR email = '' THEN full_name || ' / ' || institution_name ELSE lower(email) END AS label FROM contacts")
def apply(spark, d) -> DataFrame:
    label = F.when(F.coalesce(F.col("email"), F.lit("")) == "", F.concat("full_name", F.lit(" / "), "institution_name")).otherwise(F.lower("email"))
    return contacts(spark, d).select("_seq", label.alias("label"))


@query("V15_difference", "SELECT DISTINCT institution_name AS name FROM contacts EXCEPT SELECT name FROM targets")
def difference(spark, d) -> DataFrame:
    return contacts(spark, d).select(F.col("institution_name").alias("name")).subtract(targets(spark, d).select("name"))


@query("V16_columns", "SELECT state, _seq, coalesce(matched_role, '') AS role, 'US' AS country FROM contacts")
def columns(spark, d) -> DataFrame:
    return contacts(spark, d).withColumn("country", F.lit("US")).fillna({"matched_role": ""}).withColumnRenamed("matched_role", "role").select("state", "_seq", "role", "country")


@query("V17_number", "SELECT _seq, row_number() OVER (ORDER BY state, institution_name, _seq) AS id FROM contacts")
def number(spark, d) -> DataFrame:
    return common.numbered(contacts(spark, d), ["state", "institution_name", "_seq"], "id").select("_seq", "id")


@query("V18_case_blind", "SELECT _seq FROM contacts WHERE lower(program_type) = 'law school' OR coalesce(contains(lower(matched_role), 'role 1'), false)")
def case_blind(spark, d) -> DataFrame:
    has = F.coalesce(F.contains(F.lower("matched_role"), F.lit("role 1")), F.lit(False))
    return contacts(spark, d).where((F.lower("program_type") == "law school") | has).select("_seq")


@query("V19_update", "SELECT _seq, CASE WHEN phone IS NULL THEN 'missing' ELSE phone END AS phone, CAST(CASE WHEN phone IS NULL THEN greatest(0, confidence_score - 10) ELSE confidence_score END AS INT) AS confidence_score FROM contacts")
def update(spark, d) -> DataFrame:
    due = F.col("phone").isNull()
    return contacts(spark, d).select("_seq", F.when(due, "missing").otherwise(F.col("phone")).alias("phone"), F.when(due, F.greatest(F.lit(0), F.col("confidence_score") - 10)).otherwise(F.col("confidence_score")).alias("confidence_score"))
