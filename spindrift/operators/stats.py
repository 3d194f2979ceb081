"""Breakdowns and summaries of contacts: conditional aggregations that pass the input once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import confidence_level
from .common import SEQ, has, pct, value_counts, with_seq


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def state_breakdown(df: DataFrame) -> DataFrame:
    return value_counts(df, "state") if has(df, "state") else _none(df, "value string, n bigint")


def program_breakdown(df: DataFrame) -> DataFrame:
    """``program_type, n, pct`` of all rows, those without a type included in the whole."""
    if not has(df, "program_type"):
        return _none(df, "program_type string, n bigint, pct double")
    per = df.groupBy("program_type").agg(F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("__all"))  # one row
    return per.crossJoin(F.broadcast(whole)).where("program_type IS NOT NULL").select("program_type", "n", pct(F.col("n"), F.col("__all")).alias("pct"))


def email_quality(df: DataFrame, blank_counts: bool = True) -> DataFrame:
    """One row of coverage and status counts; shares of statuses are of the rows with an e-mail.

    ``blank_counts``: an empty e-mail counts as one, as it does in the reference mode.
    """
    with_email = F.col("email").isNotNull() if blank_counts else F.col("email").isNotNull() & (F.col("email") != "")
    n = lambda c: F.count(F.when(c, 1))
    status = F.col("email_status") if has(df, "email_status") else F.lit(None).cast("string")
    a = df.agg(
        F.count("*").alias("total"),
        n(with_email).alias("with_email"),
        n(status == "valid").alias("valid"),
        n(status == "catch-all").alias("catch_all"),
        n(status == "invalid").alias("invalid"),
        n(status == "unknown").alias("unknown"),
    )
    return a.select(
        "total", "with_email", pct(F.col("with_email"), F.col("total")).alias("coverage_pct"), (F.col("valid") + F.col("invalid") + F.col("catch_all")).alias("validated"),
        *[x for k in ("valid", "catch_all", "invalid", "unknown") for x in (F.col(k), pct(F.col(k), F.col("with_email")).alias(f"{k}_pct"))],
    )


def service_usage(df: DataFrame) -> DataFrame:
    return value_counts(df.where("email_validation_service <> 'none'"), "email_validation_service")


def source_usage(df: DataFrame) -> DataFrame:
    return value_counts(df, "email_source")


def confidence_distribution(df: DataFrame) -> DataFrame:
    """One row: counts and shares of the three levels, mean, median cut to an integer, least and most.

    Rows without a score are in no level but in the whole.
    """
    s = F.col("confidence_score")
    n = lambda level: F.count(F.when(s.isNotNull() & (confidence_level(s) == level), 1))
    a = df.agg(
        F.count("*").alias("total"), n("high").alias("high"), n("medium").alias("medium"), n("low").alias("low"), F.round(F.avg(s), 1).alias("avg_score"),
        F.median(s).cast("int").alias("median_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"),
    )
    return a.select("*", *[pct(F.col(k), F.col("total")).alias(f"{k}_pct") for k in ("high", "medium", "low")])


def top_roles(df: DataFrame, n: int = 10) -> DataFrame:
    """``role, n``: the most frequent matched roles (titles, where there is no such column); ties: first seen."""
    col = "matched_role" if has(df, "matched_role") else "title"
    per = with_seq(df).where(F.col(col).isNotNull()).groupBy(F.col(col).alias("role")).agg(F.count("*").alias("n"), F.min(SEQ).alias("__first"))
    return per.orderBy(F.desc("n"), "__first").limit(n).drop("__first")


def success_rate(df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row: institutions attempted, successful, failed, the rate, contacts each, and institutions by their number."""
    per = df.where("institution_name IS NOT NULL").groupBy("institution_name").agg(F.count("*").alias("n"))
    n = lambda c: F.count(F.when(c, 1))
    a = per.agg(
        F.count("*").alias("successful"), F.round(F.avg("n"), 1).alias("avg_contacts"), n(F.col("n") <= 2).alias("n_1_2"),
        n(F.col("n").between(3, 5)).alias("n_3_5"), n(F.col("n").between(6, 10)).alias("n_6_10"), n(F.col("n") >= 11).alias("n_11_up"),
    )
    tried = F.nullif(F.col("__targets"), F.lit(0)) if targets is not None else F.lit(None)
    if targets is not None:
        a = a.crossJoin(F.broadcast(targets.agg(F.count("*").alias("__targets"))))  # one row each
    a = a.withColumn("attempted", F.coalesce(tried, F.col("successful")))
    return a.select("attempted", "successful", (F.col("attempted") - F.col("successful")).alias("failed"), pct(F.col("successful"), F.col("attempted")).alias("rate_pct"), F.coalesce("avg_contacts", F.lit(0.0)).alias("avg_contacts"), "n_1_2", "n_3_5", "n_6_10", "n_11_up")


def summary(df: DataFrame) -> DataFrame:
    a = df.agg(F.count("*").alias("contacts"), F.count_distinct("institution_name").alias("institutions"))
    return a.select("contacts", "institutions", F.when(F.col("institutions") > 0, F.round(F.col("contacts") / F.col("institutions"), 1)).otherwise(0.0).alias("per_institution"))


def console_quality(df: DataFrame) -> DataFrame:
    """Coverage by the other rule, under which only '' is missing, and the levels' shares."""
    n = lambda c: F.count(F.when(c, 1))
    s = F.col("confidence_score")
    a = df.agg(F.count("*").alias("total"), n(F.col("email").isNull() | (F.col("email") != "")).alias("with_email"), n(s >= 75).alias("high"), n((s >= 50) & (s < 75)).alias("medium"), n(s < 50).alias("low"))
    return a.select("*", *[pct(F.col(k), F.col("total")).alias(f"{k}_pct") for k in ("with_email", "high", "medium", "low")])


def role_by_program(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """``role, program_type, n`` for every role of the catalog, zeros included."""
    per = df.where("matched_role IS NOT NULL").groupBy(F.col("matched_role").alias("__r"), F.col("program_type").alias("__p")).agg(F.count("*").alias("__n"))
    return catalog.join(per, (F.col("role") == F.col("__r")) & (F.col("program_type") == F.col("__p")), "left").select("role", "program_type", F.coalesce("__n", F.lit(0)).alias("n"))


def tier_counts(df: DataFrame, tier_col: str = "tier") -> DataFrame:
    per = df.groupBy(F.col(tier_col).alias("tier")).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("n").alias("__all")))).select("tier", "n", pct(F.col("n"), F.col("__all")).alias("pct"))


def run_metrics(df: DataFrame, seconds: float) -> DataFrame:
    """Throughput of a run that took so many seconds: contacts and institutions an hour, contacts each."""
    a = summary(df)
    return a.select("*", F.round(F.col("contacts") * 3600.0 / seconds, 1).alias("contacts_per_hour"), F.round(F.col("institutions") * 3600.0 / seconds, 1).alias("institutions_per_hour"))


def contact_statistics(df: DataFrame, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """All of the above over one cached input; the caller unpersists ``input``."""
    df = df.persist()
    out = {"input": df, "summary": summary(df), "states": state_breakdown(df), "programs": program_breakdown(df), "email_quality": email_quality(df), "confidence": confidence_distribution(df), "roles": top_roles(df), "success": success_rate(df, targets)}
    if has(df, "email_validation_service"):
        out["services"] = service_usage(df)
    if has(df, "email_source"):
        out["sources"] = source_usage(df)
    return out
