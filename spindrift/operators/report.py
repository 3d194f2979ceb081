"""The relations of a report, by sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEQ, with_seq

# fixed values: the sheets and the column order of the role-filter report
SHEETS = ["All Contacts", "Law School Contacts", "Paralegal Program Contacts", "High Confidence", "Medium Confidence", "Needs Review", "Statistics Summary", "Scraping Log"]
ROLE_COLUMNS = [
    "Organization Type", "Organization Name", "State", "First Name", "Last Name", "Title / Role", "Email Address", "Target Role", "Match Score",
    "Match Type", "Match Explanation", "Priority Score", "Priority Tier", "Notes", "Owner", "Contact Source", "Follow-Up Status",
]


def views(df: DataFrame) -> dict[str, DataFrame]:
    """The filtered sheets: by program and by confidence."""
    s = F.col("confidence_score")
    return {
        "All Contacts": df,
        "Law School Contacts": df.where(F.col("program_type") == "Law School"),
        "Paralegal Program Contacts": df.where(F.col("program_type") == "Paralegal Program"),
        "High Confidence": df.where(s >= 75),
        "Medium Confidence": df.where((s >= 50) & (s < 75)),
        "Needs Review": df.where(s < 50),
    }


def view_sizes(df: DataFrame) -> DataFrame:
    """``sheet, n`` of the filtered sheets, in one pass."""
    s, p = F.col("confidence_score"), F.col("program_type")
    tests = dict(zip(SHEETS, [F.lit(True), p == "Law School", p == "Paralegal Program", s >= 75, (s >= 50) & (s < 75), s < 50], strict=False))
    a = df.agg(*[F.count(F.when(t, 1)).alias(k) for k, t in tests.items()])
    return a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("sheet"), F.col(f"`{k}`").alias("n")) for k in tests])).alias("r")).select("r.sheet", "r.n")


def scraping_log(contacts: DataFrame, targets: DataFrame) -> DataFrame:
    """An institution a row: its first contact's values and their number, or a failed target. Sorted by name."""
    c = with_seq(contacts)
    first = lambda col: F.min_by(col, SEQ).alias(col)
    ok = c.where("institution_name IS NOT NULL").groupBy("institution_name").agg(*[first(x) for x in ("state", "program_type", "institution_url", "extracted_at")], F.count("*").alias("contacts_found"))
    ok = ok.withColumn("status", F.lit("Success"))
    done = c.select(F.col("institution_name").alias("__n")).distinct()
    t = with_seq(targets)
    failed = t.join(done, F.col("name") == F.col("__n"), "left_anti").groupBy(F.col("name").alias("institution_name")).agg(F.min_by("state", SEQ).alias("state"), F.min_by("type", SEQ).alias("program_type"), F.min_by("url", SEQ).alias("institution_url"))
    failed = failed.withColumn("extracted_at", F.lit("N/A")).withColumn("contacts_found", F.lit(0).cast("bigint")).withColumn("status", F.lit("Failed"))
    return ok.unionByName(failed).orderBy("institution_name", "status")


def statistics_rows(stats: dict[str, DataFrame]) -> DataFrame:
    """``section, metric, value``: every statistic as text, section by section."""
    out = None
    for section, df in stats.items():
        if section == "input":
            continue
        cols = df.columns
        if cols[:1] and df.schema[0].dataType.simpleString() == "string":
            rows = df.select(F.lit(section).alias("section"), F.col(cols[0]).alias("metric"), F.concat_ws(", ", *[F.col(c).cast("string") for c in cols[1:]]).alias("value"))
        else:
            rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r")).select(F.lit(section).alias("section"), "r.metric", "r.value")
        out = rows if out is None else out.unionByName(rows)
    return out


def role_view(df: DataFrame, role: str | None = None) -> DataFrame:
    out = df if role is None else df.where(F.col("Target Role") == role)
    return out.orderBy(F.col("Target Role").asc_nulls_last(), F.col("Match Score").desc_nulls_last())


def in_column_order(df: DataFrame, order: list[str] = ROLE_COLUMNS) -> DataFrame:
    """The columns of ``order`` that there are, then the others."""
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns], *[F.col(f"`{c}`") for c in df.columns if c not in order])


def column_widths(df: DataFrame, most: int = 50) -> DataFrame:
    """``column, width``: the longest value or name and two more, at most ``most``."""
    a = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.coalesce(F.col(f"`{c}`"), F.lit(0)), F.lit(len(c))) + 2, F.lit(most)).alias("width")) for c in df.columns]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.column", "r.width")


def workbook(contacts: DataFrame, stats: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """All eight sheets by name."""
    return views(contacts) | {"Statistics Summary": statistics_rows(stats), "Scraping Log": scraping_log(contacts, targets)}


def role_workbook(matched: DataFrame, law_roles: list[str]) -> dict[str, DataFrame]:
    """The role-filter report: all, by program, the first three law roles (names cut to 25 characters), and counts."""
    p = F.col("program_type")
    out = {"All Matched Contacts": role_view(matched), "Law Schools": role_view(matched.where(p == "Law School")), "Paralegal Programs": role_view(matched.where(p != "Law School"))}
    out |= {r[:25]: role_view(matched, r) for r in law_roles[:3]}
    out["Statistics"] = matched.groupBy("Target Role", "program_type").agg(F.count("*").alias("contacts"), F.round(F.avg("Match Score"), 1).alias("avg_score")).orderBy("program_type", "Target Role")
    return out
