"""The whole run, from pages to a report, as one composition of lazy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import extract_domain
from ..operators import dedup, enrich, pages, records, report, roles, stats
from ..operators.common import with_seq


def run(spark: SparkSession, page_table: DataFrame, targets: DataFrame, existing: DataFrame | None = None, validations: DataFrame | None = None, now: str = "") -> dict[str, DataFrame]:
    """The sheets of the report, and ``classes``: what is new, a duplicate or an update against ``existing``.

    ``targets``: ``url, name, state, type``. Pages belong to the target of their host.
    """
    found = pages.follow(page_table, targets).withColumn("__d", extract_domain(F.col("url")))
    t = targets.select(extract_domain(F.col("url")).alias("__td"), F.col("name").alias("institution_name"), F.col("url").alias("institution_url"), "state", F.col("type").alias("program_type"))
    contacts = found.join(t, F.col("__d") == F.col("__td")).drop("__d", "__td")
    contacts = with_seq(records.contact_records(contacts, roles.catalog(spark), now))
    contacts = dedup.deduplicate_contacts(enrich.enrich_contacts(contacts, validations))
    out = report.views(contacts)
    out["Statistics Summary"] = report.statistics_rows(stats.contact_statistics(contacts, targets))
    out["Scraping Log"] = report.scraping_log(contacts, targets)
    if existing is not None:
        out["classes"] = dedup.compare_with_existing(contacts, existing)
    return out
