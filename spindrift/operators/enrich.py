"""Enrichment of contacts from a table of e-mail validations, and e-mail patterns of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import enriched_confidence
from .common import first_per_key, pct, with_seq


def validate_emails(emails: DataFrame, validations: DataFrame) -> DataFrame:
    """One row a row of ``emails`` that is not null or empty; those never validated are unknown, 40."""
    known = first_per_key(with_seq(validations), [F.col("email")]).select(F.col("email").alias("__e"), "status", "score", "is_catchall", "is_disposable", "service")
    joined = emails.where("email IS NOT NULL AND email <> ''").join(known, F.col("email") == F.col("__e"), "left")
    return joined.select(
        *emails.columns,
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("score", F.lit(40)).alias("score"),
        F.coalesce("is_catchall", F.lit(False)).alias("is_catchall"),
        F.coalesce("is_disposable", F.lit(False)).alias("is_disposable"),
        F.coalesce("service", F.lit("none")).alias("service"),
    )


def _told(df: DataFrame, status: Column, score: Column, catch_all: Column, disposable: Column, service: Column) -> DataFrame:
    new = {"email_status": status, "email_score": score.cast("int"), "email_is_catchall": catch_all, "email_is_disposable": disposable, "email_validation_service": service}
    return df.select(*[c for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def enrich_contacts(contacts: DataFrame, validations: DataFrame | None = None) -> DataFrame:
    """Contacts with the status of their e-mail and a rescored confidence; without validations nothing is rescored.

    An empty e-mail has none; a null one, or one that the table lacks, is unknown.
    """
    if validations is None:
        return _told(contacts, F.lit("not_validated"), F.lit(0), F.lit(False), F.lit(False), F.lit("none"))
    known = first_per_key(with_seq(validations), [F.col("email")]).select(F.col("email").alias("__e"), *[F.col(c).alias(f"__{c}") for c in ("status", "score", "is_catchall", "is_disposable", "service")])
    j = contacts.join(known, F.col("email") == F.col("__e"), "left")
    blank = F.coalesce(F.col("email") == "", F.lit(False))
    out = _told(
        j,
        F.when(blank, "no_email").otherwise(F.coalesce("__status", F.lit("unknown"))),
        F.when(blank, 0).otherwise(F.coalesce("__score", F.lit(0))),
        ~blank & F.coalesce("__is_catchall", F.lit(False)),
        ~blank & F.coalesce("__is_disposable", F.lit(False)),
        F.when(blank, "none").otherwise(F.coalesce("__service", F.lit("none"))),
    )
    out = out.withColumn("confidence_score", enriched_confidence(F.col("confidence_score"), F.col("email_status")))
    return out.drop("__e", "__status", "__score", "__is_catchall", "__is_disposable", "__service")


def found_emails(contacts: DataFrame, found: DataFrame, source: str = "hunter_io") -> DataFrame:
    """E-mails of ``found`` (``_seq``, ``found_email``) where a contact has none: 20 more points, and their source."""
    j = contacts.join(found.select(F.col("_seq").alias("__s"), "found_email"), F.col("_seq") == F.col("__s"), "left")
    due = (F.col("email").isNull() | (F.col("email") == "")) & F.col("found_email").isNotNull()
    out = {"email": F.when(due, F.col("found_email")).otherwise(F.col("email")), "confidence_score": F.when(due, F.col("confidence_score") + 20).otherwise(F.col("confidence_score"))}
    src = F.col("email_source") if "email_source" in contacts.columns else F.lit(None).cast("string")
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in contacts.columns if c != "email_source"], F.when(due, source).otherwise(src).alias("email_source"))


def first_answer(*services: Column) -> Column:
    """The first service that answered: structs, null where there was no answer."""
    return F.coalesce(*services)


def validation_summary(contacts: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    has = F.col("email").isNotNull() & (F.col("email") != "")
    a = contacts.agg(F.count("*").alias("total"), n(has).alias("with_email"), n(F.col("email_status") == "valid").alias("valid"))
    return a.select("*", pct(F.col("with_email"), F.col("total")).alias("coverage_pct"), pct(F.col("valid"), F.col("with_email")).alias("valid_pct"))


def email_pattern(contacts: DataFrame, key: str = "domain", email_col: str = "email", least: int = 3, share: float = 0.6) -> DataFrame:
    """``key, pattern``: how most local parts of a domain join names: '.', '_' or none; null if too few or no majority."""
    local = F.split_part(F.col(email_col), F.lit("@"), F.lit(1))
    kind = F.when(F.contains(local, F.lit(".")), ".").when(F.contains(local, F.lit("_")), "_").otherwise("none")
    rows = contacts.where(F.col(email_col).isNotNull() & F.contains(F.col(email_col), F.lit("@"))).withColumn("__k", kind)
    n = lambda k: F.count(F.when(F.col("__k") == k, 1))
    a = rows.groupBy(key).agg(F.count("*").alias("n"), n(".").alias("dots"), n("_").alias("lines"), n("none").alias("nones"))
    enough = lambda c: (F.col("n") >= least) & (F.col(c) >= share * F.col("n"))
    return a.select(key, F.when(enough("dots"), ".").when(enough("lines"), "_").when(enough("nones"), "none").alias("pattern"))


def construct_email(first: Column, last: Column, domain: Column, pattern: Column) -> Column:
    f, l = F.lower(F.trim(F.coalesce(first, F.lit("")))), F.lower(F.trim(F.coalesce(last, F.lit(""))))  # noqa: E741
    join = F.when(pattern == "_", "_").when(pattern == "none", "").otherwise(".")
    return F.when((f == "") | (l == ""), "").otherwise(F.concat(f, join, l, F.lit("@"), domain))


def fill_by_pattern(contacts: DataFrame, key: str = "domain", penalty: int = 30) -> DataFrame:
    """Missing e-mails made up by the pattern of the contact's domain, at ``penalty`` points less; opt-in."""
    p = email_pattern(contacts, key).where("pattern IS NOT NULL").select(F.col(key).alias("__d"), F.col("pattern").alias("__p"))
    j = contacts.join(p, F.col(key) == F.col("__d"), "left")
    made = F.when(F.col("__p").isNotNull(), F.nullif(construct_email(F.col("first_name"), F.col("last_name"), F.col(key), F.col("__p")), F.lit("")))
    due = (F.col("email").isNull() | (F.col("email") == "")) & made.isNotNull()
    out = {"email": F.when(due, made).otherwise(F.col("email")), "confidence_score": F.when(due, F.greatest(F.lit(0), F.col("confidence_score") - penalty)).otherwise(F.col("confidence_score"))}
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in contacts.columns], due.alias("email_inferred"))
