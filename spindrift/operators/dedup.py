"""Deduplication, matching, merging and three-way comparison of contacts.

Rows come in an order (``_seq``) and the first of a key stays. ``mode='reference'`` counts an empty e-mail as one, so all
rows with one are the same key; ``mode='strict'`` takes it as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import merged_confidence, status_rank
from ..functions.text import normalize_email, normalize_name
from .common import SEQ, first_per_key, has, with_seq

# fixed values: which fields a merge takes from where
ALWAYS_UPDATE = ["title", "matched_role", "title_match_score", "source_url", "extraction_method", "extracted_at"]
UPDATE_IF_EMPTY = ["first_name", "last_name", "full_name", "email", "phone", "institution_url", "state", "program_type"]
VALIDATION = ["email_source", "email_status", "email_score", "email_is_catchall", "email_is_disposable", "email_validation_service"]


def _email(c: Column, mode: str) -> Column:
    return F.nullif(c, F.lit("")) if mode == "strict" else c


def deduplicate_by_email(df: DataFrame, mode: str = "reference") -> DataFrame:
    """The first row of each e-mail; rows without one stay."""
    if not has(df, "email"):
        return df
    df = with_seq(df)
    email = _email(F.col("email"), mode)
    return first_per_key(df.where(email.isNotNull()), [normalize_email(F.col("email"))]).unionByName(df.where(email.isNull()))


def deduplicate_by_name_institution(df: DataFrame, mode: str = "reference") -> DataFrame:
    """Of rows without an e-mail, the first of each name and institution; the others stay."""
    if not has(df, "full_name", "institution_name", "email"):
        return df
    df = with_seq(df)
    email = _email(F.col("email"), mode)
    keys = [normalize_name(F.col("full_name")), normalize_name(F.col("institution_name"))]
    return df.where(email.isNotNull()).unionByName(first_per_key(df.where(email.isNull()), keys))


def deduplicate_contacts(df: DataFrame, mode: str = "reference") -> DataFrame:
    """Both of the above in one shuffle: a key is an e-mail or a name and an institution."""
    df = with_seq(df)
    email = _email(F.col("email"), mode)
    by = F.when(email.isNotNull(), F.struct(F.lit("e").alias("k"), normalize_email(F.col("email")).alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(F.lit("n").alias("k"), normalize_name(F.col("full_name")).alias("a"), normalize_name(F.col("institution_name")).alias("b"))
    )
    return first_per_key(df.withColumn("__key", by), [F.col("__key")]).drop("__key")


def deduplication_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rows_before, rows_after, removed, removed_pct``."""
    b, a = before.agg(F.count("*").alias("rows_before")), after.agg(F.count("*").alias("rows_after"))
    both = b.crossJoin(a)  # one row each
    gone = F.col("rows_before") - F.col("rows_after")
    return both.select("rows_before", "rows_after", gone.alias("removed"), F.when(F.col("rows_before") > 0, F.round(gone * 100.0 / F.col("rows_before"), 1)).otherwise(0.0).alias("removed_pct"))


def deduplicate_records(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The first row of each key within ``group``: the e-mail, or name and title where there is none."""
    df = with_seq(df)
    email = F.lower(F.trim(F.coalesce("email", F.lit(""))))
    name = F.lower(F.concat(F.coalesce("full_name", F.lit("")), F.lit("_"), F.coalesce("title", F.lit(""))))
    return first_per_key(df, [*map(F.col, group or []), F.when(email != "", email).otherwise(name)])


def find_matches(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with ``match``, the first row of ``existing`` of the same e-mail, else of the same name and institution.

    Each side of either join has its keys once on the right, so it is two hash joins instead of a scan a row.
    """
    new, existing = with_seq(new), with_seq(existing)
    row = F.struct(*[F.col(c) for c in existing.columns])
    by_email = first_per_key(existing, [normalize_email(F.col("email"))]).select(normalize_email(F.col("email")).alias("__ke"), row.alias("__me"))
    named = existing.where("full_name IS NOT NULL AND institution_name IS NOT NULL")
    by_name = first_per_key(named, [normalize_name(F.col("full_name")), normalize_name(F.col("institution_name"))]).select(
        normalize_name(F.col("full_name")).alias("__kn"), normalize_name(F.col("institution_name")).alias("__ki"), row.alias("__mn")
    )
    probe = new.withColumn("__pe", F.when(F.col("email").isNotNull(), normalize_email(F.col("email"))))
    probe = probe.withColumn("__pn", F.when(F.col("institution_name").isNotNull(), normalize_name(F.col("full_name")))).withColumn("__pi", normalize_name(F.col("institution_name")))
    probe = probe.withColumn("__pn", F.when(F.col("full_name").isNotNull(), F.col("__pn")))
    out = probe.join(by_email, F.col("__pe") == F.col("__ke"), "left").join(by_name, (F.col("__pn") == F.col("__kn")) & (F.col("__pi") == F.col("__ki")), "left")
    return out.select(*new.columns, F.coalesce("__me", "__mn").alias("match"))


def changed(new: dict[str, Column], old: dict[str, Column]) -> Column:
    """The new row says something else, or its e-mail status is better."""
    differs = lambda k: new[k].isNotNull() & ~new[k].eqNullSafe(old[k])
    better = new["email_status"].isNotNull() & (status_rank(new["email_status"]) > status_rank(F.coalesce(old["email_status"], F.lit("unknown"))))
    return differs("email") | differs("title") | differs("phone") | better


def compare_with_existing(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with ``match`` and ``class``: new, duplicate or update."""
    found = find_matches(new, existing)
    fields = ["email", "title", "phone", "email_status"]
    change = changed({k: F.col(k) for k in fields}, {k: F.col(f"match.{k}") for k in fields})
    return found.withColumn("class", F.when(F.col("match").isNull(), "new").when(change, "update").otherwise("duplicate"))


def merge_matched(found: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows that ``compare_with_existing`` matched, each merged with its match; ``_seq`` is the new row's."""
    old = [f.name for f in found.schema["match"].dataType.fields]
    new = [c for c in found.columns if c not in ("match", "class")]
    n = lambda c: F.col(c)
    o = lambda c: F.col(f"match.{c}")
    better = F.lit(False)
    if "email_status" in new:
        rank = status_rank(o("email_status")) if "email_status" in old else F.lit(2)
        better = n("email_status").isNotNull() & (status_rank(n("email_status")) >= rank)
    out = {}
    for c in dict.fromkeys(old + new):
        if c in (SEQ, "confidence_score", "last_updated", "record_source"):
            continue
        kept = o(c) if c in old else F.lit(None).cast(found.schema[c].dataType)
        if c in ALWAYS_UPDATE and c in new:
            kept = F.coalesce(n(c), kept)
        elif c in UPDATE_IF_EMPTY and c in new:
            kept = F.when(n(c).isNotNull() & (n(c) != "") & (kept.isNull() | (kept == "")), n(c)).otherwise(kept)
        elif c in VALIDATION and c in new:
            kept = F.when(better, n(c)).otherwise(kept)
        out[c] = kept
    merged = found.where("match IS NOT NULL").select(
        F.col(SEQ),
        *[v.alias(k) for k, v in out.items()],
        (n("confidence_score") if "confidence_score" in new else o("confidence_score")).alias("__score"),
        F.coalesce(n("extracted_at"), now if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).alias("last_updated"),
    )
    return merged.withColumn("confidence_score", merged_confidence(F.col("__score"), F.col("email_status"), F.col("phone"))).drop("__score").withColumn("record_source", F.lit("merged"))
