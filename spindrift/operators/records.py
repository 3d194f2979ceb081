"""Contact records: what a page's section shows, with its institution, its title's parts, its role and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import contact_confidence, keep_contact
from ..functions.text import parse_name
from ..functions.titles import with_normalized_title
from .roles import match_roles

# fixed values: the columns of a record, in order
RECORD = [
    "institution_name", "institution_url", "state", "program_type", "first_name", "last_name", "full_name", "title", "title_normalized", "title_modifiers",
    "is_temporary", "is_shared_role", "matched_role", "all_matched_roles", "email", "phone", "confidence_score", "title_match_score", "extraction_method",
    "source_url", "extracted_at",
]


def score_contacts(contacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Contacts with their role, title points and confidence; those of low confidence are dropped."""
    c = match_roles(contacts, catalog)
    has = F.coalesce(F.col("email") != "", F.lit(False))
    conf = contact_confidence(has, has, F.lit(False), F.lit(False), F.col("title_match_score"), F.coalesce(F.col("phone") != "", F.lit(False)), F.lit(False))
    c = c.withColumn("confidence_score", conf)
    return c.where(keep_contact(F.col("confidence_score"), F.col("email"), F.col("title_match_score")))


def contact_records(contacts: DataFrame, catalog: DataFrame, now: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``RECORD``, after those in ``keep``, of contacts that name their institution.

    Titles that are left out keep their own wording as the normalised one, without modifiers. Missing texts are ''.
    """
    t = contacts.select("title").distinct()
    n = with_normalized_title(t.where("title <> ''"), "title", "__n").select(F.col("title").alias("__t"), "__n")
    c = score_contacts(contacts, catalog).join(n, F.col("title") == F.col("__t"), "left")
    used = F.col("__n").isNotNull() & ~F.col("__n.should_exclude")
    name = parse_name(F.col("full_name"))
    own = {
        "first_name": name["first"],
        "last_name": name["last"],
        "title_normalized": F.when(used, F.col("__n.normalized")).otherwise(F.col("title")),
        "title_modifiers": F.when(used, F.array_join("__n.modifiers", ",")),
        "is_temporary": F.coalesce(used & F.col("__n.is_temporary"), F.lit(False)),
        "is_shared_role": F.coalesce(used & F.col("__n.is_shared_role"), F.lit(False)),
        "all_matched_roles": F.array_join("all_matched_roles", ","),
        "extraction_method": F.lit("website_scrape"),
        "source_url": F.col("institution_url"),
        "extracted_at": F.lit(now),
    }
    plain = {"is_temporary", "is_shared_role", "confidence_score", "title_match_score"}
    cols = {k: own.get(k, F.col(k) if k in c.columns else F.lit(None).cast("string")) for k in RECORD}
    return c.select(*keep, *[(v if k in plain else F.coalesce(v, F.lit(""))).alias(k) for k, v in cols.items()])
