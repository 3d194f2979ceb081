"""Scores, tiers and status tables of contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: statuses, their ranks and scores
STATUS_RANK = {"valid": 4, "catch-all": 3, "unknown": 2, "invalid": 1, "no_email": 0}
PROVIDER_A_SCORE = {"valid": 100, "catch-all": 70, "unknown": 40, "invalid": 0, "do_not_mail": 0, "spamtrap": 0}
PROVIDER_B_STATUS = {0: "valid", 1: "invalid", 2: "disposable", 3: "catch-all", 4: "unknown"}
PROVIDER_B_SCORE = {0: 100, 3: 70, 4: 40, 1: 0, 2: 0}
VALID = ["valid", "deliverable"]
INVALID = ["invalid", "undeliverable", "do_not_mail", "spamtrap"]
CATCH_ALL = ["catch-all", "catchall", "accept_all"]
UNKNOWN = ["unknown", "risky"]


def table(c: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def contact_confidence(has_email: Column, on_site: Column, validated: Column, catch_all: Column, title_score: Column, phone: Column, linkedin: Column) -> Column:
    """0 to 100: what speaks for a contact, less what speaks against it. Null flags count as false."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    score = F.coalesce(title_score, F.lit(0))
    email = F.when(yes(has_email), F.when(yes(on_site), 40).otherwise(-30) + F.when(yes(validated), 30).otherwise(0) - F.when(yes(catch_all), 20).otherwise(0)).otherwise(0)
    title = F.when(score >= 90, 20).when(score >= 70, 10).otherwise(0)
    return clamp(email + title + F.when(yes(phone), 10).otherwise(0) + F.when(yes(linkedin), 10).otherwise(0)).cast("int")


def keep_contact(confidence: Column, email: Column, title_score: Column, least: int = 50) -> Column:
    """False for contacts of low confidence without an e-mail and with no close title match."""
    no_email = email.isNull() | (email == "")
    return ~((confidence < least) & no_email & (F.coalesce(title_score, F.lit(0)) < 90))


def enriched_confidence(score: Column, status: Column) -> Column:
    """30 more for a valid address, 20 less for a catch-all; kept within 0 to 100 where it changes."""
    s = F.coalesce(status, F.lit(""))
    change = F.when(s.isin(VALID), 30).when(s == "catch-all", -20).otherwise(0)
    return F.when(change != 0, clamp(score + change)).otherwise(score).cast("int")


def merged_confidence(score: Column, status: Column, phone: Column) -> Column:
    """Rescored after a merge: 10 more if valid, 5 less if catch-all, 5 more with a phone; at most 100."""
    s = F.coalesce(status, F.lit(""))
    return F.least(F.lit(100), score + F.when(s == "valid", 10).when(s == "catch-all", -5).otherwise(0) + F.when(phone.isNotNull(), 5).otherwise(0)).cast("int")


def priority_score(match: Column, confidence: Column, email: Column) -> Column:
    return (match * 0.5 + confidence * 0.3 + F.when(email.isNotNull(), 100).otherwise(0) * 0.2).cast("double")


def priority_tier(score: Column) -> Column:
    return F.when(score >= 90, "High").when(score >= 75, "Medium").otherwise("Low")


def confidence_level(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def status_rank(status: Column) -> Column:
    return F.coalesce(table(status, STATUS_RANK, 0), F.lit(0)).cast("int")


def provider_a_score(status: Column) -> Column:
    return table(F.lower(status), PROVIDER_A_SCORE, 50).cast("int")


def provider_b_status(code: Column) -> Column:
    return table(code, PROVIDER_B_STATUS, "unknown")


def provider_b_score(code: Column) -> Column:
    return table(code, PROVIDER_B_SCORE, 50).cast("int")


def is_catch_all(flag: Column, status: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(status.isin(CATCH_ALL), F.lit(False))


def title_points(score: Column) -> Column:
    """The points of a title match, in five tiers."""
    return F.when(score >= 90, 20).when(score >= 85, 17).when(score >= 80, 14).when(score >= 75, 11).when(score >= 70, 8).otherwise(0)


def adaptive_delay(current: Column, ok_rate: Column, response: Column, least: Column, most: Column) -> Column:
    """A fifth less when nearly all goes well and fast, half more when it doesn't."""
    return F.when((ok_rate > 0.95) & (response < 2.0), F.greatest(least, current * 0.8)).when((ok_rate < 0.8) | (response > 5.0), F.least(most, current * 1.5)).otherwise(current)
