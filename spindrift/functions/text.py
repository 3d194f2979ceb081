"""Text scalars: cleaning, extraction and name parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns that decide what counts as an e-mail address or a phone number
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_WHOLE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PLACEHOLDERS = ["email@example.com", "user@example.com", "admin@example.com", "info@example.com", "test@test.com", "example@example.com"]
TITLE_WORDS = ["director", "dean", "professor", "associate", "assistant", "coordinator", "librarian", "chair", "head", "manager", "specialist", "officer", "counsel"]


def clean_text(c: Column) -> Column:
    """White space of any kind becomes one space, zero-width spaces go, ends are trimmed; null gives ''."""
    return F.trim(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), F.lit("​")))


def extract_email(c: Column) -> Column:
    """The first e-mail address, null if there is none."""
    return F.nullif(F.regexp_extract(c, EMAIL, 0), F.lit(""))


def extract_phone(c: Column) -> Column:
    """The first phone number, null if there is none; it may sit inside a longer run of digits."""
    return F.nullif(F.regexp_extract(c, PHONE, 0), F.lit(""))


def parse_name(c: Column) -> Column:
    """struct(first, last): the first and the last word; one word is a first name."""
    w = F.split(clean_text(c), " ")
    return F.struct(F.element_at(w, 1).alias("first"), F.when(F.size(w) > 1, F.element_at(w, -1)).otherwise("").alias("last"))


def normalize_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def normalize_email(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def valid_email(c: Column) -> Column:
    """An address of five characters or more that is none of the usual placeholders; null is not valid."""
    return F.coalesce(c.rlike(EMAIL_WHOLE) & (F.length(c) >= 5) & ~F.lower(c).isin(PLACEHOLDERS), F.lit(False))


def anchored_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_WHOLE), F.lit(False))


def normalize_role_title(c: Column) -> Column:
    """Lower case, one space between words, nothing but word characters, spaces, &, / and -."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "), r"(?U)[^\w\s&/-]", ""))


def name_from_title(c: Column) -> Column:
    """struct(first, last) recovered from a title that holds a name; null if it holds none.

    The first of these decides: last and first with a comma between; two names and a comma; two names and a title word,
    in any case; two names and something in lower case; the first two words, if both look like names. From the third on
    names have 20 and 25 letters at most, and title words are no names (in the fourth they may be).
    """
    t = F.trim(c)
    # fixed values: what a name looks like, and the patterns it is tried with, in order
    name, any_case = r"([A-Z][a-zA-Z\-']+)", r"([A-Za-z][a-zA-Z\-']+)"

    def fits(first: Column, last: Column, no_titles: bool) -> Column:
        ok = (F.length(first) <= 20) & (F.length(last) <= 25)
        return ok & ~F.lower(first).isin(TITLE_WORDS) & ~F.lower(last).isin(TITLE_WORDS) if no_titles else ok

    out = F.lit(None)
    tries = [(rf"^{name},\s+{name}", 2, 1, None), (rf"^{name}\s+{name},", 1, 2, None)]
    tries += [(rf"(?i)^{any_case}\s+{any_case}\s+(?:{w})", 1, 2, True) for w in TITLE_WORDS]
    tries += [(rf"^{name}\s+{name}\s+[a-z0-9]", 1, 2, False), (rf"^{name}\s+{name}(?=\s|$)", 1, 2, True)]
    for pattern, i, j, no_titles in reversed(tries):
        first, last = F.regexp_extract(t, pattern, i), F.regexp_extract(t, pattern, j)
        hit = t.rlike(pattern) if no_titles is None else t.rlike(pattern) & fits(first, last, no_titles)
        out = F.when(hit, F.struct(first.alias("first"), last.alias("last"))).otherwise(out)
    return out


def confidence_in_notes(c: Column, default: int = 50) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"Confidence:\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(default))


def duration(seconds: Column) -> Column:
    """Seconds, minutes or hours with one decimal and the unit's letter."""
    show = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))  # noqa: E731  ties go to even, as in Python
    return F.when(seconds < 60, F.concat(show(seconds), F.lit("s"))).when(seconds < 3600, F.concat(show(seconds / 60), F.lit("m"))).otherwise(F.concat(show(seconds / 3600), F.lit("h")))
