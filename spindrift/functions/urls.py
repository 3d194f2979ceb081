"""URL scalars."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_url(c: Column) -> Column:
    """Has a scheme and a host part."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def normalize_url(c: Column) -> Column:
    """Trimmed, https:// unless it has http(s)://, no slash at the end; null and '' give ''."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").otherwise(F.regexp_replace(F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t)), "/+$", ""))


def extract_domain(c: Column) -> Column:
    """The host part of the normalised URL, as written: port and user kept, case kept."""
    return F.regexp_extract(normalize_url(c), r"^[^:]+://([^/?#]*)", 1)


def domain_key(c: Column) -> Column:
    """The host part in lower case; '' without a scheme."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def without_fragment(c: Column) -> Column:
    return F.split_part(c, F.lit("#"), F.lit(1))


def same_site(host: Column, base: Column) -> Column:
    """The host is the base or one of its subdomains."""
    return (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def resolve_url(base: Column, href: Column) -> Column:
    """href as seen from base (RFC 3986). An Arrow-batched function: SQL has none for it."""

    @F.pandas_udf("string")
    def join(b, h):
        def one(x, y):
            try:
                return urljoin(x or "", y or "")
            except ValueError:
                return None

        return b.combine(h, one)

    return join(base, href)
