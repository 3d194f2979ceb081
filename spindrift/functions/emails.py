"""E-mail addresses that pages hide: hex-coded attributes, spelt-out signs, scripts and data attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dom import parse
from .text import EMAIL, EMAIL_WHOLE, PLACEHOLDERS, valid_email

# fixed values: how addresses are spelt out, in the order in which they are read back, and where scripts keep them
SPELT = [
    (r"(\w+(?:\.\w+)*)\s*\[at\]\s*(\w+(?:\.\w+)*)", "$1@$2"),
    (r"(\w+(?:\.\w+)*)\s*\(at\)\s*(\w+(?:\.\w+)*)", "$1@$2"),
    (r"(\w+(?:\.\w+)*)\s+AT\s+(\w+(?:\.\w+)*)", "$1@$2"),
    (r"\[dot\]", "."),
    (r"\(dot\)", "."),
    (r"\s+DOT\s+", "."),
]
LITERAL = r"""["']([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,})["']"""
JOINED = r"""["']([a-z0-9._-]+)["']\s*\+\s*["']@["']\s*\+\s*["']([a-z0-9._-]+\.[a-z]{2,})["']"""
ATTRIBUTES = ["data-email", "data-contact", "data-mail", "data-user-email"]


def decode_hex(c: Column) -> Column:
    """The text of a hex string whose first byte is XORed with all others; null if it is no such string."""
    byte = lambda i: F.conv(F.substr(c, i, F.lit(2)), 16, 10).cast("int")
    steps = F.sequence(F.lit(3), F.length(c) - 1, F.lit(2))
    text = F.array_join(F.transform(steps, lambda i: F.char(byte(i).bitwiseXOR(byte(F.lit(1))))), "")
    return F.when(c.rlike("^([0-9A-Fa-f]{2}){2,}$"), text)


#: A text without these has nothing spelt out.
SIGNS = r"(?i)\[at\]|\(at\)|\sat\s"


def spelt_out(c: Column) -> Column:
    """The text with signs written as such. Unicode letters count as letters; the plain patterns do for ASCII texts."""

    def written(flags: str) -> Column:
        out = c
        for pattern, to in SPELT:
            # a match starts where a word does, and what is before the sign is taken as a whole: nothing to go back to
            out = F.regexp_replace(out, f"(?{flags})" + pattern.replace(r"(\w+(?:\.\w+)*)\s", r"(?<!\w)(\w++(?:\.\w++)*+)\s", 1), to)
        return out

    return F.when(F.octet_length(c) == F.char_length(c), written("i")).otherwise(written("iU"))


def emails_spelt(c: Column) -> Column:
    """Addresses that only show once the signs are written as such; sorted."""
    found = F.regexp_extract_all(F.when(c.rlike(SIGNS), spelt_out(c)), F.lit(EMAIL), F.lit(0))
    only = F.array_sort(F.array_distinct(F.filter(found, lambda e: valid_email(e) & ~F.contains(c, e))))
    return F.when(c.isNotNull(), F.coalesce(only, F.array().cast("array<string>")))


def _valid(e: str) -> bool:
    return len(e) >= 5 and re.match(EMAIL_WHOLE, e) is not None and e.lower() not in PLACEHOLDERS


def _from_hex(code: str) -> str:
    try:
        b = bytes.fromhex(code)
    except ValueError:
        return ""
    return "".join(chr(x ^ b[0]) for x in b[1:])


def _from_spelling(html: str) -> set[str]:
    text = html
    for pattern, to in SPELT:
        text = re.sub(pattern, to.replace("$", "\\"), text, flags=re.I)
    return {e for e in re.findall(EMAIL, text) if e not in html}


TECHNIQUES = ["hex", "text", "script", "noscript", "attribute"]


def recover(html: str | None) -> dict[str, list[str]]:
    """The valid addresses that each technique finds in a page or a part of one, and ``all`` of them; sorted.

    Spelt-out addresses are looked for in the markup itself, the others in its tree.
    """
    root = parse(html)
    having = lambda a: root.all(test=lambda x: bool(x.attrs.get(a)))
    scripts = [x.text() for x in root.all("script")]
    found = {
        "hex": {_from_hex(x.attrs["data-cfemail"]) for x in having("data-cfemail")},
        "text": _from_spelling(html or ""),
        "script": {e for s in scripts for e in re.findall(LITERAL, s)} | {f"{u}@{h}" for s in scripts for u, h in re.findall(JOINED, s, re.I)},
        "noscript": {e for x in root.all("noscript") for e in re.findall(EMAIL, x.text())},
        "attribute": {x.attrs[a].strip() for a in ATTRIBUTES for x in having(a)},
    }
    good = {k: sorted(filter(_valid, v)) for k, v in found.items()}
    return good | {"all": sorted(set().union(*good.values()))}


def recover_emails(html: Column) -> Column:
    """struct of the addresses that ``recover`` finds, a field a technique, and ``all``."""

    @F.pandas_udf(", ".join(f"`{k}` array<string>" for k in [*TECHNIQUES, "all"]))
    def run(pages):
        import pandas as pd

        return pd.DataFrame([recover(h) for h in pages], columns=[*TECHNIQUES, "all"])

    return run(html)
