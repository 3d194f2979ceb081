"""Target institutions: parsing, filters, the master table and the lookup of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.urls import domain_key, normalize_url, valid_url
from .common import first_per_key, numbered, with_seq

# fixed values: the fifty states and their abbreviations, in order of name
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY",
    "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO",
    "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI",
    "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}
MASTER = ["institution_id", "name", "type", "state", "city", "url", "accreditation_status", "source", "last_updated"]


def parse_listed(c: Column) -> Column:
    """struct(name, state, city, accreditation_status) of a list entry such as 'Name (1923)'.

    'State - City' is split where the first part has two words at most; null if there is no year.
    """
    # fixed values: the patterns of a list entry
    name = F.trim(F.regexp_extract(c, r"^(.+?)\s*\(\d{4}\)", 1))
    year = F.regexp_extract(c, r"\((\d{4})\)", 1)
    split = r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*-\s*(.+)"
    state, city = F.regexp_extract(name, split, 1), F.regexp_extract(name, split, 2)
    ok = name.rlike(split) & (F.size(F.split(state, r"\s+")) <= 2)
    return F.when(
        (year != "") & (name != ""),
        F.struct(name.alias("name"), F.when(ok, state).otherwise("").alias("state"), F.when(ok, F.trim(city)).otherwise("").alias("city"), F.concat(F.lit("ABA Approved ("), year, F.lit(")")).alias("accreditation_status")),
    )


def dedup_by_name(df: DataFrame) -> DataFrame:
    return first_per_key(with_seq(df), [F.col("name")])


def filter_states_or_all(df: DataFrame, states: list[str]) -> DataFrame:
    """The rows of these states; all rows, if there are none."""
    inside = F.upper(F.col("state")).isin([s.upper() for s in states])
    any_in = df.agg(F.coalesce(F.max(inside), F.lit(False)).alias("__any"))  # one row
    return df.crossJoin(F.broadcast(any_in)).where(inside | ~F.col("__any")).drop("__any")


def clean_targets(df: DataFrame) -> DataFrame:
    url = normalize_url(F.col("url"))
    return df.withColumn("name", clean_text(F.col("name"))).withColumn("url", F.when(valid_url(url), url).otherwise(""))


def state_abbreviation(c: Column) -> Column:
    """Of a state's full name in any case; '' for any other."""
    table = F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k.lower()), F.lit(v))])
    return F.coalesce(F.element_at(table, F.lower(F.trim(c))), F.lit(""))


def filter_by_states(df: DataFrame, states: list[str]) -> DataFrame:
    """Rows whose state, by full name or abbreviation, is among ``states``; '' among them lets unknown ones in."""
    wanted = [s.strip().lower() for s in states]
    return df.where(F.lower(F.trim("state")).isin(wanted) | F.lower(state_abbreviation(F.col("state"))).isin(wanted))


def align(df: DataFrame, columns: list[str], **constants) -> DataFrame:
    """Exactly ``columns``, in order: the table's own, a constant, or ''."""
    return df.select(*[F.lit(constants[c]).alias(c) if c in constants else F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def load_master(df: DataFrame, states: list[str] | None = None, program_type: str | None = None) -> DataFrame:
    """A program's institutions: law ones are of source ABA, paralegal ones of AAfPE; states in any case."""
    source = {"law": "ABA", "paralegal": "AAfPE"}.get(program_type or "")
    if source:
        df = df.where(F.col("source") == source)
    return df.where(F.upper("state").isin([s.upper() for s in states])) if states else df


def all_targets(master: DataFrame | None, live: list[DataFrame]) -> DataFrame:
    """The master table where there is one; else all live sources, by column name."""
    if master is not None:
        return master
    out = live[0]
    for x in live[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def build_master(parts: list[DataFrame], now: str) -> DataFrame:
    """One table of all sources, sorted by type, name, state, city and URL, nulls last, and numbered from 1; ranges are numbered side by
    side.

    Rows that are equal in these follow by accreditation, so that a rerun gives the same numbers.
    """
    cols = [c for c in MASTER if c not in ("institution_id", "source", "last_updated")]
    both = None
    for p in parts:
        x = align(p, cols)
        both = x if both is None else both.unionByName(x)
    both = both.withColumn("source", F.when(F.contains(F.col("type"), F.lit("Law School")), "ABA").otherwise("AAfPE")).withColumn("last_updated", F.lit(now))
    return numbered(both, ["type", "name", "state", "city", "url", "accreditation_status"], "institution_id", nulls_last=True).select(*MASTER)


def coverage(df: DataFrame, cols: tuple[str, ...] = ("state", "city", "url")) -> DataFrame:
    """``field, present, pct``; an empty string is present."""
    a = df.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in cols]))
    return a.select(rows.alias("r"), "__all").select("r.field", "r.present", F.when(F.col("__all") > 0, F.round(F.col("r.present") * 100.0 / F.col("__all"), 1)).otherwise(0.0).alias("pct"))


def by_state(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.lower("state") == state.lower())


def by_type(df: DataFrame, part: str) -> DataFrame:
    return df.where(F.coalesce(F.contains(F.lower("type"), F.lit(part.lower())), F.lit(False)))


def normalize_school(c: Column) -> Column:
    """Without what follows 'Law School' and the like; of 'A - B' the first part."""
    # fixed values: the words that end a name, and the dash
    short = F.regexp_replace(c, r"(?i)\s+(Law School|School of Law|College of Law|University).*$", "")
    dash = r"^([A-Za-z\s]+)\s*-\s*(.+)$"
    return F.trim(F.when(short.rlike(dash), F.regexp_extract(short, dash, 1)).otherwise(short))


def lookup_state(df: DataFrame, names: DataFrame, hosts: list[tuple[str, str]], name_col: str = "name", url_col: str = "url") -> DataFrame:
    """``df`` with ``found_state``: of the whole name, its first two words, its first word, or by the URL's first rule.

    ``names`` (``key``, ``state``) is a table of any size; each kind of key is one equi-join.
    """
    from ..functions.rules import first_match

    words = F.split(normalize_school(F.col(name_col)), r"\s+")
    probe = df.withColumn("__k1", normalize_school(F.col(name_col))).withColumn("__k2", F.when(F.size(words) >= 2, F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))))).withColumn("__k3", F.get(words, F.lit(0)))
    table = names.dropDuplicates(["key"])
    for i in (1, 2, 3):
        probe = probe.join(table.select(F.col("key").alias(f"__n{i}"), F.col("state").alias(f"__s{i}")), F.col(f"__k{i}") == F.col(f"__n{i}"), "left")
    by_url = first_match(domain_key(F.col(url_col)), hosts, F.lit(None).cast("string"))
    return probe.select(*df.columns, F.coalesce("__s1", "__s2", "__s3", by_url).alias("found_state"))


def enrich_states(df: DataFrame, names: DataFrame, hosts: list[tuple[str, str]], source: str = "ABA") -> DataFrame:
    """Fills states that are missing in rows of ``source``; ``outcome``: enriched, failed, or null where nothing was due."""
    due = (F.col("source") == source) & (F.col("state").isNull() | (F.col("state") == ""))
    found = lookup_state(df, names, hosts)
    return found.withColumn("outcome", F.when(due, F.when(F.col("found_state").isNotNull(), "enriched").otherwise("failed"))).withColumn("state", F.when(due, F.coalesce("found_state", "state")).otherwise(F.col("state"))).drop("found_state")


def role_variants(roles: list[str]) -> list[str]:
    """The roles, and for each its interim and acting forms and, of directors, chairs and coordinators, the shared ones."""
    out = dict.fromkeys(roles)
    for role in roles:
        out |= dict.fromkeys([f"Interim {role}", f"Acting {role}"])
        if "Director" in role:
            out |= dict.fromkeys(role.replace("Director", f"Co-{x}") for x in ("Director", "Chair", "Coordinator"))
        elif "Chair" in role:
            out[role.replace("Chair", "Co-Chair")] = None
        elif "Coordinator" in role:
            out[role.replace("Coordinator", "Co-Coordinator")] = None
    return list(out)


def directory_programs(pages: DataFrame, html_col: str = "html", base_col: str = "url", skip: tuple[str, ...] = ("other", "non-member", "organizations")) -> DataFrame:
    """``name, url, state, program_type``: the links of each list that follows a second-level heading, which is the state."""
    from .pages import heading_lists

    rows = heading_lists(pages, html_col, base_col)
    return rows.where(~F.lower("heading").isin(*skip) & (F.col("text") != "")).select(F.col("text").alias("name"), "url", F.col("heading").alias("state"), F.lit("paralegal").alias("program_type"))
