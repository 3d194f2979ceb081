"""Queries of the scalar operators: text, URLs, titles, scores and rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emails, scoring, text, titles, urls
from ..functions.rules import first_match
from ..operators import pages, roles, state
from .expected import RATIO_TABLE
from .registry import query
from .views import HEX_ADDRESSES, table, view

ASCII = r"regexp_replace({}, '[^\x00-\x7F]', ' ', 'g')"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(expr: str, values: dict, otherwise) -> str:
    one = lambda v: lit(v) if isinstance(v, str) else str(v)
    return f"CASE {expr} " + " ".join(f"WHEN {one(k)} THEN {one(v)}" for k, v in values.items()) + f" ELSE {one(otherwise)} END"


def rule_case(expr: str, rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({expr}, {lit(p)}) THEN {v}" for p, v in rules) + f" ELSE {otherwise} END"


# ---- text


@query("X1_clean_text", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


def ascii_text(c):
    """Word boundaries differ between engines after letters that are not ASCII; both sides see spaces there."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


@query("X2_extract_email", rf"SELECT doc_id, nullif(regexp_extract({ASCII.format('text')}, {lit(text.EMAIL)}), '') AS email FROM documents")
def extract_email(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.extract_email(ascii_text(F.col("text"))).alias("email"))


@query("X3_extract_phone", f"SELECT doc_id, nullif(regexp_extract(text, {lit(text.PHONE)}), '') AS phone FROM documents")
def extract_phone(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.extract_phone(F.col("text")).alias("phone"))


@query("X4_parse_name", "SELECT _seq, string_split(t, ' ')[1] AS first_name, CASE WHEN len(string_split(t, ' ')) > 1 THEN string_split(t, ' ')[-1] ELSE '' END AS last_name FROM (SELECT _seq, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM contacts)")
def parse_name(spark, d) -> DataFrame:
    n = text.parse_name(F.col("title"))
    return view(spark, d, "contacts").select("_seq", n["first"].alias("first_name"), n["last"].alias("last_name"))


@query("X5_normalize_name", "SELECT _seq, lower(trim(regexp_replace(coalesce(full_name, ''), '\\s+', ' ', 'g'))) AS name_key FROM contacts")
def normalize_name(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", text.normalize_name(F.col("full_name")).alias("name_key"))


@query("X6_normalize_email", "SELECT _seq, lower(trim(coalesce(email, ''))) AS email_key FROM contacts")
def normalize_email(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", text.normalize_email(F.col("email")).alias("email_key"))


VALID = "coalesce(regexp_matches(email, {p}) AND length(email) >= 5 AND lower(email) NOT IN ({x}), false)".format(p=lit(text.EMAIL_WHOLE), x=", ".join(map(lit, text.PLACEHOLDERS)))


@query("X7_valid_email", f"SELECT _seq, {VALID} AS valid, coalesce(regexp_matches(email, {lit(text.EMAIL_WHOLE)}), false) AS anchored FROM contacts")
def valid_email(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", text.valid_email(F.col("email")).alias("valid"), text.anchored_email(F.col("email")).alias("anchored"))


ROLE_TITLE = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'), '[^\w\s&/-]', '', 'g'))"


@query("X9_role_title", f"SELECT _seq, {ROLE_TITLE.format(c='title')} AS role_title FROM contacts")
def role_title(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", text.normalize_role_title(F.col("title")).alias("role_title"))


#: Titles that hold a name, by ``_seq % 8``; and the names.
NAMED = [("Smith, Jane Director", "Jane", "Smith"), ("Kevin Brown, Law Library Director", "Kevin", "Brown"), ("Ashley Green Associate Director of X", "Ashley", "Green"), ("Mary Major director@x", "Mary", "Major"), ("Anna Bell anna@x.edu", "Anna", "Bell"), ("Tom Hill", "Tom", "Hill"), ("Law Library Director", "Law", "Library"), ("director of law", None, None)]


def named_title(c):
    return F.get(F.array(*[F.lit(t) for t, _, _ in NAMED]), (c % 8).cast("int"))


def sql_named(i: int) -> str:
    return "CASE _seq % 8 " + " ".join(f"WHEN {k} THEN {lit(x[i])}" for k, x in enumerate(NAMED) if x[i]) + " END"


@query("X10_name_from_title", f"SELECT _seq, {sql_named(1)} AS first_name, {sql_named(2)} AS last_name FROM contacts")
def name_from_title(spark, d) -> DataFrame:
    n = text.name_from_title(named_title(F.col("_seq")))
    return view(spark, d, "contacts").select("_seq", n["first"].alias("first_name"), n["last"].alias("last_name"))


LACKS = "(_seq % 3 = 0 OR _seq % 5 = 0)"


@query("X11_fill_names", f"SELECT _seq, CASE WHEN {LACKS} AND _seq % 8 <> 7 THEN {sql_named(1)} WHEN _seq % 3 = 0 THEN NULL ELSE first_name END AS first_name, CASE WHEN {LACKS} AND _seq % 8 <> 7 THEN {sql_named(2)} WHEN _seq % 5 = 0 THEN NULL ELSE last_name END AS last_name FROM contacts")
def fill_names(spark, d) -> DataFrame:
    """Rows that lack either name take both from the title, if it gives both."""
    from ..operators.names import fill_missing_names

    c = view(spark, d, "contacts").select("_seq", F.when(F.col("_seq") % 3 != 0, F.col("first_name")).alias("first_name"), F.when(F.col("_seq") % 5 != 0, F.col("last_name")).alias("last_name"), named_title(F.col("_seq")).alias("title"))
    return fill_missing_names(c, "first_name", "last_name", "title").drop("title")


@query("X12_notes_confidence", r"SELECT _seq, coalesce(TRY_CAST(nullif(regexp_extract(notes, 'Confidence:\s*(\d+)', 1), '') AS INT), 50) AS confidence FROM contacts")
def notes_confidence(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", text.confidence_in_notes(F.col("notes")).alias("confidence"))


@query("X13_duration", "SELECT event_id, CASE WHEN v < 60 THEN printf('%.1fs', v) WHEN v < 3600 THEN printf('%.1fm', v / 60) ELSE printf('%.1fh', v / 3600) END AS shown FROM (SELECT event_id, value * 20 AS v FROM events)")
def duration(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", text.duration(F.col("value") * 20).alias("shown"))


# ---- URLs

NORM_URL = "CASE WHEN trim(coalesce({c}, '')) = '' THEN '' ELSE regexp_replace(CASE WHEN regexp_matches(trim({c}), '^https?://') THEN trim({c}) ELSE concat('https://', trim({c})) END, '/+$', '') END"


@query("U1_validate_url", "SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS ok, regexp_matches(concat('x', url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS ok_other, false AS ok_bare FROM pages")
def validate_url(spark, d) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.valid_url(u).alias("ok"), urls.valid_url(F.concat(F.lit("x"), u)).alias("ok_other"), urls.valid_url(F.lit("not a url")).alias("ok_bare"))


@query("U2_normalize_url", f"SELECT _seq, {NORM_URL.format(c='url')} AS url FROM targets")
def normalize_url(spark, d) -> DataFrame:
    return view(spark, d, "targets").select("_seq", urls.normalize_url(F.col("url")).alias("url"))


@query("U3_extract_domain", f"SELECT _seq, regexp_extract({NORM_URL.format(c='url')}, '^[^:]+://([^/?#]*)', 1) AS domain FROM targets")
def extract_domain(spark, d) -> DataFrame:
    return view(spark, d, "targets").select("_seq", urls.extract_domain(F.col("url")).alias("domain"))


@query("U4_domain_key", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM pages")
def domain_key(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.domain_key(F.col("url")).alias("domain"))


@query("U5_resolve_url", "SELECT page_id, concat(regexp_extract(url, '^[a-z]+://[^/?#]*'), '/people/a') AS joined FROM pages")
def resolve_url(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.resolve_url(F.col("url"), F.lit("/people/a")).alias("joined"))


@query("U6_without_fragment", "SELECT page_id, split_part(url, '#', 1) AS url FROM pages")
def without_fragment(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.without_fragment(F.col("url")).alias("url"))


@query("U7_same_site", "SELECT page_id, h = 'example.com' OR suffix(h, '.example.com') AS same FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM pages)")
def same_site(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.same_site(urls.domain_key(F.col("url")), F.lit("example.com")).alias("same"))


# ---- titles


def sql_titles() -> dict[str, str]:
    """The title operators over a column ``title``, as SQL of the second engine."""
    e, seen = "title", []
    for short, full in titles.ABBREVIATIONS.items():
        p = lit(rf"\b{short}\.?\b")
        seen.append(f"nullif(regexp_extract({e}, {p}, 0, 'i'), '')")
        e = f"regexp_replace({e}, {p}, {lit(full)}, 'gi')"
    for p, to in ((r"\.\.+", "."), (r"\s+\.", "."), (r"\.\s+of", " of")):
        e = f"regexp_replace({e}, {lit(p)}, {lit(to)}, 'g')"
    return {"expanded": e, "abbreviations": f"[x FOR x IN [{', '.join(seen)}] IF x IS NOT NULL]"}


def sql_strip(e: str) -> str:
    e = rf"regexp_replace({e}, '\([^)]*\)', '', 'g')"
    e = rf"regexp_replace({e}, '\s+[-–—]\s*.*$', '', 'g')"
    e = f"regexp_replace({e}, {lit(titles.DEGREES[4:])}, '', 'gi')"
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def sql_modifiers(e: str) -> tuple[str, str]:
    seen = []
    for w in titles.TEMPORARY + titles.SENIORITY:
        p = lit(rf"\b{w}\b")
        seen.append(f"nullif(regexp_extract({e}, {p}, 0, 'i'), '')")
        e = f"regexp_replace({e}, {p}, '', 'gi')"
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))", f"[x FOR x IN [{', '.join(seen)}] IF x IS NOT NULL]"


def sql_exclusions(c: str = "title") -> dict[str, str]:
    t = rf"trim(regexp_replace(lower({c}), '\([^)]*\)', '', 'g'))"
    within = lambda ps: "(" + " OR ".join(f"contains({t}, {lit(p)})" for p in ps) + ")"
    matches = lambda ps: "(" + " OR ".join(f"regexp_matches({t}, {lit(p)})" for p in ps) + ")"
    return {"is_emeritus": within(titles.EMERITUS), "is_student": matches(titles.STUDENT), "is_visiting": within(titles.VISITING), "is_support_staff": matches(titles.SUPPORT)}


T = sql_titles()
X = sql_exclusions()
ANY_X = "(" + " OR ".join(X.values()) + ")"


@query("N1_expand_abbreviations", f"SELECT _seq, {T['expanded']} AS expanded, array_to_string({T['abbreviations']}, ',') AS abbreviations FROM contacts")
def expand_abbreviations(spark, d) -> DataFrame:
    e, a = titles.expand_abbreviations(F.col("title"))
    return view(spark, d, "contacts").select("_seq", e.alias("expanded"), F.array_join(a, ",").alias("abbreviations"))


@query("N2_strip_qualifiers", f"SELECT _seq, {sql_strip('title')} AS stripped FROM contacts")
def strip_qualifiers(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", titles.strip_qualifiers(F.col("title")).alias("stripped"))


@query("N3_extract_modifiers", f"SELECT _seq, {sql_modifiers('title')[0]} AS core, array_to_string({sql_modifiers('title')[1]}, ',') AS modifiers FROM contacts")
def extract_modifiers(spark, d) -> DataFrame:
    c, m = titles.extract_modifiers(F.col("title"))
    return view(spark, d, "contacts").select("_seq", c.alias("core"), F.array_join(m, ",").alias("modifiers"))


@query("N4_check_exclusions", "SELECT _seq, " + ", ".join(f"{v} AS {k}" for k, v in X.items()) + " FROM contacts")
def check_exclusions(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", *[v.alias(k) for k, v in titles.exclusions(F.col("title")).items()])


@query("N5_should_exclude", f"SELECT _seq, {ANY_X} AS excluded FROM contacts")
def should_exclude(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", titles.should_exclude(F.col("title")).alias("excluded"))


N8 = f"""SELECT _seq, core AS normalized, array_to_string(mods, ',') AS modifiers, temp AS is_temporary, shared AS is_shared_role, excl AS should_exclude,
  CAST((CASE WHEN temp THEN -3 ELSE 0 END) + (CASE WHEN n_abbr > 0 THEN -2 ELSE 1 END) + (CASE WHEN visiting THEN -3 ELSE 0 END) + (CASE WHEN shared THEN 2 ELSE 0 END) AS INT) AS confidence_modifier
FROM (SELECT *, len([m FOR m IN mods IF list_contains([{', '.join(map(lit, titles.TEMPORARY))}], lower(m))]) > 0 AS temp,
  {" OR ".join(f"regexp_matches(lower(core), {lit(chr(92) + 'b' + re.escape(p) + chr(92) + 'b')})" for p in titles.SHARED)} AS shared
  FROM (SELECT _seq, {sql_modifiers('s')[0]} AS core, {sql_modifiers('s')[1]} AS mods, n_abbr, visiting, excl
    FROM (SELECT _seq, {sql_strip('e')} AS s, n_abbr, visiting, excl FROM (SELECT _seq, {T['expanded']} AS e, len({T['abbreviations']}) AS n_abbr, {X['is_visiting']} AS visiting, {ANY_X} AS excl FROM contacts))))"""


@query("N8_normalize_title", N8)
def normalize_title(spark, d) -> DataFrame:
    rows = titles.with_normalized_title(view(spark, d, "contacts"), "title", "n")
    return rows.select("_seq", "n.normalized", F.array_join("n.modifiers", ",").alias("modifiers"), "n.is_temporary", "n.is_shared_role", "n.should_exclude", "n.confidence_modifier")


FLAGS = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {lit(v)} END" for c, v in (("n.is_temporary", "Temporary"), ("t.is_student", "Student"), ("t.is_emeritus", "Emeritus"), ("t.is_visiting", "Visiting"), ("n.is_shared_role", "Shared Role"))) + ")"


@query(
    "N10_title_summary",
    f"""SELECT n._seq, concat_ws(' | ', 'Original: ' || t.title, 'Normalized: ' || n.normalized, CASE WHEN n.modifiers <> '' THEN 'Modifiers: ' || replace(n.modifiers, ',', ', ') END,
  CASE WHEN len(t.ab) > 0 THEN 'Abbreviations: ' || array_to_string(t.ab, ', ') END, CASE WHEN {FLAGS} <> '' THEN 'Flags: ' || {FLAGS} END,
  'Confidence Modifier: ' || printf('%+d', n.confidence_modifier), 'Should Exclude: ' || CASE WHEN n.should_exclude THEN 'True' ELSE 'False' END) AS summary
FROM ({N8}) n JOIN (SELECT _seq, title, {T['abbreviations']} AS ab, {X['is_student']} AS is_student, {X['is_emeritus']} AS is_emeritus, {X['is_visiting']} AS is_visiting FROM contacts) t ON t._seq = n._seq""",
)
def title_summary(spark, d) -> DataFrame:
    return titles.with_normalized_title(view(spark, d, "contacts"), "title", "n").select("_seq", titles.title_summary(F.col("n")).alias("summary"))


# ---- scores

CLAMP = "greatest(0, least(100, {}))"
EMAIL_POINTS = "CASE WHEN coalesce(email <> '', false) THEN CASE WHEN email_source = 'website_scrape' THEN 40 ELSE -30 END + CASE WHEN email_status = 'valid' THEN 30 ELSE 0 END - CASE WHEN email_is_catchall THEN 20 ELSE 0 END ELSE 0 END"


@query("C1_contact_confidence", f"SELECT _seq, CAST({CLAMP.format(EMAIL_POINTS + ' + CASE WHEN title_match_score >= 90 THEN 20 WHEN title_match_score >= 70 THEN 10 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END')} AS INT) AS confidence FROM contacts")
def contact_confidence(spark, d) -> DataFrame:
    c = scoring.contact_confidence(F.col("email") != "", F.col("email_source") == "website_scrape", F.col("email_status") == "valid", F.col("email_is_catchall"), F.col("title_match_score"), F.col("phone").isNotNull(), F.lit(False))
    return view(spark, d, "contacts").select("_seq", c.alias("confidence"))


@query("C2_low_confidence_drop", "SELECT _seq FROM contacts WHERE NOT (confidence_score < 50 AND (email IS NULL OR email = '') AND title_match_score < 90)")
def low_confidence_drop(spark, d) -> DataFrame:
    return view(spark, d, "contacts").where(scoring.keep_contact(F.col("confidence_score"), F.col("email"), F.col("title_match_score"))).select("_seq")


@query("C3_enrichment_adjust", f"SELECT _seq, CAST(CASE WHEN email_status IN ('valid', 'deliverable') THEN {CLAMP.format('confidence_score + 30')} WHEN email_status = 'catch-all' THEN {CLAMP.format('confidence_score - 20')} ELSE confidence_score END AS INT) AS confidence FROM contacts")
def enrichment_adjust(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", scoring.enriched_confidence(F.col("confidence_score"), F.col("email_status")).alias("confidence"))


@query("C5_merge_rescore", "SELECT _seq, CAST(least(100, confidence_score + CASE WHEN email_status = 'valid' THEN 10 WHEN email_status = 'catch-all' THEN -5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END) AS INT) AS confidence FROM contacts")
def merge_rescore(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", scoring.merged_confidence(F.col("confidence_score"), F.col("email_status"), F.col("phone")).alias("confidence"))


PRIORITY = "CAST(title_match_score * 0.5::DOUBLE + confidence_score * 0.3::DOUBLE + CASE WHEN email IS NOT NULL THEN 100 ELSE 0 END * 0.2::DOUBLE AS DOUBLE)"


@query("C6_priority", f"SELECT _seq, round(p, 1) AS priority, CASE WHEN p >= 90 THEN 'High' WHEN p >= 75 THEN 'Medium' ELSE 'Low' END AS tier FROM (SELECT _seq, {PRIORITY} AS p FROM contacts)")
def priority(spark, d) -> DataFrame:
    p = scoring.priority_score(F.col("title_match_score"), F.col("confidence_score"), F.col("email"))
    return view(spark, d, "contacts").select("_seq", F.round(p, 1).alias("priority"), scoring.priority_tier(p).alias("tier"))


@query("C8_confidence_level", "SELECT _seq, CASE WHEN confidence_score >= 75 THEN 'high' WHEN confidence_score >= 50 THEN 'medium' ELSE 'low' END AS level FROM contacts")
def confidence_level(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", scoring.confidence_level(F.col("confidence_score")).alias("level"))


@query(
    "C9_status_tables",
    f"SELECT _seq, CAST({case('email_status', scoring.STATUS_RANK, 0)} AS INT) AS status_rank, CAST({case('lower(email_status)', scoring.PROVIDER_A_SCORE, 50)} AS INT) AS a_score, "
    f"{case('_seq % 7', scoring.PROVIDER_B_STATUS, 'unknown')} AS b_status, CAST({case('_seq % 7', scoring.PROVIDER_B_SCORE, 50)} AS INT) AS b_score, "
    f"coalesce(email_is_catchall, false) OR coalesce(email_status IN ({', '.join(map(lit, scoring.CATCH_ALL))}), false) AS catch_all FROM contacts",
)
def status_tables(spark, d) -> DataFrame:
    code = F.col("_seq") % 7
    return view(spark, d, "contacts").select(
        "_seq", scoring.status_rank(F.col("email_status")).alias("status_rank"), F.coalesce(scoring.provider_a_score(F.col("email_status")), F.lit(50)).alias("a_score"), scoring.provider_b_status(code).alias("b_status"),
        scoring.provider_b_score(code).alias("b_score"), scoring.is_catch_all(F.col("email_is_catchall"), F.col("email_status")).alias("catch_all"),
    )


@query("F10_title_points", "SELECT _seq, CAST(CASE WHEN title_match_score >= 90 THEN 20 WHEN title_match_score >= 85 THEN 17 WHEN title_match_score >= 80 THEN 14 WHEN title_match_score >= 75 THEN 11 WHEN title_match_score >= 70 THEN 8 ELSE 0 END AS INT) AS points FROM contacts")
def title_points(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", scoring.title_points(F.col("title_match_score")).cast("int").alias("points"))


@query("K13_adaptive_delay", "SELECT event_id, CASE WHEN ok > 0.95::DOUBLE AND rt < 2 THEN greatest(2.0::DOUBLE, 5.0::DOUBLE * 0.8::DOUBLE) WHEN ok < 0.8::DOUBLE OR rt > 5 THEN least(10.0::DOUBLE, 5.0::DOUBLE * 1.5::DOUBLE) ELSE 5.0::DOUBLE END AS delay FROM (SELECT event_id, (event_id % 100) / 100.0::DOUBLE AS ok, value / 50 AS rt FROM events)")
def adaptive_delay(spark, d) -> DataFrame:
    dl = scoring.adaptive_delay(F.lit(5.0), (F.col("event_id") % 100) / 100.0, F.col("value") / 50, F.lit(2.0), F.lit(10.0))
    return table(spark, d, "events").select("event_id", dl.alias("delay"))


# ---- rule tables

URLS = "SELECT page_id, concat(url, CASE page_id % 12 WHEN 0 THEN '/directory' WHEN 1 THEN '/faculty/jane-doe' WHEN 2 THEN '/student-directory' WHEN 3 THEN '/search?q=x' WHEN 4 THEN '/people/ann' WHEN 5 THEN '/contact' WHEN 6 THEN '/team/a' WHEN 7 THEN '/profile/b' WHEN 8 THEN '/portal/x' ELSE '' END) AS u FROM {pages}"


@query(
    "P1_url_type",
    "SELECT page_id, " + rule_case("lower(u)", [(p, lit(t)) for p, t, _ in pages.PAGE_RULES], "CASE WHEN regexp_matches(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*(/|/index.html|/index.php)?([?#].*)?$') THEN 'homepage' END")
    + " AS kind, CAST(" + rule_case("lower(u)", [(p, s) for p, _, s in pages.PAGE_RULES], "CASE WHEN regexp_matches(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*(/|/index.html|/index.php)?([?#].*)?$') THEN 70 END")
    + f" AS INT) AS score FROM ({URLS.format(pages='pages')})",
)
def url_type(spark, d) -> DataFrame:
    t = pages.url_type(F.col("u"))
    return spark.sql(URLS.replace("{pages}", "{p}"), p=table(spark, d, "pages")).select("page_id", t["type"].alias("kind"), t["score"].cast("int").alias("score"))


@query("P6_heading_type", "SELECT _seq, CASE WHEN contains(lower(title), 'directory') OR contains(lower(title), 'our team') OR contains(lower(title), 'our people') OR contains(lower(title), 'staff') OR contains(lower(title), 'faculty') THEN 'directory_listing' WHEN regexp_matches(title, '^[A-Z]\\S*( [A-Z]\\S*){1,3}$') THEN 'individual_profile' END AS kind FROM contacts")
def heading_type(spark, d) -> DataFrame:
    return view(spark, d, "contacts").select("_seq", pages.heading_type(F.col("title"))["type"].alias("kind"))


def sql_profile_score() -> str:
    w = r"[x FOR x IN regexp_split_to_array(trim(t), '\s+') IF x <> '']"
    up = "regexp_matches(x, '^[A-Z]')"
    name = f"CASE WHEN len({w}) BETWEEN 2 AND 4 THEN CASE WHEN len([x FOR x IN {w} IF length(x) > 1 AND NOT {up}]) = 0 THEN 40 WHEN len([x FOR x IN {w} IF {up}]) > 0 THEN 20 ELSE 0 END ELSE 0 END"
    has = lambda ps: "(" + " OR ".join(f"contains(lower(t), {lit(p)})" for p in ps) + ")"
    never = " OR ".join(f"regexp_matches(lower(u), {lit(p)})" for p in pages.NOT_PROFILES)
    total = f"{rule_case('lower(u)', pages.PROFILE_URLS, '0')} + {name} + CASE WHEN {has(pages.TITLE_WORDS)} THEN 10 ELSE 0 END + CASE WHEN {has(pages.ACTIONS)} THEN 15 ELSE 0 END + 15"
    return f"CAST(CASE WHEN {never} THEN 0 ELSE least(100, {total}) END AS INT)"


@query("L3_profile_link_score", f"SELECT page_id, {sql_profile_score()} AS score FROM (SELECT page_id, u, CASE page_id % 4 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'View Profile' WHEN 2 THEN 'dean of law' ELSE 'x' END AS t FROM ({URLS.format(pages='pages')}))")
def profile_link_score(spark, d) -> DataFrame:
    t = F.when(F.col("page_id") % 4 == 0, "Jane Doe").when(F.col("page_id") % 4 == 1, "View Profile").when(F.col("page_id") % 4 == 2, "dean of law").otherwise("x")
    s = pages.profile_link_score(F.col("u"), t, F.lit(""), F.lit(3), F.lit(False))
    return spark.sql(URLS.replace("{pages}", "{p}"), p=table(spark, d, "pages")).select("page_id", s.cast("int").alias("score"))


@query("T18_host_rules", "SELECT page_id, CASE WHEN regexp_matches(h, 'blog\\.') THEN 'BL' WHEN regexp_matches(h, 'example\\.com') THEN 'CO' WHEN regexp_matches(h, '\\.net$') THEN 'NE' END AS state FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def host_rules(spark, d) -> DataFrame:
    rules = [(r"blog\.", "BL"), (r"example\.com", "CO"), (r"\.net$", "NE")]
    return table(spark, d, "pages").select("page_id", first_match(urls.domain_key(F.col("url")), rules, F.lit(None).cast("string")).alias("state"))


# ---- e-mails

OF_HEX = "CASE page_id % 5 " + " ".join(f"WHEN {i} THEN {lit(a)}" for i, a in enumerate(HEX_ADDRESSES)) + " END"


@query("E1_decode_hex", f"SELECT page_id, CASE WHEN page_id % 8 = 3 THEN {OF_HEX} END AS email FROM web_pages")
def decode_hex(spark, d) -> DataFrame:
    """Of every page the first hidden code; pages without one give null."""
    return view(spark, d, "web_pages").select("page_id", emails.decode_hex(F.regexp_extract("html", 'data-cfemail="([^"]*)"', 1)).alias("email"))


def sql_spelt(c: str) -> str:
    for p, to in emails.SPELT:
        c = f"regexp_replace({c}, {lit(p)}, {lit(to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'gi')"
    return c


@query("E2_emails_spelt", f"SELECT page_id, array_to_string(list_sort(list_distinct([e FOR e IN regexp_extract_all({sql_spelt('html')}, {lit(text.EMAIL)}) IF NOT contains(html, e)])), ',') AS emails FROM web_pages")
def emails_spelt(spark, d) -> DataFrame:
    return view(spark, d, "web_pages").select("page_id", F.array_join(emails.emails_spelt(F.col("html")), ",").alias("emails"))


@query("E7_decode_documents", f"SELECT doc_id, array_to_string(list_sort(list_distinct([e FOR e IN regexp_extract_all({sql_spelt('t')}, {lit(text.EMAIL)}) IF NOT contains(t, e) AND lower(e) NOT IN ({', '.join(map(lit, text.PLACEHOLDERS))})])), ',') AS emails FROM (SELECT doc_id, {ASCII.format('text')} AS t FROM documents)")
def decode_documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(emails.emails_spelt(ascii_text(F.col("text"))), ",").alias("emails"))


RECOVERED = f"list_sort([{OF_HEX}, " + ", ".join(f"concat('{k}', page_id, '@law.edu')" for k in ("desk", "script", "joined", "plain", "attr")) + "])"


@query("E6_recover_emails", f"SELECT page_id, CASE WHEN page_id % 8 = 3 THEN array_to_string({RECOVERED}, ',') ELSE '' END AS emails FROM web_pages")
def recover_emails(spark, d) -> DataFrame:
    return view(spark, d, "web_pages").select("page_id", F.array_join(emails.recover_emails(F.col("html"))["all"], ",").alias("emails"))


@query("E8_recovery_counts", "SELECT n AS hex, n AS text, 2 * n AS script, n AS noscript, n AS attribute FROM (SELECT count(*) AS n FROM web_pages WHERE page_id % 8 = 3)")
def recovery_counts(spark, d) -> DataFrame:
    """How many addresses each technique recovers from all pages."""
    p = view(spark, d, "web_pages").withColumn("r", emails.recover_emails(F.col("html")))
    return p.agg(*[F.sum(F.size(f"r.{k}")).alias(k) for k in emails.TECHNIQUES])


# ---- fuzzy

@query("F1_ratios", f"SELECT t.title, b, ratio, partial_ratio, token_sort, token_set FROM (SELECT DISTINCT title FROM contacts) t JOIN {RATIO_TABLE} r ON t.title = r.title")
def ratios(spark, d) -> DataFrame:
    """Every distinct title with two roles."""
    from ..functions import fuzzy

    roles_ = F.explode(F.array(F.lit("law library director"), F.lit("program coordinator"))).alias("b")
    df = view(spark, d, "contacts").select("title").distinct().select("title", F.lower("title").alias("a"), roles_)
    a, b = F.col("a"), F.col("b")
    return df.select("title", "b", fuzzy.ratio_col(a, b).alias("ratio"), fuzzy.partial_ratio_col(a, b).alias("partial_ratio"), fuzzy.token_sort_ratio_col(a, b).alias("token_sort"), fuzzy.token_set_ratio_col(a, b).alias("token_set"))


def _sql_context(t: str, r: str) -> str:
    return " OR ".join(f"(contains({r}, {lit(k)}) AND NOT (" + " OR ".join(f"contains({t}, {lit(n)})" for n in need) + "))" for k, need in roles.SPECIFIC.items())


@query(
    "F6_role_adjustments",
    f"""SELECT title, role, CAST(least(10, 5 * len([w FOR w IN list_distinct(string_split(title, ' ')) IF list_contains(string_split(role, ' '), w) AND w NOT IN ({', '.join(map(lit, roles.GENERIC))})])) AS INT) AS boost,
  CAST(CASE WHEN list_contains(string_split(title, ' '), 'professor') AND NOT list_contains(string_split(role, ' '), 'professor') AND NOT (contains(role, 'faculty') OR contains(role, 'academic') OR contains(role, 'dean')) THEN 20 ELSE 0 END AS INT) AS professor,
  CAST(CASE WHEN {_sql_context('title', 'role')} THEN 25 ELSE 0 END AS INT) AS context
FROM (SELECT DISTINCT lower(title) AS title FROM contacts), (SELECT lower(unnest([{', '.join(map(lit, roles.LAW_ROLES + roles.PARALEGAL_ROLES))}])) AS role)""",
)
def role_adjustments(spark, d) -> DataFrame:
    """Boost and penalties of every distinct title with every role."""
    t = view(spark, d, "contacts").select(F.lower("title").alias("title")).distinct()
    r = roles.catalog(spark).select(F.lower("role").alias("role"))
    a, b = F.col("title"), F.col("role")
    return t.join(F.broadcast(r)).select("title", "role", roles.meaningful_boost(a, b).alias("boost"), roles.professor_penalty(a, b).alias("professor"), roles.context_penalty(a, b).alias("context"))


# ---- routing rules


@query("K10_fast_fail", "SELECT event_id, coalesce(status_code IN (403, 404, 410, 451, 500, 502, 503), false) AS fast_fail FROM request_log")
def fast_fail(spark, d) -> DataFrame:
    return view(spark, d, "request_log").select("event_id", state.fast_fail(F.col("status_code")).alias("fast_fail"))
