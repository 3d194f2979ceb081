"""Queries of the relational operators: deduplication, matching, enrichment, statistics, reports, targets, state."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_email
from ..functions.urls import domain_key
from ..operators import common, dedup, enrich, report, state, stats, targets
from ..operators.roles import LAW_ROLES, PARALEGAL_ROLES
from .registry import ORACLES, query
from .scalars import NORM_URL, lit
from .views import table, view

KEY_E = "lower(trim(coalesce(email, '')))"
NAME = lambda c: f"lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
FIRST = "row_number() OVER (PARTITION BY {k} ORDER BY _seq) = 1"


def contacts(spark, d) -> DataFrame:
    return view(spark, d, "contacts")


# ---- verbs


@query("V9_first_per_key", f"SELECT _seq, state, program_type FROM contacts QUALIFY {FIRST.format(k='state, program_type')}")
def first_per_key(spark, d) -> DataFrame:
    return common.first_per_key(contacts(spark, d), [F.col("state"), F.col("program_type")]).select("_seq", "state", "program_type")


@query("V4_value_counts", "SELECT email_status AS value, count(*) AS n FROM contacts WHERE email_status IS NOT NULL GROUP BY 1")
def value_counts(spark, d) -> DataFrame:
    return common.value_counts(contacts(spark, d), "email_status")


# ---- deduplication


@query("D1_dedup_by_email", f"SELECT _seq, email FROM contacts WHERE email IS NULL UNION ALL SELECT _seq, email FROM (SELECT * FROM contacts WHERE email IS NOT NULL QUALIFY {FIRST.format(k=KEY_E)})")
def dedup_by_email(spark, d) -> DataFrame:
    return dedup.deduplicate_by_email(contacts(spark, d)).select("_seq", "email")


@query("D2_dedup_by_name", f"SELECT _seq, full_name FROM contacts WHERE email IS NOT NULL UNION ALL SELECT _seq, full_name FROM (SELECT * FROM contacts WHERE email IS NULL QUALIFY {FIRST.format(k=NAME('full_name') + ', ' + NAME('institution_name'))})")
def dedup_by_name(spark, d) -> DataFrame:
    return dedup.deduplicate_by_name_institution(contacts(spark, d)).select("_seq", "full_name")


D3_KEY = f"CASE WHEN email IS NOT NULL THEN 'e' || {KEY_E} ELSE 'n' || {NAME('full_name')} || chr(1) || {NAME('institution_name')} END"
D3 = f"SELECT * FROM contacts QUALIFY {FIRST.format(k=D3_KEY)}"


@query("D3_hierarchical_dedup", f"SELECT _seq, full_name, email, institution_name, state, confidence_score FROM ({D3})")
def hierarchical_dedup(spark, d) -> DataFrame:
    return dedup.deduplicate_contacts(contacts(spark, d)).select("_seq", "full_name", "email", "institution_name", "state", "confidence_score")


@query("D3_dedup_report", f"SELECT b AS rows_before, a AS rows_after, b - a AS removed, round((b - a) * 100.0::DOUBLE / b, 1) AS removed_pct FROM (SELECT count(*) AS b FROM contacts), (SELECT count(*) AS a FROM ({D3}))")
def dedup_report(spark, d) -> DataFrame:
    return dedup.deduplication_report(contacts(spark, d), dedup.deduplicate_contacts(contacts(spark, d)))


@query("D3_strict_dedup", f"SELECT _seq, email FROM (SELECT * FROM contacts QUALIFY {FIRST.format(k=D3_KEY.replace("email IS NOT NULL", "email <> ''"))})")
def strict_dedup(spark, d) -> DataFrame:
    return dedup.deduplicate_contacts(contacts(spark, d), "strict").select("_seq", "email")


@query("H8_dedup_records", "SELECT _seq, institution_name FROM contacts QUALIFY row_number() OVER (PARTITION BY institution_name, CASE WHEN lower(trim(coalesce(email, ''))) <> '' THEN lower(trim(email)) ELSE lower(coalesce(full_name, '') || '_' || coalesce(title, '')) END ORDER BY _seq) = 1")
def dedup_records(spark, d) -> DataFrame:
    return dedup.deduplicate_records(contacts(spark, d), ["institution_name"]).select("_seq", "institution_name")


@query("T4_dedup_documents", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_documents(spark, d) -> DataFrame:
    """First document of each text: the same rule on a table of texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("_seq"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return common.first_per_key(docs, [F.col("h")]).select(F.col("_seq").alias("doc_id"))


MATCH = f"""SELECT n.*, coalesce(e._seq, m._seq) AS match_seq FROM (SELECT *, CASE WHEN email IS NOT NULL THEN {KEY_E} END AS pe, {NAME('full_name')} AS pn, {NAME('institution_name')} AS pi FROM contacts) n
LEFT JOIN (SELECT {KEY_E} AS ke, min(_seq) AS _seq FROM existing GROUP BY 1) e ON n.pe = e.ke
LEFT JOIN (SELECT {NAME('full_name')} AS kn, {NAME('institution_name')} AS ki, min(_seq) AS _seq FROM existing GROUP BY 1, 2) m ON n.pn = m.kn AND n.pi = m.ki"""


@query("D4_find_matches", f"SELECT _seq, match_seq FROM ({MATCH})")
def find_matches(spark, d) -> DataFrame:
    return dedup.find_matches(contacts(spark, d), view(spark, d, "existing")).select("_seq", F.col("match._seq").alias("match_seq"))


RANK = lambda c: f"CASE {c} WHEN 'valid' THEN 4 WHEN 'catch-all' THEN 3 WHEN 'unknown' THEN 2 WHEN 'invalid' THEN 1 ELSE 0 END"
DIFF = lambda c: f"(n.{c} IS NOT NULL AND n.{c} IS DISTINCT FROM o.{c})"
D6 = f"""SELECT n._seq, n.match_seq, CASE WHEN n.match_seq IS NULL THEN 'new' WHEN {DIFF('email')} OR {DIFF('title')} OR {DIFF('phone')}
  OR (n.email_status IS NOT NULL AND {RANK('n.email_status')} > {RANK("coalesce(o.email_status, 'unknown')")}) THEN 'update' ELSE 'duplicate' END AS class
FROM ({MATCH}) n LEFT JOIN existing o ON n.match_seq = o._seq"""


@query("D6_compare", f"SELECT _seq, match_seq, class FROM ({D6})")
def compare(spark, d) -> DataFrame:
    return dedup.compare_with_existing(contacts(spark, d), view(spark, d, "existing")).select("_seq", F.col("match._seq").alias("match_seq"), "class")


BETTER = f"(n.email_status IS NOT NULL AND {RANK('n.email_status')} >= {RANK('o.email_status')})"
FILL = lambda c: f"CASE WHEN n.{c} IS NOT NULL AND n.{c} <> '' AND (o.{c} IS NULL OR o.{c} = '') THEN n.{c} ELSE o.{c} END AS {c}"


@query(
    "D7_merge",
    f"""SELECT _seq, title, matched_role, email, phone, state, email_status, last_updated, record_source, CAST(least(100, score + CASE WHEN email_status = 'valid' THEN 10 WHEN email_status = 'catch-all' THEN -5 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END) AS INT) AS confidence_score
FROM (SELECT n._seq, coalesce(n.title, o.title) AS title, coalesce(n.matched_role, o.matched_role) AS matched_role, {FILL('email')}, {FILL('phone')}, {FILL('state')},
  CASE WHEN {BETTER} THEN n.email_status ELSE o.email_status END AS email_status, n.extracted_at AS last_updated, 'merged' AS record_source, n.confidence_score AS score
  FROM ({MATCH}) n JOIN existing o ON n.match_seq = o._seq JOIN ({D6}) c ON c._seq = n._seq WHERE c.class = 'update')""",
)
def merge(spark, d) -> DataFrame:
    found = dedup.compare_with_existing(contacts(spark, d), view(spark, d, "existing")).where("class = 'update'")
    return dedup.merge_matched(found).select("_seq", "title", "matched_role", "email", "phone", "state", "email_status", "last_updated", "record_source", "confidence_score")


# ---- enrichment


@query("R1_validate_emails", "SELECT c._seq, coalesce(v.status, 'unknown') AS status, coalesce(v.score, 40) AS score, coalesce(v.is_catchall, false) AS is_catchall, coalesce(v.is_disposable, false) AS is_disposable, coalesce(v.service, 'none') AS service FROM contacts c LEFT JOIN validations v ON c.email = v.email WHERE c.email IS NOT NULL AND c.email <> ''")
def validate_emails(spark, d) -> DataFrame:
    return enrich.validate_emails(contacts(spark, d).select("_seq", "email"), view(spark, d, "validations")).drop("email")


R2 = """SELECT c._seq, c.email, CASE WHEN c.email = '' THEN 'no_email' ELSE coalesce(v.status, 'unknown') END AS email_status, CASE WHEN c.email = '' THEN 0 ELSE coalesce(v.score, 0) END AS email_score,
  CASE WHEN c.email = '' THEN 'none' ELSE coalesce(v.service, 'none') END AS email_validation_service, coalesce(v.is_catchall, false) AS email_is_catchall, c.confidence_score FROM contacts c LEFT JOIN validations v ON c.email = v.email"""


@query("R2_lookup_join", f"SELECT _seq, email_status, CAST(email_score AS INT) AS email_score, email_validation_service, email_is_catchall FROM ({R2})")
def lookup_join(spark, d) -> DataFrame:
    return enrich.enrich_contacts(contacts(spark, d), view(spark, d, "validations")).select("_seq", "email_status", "email_score", "email_validation_service", "email_is_catchall")


@query("R3_not_validated", "SELECT _seq, 'not_validated' AS email_status, CAST(0 AS INT) AS email_score, confidence_score FROM contacts")
def not_validated(spark, d) -> DataFrame:
    return enrich.enrich_contacts(contacts(spark, d)).select("_seq", "email_status", "email_score", "confidence_score")


@query("R5_enrich", f"SELECT _seq, email_status, CAST(CASE WHEN email_status = 'valid' THEN least(100, confidence_score + 30) WHEN email_status = 'catch-all' THEN greatest(0, confidence_score - 20) ELSE confidence_score END AS INT) AS confidence_score FROM ({R2})")
def enrich_contacts(spark, d) -> DataFrame:
    return enrich.enrich_contacts(contacts(spark, d), view(spark, d, "validations")).select("_seq", "email_status", "confidence_score")


@query("R6_validation_summary", "SELECT total, with_email, valid, round(with_email * 100.0::DOUBLE / total, 1) AS coverage_pct, round(valid * 100.0::DOUBLE / with_email, 1) AS valid_pct FROM (SELECT count(*) AS total, count(*) FILTER (WHERE email <> '') AS with_email, count(*) FILTER (WHERE email_status = 'valid') AS valid FROM contacts)")
def validation_summary(spark, d) -> DataFrame:
    return enrich.validation_summary(contacts(spark, d))


@query("C4_found_emails", "SELECT _seq, CASE WHEN due THEN made ELSE email END AS email, CASE WHEN due THEN confidence_score + 20 ELSE confidence_score END AS confidence_score, CASE WHEN due THEN 'hunter_io' ELSE email_source END AS email_source FROM (SELECT *, 'found' || CAST(_seq AS VARCHAR) || '@x.org' AS made, (email IS NULL OR email = '') AND _seq % 4 = 0 AS due FROM contacts)")
def found_emails(spark, d) -> DataFrame:
    c = contacts(spark, d)
    found = c.where("_seq % 4 = 0").select("_seq", F.concat(F.lit("found"), F.col("_seq").cast("string"), F.lit("@x.org")).alias("found_email"))
    return enrich.found_emails(c, found).select("_seq", "email", "confidence_score", "email_source")


@query("C15_first_answer", "SELECT _seq, CASE WHEN _seq % 2 = 0 THEN 'b' WHEN _seq % 3 = 0 THEN 'a' WHEN _seq % 5 = 0 THEN 'c' END AS service FROM contacts")
def first_answer(spark, d) -> DataFrame:
    one = lambda n, s: F.when(F.col("_seq") % n == 0, F.struct(F.lit(s).alias("service")))
    return contacts(spark, d).select("_seq", enrich.first_answer(one(2, "b"), one(3, "a"), one(5, "c"))["service"].alias("service"))


M1 = """SELECT domain, CASE WHEN n >= 3 AND dots >= 0.6::DOUBLE * n THEN '.' WHEN n >= 3 AND lines >= 0.6::DOUBLE * n THEN '_' WHEN n >= 3 AND nones >= 0.6::DOUBLE * n THEN 'none' END AS pattern
FROM (SELECT domain, count(*) AS n, count(*) FILTER (WHERE contains(l, '.')) AS dots, count(*) FILTER (WHERE NOT contains(l, '.') AND contains(l, '_')) AS lines, count(*) FILTER (WHERE NOT contains(l, '.') AND NOT contains(l, '_')) AS nones
  FROM (SELECT domain, split_part(email, '@', 1) AS l FROM contacts WHERE email IS NOT NULL AND contains(email, '@')) GROUP BY domain)"""


@query("M1_email_pattern", M1)
def email_pattern(spark, d) -> DataFrame:
    return enrich.email_pattern(contacts(spark, d))


@query("M2_construct_email", "SELECT _seq, lower(first_name) || CASE _seq % 3 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE '' END || lower(last_name) || '@' || domain AS email FROM contacts")
def construct_email(spark, d) -> DataFrame:
    p = F.when(F.col("_seq") % 3 == 0, ".").when(F.col("_seq") % 3 == 1, "_").otherwise("none")
    return contacts(spark, d).select("_seq", enrich.construct_email(F.col("first_name"), F.col("last_name"), F.col("domain"), p).alias("email"))


@query("M3_fill_by_pattern", f"SELECT c._seq, CASE WHEN due THEN made ELSE email END AS email, CASE WHEN due THEN greatest(0, confidence_score - 30) ELSE confidence_score END AS confidence_score, due AS email_inferred FROM (SELECT c.*, lower(first_name) || CASE pattern WHEN '_' THEN '_' WHEN 'none' THEN '' ELSE '.' END || lower(last_name) || '@' || c.domain AS made, (email IS NULL OR email = '') AND pattern IS NOT NULL AS due FROM contacts c LEFT JOIN ({M1}) p ON c.domain = p.domain) c")
def fill_by_pattern(spark, d) -> DataFrame:
    return enrich.fill_by_pattern(contacts(spark, d)).select("_seq", "email", "confidence_score", "email_inferred")


# ---- statistics

N = lambda c: f"count(*) FILTER (WHERE {c})"
PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} * 100.0::DOUBLE / {b}, 1) ELSE 0.0::DOUBLE END"


@query("A1_state_breakdown", "SELECT state AS value, count(*) AS n FROM contacts WHERE state IS NOT NULL GROUP BY 1")
def state_breakdown(spark, d) -> DataFrame:
    return stats.state_breakdown(contacts(spark, d))


@query("A2_program_breakdown", f"SELECT program_type, n, {PCT('n', 'a')} AS pct FROM (SELECT program_type, count(*) AS n FROM contacts GROUP BY 1), (SELECT count(*) AS a FROM contacts)")
def program_breakdown(spark, d) -> DataFrame:
    return stats.program_breakdown(contacts(spark, d))


@query(
    "A3_email_quality",
    f"SELECT total, with_email, {PCT('with_email', 'total')} AS coverage_pct, valid + invalid + catch_all AS validated, "
    + ", ".join(f"{k}, {PCT(k, 'with_email')} AS {k}_pct" for k in ("valid", "catch_all", "invalid", "unknown"))
    + " FROM (SELECT count(*) AS total, count(email) AS with_email, "
    + ", ".join(f"{N(c)} AS {k}" for k, c in (("valid", "email_status = 'valid'"), ("catch_all", "email_status = 'catch-all'"), ("invalid", "email_status = 'invalid'"), ("unknown", "email_status = 'unknown'")))
    + " FROM contacts)",
)
def email_quality(spark, d) -> DataFrame:
    return stats.email_quality(contacts(spark, d))


@query("A4_service_usage", "SELECT email_validation_service AS value, count(*) AS n FROM contacts WHERE email_validation_service <> 'none' GROUP BY 1")
def service_usage(spark, d) -> DataFrame:
    return stats.service_usage(contacts(spark, d))


@query("A5_source_usage", "SELECT email_source AS value, count(*) AS n FROM contacts WHERE email_source IS NOT NULL GROUP BY 1")
def source_usage(spark, d) -> DataFrame:
    return stats.source_usage(contacts(spark, d))


@query(
    "A6_confidence_distribution",
    f"SELECT *, {PCT('high', 'total')} AS high_pct, {PCT('medium', 'total')} AS medium_pct, {PCT('low', 'total')} AS low_pct FROM (SELECT count(*) AS total, {N('s >= 75')} AS high, {N('s >= 50 AND s < 75')} AS medium, {N('s < 50')} AS low, round(avg(s), 1) AS avg_score, CAST(trunc(median(s)) AS INT) AS median_score, min(s) AS min_score, max(s) AS max_score FROM (SELECT confidence_score AS s FROM contacts))",
)
def confidence_distribution(spark, d) -> DataFrame:
    return stats.confidence_distribution(contacts(spark, d))


@query("A7_top_roles", "SELECT matched_role AS role, count(*) AS n FROM contacts WHERE matched_role IS NOT NULL GROUP BY 1 ORDER BY n DESC, min(_seq) LIMIT 10")
def top_roles(spark, d) -> DataFrame:
    return stats.top_roles(contacts(spark, d))


@query(
    "A8_success_rate",
    f"SELECT attempted, successful, attempted - successful AS failed, {PCT('successful', 'attempted')} AS rate_pct, avg_contacts, n_1_2, n_3_5, n_6_10, n_11_up FROM (SELECT count(*) AS successful, round(avg(n), 1) AS avg_contacts, {N('n <= 2')} AS n_1_2, {N('n BETWEEN 3 AND 5')} AS n_3_5, {N('n BETWEEN 6 AND 10')} AS n_6_10, {N('n >= 11')} AS n_11_up FROM (SELECT institution_name, count(*) AS n FROM contacts GROUP BY 1)), (SELECT count(*) AS attempted FROM targets)",
)
def success_rate(spark, d) -> DataFrame:
    return stats.success_rate(contacts(spark, d), view(spark, d, "targets"))


@query("A9_summary", "SELECT count(*) AS contacts, count(DISTINCT institution_name) AS institutions, round(count(*) / count(DISTINCT institution_name), 1) AS per_institution FROM contacts")
def summary(spark, d) -> DataFrame:
    return stats.summary(contacts(spark, d))


@query(
    "A11_console_quality",
    "SELECT *, " + ", ".join(f"{PCT(k, 'total')} AS {k}_pct" for k in ("with_email", "high", "medium", "low")) + f" FROM (SELECT count(*) AS total, {N("email IS NULL OR email <> ''")} AS with_email, {N('confidence_score >= 75')} AS high, {N('confidence_score >= 50 AND confidence_score < 75')} AS medium, {N('confidence_score < 50')} AS low FROM contacts)",
)
def console_quality(spark, d) -> DataFrame:
    return stats.console_quality(contacts(spark, d))


PROGRAMS = ("Law School", "Paralegal Program")


@query("A12_role_by_program", "SELECT r.role, p.program_type, count(c._seq) AS n FROM (SELECT 'Role ' || CAST(range AS VARCHAR) AS role FROM range(20)) r CROSS JOIN (VALUES ('Law School'), ('Paralegal Program')) p(program_type) LEFT JOIN contacts c ON c.matched_role = r.role AND c.program_type = p.program_type GROUP BY 1, 2")
def role_by_program(spark, d) -> DataFrame:
    catalog = spark.createDataFrame([(f"Role {i}", p) for i, p in itertools.product(range(20), PROGRAMS)], "role string, program_type string")
    return stats.role_by_program(contacts(spark, d), catalog)


@query("A12_tier_counts", f"SELECT tier, n, {PCT('n', 'a')} AS pct FROM (SELECT CASE WHEN confidence_score >= 75 THEN 'high' WHEN confidence_score >= 50 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM contacts GROUP BY 1), (SELECT count(*) AS a FROM contacts)")
def tier_counts(spark, d) -> DataFrame:
    from ..functions.scoring import confidence_level

    return stats.tier_counts(contacts(spark, d).withColumn("tier", confidence_level(F.col("confidence_score"))))


@query("A13_run_metrics", "SELECT contacts, institutions, round(contacts / institutions, 1) AS per_institution, round(contacts * 3600.0::DOUBLE / 120, 1) AS contacts_per_hour, round(institutions * 3600.0::DOUBLE / 120, 1) AS institutions_per_hour FROM (SELECT count(*) AS contacts, count(DISTINCT institution_name) AS institutions FROM contacts)")
def run_metrics(spark, d) -> DataFrame:
    return stats.run_metrics(contacts(spark, d), 120.0)


# ---- reports


@query(
    "W2_view_sizes",
    "SELECT sheet, CAST(n AS BIGINT) AS n FROM (SELECT count(*) AS \"All Contacts\", " + ", ".join(f'{N(c)} AS "{k}"' for k, c in (("Law School Contacts", "program_type = 'Law School'"), ("Paralegal Program Contacts", "program_type = 'Paralegal Program'"), ("High Confidence", "confidence_score >= 75"), ("Medium Confidence", "confidence_score >= 50 AND confidence_score < 75"), ("Needs Review", "confidence_score < 50"))) + " FROM contacts) UNPIVOT (n FOR sheet IN (COLUMNS(*)))",
)
def view_sizes(spark, d) -> DataFrame:
    return report.view_sizes(contacts(spark, d))


@query("W2_high_confidence", "SELECT _seq, confidence_score FROM contacts WHERE confidence_score >= 75")
def high_confidence(spark, d) -> DataFrame:
    return report.views(contacts(spark, d))["High Confidence"].select("_seq", "confidence_score")


def sql_rows(section: str, name: str, cols: list[str], first: bool) -> str:
    """The rows of a statistic: its first column names them, or each column is one."""
    text = lambda c: f"CAST({c} AS VARCHAR)"
    if first:
        return f"SELECT {lit(section)} AS section, {cols[0]} AS metric, concat_ws(', ', {', '.join(map(text, cols[1:]))}) AS value FROM ({ORACLES[name]})"
    return " UNION ALL ".join(f"SELECT {lit(section)} AS section, {lit(c)} AS metric, {text(c)} AS value FROM ({ORACLES[name]})" for c in cols)


def sql_statistics() -> str:
    parts = [
        ("summary", "A9_summary", ["contacts", "institutions", "per_institution"], False), ("states", "A1_state_breakdown", ["value", "n"], True), ("programs", "A2_program_breakdown", ["program_type", "n", "pct"], True),
        ("email_quality", "A3_email_quality", ["total", "with_email", "coverage_pct", "validated", "valid", "valid_pct", "catch_all", "catch_all_pct", "invalid", "invalid_pct", "unknown", "unknown_pct"], False),
        ("services", "A4_service_usage", ["value", "n"], True), ("sources", "A5_source_usage", ["value", "n"], True),
    ]
    return " UNION ALL ".join(sql_rows(*p) for p in parts)


@query("W3_statistics_rows", sql_statistics())
def statistics_rows(spark, d) -> DataFrame:
    """Of all sections those that other queries state in SQL alone."""
    s = stats.contact_statistics(contacts(spark, d), view(spark, d, "targets"))
    return report.statistics_rows({k: s[k] for k in ("summary", "states", "programs", "email_quality", "services", "sources")})


@query(
    "W4_scraping_log",
    """SELECT institution_name, arg_min(state, _seq) AS state, arg_min(program_type, _seq) AS program_type, arg_min(institution_url, _seq) AS institution_url, arg_min(extracted_at, _seq) AS extracted_at, count(*) AS contacts_found, 'Success' AS status FROM contacts GROUP BY 1
UNION ALL SELECT name, arg_min(state, _seq), arg_min(type, _seq), arg_min(url, _seq), 'N/A', 0, 'Failed' FROM targets WHERE name NOT IN (SELECT institution_name FROM contacts) GROUP BY name""",
)
def scraping_log(spark, d) -> DataFrame:
    return report.scraping_log(contacts(spark, d), view(spark, d, "targets"))


@query("S16_column_widths", "SELECT 'full_name' AS \"column\", CAST(least(greatest(max(length(full_name)), 9) + 2, 50) AS INT) AS width FROM contacts UNION ALL SELECT 'title', CAST(least(greatest(max(length(title)), 5) + 2, 50) AS INT) FROM contacts")
def column_widths(spark, d) -> DataFrame:
    return report.column_widths(contacts(spark, d).select("full_name", "title"))


# ---- targets


@query("T1_parse_listed", "SELECT _seq, listed, trim(regexp_extract(listed, '^(.+?)\\s*\\(\\d{4}\\)', 1)) AS name, 'ABA Approved (' || regexp_extract(listed, '\\((\\d{4})\\)', 1) || ')' AS accreditation_status FROM (SELECT _seq, name || ' (' || CAST(1900 + _seq % 100 AS VARCHAR) || ')' AS listed FROM targets)")
def parse_listed(spark, d) -> DataFrame:
    t = view(spark, d, "targets").select("_seq", F.concat("name", F.lit(" ("), (F.col("_seq") % 100 + 1900).cast("string"), F.lit(")")).alias("listed"))
    p = targets.parse_listed(F.col("listed"))
    return t.select("_seq", "listed", p["name"].alias("name"), p["accreditation_status"].alias("accreditation_status"))


@query("T4_dedup_targets", f"SELECT _seq, name FROM targets QUALIFY {FIRST.format(k='name')}")
def dedup_targets(spark, d) -> DataFrame:
    return targets.dedup_by_name(view(spark, d, "targets")).select("_seq", "name")


@query("T5_states_or_all", "SELECT _seq, state FROM targets WHERE upper(state) IN ('NATION_3', 'NATION_14') OR NOT EXISTS (SELECT 1 FROM targets WHERE upper(state) IN ('NATION_3', 'NATION_14'))")
def states_or_all(spark, d) -> DataFrame:
    return targets.filter_states_or_all(view(spark, d, "targets"), ["Nation_3", "nation_14"]).select("_seq", "state")


@query("T5_no_such_state", "SELECT _seq, state FROM targets")
def no_such_state(spark, d) -> DataFrame:
    return targets.filter_states_or_all(view(spark, d, "targets"), ["Atlantis"]).select("_seq", "state")


@query("T6_clean_targets", f"SELECT _seq, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN u ELSE '' END AS url FROM (SELECT _seq, name, {NORM_URL.format(c='url')} AS u FROM targets)")
def clean_targets(spark, d) -> DataFrame:
    return targets.clean_targets(view(spark, d, "targets")).select("_seq", "name", "url")


NAMES = list(targets.STATES)
STATE_OF = "[" + ", ".join(map(lit, NAMES)) + "][CAST(_seq % 50 AS INT) + 1]"
ABBR_OF = "[" + ", ".join(lit(v) for v in targets.STATES.values()) + "][CAST(_seq % 50 AS INT) + 1]"


@query("T9_filter_by_states", f"SELECT _seq, s AS state FROM (SELECT _seq, {STATE_OF} AS s, {ABBR_OF} AS a FROM contacts) WHERE lower(s) IN ('ny', 'texas', 'ca') OR lower(a) IN ('ny', 'texas', 'ca')")
def filter_by_states(spark, d) -> DataFrame:
    c = contacts(spark, d).select("_seq", F.get(F.array(*map(F.lit, NAMES)), (F.col("_seq") % 50).cast("int")).alias("state"))
    return targets.filter_by_states(c, ["NY", "Texas", "ca"])


@query("T10_align", "SELECT name, state, city, url, 'Paralegal Program' AS type, 'AAfPE Member' AS accreditation_status FROM targets")
def align(spark, d) -> DataFrame:
    return targets.align(view(spark, d, "targets"), ["name", "state", "city", "url", "type", "accreditation_status"], type="Paralegal Program", accreditation_status="AAfPE Member")


@query("T11_load_master", "SELECT _seq, name FROM targets WHERE source = 'ABA' AND upper(state) IN ('NATION_3', 'NATION_8', 'NATION_14')")
def load_master(spark, d) -> DataFrame:
    return targets.load_master(view(spark, d, "targets"), ["Nation_3", "nation_8", "NATION_14"], "law").select("_seq", "name")


@query("T12_all_targets", "SELECT name, state FROM targets UNION ALL SELECT institution_name, state FROM contacts")
def all_targets(spark, d) -> DataFrame:
    return targets.all_targets(None, [view(spark, d, "targets").select("name", "state"), contacts(spark, d).select(F.col("institution_name").alias("name"), "state")])


@query("T13_build_master", "SELECT row_number() OVER (ORDER BY type, name, state, city, url) AS institution_id, name, type, state, city, url, accreditation_status, CASE WHEN contains(type, 'Law School') THEN 'ABA' ELSE 'AAfPE' END AS source, '2024-01-01' AS last_updated FROM targets")
def build_master(spark, d) -> DataFrame:
    t = view(spark, d, "targets")
    return targets.build_master([t.where("type = 'Law School'"), t.where("type <> 'Law School'")], "2024-01-01")


@query("T14_coverage", f"SELECT field, present, {PCT('present', 'a')} AS pct FROM (SELECT 'state' AS field, count(state) AS present, count(*) AS a FROM existing UNION ALL SELECT 'email', count(email), count(*) FROM existing)")
def coverage(spark, d) -> DataFrame:
    return targets.coverage(view(spark, d, "existing"), ("state", "email"))


@query("T15_lookups", "SELECT _seq, 's' AS by FROM targets WHERE lower(state) = 'nation_8' UNION ALL SELECT _seq, 't' FROM targets WHERE contains(lower(type), 'law')")
def lookups(spark, d) -> DataFrame:
    t = view(spark, d, "targets")
    return targets.by_state(t, "Nation_8").select("_seq", F.lit("s").alias("by")).unionByName(targets.by_type(t, "Law").select("_seq", F.lit("t").alias("by")))


PLACES = ["Albany", "Boston", "Kent", "New Haven"]
ENDINGS = ["", " Law School", " University School of Law", " College of Law at X", " - Downtown"]
PLACE = "[" + ", ".join(map(lit, PLACES)) + "][CAST(_seq % 4 AS INT) + 1]"


@query("T16_normalize_school", f"SELECT _seq, {PLACE} AS short FROM targets")
def normalize_school(spark, d) -> DataFrame:
    """Places of targets with one of five endings, all of which go."""
    one = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("_seq") % len(values)).cast("int"))
    return view(spark, d, "targets").select("_seq", targets.normalize_school(F.concat(one(PLACES), one(ENDINGS))).alias("short"))


LOOKUP = [("Institution 7", "AA"), ("Institution 12", "BB"), ("Institution", "ZZ")]


@query("T17_lookup_state", "SELECT _seq, CASE name WHEN 'Institution 7' THEN 'AA' WHEN 'Institution 12' THEN 'BB' ELSE 'ZZ' END AS found_state FROM targets")
def lookup_state(spark, d) -> DataFrame:
    names = spark.createDataFrame(LOOKUP, "key string, state string")
    return targets.lookup_state(view(spark, d, "targets"), names, [(r"\.edu", "UU")]).select("_seq", "found_state")


@query("T19_enrich_states", "SELECT _seq, CASE WHEN due THEN CASE name WHEN 'Institution 7' THEN 'AA' WHEN 'Institution 12' THEN 'BB' ELSE 'ZZ' END ELSE state END AS state, CASE WHEN due THEN 'enriched' END AS outcome FROM (SELECT _seq, name, CASE WHEN _seq % 4 = 0 THEN NULL ELSE state END AS state, source = 'ABA' AND _seq % 4 = 0 AS due FROM targets)")
def enrich_states(spark, d) -> DataFrame:
    t = view(spark, d, "targets").withColumn("state", F.when(F.col("_seq") % 4 != 0, F.col("state")))
    return targets.enrich_states(t, spark.createDataFrame(LOOKUP, "key string, state string"), []).select("_seq", "state", "outcome")


def sql_variants(names: list[str]) -> str:
    r = f"(SELECT unnest([{', '.join(map(lit, names))}]) AS r)"
    swapped = [("Director", "Director"), ("Director", "Chair"), ("Director", "Coordinator")]
    parts = [f"SELECT r FROM {r}", f"SELECT 'Interim ' || r FROM {r}", f"SELECT 'Acting ' || r FROM {r}"]
    parts += [f"SELECT replace(r, 'Director', 'Co-{x}') FROM {r} WHERE contains(r, 'Director')" for _, x in swapped]
    parts += [f"SELECT replace(r, 'Chair', 'Co-Chair') FROM {r} WHERE contains(r, 'Chair') AND NOT contains(r, 'Director')"]
    parts += [f"SELECT replace(r, 'Coordinator', 'Co-Coordinator') FROM {r} WHERE contains(r, 'Coordinator') AND NOT contains(r, 'Director') AND NOT contains(r, 'Chair')"]
    return " UNION ".join(parts)


PREFIX = "CASE _seq % 4 WHEN 0 THEN 'Interim ' WHEN 1 THEN 'Acting ' ELSE '' END"
VARIED = f"{PREFIX} || CASE WHEN _seq % 7 = 0 THEN replace(title, 'Director', 'Co-Director') ELSE title END"


@query("T20_role_variants", f"SELECT _seq, v AS title FROM (SELECT _seq, program_type, {VARIED} AS v FROM contacts) WHERE (program_type = 'Law School' AND v IN ({sql_variants(LAW_ROLES)})) OR (program_type <> 'Law School' AND v IN ({sql_variants(PARALEGAL_ROLES)}))")
def role_variants(spark, d) -> DataFrame:
    """Contacts whose title, with a prefix or a shared office, is a form of one of their program's roles."""
    n = F.col("_seq")
    shared = F.when(n % 7 == 0, F.replace("title", F.lit("Director"), F.lit("Co-Director"))).otherwise(F.col("title"))
    c = contacts(spark, d).select("_seq", "program_type", F.concat(F.when(n % 4 == 0, "Interim ").when(n % 4 == 1, "Acting ").otherwise(""), shared).alias("title"))
    law = F.col("program_type") == "Law School"
    return c.where((law & F.col("title").isin(targets.role_variants(LAW_ROLES))) | (~law & F.col("title").isin(targets.role_variants(PARALEGAL_ROLES)))).select("_seq", "title")


# ---- state

GOOD = "success AND found > 0"
K1 = f"SELECT domain, {N('method = ' + lit('static') + ' AND ' + GOOD)} AS static_success, {N('method = ' + lit('static'))} AS static_total, {N('method = ' + lit('playwright') + ' AND ' + GOOD)} AS playwright_success, {N('method = ' + lit('playwright'))} AS playwright_total FROM request_log GROUP BY domain"


def request_log(spark, d) -> DataFrame:
    return view(spark, d, "request_log")


@query("K1_route_counters", K1)
def route_counters(spark, d) -> DataFrame:
    return state.route_counters(request_log(spark, d)).drop("last_method")


@query("K1_running_counters", "SELECT event_id, count(*) FILTER (WHERE method = 'static' AND success AND found > 0) OVER w AS static_success, count(*) FILTER (WHERE method = 'static') OVER w AS static_total FROM request_log WINDOW w AS (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_counters(spark, d) -> DataFrame:
    return state.running_route_counters(request_log(spark, d)).select("event_id", "static_success", "static_total")


#: Hosts with a history: their counters as they are, or with static or dynamic successes only.
HISTORY = f"SELECT 'host' || domain AS domain, CASE WHEN domain % 3 = 0 THEN static_total WHEN domain % 3 = 1 THEN 0 ELSE static_success END AS static_success, static_total, CASE WHEN domain % 3 = 1 THEN playwright_total ELSE playwright_success END AS playwright_success, playwright_total FROM ({K1})"
ROUTE_URL = "concat('https://host', CAST(page_id % 60 AS VARCHAR(10)), CASE page_id % 7 WHEN 0 THEN '/directory?x=1' WHEN 1 THEN '/about/staff' WHEN 2 THEN '/faculty' ELSE '/x' END)"


@query(
    "K2_route",
    f"""SELECT page_id, url, starts_with(reason, 'pattern_match:') OR reason = 'directory_keyword_suggests_playwright' OR starts_with(reason, 'domain_history:playwright') AS dynamic, reason
FROM (SELECT page_id, url, CASE {" ".join(f"WHEN regexp_matches(url, {lit(p)}) THEN {lit('pattern_match:' + p)}" for p in state.DYNAMIC)}
  WHEN domain IS NOT NULL AND rs > 0.7 AND static_total >= 3 THEN 'domain_history:static_rate=' || printf('%.1f%%', rs * 100) WHEN domain IS NOT NULL AND rs < 0.3 AND rp > 0.7 AND playwright_total >= 2 THEN 'domain_history:playwright_rate=' || printf('%.1f%%', rp * 100)
  WHEN {" OR ".join(f"regexp_matches(url, {lit(p)})" for p in state.STATIC)} THEN 'static_pattern_match' WHEN {" OR ".join(f"contains(url, {lit(w)})" for w in state.DIRECTORY_WORDS)} THEN 'directory_keyword_suggests_playwright' ELSE 'default_static_first' END AS reason
  FROM (SELECT page_id, {ROUTE_URL} AS url, page_id % 60 AS k FROM pages) p LEFT JOIN (SELECT *, static_success / nullif(static_total, 0) AS rs, playwright_success / nullif(playwright_total, 0) AS rp FROM ({HISTORY})) h ON h.domain = 'host' || k)""",
)
def route(spark, d) -> DataFrame:
    n, c = F.col("domain") % 3, state.route_counters(request_log(spark, d)).drop("last_method")
    c = c.withColumn("static_success", F.when(n == 0, F.col("static_total")).when(n == 1, 0).otherwise(F.col("static_success"))).withColumn("playwright_success", F.when(n == 1, F.col("playwright_total")).otherwise(F.col("playwright_success")))
    urls = spark.sql(f"SELECT page_id, {ROUTE_URL} AS url FROM {{p}}", p=table(spark, d, "pages"))
    return state.route(urls, c.withColumn("domain", F.concat(F.lit("host"), F.col("domain").cast("string"))))


@query(
    "K2_route_by_rules",
    "SELECT page_id, reason <> 'static_pattern_match' AND reason <> 'default_static_first' AS dynamic, reason FROM (SELECT page_id, CASE "
    + " ".join(f"WHEN regexp_matches(lower(u), {lit(p)}) THEN {lit('pattern_match:' + p)}" for p in state.DYNAMIC)
    + " WHEN " + " OR ".join(f"regexp_matches(lower(u), {lit(p)})" for p in state.STATIC) + " THEN 'static_pattern_match' WHEN " + " OR ".join(f"contains(lower(u), {lit(w)})" for w in state.DIRECTORY_WORDS)
    + " THEN 'directory_keyword_suggests_playwright' ELSE 'default_static_first' END AS reason FROM (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/directory?x=1' WHEN 1 THEN '/about/staff' WHEN 2 THEN '/faculty' WHEN 3 THEN '/contact' WHEN 4 THEN '#/people' ELSE '' END AS u FROM pages))",
)
def route_by_rules(spark, d) -> DataFrame:
    n = F.col("page_id") % 6
    more = F.when(n == 0, "/directory?x=1").when(n == 1, "/about/staff").when(n == 2, "/faculty").when(n == 3, "/contact").when(n == 4, "#/people").otherwise("")
    none = spark.createDataFrame([], "domain string, static_success bigint, static_total bigint, playwright_success bigint, playwright_total bigint")
    return state.route(table(spark, d, "pages").select("page_id", F.concat("url", more).alias("url")), none).select("page_id", "dynamic", "reason")


@query("K3_route_summary", f"SELECT count(*) AS domains, CAST(sum(static_success) AS BIGINT) AS static_success, CAST(sum(static_total) AS BIGINT) AS static_total, CAST(sum(playwright_success) AS BIGINT) AS playwright_success, CAST(sum(playwright_total) AS BIGINT) AS playwright_total, round(sum(static_success) / sum(static_total), 4) AS static_rate, round(sum(playwright_success) / sum(playwright_total), 4) AS playwright_rate FROM ({K1})")
def route_summary(spark, d) -> DataFrame:
    return state.route_summary(state.route_counters(request_log(spark, d)))


K5 = """WITH RECURSIVE e AS (SELECT domain, kind, status_code, ts, event_id, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS rn FROM request_log),
s AS (SELECT domain, CAST(0 AS BIGINT) AS rn, 2.0::DOUBLE AS delay, CAST(0 AS BIGINT) AS errors FROM (SELECT DISTINCT domain FROM e) UNION ALL
 SELECT s.domain, e.rn, CASE WHEN e.kind = 'success' THEN greatest(1.0::DOUBLE, s.delay * 0.9::DOUBLE) WHEN e.status_code IN (429, 503) THEN least(10.0::DOUBLE, s.delay * 2.0::DOUBLE) ELSE least(10.0::DOUBLE, s.delay * 1.5::DOUBLE) END,
 CASE WHEN e.kind = 'success' THEN 0 ELSE s.errors + 1 END FROM s JOIN e ON e.domain = s.domain AND e.rn = s.rn + 1)
SELECT domain, round(delay, 9) AS delay, errors FROM s QUALIFY row_number() OVER (PARTITION BY domain ORDER BY rn DESC) = 1"""


def recursive(sql: str) -> str:
    """A recursive query over the log, which cannot be named before it."""
    from .views import LOG

    return sql.replace("FROM request_log", f"FROM ({LOG})")


@query("K5_delay_state", recursive(K5))
def delay_state(spark, d) -> DataFrame:
    return state.delay_state(request_log(spark, d))


K6 = """WITH RECURSIVE e AS (SELECT domain, kind, status_code, ts, event_id, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) AS rn, lag(ts) OVER (PARTITION BY domain ORDER BY ts, event_id) AS last FROM request_log),
s AS (SELECT domain, CAST(0 AS BIGINT) AS rn, 2.0::DOUBLE AS delay FROM (SELECT DISTINCT domain FROM e) UNION ALL
 SELECT s.domain, e.rn, CASE WHEN e.kind = 'success' THEN greatest(1.0::DOUBLE, s.delay * 0.9::DOUBLE) WHEN e.status_code IN (429, 503) THEN least(10.0::DOUBLE, s.delay * 2.0::DOUBLE) ELSE least(10.0::DOUBLE, s.delay * 1.5::DOUBLE) END FROM s JOIN e ON e.domain = s.domain AND e.rn = s.rn + 1)
SELECT e.domain, e.event_id, round(s.delay, 9) AS delay, round(CASE WHEN e.last IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, s.delay - (epoch_us(e.ts) - epoch_us(e.last)) / 1e6::DOUBLE) END, 9) AS wait_s FROM e JOIN s ON s.domain = e.domain AND s.rn = e.rn - 1"""


@query("K6_wait_times", recursive(K6))
def wait_times(spark, d) -> DataFrame:
    return state.wait_times(request_log(spark, d)).select("domain", "event_id", "delay", "wait_s")


@query("K7_limiter_summary", f"SELECT *, round(total_delays / greatest(1, total_requests), 2) AS avg_delay_per_request FROM (SELECT count(*) AS total_requests, round(sum(wait_s), 1) AS total_delays, count(DISTINCT domain) AS domains_accessed FROM ({recursive(K6)})), (SELECT count(*) FILTER (WHERE errors > 0) AS domains_with_errors FROM ({recursive(K5)}))")
def limiter_summary(spark, d) -> DataFrame:
    return state.limiter_summary(request_log(spark, d))


@query("K8_sliding_timeout", "SELECT domain, event_id, load_s, CAST(greatest(8000, least(45000, floor(avg(load_s) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 2.5::DOUBLE * 1000))) AS INT) AS timeout_ms FROM request_log WHERE kind = 'success'")
def sliding_timeout(spark, d) -> DataFrame:
    return state.adaptive_timeouts(request_log(spark, d)).drop("ts")


@query("K9_backoff_runs", "SELECT domain, event_id, CAST(k AS INT) AS k, CAST(least(45000, floor(30000 * pow(1.5::DOUBLE, least(k, 4)))) AS INT) AS timeout_ms FROM (SELECT domain, event_id, row_number() OVER (PARTITION BY domain, island ORDER BY ts, event_id) AS k FROM (SELECT *, count(*) FILTER (WHERE kind = 'success') OVER (PARTITION BY domain ORDER BY ts, event_id) AS island FROM request_log) WHERE kind = 'timeout')")
def backoff_runs(spark, d) -> DataFrame:
    return state.backoff_runs(request_log(spark, d)).drop("ts")


@query("K11_timeout_summary", f"SELECT *, round(total_timeouts * 100.0::DOUBLE / greatest(1, total_requests), 1) AS timeout_rate FROM (SELECT count(*) AS total_requests, {N('kind = ' + lit('timeout'))} AS total_timeouts, {N('kind = ' + lit('http_error') + ' AND status_code IN (403, 404, 410, 451, 500, 502, 503)')} AS total_fast_fails, count(DISTINCT domain) AS domains_tracked FROM request_log)")
def timeout_summary(spark, d) -> DataFrame:
    return state.timeout_summary(request_log(spark, d))


@query("K11_domain_timeouts", "SELECT d.domain, coalesce(round(l.avg_load_s, 2), 0) AS avg_load_s, coalesce(l.samples, 0) AS samples, coalesce(t.n, 0) AS consecutive_timeouts FROM (SELECT DISTINCT domain FROM request_log) d LEFT JOIN (SELECT domain, avg(load_s) AS avg_load_s, count(*) AS samples FROM (SELECT * FROM request_log WHERE kind = 'success' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY 1) l ON l.domain = d.domain LEFT JOIN (SELECT domain, count(*) FILTER (WHERE kind = 'timeout') AS n FROM (SELECT *, count(*) FILTER (WHERE kind = 'success') OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS later FROM request_log) WHERE later = 0 GROUP BY 1) t ON t.domain = d.domain")
def domain_timeouts(spark, d) -> DataFrame:
    return state.domain_timeouts(request_log(spark, d))


@query("K12_remaining", "SELECT _seq, name FROM targets WHERE name NOT IN (SELECT institution_name FROM contacts WHERE program_type = 'Law School')")
def remaining(spark, d) -> DataFrame:
    done = contacts(spark, d).where("program_type = 'Law School'").select(F.col("institution_name").alias("name"))
    return state.remaining(view(spark, d, "targets"), done).select("_seq", "name")


@query("U4_pages_by_domain", "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1")
def pages_by_domain(spark, d) -> DataFrame:
    return table(spark, d, "pages").groupBy(domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query("X6_shared_addresses", f"SELECT {KEY_E} AS email_key, count(*) AS n FROM contacts GROUP BY 1 HAVING count(*) > 1")
def shared_addresses(spark, d) -> DataFrame:
    return contacts(spark, d).groupBy(normalize_email(F.col("email")).alias("email_key")).agg(F.count("*").alias("n")).where("n > 1")
