"""Queries of the page, role, source and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, pages, records, report, roles, state, targets
from ..operators.names import fill_missing_names
from ..sources.scratch import shared_path
from ..sources.tables import append_contacts, read_csv, replace_table, save_csv, write_by_source
from .expected import ROLE_TABLE, TARGET_TABLE
from .registry import query
from .relations import K1, K5, recursive
from .scalars import N8, OF_HEX, URLS, lit, named_title, rule_case, sql_named
from .views import HOST, MAIL, PERSON, PHONE, TITLE, table, view

# ---- pages

A = r"""regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)"""


def web(spark, d) -> DataFrame:
    """The derived pages as a table of their own, as pages are: many expressions read their markup."""
    path = shared_path(spark, "web")
    view(spark, d, "web_pages").write.parquet(path)
    return spark.read.parquet(path)


def per_kind(values: list) -> str:
    """SQL of a value by the kind of a page of ``web_pages``."""
    return "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


CARDS = "(5 + page_id % 3)"  # of a team page


@query(
    "P5_link_features",
    f"SELECT page_id, CAST({per_kind([2, 0, 1, 0, 0, 5, 0, 1])} AS INT) AS person_links, CAST({per_kind([1, 1, 0, 0, 0, 1, 0, 0])} AS INT) AS mailto_links, "
    f"CAST({per_kind([0, 0, 0, 1, 0, 0, CARDS, 0])} AS INT) AS contact_blocks, CAST({per_kind([0, 0, 0, 0, 0, 1, CARDS, 0])} AS INT) AS person_blocks, page_id % 8 IN (0, 1, 2, 5, 7) AS has_links FROM web_pages",
)
def link_features(spark, d) -> DataFrame:
    p = web(spark, d).withColumn("f", pages.page_features(F.col("html"))).withColumn("l", pages.page_links(F.col("html"), F.col("url")))
    return p.select("page_id", "f.person_links", "f.mailto_links", "f.contact_blocks", "f.person_blocks", (F.size("l") > 0).alias("has_links"))


#: By the rules: points of the URL, of the page's parts and of its links, by type; the best.
KINDS = ["directory_listing", "individual_profile", "homepage", "contact_form", "individual_profile", "portal", "directory_listing", "individual_profile"]
P7 = f"SELECT page_id, {per_kind([lit(k) for k in KINDS])} AS page_type, CAST({per_kind([125, 130, 70, 70, 15, -100, 140, 15])} AS INT) AS confidence, page_id % 8 = 5 AS excluded, page_id % 8 IN (0, 6) AS is_directory, page_id % 8 = 1 AS is_profile FROM web_pages"


@query("P7_classify_pages", P7)
def classify_pages(spark, d) -> DataFrame:
    return pages.classify(web(spark, d)).select("page_id", "page_type", "confidence", "excluded", "is_directory", "is_profile")


HOME = "CASE WHEN regexp_matches(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*(/|/index.html|/index.php)?([?#].*)?$') THEN {} END"
WORDS = r"len([x FOR x IN regexp_split_to_array(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\s+') IF x <> ''])"
OWN = f"15 + CASE WHEN {WORDS} BETWEEN 2 AND 4 THEN 15 ELSE 0 END"


@query(
    "P7_classify_prose",
    f"""SELECT page_id, CASE WHEN kind IS NULL OR (kind <> 'individual_profile' AND own > score) THEN 'individual_profile' ELSE kind END AS page_type, CAST(CASE WHEN kind IS NULL THEN own WHEN kind = 'individual_profile' THEN score + own ELSE greatest(score, own) END AS INT) AS confidence
FROM (SELECT page_id, {rule_case('lower(u)', [(p, lit(t)) for p, t, _ in pages.PAGE_RULES], HOME.format("'homepage'"))} AS kind, {rule_case('lower(u)', [(p, s) for p, _, s in pages.PAGE_RULES], HOME.format(70))} AS score, {OWN} AS own
  FROM (SELECT p.html, x.page_id, x.u FROM ({URLS.format(pages='pages')}) x JOIN pages p ON p.page_id = x.page_id))""",
)
def classify_prose(spark, d) -> DataFrame:
    """Pages of prose at addresses of all kinds: a heading of a few words and few links to persons speak for a profile."""
    p = table(spark, d, "pages")
    at = spark.sql(URLS.replace("{pages}", "{p}"), p=p).withColumnRenamed("page_id", "__id")
    named = p.join(at, F.col("page_id") == F.col("__id")).select("page_id", F.col("u").alias("url"), "html")
    return pages.classify(named).select("page_id", "page_type", "confidence")


@query("P10_counts_by_type", f"SELECT page_type, count(*) AS n FROM ({P7}) GROUP BY 1")
def counts_by_type(spark, d) -> DataFrame:
    return pages.classify(web(spark, d)).groupBy("page_type").agg(F.count("*").alias("n"))


@query("H10_contact_content", f"SELECT page_id, page_id % 8 = 6 AND {CARDS} > 5 AS has, page_id % 8 <> 6 AS lacks FROM web_pages")
def contact_content(spark, d) -> DataFrame:
    p = web(spark, d).withColumn("c", pages.has_contact_content(pages.page_features(F.col("html"))))
    return p.select("page_id", "c.has", "c.lacks")


@query("L1_page_links", f"SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest({A}) AS href FROM pages) GROUP BY 1")
def page_links(spark, d) -> DataFrame:
    return pages.links_of(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"))


L1 = f"""SELECT page_id, concat({HOST}, '/profile/p', page_id + 1) AS url, 100 AS score FROM web_pages WHERE page_id % 8 = 0
UNION ALL SELECT page_id, concat({HOST}, '/faculty-directory'), 100 FROM web_pages WHERE page_id % 8 = 2 UNION ALL SELECT page_id, concat({HOST}, '/administration/staff?x=', page_id), 50 FROM web_pages WHERE page_id % 8 = 2"""


@query("L1_directory_pages", L1)
def directory_pages(spark, d) -> DataFrame:
    return pages.directory_pages(pages.links_of(web(spark, d)), most=5).select("page_id", "url", "score")


@query("L2_directories_or_home", f"{L1} UNION ALL SELECT page_id, url, 0 FROM web_pages WHERE page_id % 8 NOT IN (0, 2)")
def directories_or_home(spark, d) -> DataFrame:
    p = web(spark, d)
    return pages.directories_or_home(p, pages.links_of(p)).select("page_id", "url", "score")


@query("L4_profile_links", f"SELECT page_id, concat({HOST}, {per_kind([f"concat('/profile/p', page_id + 1)", "''", "'/faculty-directory'", "''", "''", "'/grades'", "''", "''"])}) AS url, CAST({per_kind([100, 0, 50, 0, 0, 40, 0, 0])} AS INT) AS score FROM web_pages WHERE page_id % 8 IN (0, 2, 5)")
def profile_links(spark, d) -> DataFrame:
    return pages.profile_links(pages.links_of(web(spark, d))).select("page_id", "url", "score")


@query("L6_link_context", "SELECT page_id, href AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS href FROM pages)")
def link_context(spark, d) -> DataFrame:
    """The text around each link; here each stands alone in its list item, so it is the link's own."""
    return pages.links_of(table(spark, d, "pages")).select("page_id", F.col("context").alias("text"))


@query("L5_dedup_links", "SELECT split_part(url, '#', 1) AS url, max(page_id % 7) AS score FROM pages GROUP BY 1")
def dedup_links(spark, d) -> DataFrame:
    links = table(spark, d, "pages").select("url", (F.col("page_id") % 7).alias("score"), F.col("page_id").alias("ord"))
    return pages.deduplicate_links(links).select(F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), "score")


@query("L7_link_summary", f"SELECT count(*) AS links, count(DISTINCT page_id) AS pages, round(count(*) / count(DISTINCT page_id), 1) AS per_page FROM (SELECT page_id, unnest({A}) AS href FROM pages)")
def link_summary(spark, d) -> DataFrame:
    return pages.link_summary(pages.links_of(table(spark, d, "pages")))


#: A page's contacts: what each card, row or section shows. A title needs a word of a job.
JOB = f"CASE WHEN regexp_matches(lower({TITLE}), '{'|'.join(pages.JOB_WORDS)}') THEN {TITLE} ELSE '' END"
H7 = f"""
SELECT page_id, 0 AS ord, {PERSON} AS full_name, {JOB} AS title, {MAIL} AS email, {PHONE} AS phone FROM web_pages WHERE page_id % 8 = 0
UNION ALL SELECT page_id, 1, 'Second Person', 'Dean of Students', '', '' FROM web_pages WHERE page_id % 8 = 0
UNION ALL SELECT page_id, 2, 'Third Person', '', '', '' FROM web_pages WHERE page_id % 8 = 0
UNION ALL SELECT page_id, 0, {PERSON}, concat({TITLE}, ' | Lecturer'), {MAIL}, {PHONE} FROM web_pages WHERE page_id % 8 = 1
UNION ALL SELECT page_id, 0, '', '', {OF_HEX}, '' FROM web_pages WHERE page_id % 8 = 3
UNION ALL SELECT page_id, 0, {PERSON}, '', {MAIL}, '' FROM web_pages WHERE page_id % 8 IN (4, 5)
UNION ALL SELECT page_id, unnest(range({CARDS})), {PERSON}, 'Reference Librarian', '', '' FROM web_pages WHERE page_id % 8 = 6
"""


@query("H7_page_contacts", f"SELECT page_id, CAST(ord AS INT) AS ord, full_name, title, email, phone, split_part(full_name, ' ', 1) AS first_name, split_part(full_name, ' ', 2) AS last_name FROM ({H7})")
def page_contacts(spark, d) -> DataFrame:
    return pages.contacts_of(web(spark, d), ["page_id"]).select("page_id", "ord", "full_name", "title", "email", "phone", "first_name", "last_name")


@query("H1_sections_of_pages", f"SELECT page_id, count(*) AS sections FROM ({H7}) GROUP BY 1")
def sections_of_pages(spark, d) -> DataFrame:
    return pages.contacts_of(web(spark, d), ["page_id"]).groupBy("page_id").agg(F.count("*").alias("sections"))


@query("T8_directory_programs", f"""SELECT concat('A College ', page_id) AS name, concat('https://a', page_id, '.edu/x') AS url, 'California' AS state, 'paralegal' AS program_type FROM web_pages WHERE page_id % 8 = 7
UNION ALL SELECT 'B', 'https://b.edu', 'California', 'paralegal' FROM web_pages WHERE page_id % 8 = 7 UNION ALL SELECT 'D', concat({HOST}, '/d'), 'Ohio', 'paralegal' FROM web_pages WHERE page_id % 8 = 7""")
def directory_programs(spark, d) -> DataFrame:
    return targets.directory_programs(web(spark, d))


#: From a directory, a table and a portal: the portal is excluded, and the directory's profile is followed.
H9 = f"SELECT * FROM ({H7}) WHERE page_id % 8 IN (0, 1, 4)"


def followed(spark, d) -> DataFrame:
    p = web(spark, d)
    return pages.follow(p, p.where("page_id % 8 IN (0, 4, 5)").select("url"))


@query("H9_follow_links", f"SELECT page_id, CAST(ord AS INT) AS ord, full_name, title, email, phone FROM ({H9})")
def follow_links(spark, d) -> DataFrame:
    """Contacts of pages to start from, unless they are excluded, and of the profiles that directories among them link to."""
    return followed(spark, d).select("page_id", "ord", "full_name", "title", "email", "phone")


@query("L8_profile_fanout", "SELECT page_id, url FROM web_pages p WHERE page_id % 8 = 1 OR (page_id % 8 = 0 AND EXISTS (SELECT 1 FROM pages q WHERE q.page_id = p.page_id + 2))")
def profile_fanout(spark, d) -> DataFrame:
    """Pages reached as profiles from any page's best twenty links: profiles, and the directory that home pages link to."""
    p = web(spark, d)
    links = pages.profile_links(pages.links_of(p), least=35, most=20).select(F.col("url").alias("u")).distinct()
    return p.join(links, F.col("url") == F.col("u"), "left_semi").select("page_id", "url")


# ---- roles


def contacts(spark, d) -> DataFrame:
    return view(spark, d, "contacts")


LAW = "(program_type = 'Law School')"
MATCHED = f"SELECT c.*, r.role, coalesce(r.score, 0) AS score, coalesce(r.points, 0) AS points, coalesce(r.others, '') AS others FROM contacts c LEFT JOIN {ROLE_TABLE} r ON r.title = c.title AND r.law = {LAW}"
AIMED = f"SELECT c.*, t.role, coalesce(t.score, 0) AS score, t.kind, t.why FROM contacts c LEFT JOIN {TARGET_TABLE} t ON t.title = c.title AND t.law = {LAW}"


@query("F13_match_roles", f"SELECT _seq, title, role AS matched_role, score AS title_match_score, points AS title_points, others FROM ({MATCHED})")
def match_roles(spark, d) -> DataFrame:
    m = roles.match_roles(contacts(spark, d), roles.catalog(spark))
    return m.select("_seq", "title", "matched_role", "title_match_score", "title_points", F.array_join("all_matched_roles", "|").alias("others"))


@query("F14_exact_roles", "SELECT _seq, CAST(100 AS INT) AS title_match_score FROM contacts WHERE (program_type = 'Law School' AND title IN (" + ", ".join(map(lit, roles.LAW_ROLES)) + ")) OR (program_type <> 'Law School' AND title IN (" + ", ".join(map(lit, roles.PARALEGAL_ROLES)) + "))")
def exact_roles(spark, d) -> DataFrame:
    """Titles that are a role of their program match in full, that role or an earlier one that contains it."""
    catalog = roles.catalog(spark).select("law", "role")
    m = roles.match_roles(contacts(spark, d), roles.catalog(spark)).withColumn("__law", F.col("program_type") == "Law School")
    exact = m.join(catalog, (F.col("title") == F.col("role")) & (F.col("__law") == F.col("law")), "left_semi")
    return exact.select("_seq", "title_match_score")


@query("F15_match_targets", f"SELECT _seq, title, role AS target_role, score AS match_score, kind AS match_type, why AS match_explanation FROM ({AIMED})")
def match_targets(spark, d) -> DataFrame:
    return roles.match_targets(contacts(spark, d), roles.target_catalog(spark)).select("_seq", "title", "target_role", "match_score", "match_type", "match_explanation")


@query("F16_exact_targets", "SELECT _seq, title AS target_role, CAST(100 AS INT) AS match_score FROM contacts WHERE (program_type = 'Law School' AND title IN (" + ", ".join(map(lit, roles.LAW_TARGETS)) + ")) OR (program_type <> 'Law School' AND title IN (" + ", ".join(map(lit, roles.PARALEGAL_TARGETS)) + "))")
def exact_targets(spark, d) -> DataFrame:
    m = roles.match_targets(contacts(spark, d), roles.target_catalog(spark))
    return m.where("match_type = 'Exact'").select("_seq", "target_role", "match_score")


W7 = f"""SELECT * FROM (SELECT *, score * 0.5::DOUBLE + coalesce(TRY_CAST(nullif(regexp_extract(notes, 'Confidence:\\s*(\\d+)', 1), '') AS INT), 50) * 0.3::DOUBLE + CASE WHEN email IS NOT NULL THEN 100 ELSE 0 END * 0.2::DOUBLE AS p FROM ({AIMED}) WHERE role IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY email ORDER BY p DESC, _seq) = 1"""
TIER = "CASE WHEN p >= 90 THEN 'High' WHEN p >= 75 THEN 'Medium' ELSE 'Low' END"


@query("W7_filter_by_roles", f"SELECT _seq, role AS target_role, score AS match_score, kind AS match_type, round(p, 1) AS priority_score, {TIER} AS priority_tier FROM ({W7})")
def filter_by_roles(spark, d) -> DataFrame:
    return roles.filter_by_roles(contacts(spark, d), roles.target_catalog(spark)).select("_seq", "target_role", "match_score", "match_type", "priority_score", "priority_tier")


@query("W5_role_view", f'SELECT title AS "Title / Role", role AS "Target Role", score AS "Match Score", {TIER} AS "Priority Tier" FROM ({W7})')
def role_view(spark, d) -> DataFrame:
    f = roles.filter_by_roles(contacts(spark, d), roles.target_catalog(spark))
    named = f.select(F.col("target_role").alias("Target Role"), F.col("match_score").alias("Match Score"), F.col("title").alias("Title / Role"), F.col("priority_tier").alias("Priority Tier"))
    return report.in_column_order(report.role_view(named))


# ---- sources


@query("S5_fill_names", f'SELECT _seq, CASE WHEN _seq % 2 = 0 AND _seq % 8 <> 7 THEN {sql_named(1)} WHEN _seq % 2 = 1 THEN first_name END AS "First Name", CASE WHEN _seq % 2 = 0 AND _seq % 8 <> 7 THEN {sql_named(2)} WHEN _seq % 2 = 1 THEN last_name END AS "Last Name" FROM contacts')
def fill_names(spark, d) -> DataFrame:
    """A sheet whose every second row lacks its names."""
    odd = F.col("_seq") % 2 == 1
    c = contacts(spark, d).select("_seq", F.when(odd, F.col("first_name")).alias("First Name"), F.when(odd, F.col("last_name")).alias("Last Name"), named_title(F.col("_seq")).alias("Title / Role"))
    return fill_missing_names(c).drop("Title / Role")


@query("S1_csv_round_trip", "SELECT CAST(_seq AS VARCHAR) AS _seq, full_name, title, state FROM contacts")
def csv_round_trip(spark, d) -> DataFrame:
    path = save_csv(contacts(spark, d).select("_seq", "full_name", "title", "state"), shared_path(spark, "csv"), "contacts")
    return read_csv(spark, path)


@query("S11_append", "SELECT _seq, full_name FROM contacts")
def append(spark, d) -> DataFrame:
    path, c = shared_path(spark, "append"), contacts(spark, d).select("_seq", "full_name")
    for part in (c.where("_seq % 2 = 0"), c.where("_seq % 2 = 1"), c.where("false")):
        append_contacts(part, path)
    return spark.read.parquet(path)


@query("K4_stored_counters", K1)
def stored_counters(spark, d) -> DataFrame:
    """Two runs, the second of which finds the counters that the first has left."""
    path, log = shared_path(spark, "counters"), view(spark, d, "request_log")
    late = F.col("method") == "playwright"
    replace_table(state.add_counters(state.route_counters(log.where(~late))), path)
    replace_table(state.add_counters(spark.read.parquet(path), state.route_counters(log.where(late))), path)
    return spark.read.parquet(path)


@query("S12_by_source", "SELECT source, count(*) AS n FROM targets GROUP BY 1")
def by_source(spark, d) -> DataFrame:
    path = shared_path(spark, "by-source")
    write_by_source(view(spark, d, "targets"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


# ---- streams


def log_stream(spark, d) -> DataFrame:
    """The request log as a stream of its file."""
    from .views import LOG

    path = shared_path(spark, "log")
    spark.sql(LOG.replace("FROM events", "FROM {e}"), e=table(spark, d, "events")).repartitionByRange(1, "event_id").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _last(spark, updates, path: str) -> DataFrame:
    from ..streaming.domains import latest

    q = latest(updates, path, f"{path}-state")
    q.awaitTermination()
    rows = spark.read.parquet(path)
    newest = rows.groupBy("domain").agg(F.max("batch").alias("__b")).withColumnRenamed("domain", "__d")
    return rows.join(newest, (F.col("domain") == F.col("__d")) & (F.col("batch") == F.col("__b"))).drop("__d", "__b", "batch")


@query("K5_delay_stream", recursive(K5))
def delay_stream(spark, d) -> DataFrame:
    from ..streaming.domains import delays

    return _last(spark, delays(log_stream(spark, d)), shared_path(spark, "delays")).withColumn("delay", F.round("delay", 9))


K8 = """SELECT d.domain, CAST(least(45000, floor(coalesce(l.current, 30000) * pow(1.5::DOUBLE, least(coalesce(t.n, 0), 8)))) AS INT) AS timeout_ms, coalesce(t.n, 0) AS consecutive FROM (SELECT DISTINCT domain FROM request_log) d
LEFT JOIN (SELECT domain, greatest(8000, least(45000, floor(fsum(load_s) / count(*) * 2.5::DOUBLE * 1000))) AS current FROM (SELECT * FROM request_log WHERE kind = 'success' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY 1) l ON l.domain = d.domain
LEFT JOIN (SELECT domain, count(*) FILTER (WHERE kind = 'timeout') AS n FROM (SELECT *, count(*) FILTER (WHERE kind = 'success') OVER (PARTITION BY domain ORDER BY ts DESC, event_id DESC) AS later FROM request_log) WHERE later = 0 GROUP BY 1) t ON t.domain = d.domain"""


@query("K8_timeout_stream", K8)
def timeout_stream(spark, d) -> DataFrame:
    from ..streaming.domains import timeouts

    return _last(spark, timeouts(log_stream(spark, d)), shared_path(spark, "timeouts"))


@query("S11_append_stream", "SELECT event_id, domain, kind FROM request_log")
def append_stream(spark, d) -> DataFrame:
    from ..streaming.domains import append_contacts as stream

    path = shared_path(spark, "appended")
    stream(log_stream(spark, d), path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).select("event_id", "domain", "kind")


# ---- all of it


SCHOOL = "concat('School ', page_id - page_id % 8)"
HAS = "CASE WHEN {} <> '' THEN {} ELSE 0 END"
SCORED = f"""SELECT *, CAST(least(100, {HAS.format('email', 40)} + {HAS.format('phone', 10)} + CASE WHEN score >= 90 THEN 20 WHEN score >= 70 THEN 10 ELSE 0 END) AS INT) AS confidence
FROM (SELECT c.*, coalesce(r.role, '') AS role, coalesce(r.score, 0) AS score, replace(coalesce(r.others, ''), '|', ',') AS others FROM ({H7}) c LEFT JOIN {ROLE_TABLE} r ON r.title = c.title AND r.law = (page_id % 16 < 8))"""
KEPT = f"SELECT * FROM ({SCORED}) WHERE NOT (confidence < 50 AND email = '' AND score < 90)"
#: Each distinct title of a page, normalised as contacts' titles are.
NORMALIZED = N8.replace("FROM contacts", f"FROM (SELECT DISTINCT title AS _seq, title FROM ({H7})) contacts")


@query(
    "H7_contact_records",
    f"""SELECT page_id, CAST(ord AS INT) AS ord, {SCHOOL} AS institution_name, {HOST} AS institution_url, 'Ohio' AS state, CASE WHEN page_id % 16 < 8 THEN 'Law School' ELSE 'Paralegal Program' END AS program_type, split_part(full_name, ' ', 1) AS first_name, split_part(full_name, ' ', 2) AS last_name,
  full_name, title, CASE WHEN n.should_exclude THEN title ELSE n.normalized END AS title_normalized, CASE WHEN n.should_exclude THEN '' ELSE n.modifiers END AS title_modifiers, NOT n.should_exclude AND n.is_temporary AS is_temporary, NOT n.should_exclude AND n.is_shared_role AS is_shared_role,
  role AS matched_role, others AS all_matched_roles, email, phone, confidence AS confidence_score, score AS title_match_score, 'website_scrape' AS extraction_method, {HOST} AS source_url, '2024-01-01 00:00:00' AS extracted_at
FROM ({KEPT}) c JOIN ({NORMALIZED}) n ON n._seq = c.title""",
)
def contact_records(spark, d) -> DataFrame:
    """The full records of all pages, whose sites are law schools and paralegal programs in turn."""
    site = F.col("page_id") - F.col("page_id") % 8
    host = F.concat(F.lit("https://law"), site.cast("string"), F.lit(".example.edu"))
    found = pages.contacts_of(web(spark, d), ["page_id"])
    named = found.select("page_id", "ord", "full_name", "title", "email", "phone", F.concat(F.lit("School "), site.cast("string")).alias("institution_name"), host.alias("institution_url"), F.lit("Ohio").alias("state"), F.when(F.col("page_id") % 16 < 8, "Law School").otherwise("Paralegal Program").alias("program_type"))
    return records.contact_records(named, roles.catalog(spark), "2024-01-01 00:00:00", keep=("page_id", "ord"))


@query("Z1_contact_run", f"SELECT page_id, full_name, title, email, role AS matched_role, confidence AS confidence_score FROM (SELECT * FROM ({KEPT}) WHERE page_id % 8 IN (0, 1, 4)) WHERE email <> '' UNION ALL SELECT min(page_id), arg_min(full_name, page_id), arg_min(title, page_id), '', arg_min(role, page_id), CAST(arg_min(confidence, page_id) AS INT) FROM ({KEPT}) WHERE page_id % 8 IN (0, 1, 4) AND email = '' HAVING count(*) > 0")
def contact_run(spark, d) -> DataFrame:
    """From pages to deduplicated, scored contacts: all without an address count as one, as an empty one is an address."""
    path = shared_path(spark, "found")
    followed(spark, d).write.parquet(path)  # pages are parsed once, though contacts and their distinct titles are both read
    found = spark.read.parquet(path)
    law = F.when(F.col("page_id") % 16 < 8, "Law School").otherwise("Paralegal Program")
    scored = records.score_contacts(found.withColumn("program_type", law), roles.catalog(spark)).withColumn("_seq", F.col("page_id") * 1000 + F.col("ord"))
    kept = dedup.deduplicate_contacts(scored.withColumn("institution_name", F.lit("")))
    return kept.select("page_id", "full_name", "title", "email", F.coalesce("matched_role", F.lit("")).alias("matched_role"), "confidence_score")
