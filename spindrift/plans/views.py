"""The tables that queries run on, derived from the star schema by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Made-up titles that use every rule of the title operators.
TITLES = [
    "Law Library Director", "Dir. of Legal Writing", "Assoc. Dean for Academic Affairs", "Interim Library Director", "Professor of Law",
    "Co-Director of Clinical Programs", "Senior Reference Librarian", "Paralegal Program Director", "Director, Paralegal Studies", "Program Coordinator",
    "Dean Emeritus", "Student Worker", "Visiting Professor", "Assistant to the Dean", "Head of Reference (Adjunct)", "IT Director - Law School",
    "Acting Chair, Legal Studies", "Legal Studies Instructor", "Director of Experiential Learning, J.D.", "Dept. Chair", "Technology Librarian",
    "Prof. of Clinical Law", "Chief Information Officer", "Workforce Development Dean", "Legal Writing Program Director", "Admin. Asst.",
    "Registrar", "Joint Head Librarian", "Academic Success Director", "Asst. Dir. Law Library",
]


def _pick(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CONTACTS = f"""
SELECT CAST(c_custkey AS BIGINT) AS _seq, c_name AS full_name, concat('First', CAST(c_custkey % 53 AS VARCHAR(10))) AS first_name, concat('Last', CAST(c_custkey % 211 AS VARCHAR(10))) AS last_name,
  n_name AS state, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Law School' ELSE 'Paralegal Program' END AS program_type,
  concat('Institution ', CAST(c_custkey % 97 AS VARCHAR(10))) AS institution_name, concat('https://inst', CAST(c_custkey % 97 AS VARCHAR(10)), '.example.edu') AS institution_url,
  {_pick("c_custkey % 30", TITLES)} AS title,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 2 = 1 THEN upper(concat('user.', CAST(c_custkey % 400 AS VARCHAR(10)), '@host', CAST(c_custkey % 7 AS VARCHAR(10)), '.edu'))
    ELSE concat('user.', CAST(c_custkey % 400 AS VARCHAR(10)), '@host', CAST(c_custkey % 7 AS VARCHAR(10)), '.edu') END AS email,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE concat('(555) ', CAST(100 + c_custkey % 900 AS VARCHAR(10)), '-', CAST(1000 + c_custkey % 9000 AS VARCHAR(10))) END AS phone,
  CAST((c_custkey * 37) % 101 AS INT) AS confidence_score, CAST((c_custkey * 53) % 101 AS INT) AS title_match_score,
  {_pick("c_custkey % 6", ["valid", "catch-all", "unknown", "invalid", "no_email"])} AS email_status,
  (c_custkey % 6 = 1) AS email_is_catchall, {_pick("c_custkey % 4", ["neverbounce", "zerobounce", "none", "hunter"])} AS email_validation_service,
  {_pick("c_custkey % 3", ["website_scrape", "hunter_io"])} AS email_source, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('Role ', CAST(c_custkey % 17 AS VARCHAR(10))) END AS matched_role,
  concat('host', CAST(c_custkey % 7 AS VARCHAR(10)), '.edu') AS domain, concat('Notes. Confidence: ', CAST(c_custkey % 100 AS VARCHAR(10))) AS notes,
  concat('2024-01-', CAST(10 + c_custkey % 20 AS VARCHAR(10)), ' 00:00:00') AS extracted_at
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

#: An older state of every second contact: some with another title or phone, some of another name, some never seen again.
EXISTING = f"""
SELECT _seq, full_name, first_name, last_name, CASE WHEN _seq % 3 = 0 THEN NULL ELSE state END AS state, program_type, institution_name, institution_url,
  CASE WHEN _seq % 7 = 0 THEN 'Former Title' ELSE title END AS title, email, CASE WHEN _seq % 10 = 0 THEN '' ELSE phone END AS phone, confidence_score, title_match_score,
  CASE WHEN _seq % 8 = 0 THEN 'unknown' ELSE email_status END AS email_status, matched_role, '2023-06-01 00:00:00' AS extracted_at
FROM ({CONTACTS}) c WHERE _seq % 2 = 0
"""

TARGETS = """
SELECT CAST(s_suppkey AS BIGINT) AS _seq, concat('Institution ', CAST(s_suppkey % 120 AS VARCHAR(10))) AS name, n_name AS state, '' AS city,
  CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN concat('inst', CAST(s_suppkey AS VARCHAR(10)), '.example.edu/') ELSE concat(' http://www.inst', CAST(s_suppkey AS VARCHAR(10)), '.example.edu/law// ') END AS url,
  CASE WHEN s_suppkey % 2 = 0 THEN 'Law School' ELSE 'Paralegal Program' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'ABA' ELSE 'AAfPE' END AS source,
  concat('ABA Approved (', CAST(1900 + s_suppkey % 100 AS VARCHAR(10)), ')') AS accreditation_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

#: A log of requests: errors, time-outs and loads by kind of event.
LOG = """
SELECT event_id, user_id % 50 AS domain, ts, CASE WHEN event_type = 'error' THEN 'http_error' WHEN event_type = 'signup' THEN 'timeout' ELSE 'success' END AS kind,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 500 END END AS status_code, value / 10 AS load_s,
  CASE WHEN event_id % 3 = 0 THEN 'playwright' ELSE 'static' END AS method, event_type NOT IN ('error', 'signup') AS success, CAST(event_id % 4 AS INT) AS found
FROM events
"""

VALIDATIONS = f"""
SELECT email, min(_seq) AS _seq, CASE WHEN min(_seq) % 3 = 0 THEN 'valid' WHEN min(_seq) % 3 = 1 THEN 'catch-all' ELSE 'invalid' END AS status, CAST(min(_seq) % 101 AS INT) AS score,
  min(_seq) % 3 = 1 AS is_catchall, min(_seq) % 17 = 0 AS is_disposable, 'neverbounce' AS service
FROM ({CONTACTS}) c WHERE email IS NOT NULL AND email <> '' AND _seq % 5 <> 0 GROUP BY email
"""


def _hidden(address: str, key: int) -> str:
    return bytes([key, *(b ^ key for b in address.encode())]).hex()


#: Addresses that pages hide in hex, by ``page_id % 5``.
HEX_ADDRESSES = ["ann.bell@law.edu", "cy.dunn@law.edu", "eve.fox@law.edu", "gus.hill@law.edu", "ida.judd@law.edu"]

_ID = "CAST(page_id AS VARCHAR(20))"
HOST = "concat('https://law', CAST(page_id - page_id % 8 AS VARCHAR(20)), '.example.edu')"
PERSON = "concat('First', CAST(page_id % 53 AS VARCHAR(10)), ' Last', CAST(page_id % 211 AS VARCHAR(10)))"
MAIL = f"concat('p', {_ID}, '@law.example.edu')"
PHONE = "concat('(555) ', CAST(100 + page_id % 900 AS VARCHAR(10)), '-', CAST(1000 + page_id % 9000 AS VARCHAR(10)))"
TITLE = _pick("page_id % 30", TITLES)
PATHS = ["/faculty-directory", "", "", "/contact", "/about/records", "/portal", "/team", "/programs"]
PATH = f"CASE page_id % 8 WHEN 1 THEN concat('/profile/p', {_ID}) " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS) if i != 1) + " END"

#: Sites of eight pages each: a directory, a profile it links to, a home page, one that hides addresses, a table, a
#: portal, a team without mail links, and lists of programs by state.
WEB_PAGES = f"""
SELECT page_id, concat({HOST}, {PATH}) AS url, concat('<html><body>', CASE page_id % 8
  WHEN 0 THEN concat('<h1>Faculty Directory</h1><div class="people"><ul><li class="profile-card"><h3>', {PERSON}, '</h3>
<p>', {TITLE}, '</p>
<a href="mailto:', {MAIL}, '">E-mail</a>
<p>Phone: ', {PHONE}, '</p>
<a href="/profile/p', CAST(page_id + 1 AS VARCHAR(20)), '">View profile</a></li>',
    '<li class="profile-card"><strong class="name">Second Person', '</strong>
<span class="position">Dean of Students</span>
<a href="https://twitter.com/x">Second Person</a></li>', '<li class="profile-card"><h4>Third Person</h4>
<a href="/news/p">News</a></li></ul></div>')
  WHEN 1 THEN concat('<div class="bio-content"><h1 itemprop="name">', {PERSON}, '</h1>
<span itemprop="jobTitle">', {TITLE}, '</span>
<span itemprop="jobTitle">Lecturer</span>
<a itemprop="email" href="mailto:', {MAIL}, '">mail</a>
<a href="tel:', {PHONE}, '">call</a></div>')
  WHEN 2 THEN concat('<nav><a href="/about">About</a><a href="/faculty-directory">Faculty Directory</a><a href="/students">Students</a><a href="/administration/staff?x=', {_ID}, '">Staff</a><a href="/news">News</a></nav><p>Welcome to school ', {_ID}, '</p>')
  WHEN 3 THEN concat('<div class="contact-info"><p>Office of records</p>
<a data-cfemail="', {_pick("page_id % 5", [_hidden(a, 0x1A + 16 * i) for i, a in enumerate(HEX_ADDRESSES)])}, '">protected</a></div><p>Write to office', {_ID}, ' [at] law [dot] edu or desk', {_ID}, '(at)law(dot)edu</p><script>var a = "script', {_ID}, '@law.edu"; var b = "joined', {_ID}, '" + "@" + "law.edu";</script><noscript>plain', {_ID}, '@law.edu</noscript><span data-email="attr', {_ID}, '@law.edu">x</span>')
  WHEN 4 THEN concat('<table><tr><td>', {PERSON}, '</td>
<td>', {MAIL}, '</td></tr><tr><td>no one</td></tr></table>')
  WHEN 5 THEN concat('<div class="member-card"><h3>', {PERSON}, '</h3>
<a href="mailto:', {MAIL}, '">E-mail</a></div>', repeat('<a href="/grades">Your Grades</a>', 5))
  WHEN 6 THEN concat('<h1>Our Team</h1>', repeat(concat('<div class="staff-card team-member"><b>', {PERSON}, '</b>
<p>Reference Librarian</p>
<p>Answers questions at the desk and on the telephone on most days of the week.</p></div>'), CAST(5 + page_id % 3 AS INT)))
  ELSE concat('<h2>California</h2><ul><li><a href="//a', {_ID}, '.edu/x">A  College ', {_ID}, '</a></li><li><a href="b.edu">B</a></li></ul><h2>Other</h2><ul><li><a href="c.edu">C</a></li></ul><h2>Ohio</h2><p>None yet</p><ul><li><a href="/d">D</a></li><li><a href="/e"> </a></li></ul>') END,
  '</body></html>') AS html
FROM pages
"""

VIEWS = {"contacts": CONTACTS, "existing": EXISTING, "targets": TARGETS, "request_log": LOG, "validations": VALIDATIONS, "web_pages": WEB_PAGES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the files of ``sf_dir``, without registering any view."""
    sql, frames = VIEWS[name], {}
    for t in ("customer", "nation", "supplier", "events", "pages"):
        if t in sql:
            frames[f"t_{t}"] = table(spark, sf_dir, t)
            sql = sql.replace(f"FROM {t} ", f"FROM {{t_{t}}} ").replace(f"FROM {t}\n", f"FROM {{t_{t}}}\n").replace(f"JOIN {t} ", f"JOIN {{t_{t}}} ")
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """``sql`` with the derived tables that it names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in used) + " " + sql if used else sql
