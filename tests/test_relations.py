"""Relational operators on the hand-checked tables, and their invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.operators import common, dedup, enrich, report, state, stats, targets
from spindrift.sources import tables

CONTACT = "full_name string, institution_name string, email string, title string, phone string, confidence_score int, email_status string, extracted_at string"


def contacts(spark, rows):
    return spark.createDataFrame([(i, *(list(r) + [None] * (8 - len(r)))) for i, r in enumerate(rows)], f"_seq bigint, {CONTACT}")


@pytest.mark.parametrize(
    ("f", "rows", "want"),
    [
        (dedup.deduplicate_by_email, [("a", "x", "john@example.com"), ("b", "x", "john@example.com"), ("c", "x", "bob@example.com")], 2),
        (dedup.deduplicate_by_email, [("a", "x", "JOHN@EXAMPLE.COM"), ("b", "x", "john@example.com")], 1),
        (dedup.deduplicate_by_email, [("a", "x", "j@e.com"), ("b", "x", None), ("c", "x", "")], 3),
        (dedup.deduplicate_by_name_institution, [("John", "Stanford", None), ("John", "Stanford", None), ("Jane", "UCLA", None)], 2),
        (dedup.deduplicate_by_name_institution, [("John", "Stanford", None), ("John", "UCLA", None)], 2),
        (dedup.deduplicate_by_name_institution, [("John", "S", "a@b.c"), ("John", "S", "d@e.f"), ("John", "S", None)], 3),
        (dedup.deduplicate_contacts, [("a", "x", "j@e.com"), ("b", "x", "J@e.com"), ("J", "S", None), ("j ", "s", None), ("K", "S", None)], 3),
        (dedup.deduplicate_contacts, [("a", "x", ""), ("b", "y", ""), ("c", "z", "")], 1),
    ],
)
def test_dedup(spark, f, rows, want):
    out = f(contacts(spark, rows))
    assert out.count() == want and f(out).count() == want


def test_strict_mode_takes_blanks_as_missing(spark):
    df = contacts(spark, [("a", "x", ""), ("b", "y", ""), ("a", "x", None)])
    assert dedup.deduplicate_contacts(df, "strict").count() == 2


def test_compare_and_merge(spark):
    old = contacts(spark, [("John", "S", "j@e.com", "Director", "555-0000", 60, "unknown", "old"), ("Jane", "S", "k@e.com", "Professor", "555-1111", 60, "valid", "old")])
    new = contacts(spark, [("John", "S", "j@e.com", "Associate Director", "555-0000", 60, "valid", "new"), ("Jane", "S", "k@e.com", "Professor", "555-1111", 60, "valid", "new"), ("Bob", "S", "b@e.com", "Dean", "", 60, "valid", "new")])
    found = dedup.compare_with_existing(new, old)
    assert {r.full_name: r["class"] for r in found.collect()} == {"John": "update", "Jane": "duplicate", "Bob": "new"}
    m = dedup.merge_matched(found.where("class = 'update'")).first()
    assert (m.title, m.email_status, m.last_updated, m.record_source, m.confidence_score) == ("Associate Director", "valid", "new", "merged", 75)
    worse = contacts(spark, [("John", "S", "j@e.com", None, None, 60, "invalid", "new")])
    m = dedup.merge_matched(dedup.compare_with_existing(worse, contacts(spark, [("John", "S", "j@e.com", "Director", "5", 60, "catch-all", "old")]))).first()
    assert (m.title, m.phone, m.email_status, m.confidence_score) == ("Director", "5", "catch-all", 60)
    assert {r["class"] for r in dedup.compare_with_existing(new, old.limit(0)).collect()} == {"new"}
    assert dedup.compare_with_existing(new.limit(0), old).count() == 0


def test_match_by_name_needs_both_blank_emails(spark):
    old = contacts(spark, [("John Doe", "S", "", "Director")])
    got = dedup.find_matches(contacts(spark, [("JOHN  DOE", "s", "", "Dean"), ("Jim", "S", "x@y.z", "")]), old).collect()
    assert [r.match is not None for r in got] == [True, False]


SIX = [
    ("Stanford", "CA", "Law School", "Library Director", "a", "p", 80, "valid", False, "neverbounce", "website_scrape"),
    ("Stanford", "CA", "Law School", "Associate Dean", "b", "p", 75, "valid", False, "zerobounce", "website_scrape"),
    ("UCLA", "CA", "Law School", "Legal Writing Director", "c", "", 60, "catch-all", True, "neverbounce", "website_scrape"),
    ("NYU", "NY", "Law School", "Program Coordinator", "d", "p", 45, "invalid", False, "zerobounce", "website_scrape"),
    ("Texas Para", "TX", "Paralegal Program", "Program Director", "", "p", 50, "no_email", False, "none", "none"),
    ("Cal Para", "CA", "Paralegal Program", "Program Director", "e", "p", 90, "valid", False, "hunter", "hunter_io"),
]


@pytest.fixture(scope="module")
def six(spark):
    cols = "institution_name string, state string, program_type string, matched_role string, email string, phone string, confidence_score int, email_status string, email_is_catchall boolean, email_validation_service string, email_source string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SIX)], f"_seq bigint, {cols}")


def test_statistics(spark, six):
    assert [(r.value, r.n) for r in stats.state_breakdown(six).collect()] == [("CA", 4), ("NY", 1), ("TX", 1)]
    assert stats.state_breakdown(six.drop("state")).count() == 0
    assert {r.program_type: (r.n, r.pct) for r in stats.program_breakdown(six).collect()} == {"Law School": (4, 66.7), "Paralegal Program": (2, 33.3)}
    q = stats.email_quality(six).first()
    assert (q.total, q.with_email, q.coverage_pct, q.valid, q.valid_pct, q.catch_all, q.invalid, q.unknown) == (6, 6, 100.0, 3, 50.0, 1, 1, 0)
    assert stats.email_quality(six, blank_counts=False).first().with_email == 5
    assert {r.value: r.n for r in stats.service_usage(six).collect()} == {"neverbounce": 2, "zerobounce": 2, "hunter": 1}
    c = stats.confidence_distribution(six).first()
    assert (c.high, c.high_pct, c.medium, c.low, c.avg_score, c.median_score, c.min_score, c.max_score) == (3, 50.0, 2, 1, 66.7, 67, 45, 90)
    assert [(r.role, r.n) for r in stats.top_roles(six, 3).collect()][0] == ("Program Director", 2) and stats.top_roles(six, 5).count() == 5
    t = spark.createDataFrame([(f"t{i}",) for i in range(6)], "name string")
    r = stats.success_rate(six, t).first()
    assert (r.attempted, r.successful, r.failed, r.rate_pct, r.n_1_2) == (6, 5, 1, 83.3, 5)
    assert stats.success_rate(six).first().rate_pct == 100.0 and stats.success_rate(six.limit(0)).first().rate_pct == 0.0
    assert tuple(stats.summary(six).first()) == (6, 5, 1.2)


def test_report(spark, six):
    four = spark.createDataFrame([(0, "A", "CA", "Law School", 80), (1, "A", "CA", "Law School", 60), (2, "B", "NY", "Law School", 45), (3, "C", "TX", "Paralegal Program", 90)], "_seq bigint, institution_name string, state string, program_type string, confidence_score int").withColumns({"institution_url": F.lit("u"), "extracted_at": F.lit("t")})
    five = spark.createDataFrame([(i, n, "S", "T", "u") for i, n in enumerate("ABCDE")], "_seq bigint, name string, state string, type string, url string")
    v = {k: x.count() for k, x in report.views(four).items()}
    assert v == {"All Contacts": 4, "Law School Contacts": 3, "Paralegal Program Contacts": 1, "High Confidence": 2, "Medium Confidence": 1, "Needs Review": 1}
    assert {r.sheet: r.n for r in report.view_sizes(four).collect()} == v
    log = report.scraping_log(four, five).collect()
    assert len(log) == 5 and {r.status for r in log} == {"Success", "Failed"} and log[0].contacts_found == 2
    rows = report.statistics_rows({k: x for k, x in stats.contact_statistics(six).items() if k != "input"})
    assert rows.where("section = 'summary' AND metric = 'contacts'").first().value == "6"


def test_enrichment(spark):
    known = spark.createDataFrame([(0, "v@x", "valid", 100, False, False, "n"), (1, "c@x", "catch-all", 70, True, False, "n"), (2, "i@x", "invalid", 0, False, False, "n"), (3, "v@x", "invalid", 0, False, False, "n")], "_seq bigint, email string, status string, score int, is_catchall boolean, is_disposable boolean, service string")
    df = contacts(spark, [("a", "x", "v@x", "", "", 50), ("b", "x", "c@x", "", "", 50), ("c", "x", "", "", "", 40), ("d", "x", None, "", "", 40), ("e", "x", "?@x", "", "", 40)])
    got = {r.full_name: (r.email_status, r.email_score, r.confidence_score) for r in enrich.enrich_contacts(df, known).collect()}
    assert got == {"a": ("valid", 100, 80), "b": ("catch-all", 70, 30), "c": ("no_email", 0, 40), "d": ("unknown", 0, 40), "e": ("unknown", 0, 40)}
    assert [r.email_status for r in enrich.enrich_contacts(df).collect()] == ["not_validated"] * 5
    assert sorted((r.status, r.score) for r in enrich.validate_emails(df, known).collect()) == [("catch-all", 70), ("unknown", 40), ("valid", 100)]


def test_email_pattern(spark):
    rows = [("d1", "a.b@d1"), ("d1", "c.d@d1"), ("d1", "e.f@d1"), ("d2", "a_b@d2"), ("d2", "c_d@d2"), ("d2", "e_f@d2"), ("d3", "a.b@d3"), ("d4", "a.b@d4"), ("d4", "c_d@d4"), ("d4", "ef@d4")]
    got = {r.domain: r.pattern for r in enrich.email_pattern(spark.createDataFrame(rows, "domain string, email string")).collect()}
    assert got == {"d1": ".", "d2": "_", "d3": None, "d4": None}


def log(spark, events):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t + dt.timedelta(seconds=i), k, c, x) for i, (k, c, x) in enumerate(events)]
    return spark.createDataFrame(rows, "event_id bigint, domain bigint, ts timestamp, kind string, status_code int, load_s double")


def test_state(spark):
    assert state.delay_state(log(spark, [("success", None, 1.0)])).first().delay == pytest.approx(1.8)
    assert state.delay_state(log(spark, [("http_error", 429, None)])).first().delay == 4.0
    assert state.delay_state(log(spark, [("http_error", 500, None)])).first().delay == 3.0
    assert state.adaptive_timeouts(log(spark, [("success", None, 2.0)])).first().timeout_ms == 8000
    assert state.adaptive_timeouts(log(spark, [("success", None, 15.0)])).first().timeout_ms == 37500
    assert [r.timeout_ms for r in state.backoff_runs(log(spark, [("timeout", None, None)] * 2)).orderBy("k").collect()] == [45000, 45000]
    assert state.domain_timeouts(log(spark, [("timeout", None, None), ("success", None, 3.0), ("timeout", None, None)])).first().consecutive_timeouts == 1


def test_first_per_key_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, "a")], "_seq bigint, k string")
    assert sorted(r._seq for r in common.first_per_key(df, [F.col("k")]).collect()) == [0, 2]


def test_targets(spark):
    df = spark.createDataFrame([("Chicago - Kent (1936)",), ("Yale University (1923)",), ("no year",)], "x string")
    got = [r.p for r in df.select(targets.parse_listed(F.col("x")).alias("p")).collect()]
    assert (got[0].state, got[0].city) == ("Chicago", "Kent") and got[1].name == "Yale University" and got[2] is None
    t = spark.createDataFrame([("B", "Ohio", "Law School"), ("A", "Utah", "Paralegal Program"), ("C", "Ohio", "Law School")], "name string, state string, type string")
    master = targets.build_master([t], "now").orderBy("institution_id").collect()
    assert [(r.institution_id, r.name, r.source) for r in master] == [(1, "B", "ABA"), (2, "C", "ABA"), (3, "A", "AAfPE")]
    assert targets.filter_states_or_all(t, ["ohio"]).count() == 2 and targets.filter_states_or_all(t, ["none"]).count() == 3


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 'say "x"', 80), ("line\nbreak", None, 45)], "name string, note string, confidence_score int")
    now = dt.datetime(2024, 1, 2, 3, 4, 5)
    path = tables.save_csv(df, str(tmp_path), "out", now, single=True)
    assert path.endswith("out_20240102_030405") and {r.name for r in tables.read_csv(spark, path).collect()} == {"a, b", "line\nbreak"}
    book = f"{tmp_path}/book.xlsx"
    tables.write_workbook({"All Contacts": df, "Other": df.limit(1)}, book)
    assert {r.name for r in tables.load_existing(spark, book).collect()} == {"a, b", "line\nbreak"}
    assert {k: x.count() for k, x in tables.read_all_sheets(spark, book).items()} == {"All Contacts": 2, "Other": 1}
    assert tables.load_existing(spark, f"{tmp_path}/none.csv") is None and tables.load_existing(spark, __file__) is None
    tables.cache_table(df, str(tmp_path), "c", now)
    hit = lambda h: tables.cached_table(spark, str(tmp_path), "c", now + dt.timedelta(hours=h))
    assert hit(24).count() == 2 and hit(24.1) is None and tables.cached_table(spark, str(tmp_path), "nope", now) is None
    for _ in range(2):
        tables.append_contacts(df, f"{tmp_path}/app")
    assert spark.read.parquet(f"{tmp_path}/app").count() == 4
    target = f"file://{tmp_path}/t"
    assert tables.replace_with_backup(df, target, now) is None and tables.replace_with_backup(df.limit(1), target, now) is not None
    assert spark.read.parquet(target).count() == 1


def test_json_cache_and_role_workbook(spark, tmp_path):
    from spindrift.operators import names, roles

    now = dt.datetime(2024, 1, 2)
    progs = spark.createDataFrame([("A", "u", "Ohio", "paralegal")], "name string, url string, state string, program_type string")
    tables.write_json_cache(progs, f"{tmp_path}/j", now)
    assert tables.read_json_cache(spark, f"{tmp_path}/j", now + dt.timedelta(hours=24)).first().name == "A"
    assert tables.read_json_cache(spark, f"{tmp_path}/j", now + dt.timedelta(hours=25)) is None and tables.read_json_cache(spark, f"{tmp_path}/no", now) is None
    m = spark.createDataFrame([("Law Library Director", 100, "Law School"), ("Program Chair", 90, "Paralegal Program")], "`Target Role` string, `Match Score` int, program_type string")
    books = report.role_workbook(m, list(roles.LAW_TARGETS))
    assert list(books) == ["All Matched Contacts", "Law Schools", "Paralegal Programs", "Law Library Director", "Associate Dean for Academi", "Legal Writing Director", "Statistics"] or max(map(len, books)) <= 25
    assert books["Law Schools"].count() == 1 and books["Statistics"].count() == 2
    book = spark.createDataFrame([(None, None, "Kevin Gerson, Law Library Director"), ("A", "B", "x")], "`First Name` string, `Last Name` string, `Title / Role` string")
    tables.write_workbook({"S": book, "T": progs}, f"{tmp_path}/in.xlsx")
    fixed = names.fix_workbook(spark, f"{tmp_path}/in.xlsx", f"{tmp_path}/out.xlsx")
    assert [tuple(r)[:2] for r in fixed["S"].collect()] == [("Kevin", "Gerson"), ("A", "B")] and fixed["T"].count() == 1


def test_streams_equal_their_batch_twins(spark):
    from spindrift.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    a = {r.domain: (round(r.delay, 9), r.errors) for r in QUERIES["K5_delay_state"](spark, sf).collect()}
    assert {r.domain: (round(r.delay, 9), r.errors) for r in QUERIES["K5_delay_stream"](spark, sf).collect()} == a
    b = {r.domain: r.consecutive_timeouts for r in QUERIES["K11_domain_timeouts"](spark, sf).collect()}
    assert {r.domain: r.consecutive for r in QUERIES["K8_timeout_stream"](spark, sf).collect()} == b


def test_stream_timeouts_to_the_last_bit(spark, tmp_path):
    import random

    import duckdb

    from spindrift.plans import ORACLES, QUERIES

    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    order = rng.sample(range(250), 250)  # five loads a domain; sums whose mean is a whole number of milliseconds are frequent
    rows = [(i, start + dt.timedelta(seconds=order[i]), i % 50, "view", rng.randrange(1, 20_000) / 100) for i in range(250)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 4})
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["K8_timeout_stream"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["K8_timeout_stream"](spark, str(tmp_path)).collect()) == want


def test_master_numbers_of_equal_names(spark):
    """Rows that the order leaves equal get the same numbers however they lie."""
    rows = [("A", "Law School", "Ohio", "", "", f"ABA Approved ({1900 + i % 100})") for i in range(300)] + [("A", "Paralegal Program", None, "", "", None)] * 2
    cols = "name string, type string, state string, city string, url string, accreditation_status string"
    got = [sorted(tuple(r) for r in targets.build_master([spark.createDataFrame(x, cols).repartition(n)], "2024-01-01").collect()) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert got[0] == got[1] and [r[0] for r in got[0]] == list(range(1, 303))
    assert [r[6] for r in got[0][:300]] == sorted(r[5] for r in rows[:300])


def test_master_numbers_nulls_last(spark, tmp_path):
    """As the SQL does; here a nation has no name."""
    import duckdb

    from spindrift.plans import ORACLES, QUERIES

    nations = [(i, None if i == 2 else f"NATION_{i}") for i in range(4)]
    rows = [(i, i // 120 % 4) for i in range(480)]  # each name in each state, so that nothing is equal in all columns of the order
    for name, x, cols in (("nation", nations, "n_nationkey int, n_name string"), ("supplier", rows, "s_suppkey long, s_nationkey int")):
        spark.createDataFrame(x, cols).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("nation", "supplier"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["T13_build_master"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["T13_build_master"](spark, str(tmp_path)).collect()) == want


def test_surrogate_keys_with_nulls_last(spark):
    rows = [(["b", "", None, "Ünï", "a"][i % 5], [1, 2, None][i % 3], i) for i in range(200)]
    df = spark.createDataFrame(rows, "name string, n int, other int").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is None, (r[0] or "").encode(), r[1] is None, r[1] or 0, r[2]))
    for size in (1_000, 60, 7):
        got = common.numbered(df, ["name", "n", "other"], "id", size, nulls_last=True).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(*r, i + 1) for i, r in enumerate(want)]


def test_surrogate_keys_by_ranges(spark, monkeypatch):
    import random

    rng = random.Random(1)
    names = ["In", "Institution", "", None, "Ünï", "a", "b'c"]
    rows = [(rng.choice(names), rng.choice([1, 2, None]), i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, n int, other int").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    for size in (1_000, 60, 7):
        got = common.numbered(df, ["name", "n", "other"], "id", size).orderBy("id").collect()
        assert [r.id for r in got] == list(range(1, 501)) and [(r.name, r.n, r.other) for r in got] == want
    assert common.numbered(df.limit(0), ["name"], "id").count() == 0


def test_delay_folds_equal_a_loop(spark, monkeypatch):
    """Over days, hours and chunks of an hour; long runs of errors, and of successes."""
    import random

    monkeypatch.setattr(state, "CHUNK", 5)
    rng, t, rows = random.Random(2), dt.datetime(2024, 1, 1, 23, 50), []
    for i in range(400):
        t += dt.timedelta(seconds=rng.choice([0, 1, 30, 4000]))
        kind = "success" if (i // 60) % 2 else rng.choice(["success", "http_error", "timeout"])
        rows.append((i, i % 2, t, kind, rng.choice([429, 503, 404]) if kind == "http_error" else None, 1.0))
    df = spark.createDataFrame(rows, "event_id bigint, domain bigint, ts timestamp, kind string, status_code int, load_s double").repartition(3)
    wait, delay, errors, last = {}, {0: 2.0, 1: 2.0}, {0: 0, 1: 0}, {}
    for i, d, at, kind, code, _ in rows:
        gap = (at - last[d]).total_seconds() if d in last else None
        wait[i] = (delay[d], 0.0 if gap is None else max(0.0, delay[d] - gap))
        last[d] = at
        if kind == "success":
            delay[d], errors[d] = max(1.0, delay[d] * 0.9), 0
        else:
            delay[d], errors[d] = min(10.0, delay[d] * (2.0 if code in (429, 503) else 1.5)), errors[d] + 1
    got = {r.event_id: (r.delay, r.wait_s) for r in state.wait_times(df).collect()}
    assert got.keys() == wait.keys() and all(got[i] == (pytest.approx(a, abs=1e-8), pytest.approx(b, abs=1e-8)) for i, (a, b) in wait.items())
    assert {r.domain: (r.delay, r.errors) for r in state.delay_state(df).collect()} == {d: (pytest.approx(delay[d], abs=1e-8), errors[d]) for d in (0, 1)}
    many = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1), "http_error", 500, 1.0) for i in range(3000)], df.schema)
    assert state.delay_state(many).first()["delay"] == 10.0


def test_contact_records(spark):
    from spindrift.operators import records, roles

    rows = [("Ann Bell", "Interim Law Library Director", "a@b.edu", "", "I", "u", "CA", "Law School"), ("No Role", "Student Worker", "s@b.edu", "5", "I", "u", "CA", "Law School"), ("Low", "Gardener", "", "5", "I", "u", "CA", "Law School"), ("", "", "x@b.edu", None, "I", "u", None, "Paralegal Program")]
    df = spark.createDataFrame(rows, "full_name string, title string, email string, phone string, institution_name string, institution_url string, state string, program_type string")
    got = {r.email: r for r in records.contact_records(df, roles.catalog(spark), "now").collect()}
    assert set(got) == {"a@b.edu", "s@b.edu", "x@b.edu"} and list(got["a@b.edu"].asDict()) == records.RECORD
    a, s, x = got["a@b.edu"], got["s@b.edu"], got["x@b.edu"]
    assert (a.title_normalized, a.title_modifiers, a.is_temporary, a.first_name, a.confidence_score, a.source_url) == ("Law Library Director", "Interim", True, "Ann", 60, "u")
    assert (s.title_normalized, s.title_modifiers, s.matched_role, s.confidence_score) == ("Student Worker", "", "", 50)
    assert (x.title, x.title_normalized, x.state, x.phone, x.first_name) == ("", "", "", "", "")


def test_expected_values_equal_brute_force():
    import brute_roles as brute
    import duckdb

    from spindrift.plans import expected, scalars

    titles = sorted({t for t, *_ in expected.ROLES})
    made = ", ".join(f"({i}, {scalars.lit(t)})" for i, t in enumerate(titles))
    sql = scalars.N8.replace("FROM contacts", f"FROM (SELECT * FROM (VALUES {made}) v(_seq, title)) c")
    norm = {titles[i]: r for i, *r in duckdb.sql(f"SELECT _seq, normalized, should_exclude, confidence_modifier FROM ({sql})").fetchall()}
    for title, law, *want in expected.ROLES:
        assert list(brute.match_role(*norm[title], law)) == want, title
    for title, law, *want in expected.TARGETS:
        assert list(brute.match_target(title, law)) == want, title
    for title, role, *want in expected.RATIOS:
        assert [f(title.lower(), role) for f in (brute.ratio, brute.partial, brute.token_sort, brute.token_set)] == want, title
