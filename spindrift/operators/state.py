"""Per-domain state over a log of requests: routes, delays, timeouts, as windows and ordered folds.

A log has ``domain``, ``ts``, an order within equal times (``event_id``) and ``kind``: success, timeout or http_error.
The delay's fold runs by parts of an hour, so a hot domain is many tasks; windows over a domain sort its log and can spill
it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import any_match, any_within
from ..functions.urls import domain_key

# fixed values: the limits of delays and timeouts, and the routing tables
DELAY_START, DELAY_LEAST, DELAY_MOST = 2.0, 1.0, 10.0
TIMEOUT_DEFAULT, TIMEOUT_LEAST, TIMEOUT_MOST, TIMEOUT_FACTOR, BACKOFF = 30000, 8000, 45000, 2.5, 1.5
SAMPLES = 10
FAST_FAIL = [403, 404, 410, 451, 500, 502, 503]
DYNAMIC = [
    "/directory/search", "/people/search", "/staff/ajax", "/faculty/ajax", r"\?ajax=", "#/people", "#/staff", "/api/directory", r"/directory\?",
    r"/faculty-staff/?\?", "/expert-directory",
]
STATIC = ["/about/staff", "/about/faculty", "/contact$", "/administration$"]
DIRECTORY_WORDS = ["directory", "faculty", "staff", "people", "expert"]


def _order() -> list[Column]:
    return [F.col("ts"), F.col("event_id")]


def route_counters(log: DataFrame) -> DataFrame:
    """``domain`` and, for each way of fetching, how often it was tried and brought something."""
    n = lambda c: F.count(F.when(c, 1))
    good = F.coalesce(F.col("success") & (F.col("found") > 0), F.lit(False))
    static, dynamic = F.col("method") == "static", F.col("method") == "playwright"
    return log.groupBy("domain").agg(n(static & good).alias("static_success"), n(static).alias("static_total"), n(dynamic & good).alias("playwright_success"), n(dynamic).alias("playwright_total"), F.max_by("method", F.struct(*_order())).alias("last_method"))


COUNTERS = ["static_success", "static_total", "playwright_success", "playwright_total"]


def add_counters(*counters: DataFrame) -> DataFrame:
    """The counters of several runs as one table; they add up by domain, so a run only needs its own log."""
    out = counters[0].select("domain", *COUNTERS)
    for c in counters[1:]:
        out = out.unionByName(c.select("domain", *COUNTERS))
    return out.groupBy("domain").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def running_route_counters(log: DataFrame) -> DataFrame:
    """The log with the counters as they stood before each request."""
    w = Window.partitionBy("domain").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce(F.col("success") & (F.col("found") > 0), F.lit(False))
    out = log
    for m, name in (("static", "static"), ("playwright", "playwright")):
        out = out.withColumn(f"{name}_success", F.count(F.when((F.col("method") == m) & good, 1)).over(w)).withColumn(f"{name}_total", F.count(F.when(F.col("method") == m, 1)).over(w))
    return out


def rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, success / total).otherwise(0.0)


def route(urls: DataFrame, counters: DataFrame, url_col: str = "url", force: bool = False) -> DataFrame:
    """``urls`` with ``dynamic`` and ``reason``: the first rule that decides how a page is to be fetched."""
    c = counters.select(F.col("domain").alias("__d"), "static_success", "static_total", "playwright_success", "playwright_total")
    j = urls.withColumn("__k", domain_key(F.col(url_col))).join(c, F.col("__k") == F.col("__d"), "left")
    u = F.lower(F.coalesce(url_col, F.lit("")))
    rs, rp = rate(F.col("static_success"), F.col("static_total")), rate(F.col("playwright_success"), F.col("playwright_total"))
    known = F.col("__d").isNotNull()
    pattern = F.lit(None).cast("string")
    for p in reversed(DYNAMIC):
        pattern = F.when(u.rlike(p), F.lit(f"pattern_match:{p}")).otherwise(pattern)
    share = lambda r: F.format_string("%.1f%%", r * 100)
    reason = (
        F.when(F.lit(force), "forced")
        .when(pattern.isNotNull(), pattern)
        .when(known & (rs > 0.7) & (F.col("static_total") >= 3), F.concat(F.lit("domain_history:static_rate="), share(rs)))
        .when(known & (rs < 0.3) & (rp > 0.7) & (F.col("playwright_total") >= 2), F.concat(F.lit("domain_history:playwright_rate="), share(rp)))
        .when(any_match(u, STATIC), "static_pattern_match")
        .when(any_within(u, DIRECTORY_WORDS), "directory_keyword_suggests_playwright")
        .otherwise("default_static_first")
    )
    dynamic = reason.isin("forced", "directory_keyword_suggests_playwright") | F.startswith(reason, F.lit("pattern_match:")) | F.startswith(reason, F.lit("domain_history:playwright"))
    return j.select(*urls.columns, dynamic.alias("dynamic"), reason.alias("reason"))


def route_summary(counters: DataFrame) -> DataFrame:
    a = counters.agg(F.count("*").alias("domains"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("static_success", "static_total", "playwright_success", "playwright_total")])
    return a.select("*", F.round(rate(F.col("static_success"), F.col("static_total")), 4).alias("static_rate"), F.round(rate(F.col("playwright_success"), F.col("playwright_total")), 4).alias("playwright_rate"))


def next_delay(delay: Column, kind: Column, code: Column) -> Column:
    """The delay after a request: a tenth less after success, double when told to slow down, half more after other errors."""
    worse = F.when(code.isin(429, 503), F.least(F.lit(DELAY_MOST), delay * 2.0)).otherwise(F.least(F.lit(DELAY_MOST), delay * 1.5))
    return F.when(kind == "success", F.greatest(F.lit(DELAY_LEAST), delay * 0.9)).otherwise(worse)


#: Events of an hour that are folded as one array.
CHUNK = 256
#: The composition of steps x -> min(hi, max(lo, a * x)), with the errors since the last success, and the last time.
STEPS = "struct<a:double,lo:double,hi:double,e:bigint,ok:boolean,last:timestamp>"


def _steps(a: Column, lo: Column, hi: Column, e: Column, ok: Column, last: Column) -> Column:
    return F.struct(a.alias("a"), lo.alias("lo"), hi.alias("hi"), e.alias("e"), ok.alias("ok"), last.alias("last")).cast(STEPS)


def _nothing() -> Column:
    return _steps(F.lit(1.0), F.lit(0.0), F.lit(1e300), F.lit(0), F.lit(False), F.lit(None))


def _then(p: Column, q: Column) -> Column:
    """The steps of p, then those of q: again of the form of one."""
    bound = lambda x: F.least(q["hi"], F.greatest(q["lo"], q["a"] * x))
    # beyond 1e100 a factor reaches every bound
    return _steps(F.least(F.lit(1e100), p["a"] * q["a"]), bound(p["lo"]), bound(p["hi"]), F.when(q["ok"], q["e"]).otherwise(p["e"] + q["e"]), p["ok"] | q["ok"], F.coalesce(q["last"], p["last"]))


def _events(log: DataFrame) -> DataFrame:
    """``domain, day, hour, chunk, ts, event_id, f``: each request's step, with the chunk of its hour that it belongs to."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    rows = log.select("domain", F.date_trunc("day", "ts").alias("day"), hour, F.col("ts").cast("timestamp").alias("ts"), "event_id", "kind", "status_code")
    good = F.col("kind") == "success"
    factor = F.when(good, 0.9).when(F.col("status_code").isin(429, 503), 2.0).otherwise(1.5)
    f = _steps(factor, F.when(good, DELAY_LEAST).otherwise(0.0), F.when(good, 1e300).otherwise(DELAY_MOST), F.when(good, 0).otherwise(1), good, F.col("ts"))
    chunk = F.floor((F.row_number().over(Window.partitionBy("domain", "day", "hour").orderBy(*_order())) - 1) / CHUNK)
    return rows.withColumn("chunk", chunk).select("domain", "day", "hour", "chunk", "ts", "event_id", f.alias("f"))


def _fold(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keys`` and ``f``, the steps of a group's rows in order, one after the other; and ``rows``, these with ``before``,
    the steps of those before each in its group. Groups are small: what grows is their number."""
    xs = F.array_sort(F.collect_list(F.struct(*order, "f")))
    start = F.struct(_nothing().alias("t"), F.array().cast(f"array<{STEPS}>").alias("before"))
    step = lambda s, x: F.struct(_then(s["t"], x["f"]).alias("t"), F.concat(s["before"], F.array(s["t"])).alias("before"))
    s = rows.groupBy(*keys).agg(xs.alias("xs")).withColumn("s", F.aggregate("xs", start, step))
    zipped = F.zip_with("xs", "s.before", lambda x, p: F.struct(*[x[c].alias(c) for c in order], p.alias("before")))
    return s.select(*keys, F.col("s.t").alias("f"), zipped.alias("rows"))


#: A domain's log is folded by chunks of an hour, these by hours, hours by days, and days by domains.
LEVELS = [(["domain", "day", "hour", "chunk"], ["ts", "event_id"]), (["domain", "day", "hour"], ["chunk"]), (["domain", "day"], ["hour"]), (["domain"], ["day"])]


def _folds(log: DataFrame) -> list[DataFrame]:
    out, rows = [], _events(log)
    for keys, order in LEVELS:
        out.append(_fold(rows, keys, order))
        rows = out[-1].select(*keys, "f")
    return out


def _after(f: Column, delay: Column) -> Column:
    return F.least(f["hi"], F.greatest(f["lo"], f["a"] * delay))


def delay_state(log: DataFrame) -> DataFrame:
    """``domain, delay, errors``: the delay after all of a domain's requests in order, and errors since the last success.

    Every step is x -> min(hi, max(lo, a * x)), and such steps compose to one of the same form. So parts of a log are
    folded side by side, whatever the delay before them; delays are told to nine decimals.
    """
    return _folds(log)[-1].select("domain", F.round(_after(F.col("f"), F.lit(DELAY_START)), 9).alias("delay"), F.col("f.e").alias("errors"))


def wait_times(log: DataFrame) -> DataFrame:
    """The log with ``wait_s``: how long each request has to wait after the one before, at the delay as it then stands."""
    levels = _folds(log)
    before = None
    for (keys, order), fold in list(zip(LEVELS, levels, strict=True))[::-1]:
        rows = fold.select(*keys, F.explode("rows").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in order], F.col("r.before").alias("f"))
        # the steps before a row: those before its group, then those in it
        before = rows if before is None else rows.join(before.withColumnRenamed("f", "p"), keys).withColumn("f", _then(F.col("p"), F.col("f"))).drop("p")
    micros = lambda c: F.unix_micros(c)
    gap = (micros(F.col("ts")) - micros(F.col("f.last"))) / 1e6
    delay = _after(F.col("f"), F.lit(DELAY_START))
    wait = F.when(gap.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), delay - gap))
    return before.select("domain", "ts", "event_id", F.round(delay, 9).alias("delay"), F.round(wait, 9).alias("wait_s"))


def limiter_summary(log: DataFrame) -> DataFrame:
    w = wait_times(log)
    a = w.agg(F.count("*").alias("total_requests"), F.round(F.coalesce(F.sum("wait_s"), F.lit(0.0)), 1).alias("total_delays"), F.count_distinct("domain").alias("domains_accessed"))
    bad = delay_state(log).agg(F.count(F.when(F.col("errors") > 0, 1)).alias("domains_with_errors"))
    both = a.crossJoin(F.broadcast(bad))  # one row each
    return both.select("*", F.round(F.col("total_delays") / F.greatest(F.lit(1), F.col("total_requests")), 2).alias("avg_delay_per_request"))


def adaptive_timeouts(log: DataFrame) -> DataFrame:
    """A row a success: ``timeout_ms`` from the mean of the last ten load times, within its limits."""
    w = Window.partitionBy("domain").orderBy(*_order()).rowsBetween(1 - SAMPLES, Window.currentRow)
    ms = F.floor(F.avg("load_s").over(w) * TIMEOUT_FACTOR * 1000).cast("int")
    return log.where("kind = 'success'").select("domain", "ts", "event_id", "load_s", F.greatest(F.lit(TIMEOUT_LEAST), F.least(F.lit(TIMEOUT_MOST), ms)).alias("timeout_ms"))


def backoff_runs(log: DataFrame) -> DataFrame:
    """A row a timeout: ``k``, the timeouts in a row since the last success, and ``timeout_ms`` from the default."""
    w = Window.partitionBy("domain").orderBy(*_order())
    islands = log.withColumn("island", F.count(F.when(F.col("kind") == "success", 1)).over(w)).where("kind = 'timeout'")
    k = F.row_number().over(Window.partitionBy("domain", "island").orderBy(*_order()))
    out = islands.withColumn("k", k)
    return out.select("domain", "ts", "event_id", "k", F.least(F.lit(float(TIMEOUT_MOST)), F.floor(F.lit(float(TIMEOUT_DEFAULT)) * F.pow(F.lit(BACKOFF), F.least(F.col("k"), F.lit(4))))).cast("int").alias("timeout_ms"))


def fast_fail(code: Column) -> Column:
    return F.coalesce(code.isin(FAST_FAIL), F.lit(False))


def timeout_summary(log: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    a = log.agg(F.count("*").alias("total_requests"), n(F.col("kind") == "timeout").alias("total_timeouts"), n((F.col("kind") == "http_error") & fast_fail(F.col("status_code"))).alias("total_fast_fails"), F.count_distinct("domain").alias("domains_tracked"))
    return a.select("*", F.round(F.col("total_timeouts") * 100.0 / F.greatest(F.lit(1), F.col("total_requests")), 1).alias("timeout_rate"))


def domain_timeouts(log: DataFrame) -> DataFrame:
    """``domain``, mean of its last ten loads, how many there are, and its timeouts since the last success."""
    w = Window.partitionBy("domain").orderBy(F.desc("ts"), F.desc("event_id"))
    good = log.where("kind = 'success'").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= SAMPLES)
    loads = good.groupBy("domain").agg(F.round(F.avg("load_s"), 2).alias("avg_load_s"), F.count("*").alias("samples"))
    last = log.groupBy("domain").agg(F.max(F.when(F.col("kind") == "success", F.struct(*_order()))).alias("__last"))
    since = log.join(last, "domain").where((F.col("kind") == "timeout") & (F.col("__last").isNull() | (F.struct(*_order()) > F.col("__last")))).groupBy("domain").agg(F.count("*").alias("__n"))
    return last.select("domain").join(loads, "domain", "left").join(since, "domain", "left").select("domain", F.coalesce("avg_load_s", F.lit(0.0)).alias("avg_load_s"), F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("__n", F.lit(0)).alias("consecutive_timeouts"))


def remaining(targets: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """What a resumed run has left: targets whose key is not among those done; a null key is never done."""
    return targets.join(done.select(F.col(key).alias("__done")).distinct(), F.col(key) == F.col("__done"), "left_anti")
