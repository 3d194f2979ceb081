"""The per-domain operators over streams: state of a key is a few numbers, kept by the engine and its checkpoint.

A batch's events of one domain are sorted in one place, four or five numbers an event; a stream's trigger options bound
how many files, and so events, a batch has.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.state import BACKOFF, DELAY_LEAST, DELAY_MOST, DELAY_START, SAMPLES, TIMEOUT_DEFAULT, TIMEOUT_FACTOR, TIMEOUT_LEAST, TIMEOUT_MOST


def delays(log: DataFrame) -> DataFrame:
    """``domain, delay, errors`` of each domain that a batch touches, after its events in order of time."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        delay, errors = state.get if state.exists else (DELAY_START, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind, code in zip(rows["kind"], rows["status_code"], strict=True):
            if kind == "success":
                delay, errors = max(DELAY_LEAST, delay * 0.9), 0
            else:
                delay, errors = min(DELAY_MOST, delay * (2.0 if code in (429, 503) else 1.5)), errors + 1
        state.update((delay, errors))
        yield pd.DataFrame({"domain": [key[0]], "delay": [delay], "errors": [errors]})

    out = "domain long, delay double, errors long"
    cols = log.select("domain", "ts", "event_id", "kind", "status_code")
    return cols.groupBy("domain").applyInPandasWithState(step, out, "delay double, errors long", "update", "NoTimeout")


def kahan_sum(values) -> float:
    """Kahan's sum of the values in their order, less the rest that it carries. A mean of cents lies on a whole
    millisecond often, and there the last bit of the sum tells which one ``floor`` gives."""
    total = rest = 0.0
    for x in values:
        add = x - rest
        new = total + add
        rest, total = (new - total) - add, new
    return total - rest


def timeouts(log: DataFrame) -> DataFrame:
    """``domain, timeout_ms, consecutive``: the timeout of each domain that a batch touches, after its events. Loads are
    added newest first."""

    def step(key, frames: Iterator, state):
        import pandas as pd

        loads, current, run = state.get if state.exists else ([], TIMEOUT_DEFAULT, 0)
        loads = list(loads)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind, load in zip(rows["kind"], rows["load_s"], strict=True):
            if kind == "success":
                loads, run = [*loads, float(load)][-SAMPLES:], 0
            elif kind == "timeout":
                run += 1
                # the factor applies once for each timeout in a row
        if loads:
            current = max(TIMEOUT_LEAST, min(TIMEOUT_MOST, int(kahan_sum(reversed(loads)) / len(loads) * TIMEOUT_FACTOR * 1000)))
        state.update((loads, current, run))
        yield pd.DataFrame({"domain": [key[0]], "timeout_ms": [min(TIMEOUT_MOST, int(current * BACKOFF ** min(run, 8)))], "consecutive": [run]})

    out = "domain long, timeout_ms int, consecutive long"
    cols = log.select("domain", "ts", "event_id", "kind", "load_s")
    return cols.groupBy("domain").applyInPandasWithState(step, out, "loads array<double>, current int, run long", "update", "NoTimeout")


def latest(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of updates to its end into a table that keeps each batch under its number; a rerun replaces it."""

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return updates.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_contacts(contacts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of contacts to a Parquet table, each batch once, up to what there is now."""
    return contacts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
