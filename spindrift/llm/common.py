"""What the training-data operators share: ASCII text rules and scratch tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else. ``lower`` has a fast path for ASCII text, where it does the same."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array if it has none."""
    t = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RE))


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; where it is unset in a local session, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isEmpty():
            if not re.match(r"local($|\[)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spindrift-')}")
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get()
    return root.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have ended first; the folder's owner cleans up then
            pass

    atexit.register(gone)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage through a Parquet table in the shared folder, so no lost executor undoes it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Sides of joins that grow with the input are broadcast up to so many rows, whatever Spark's threshold: that goes by
#: compressed bytes, and a broadcast passes through the driver in full.
BROADCAST_ROWS = 20_000


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` for a join that is merged if it has more than ``BROADCAST_ROWS`` rows (or nobody knows how many)."""
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def release() -> None:
    """Gives memory that a worker has freed back to the system: Arrow's pool and the C library keep it otherwise, and
    workers of several tasks share a machine. Called after a batch of some megabytes."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def runs(batches, n_keys: int, limit: int | None = None):
    """Of batches sorted by their first ``n_keys`` columns: one table a key, or of ``limit`` rows of it at most."""
    import pyarrow as pa

    held, rows, key = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True))
        start = 0
        for i in range(b.num_rows + 1):
            ends = i < b.num_rows and keys[i] != key
            full = limit is not None and rows + i - start >= limit
            if i == b.num_rows or ends or full:
                if i > start:
                    held.append(b.slice(start, i - start))
                    rows += i - start
                if (ends or full) and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows = [], 0
                start = i
                if i < b.num_rows:
                    key = keys[i]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
