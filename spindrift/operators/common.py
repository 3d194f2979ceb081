"""Helpers of the relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ = "_seq"


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def with_seq(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` with an ordinal ``_seq`` where it has none: ``by``, or the order of the rows as they are read."""
    if SEQ in df.columns:
        return df
    return df.withColumn(SEQ, F.col(by) if by else F.monotonically_increasing_id())


def first_per_key(df: DataFrame, keys: list[Column], order: list[Column] | None = None) -> DataFrame:
    """The first row of each key by ``order`` (default ``_seq``); null keys equal each other.

    The window's rank limit is applied before the shuffle too, so of a hot key a task sends one row.
    """
    w = Window.partitionBy(*keys).orderBy(*(order or [F.col(SEQ)]))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """``value, n``: how often each value but null occurs, the most frequent first (ties: by value)."""
    out = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if n is None else out.limit(n)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def numbered(df: DataFrame, order: list[str], out: str, rows: int = 100_000, nulls_last: bool = False) -> DataFrame:
    """``df`` with ``out``, 1 to n in the order of columns; rows that are equal in these are numbered in any order.

    The order is cut into ranges of about ``rows`` rows, 4,096 at most, by where Spark would cut it; a range is numbered
    by itself, after all those before it. Nulls come first, or last.
    """
    by = [x for c in order for x in ((F.col(c).isNull(), F.col(c)) if nulls_last else (F.col(c),))]
    key = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(by)])
    keys = df.select(key.alias("k"))
    parts = max(1, min(4_096, -(-keys.count() // rows)))
    lows = sorted_lows(keys, parts) if parts > 1 else []
    spot = F.lit(0)
    if lows:
        table = F.array(*[F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(low)]) for low in lows])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(lows).bit_length()))])
        spot = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(lows)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at))
    placed = df.withColumn("__range", spot)
    before = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = before.select(F.col("__range").alias("__r"), (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # a row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    told = placed.withColumn("__in", inside).join(F.broadcast(before), F.col("__range") == F.col("__r"))
    return told.withColumn(out, (F.col("__before") + F.col("__in")).cast("bigint")).drop("__range", "__in", "__r", "__before")


def sorted_lows(keys: DataFrame, parts: int) -> list[tuple]:
    """The least key of each range but the first."""
    firsts = keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("low")).orderBy("low").collect()
    return [tuple(r["low"]) for r in firsts][1:]
