"""Ordered rule tables, compiled to CASE expressions: the first rule that fits decides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(c: Column, rules: Iterable[tuple[str, object]], otherwise: Column | None = None) -> Column:
    """The value of the first pattern found anywhere in c."""
    out = F.lit(None) if otherwise is None else otherwise
    for pattern, value in reversed(list(rules)):
        out = F.when(c.rlike(pattern), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def any_within(c: Column, parts: Iterable[str]) -> Column:
    """Any of the parts is a substring of c."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def first_by_table(values, table, value_col: str, pattern_col: str, result_col: str, order_col: str):
    """``values`` with ``result_col`` of the first rule by ``order_col``, for rule tables too long for one CASE.

    Distinct values meet every rule once; ``table`` is a rule table of bounded size and is broadcast.
    """
    distinct = values.select(F.col(value_col).alias("__v")).where("__v IS NOT NULL").distinct()
    rules = F.broadcast(table.select(F.col(pattern_col).alias("__p"), F.col(result_col).alias("__r"), F.col(order_col).alias("__o")))
    hit = distinct.join(rules, F.expr("__v RLIKE __p")).groupBy("__v").agg(F.min_by("__r", "__o").alias(result_col))
    return values.drop(result_col).join(hit, values[value_col] == hit["__v"], "left").drop("__v")
