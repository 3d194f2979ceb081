"""Names that are missing where a title holds them, in tables and whole workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_from_title
from ..sources.tables import read_all_sheets, write_workbook
from .common import has


def fill_missing_names(df: DataFrame, first: str = "First Name", last: str = "Last Name", title: str = "Title / Role") -> DataFrame:
    """Both names from the title where either is null and the title gives both; a table without these columns stays."""
    if not has(df, first, last, title):
        return df
    n = name_from_title(F.col(f"`{title}`"))
    due = (F.col(f"`{first}`").isNull() | F.col(f"`{last}`").isNull()) & n["first"].isNotNull() & n["last"].isNotNull()
    new = {first: F.when(due, n["first"]).otherwise(F.col(f"`{first}`")), last: F.when(due, n["last"]).otherwise(F.col(f"`{last}`"))}
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def fix_workbook(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """All sheets of a workbook with their names filled, written anew; returns them."""
    fixed = {k: fill_missing_names(v) for k, v in read_all_sheets(spark, path).items()}
    write_workbook(fixed, out)
    return fixed
