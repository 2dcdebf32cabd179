"""The mapping grid: blank rows, adding and removing rows, duplicates, valid rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import trim_blank

BLANK_ROWS = 5


def blank(spark: SparkSession, n: int = BLANK_ROWS) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("row_id"), F.lit("").alias("bookmark"), F.lit("").alias("table"))


def add_row(config: DataFrame) -> DataFrame:
    new = config.agg((F.coalesce(F.max("row_id"), F.lit(0)) + 1).alias("row_id")).select("row_id", F.lit("").alias("bookmark"), F.lit("").alias("table"))
    return config.select("row_id", "bookmark", "table").unionByName(new)


def remove_last_row(config: DataFrame) -> DataFrame:
    """Without the last row, unless it is the only one."""
    ends = config.agg(F.max("row_id").alias("last"), F.min("row_id").alias("first"))
    return config.join(F.broadcast(ends)).where((F.col("row_id") < F.col("last")) | (F.col("first") == F.col("last"))).drop("last", "first")


def valid_rows(config: DataFrame, trimmed: bool = False) -> DataFrame:
    """Rows with both names."""
    b, t = (trim_blank("bookmark"), trim_blank("table")) if trimmed else (F.col("bookmark"), F.col("table"))
    return config.where((b != "") & (t != ""))


def duplicates(config: DataFrame, column: str) -> DataFrame:
    """(name, rows): names of two or more rows, with their row numbers."""
    named = config.select("row_id", trim_blank(column).alias("name")).where(F.col("name") != "")
    return named.groupBy("name").agg(F.sort_array(F.collect_list("row_id")).alias("rows")).where(F.size("rows") > 1)


def reset_rows(selections: DataFrame, row_ids: Sequence[int]) -> DataFrame:
    """Selections without what was chosen for the given rows."""
    return selections.where(~F.col("row_id").isin(list(row_ids)))


def in_order(selections: DataFrame) -> DataFrame:
    """Selections whose excluded places are each listed once, in ascending order."""
    names = ("excluded_cols", "excluded_rows", "excluded_header_rows")
    return selections.withColumns({n: F.array_sort(F.array_distinct(n)) for n in names})
