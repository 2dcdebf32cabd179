"""Heavy hitters by Misra-Gries summaries, merged in two levels.

``approx_top_k_accumulate`` keeps a counter table of fixed size per task (the Misra-Gries
family of sketches: counts are decremented together when the table is full), so a key that
holds more than about 1/``tracked`` of the rows is always among the survivors. A first level
merges the tasks' tables in ``groups`` groups, a second one merges the groups, so that no task
reads as many tables as the input has partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = 512


def frequent(df: DataFrame, key: str, tracked: int = TRACKED, top: int = 256, groups: int = 32) -> DataFrame:
    """At most ``top`` candidate keys (a LONG column) with a lower/upper estimate of their count.

    Nulls are not counted. An empty input gives no rows. The result's size is bound by ``top``
    whatever the input's size, so it may be broadcast; counts are estimates to be verified.
    """
    part = F.spark_partition_id() % groups
    summary = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), part.alias("g"))
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("s"))
        .groupBy(F.lit("all"))  # unlike a global aggregate it makes no summary of an empty partition
        .agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    )
    return summary.select(F.explode(F.expr(f"approx_top_k_estimate(s, {top})")).alias("e")).select(
        F.col("e.item").alias(key), F.col("e.count").alias("estimate")
    )
