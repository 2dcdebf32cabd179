"""Connected components by alternating large-star and small-star steps.

Each step rewires links toward smaller nodes with joins and partial aggregates, and writes the
links to the shared folder, so lineage stays short and nothing is collected: the driver sees a
count and a checksum of the links. The smallest neighbours are written too, so that a hub's rows
meet them in a plain join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import delete, written


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node that has a link to another one; root: the component's smallest.

    Links of a node to itself and null ends count for nothing; repeats are harmless.
    """
    links, path = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links"
    )
    was = _sum(links)
    while was[0]:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least, least_path = written(both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("u"), F.least("hi", "m").alias("m")), "least")
        large = (
            both.where(F.col("lo") > F.col("hi")).join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(own.withColumnRenamed("hi", "u"), F.col("hi") == F.col("u")).where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        links, new = written(moved.unionByName(own.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        for done in (path, least_path):  # the new table does without them
            delete(edges.sparkSession, done)
        path, now = new, _sum(links)
        if now == was:
            break
        was = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
