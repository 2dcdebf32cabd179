"""Summaries of reports: parameters, timelines, table info."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.select import combine, label_of, reference_rows

NO_STRINGS = "array<string>"


def _in_order(value: str, place: Column, name: str, rows: DataFrame) -> DataFrame:
    """Distinct values of each document by first appearance, as an array."""
    first = rows.where(F.col(value).isNotNull()).groupBy("doc_id", value).agg(F.min(place).alias("place"))
    ordered = F.sort_array(F.collect_list(F.struct("place", value)))
    return first.groupBy("doc_id").agg(F.transform(ordered, lambda x: x[value]).alias(name))


def parameters(pages: DataFrame) -> DataFrame:
    return _in_order("parameter", F.struct("page_no"), "parameters", pages)


def timelines(rows: DataFrame) -> DataFrame:
    labelled = rows.where(~F.col("is_header")).select("doc_id", "page_no", "row_no", label_of().alias("label"))
    return _in_order("label", F.struct("page_no", "row_no"), "timelines", labelled)


def table_info(catalog: DataFrame, pages: DataFrame, rows: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """A row for each table of the catalog (table_name), zeros and empty lists where it has no rows."""
    ref = reference_rows(combine(pages, rows)).select(
        "doc_id", F.size("ref").alias("n_cols"), F.col("n_rows").cast("int").alias("n_rows"), F.transform("ref", lambda c: c["text"]).alias("col_names")
    )
    joined = catalog.select(F.col("table_name").alias("doc_id")).join(ref, "doc_id", "left").join(parameters(pages), "doc_id", "left").join(timelines(rows), "doc_id", "left")
    flagged = joined.withColumn("is_image", F.lit(False))
    if images is not None:
        flagged = joined.join(images.select("doc_id", F.lit(True).alias("is_image")), "doc_id", "left").withColumn("is_image", F.coalesce("is_image", F.lit(False)))
    empty = F.array().cast(NO_STRINGS)
    return flagged.select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_cols", "n_rows")),
        *(F.coalesce(c, empty).alias(c) for c in ("col_names", "parameters", "timelines")),
        "is_image",
    )
