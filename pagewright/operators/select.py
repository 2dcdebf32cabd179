"""Selection, combination and exclusion of pages, rows and columns.

Tables carry (doc_id, page_no, row_no): order never depends on partitions. ``item`` names what a
result is combined by: a document, or a mapping's row where documents are mapped more than once.
A report is one file and is lexed in one task, so windows by document hold no more than a task did.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import is_blank, trim_blank

NO_INTS = "array<int>"


def filter_pages(df: DataFrame, parameters: Sequence[str] | None) -> DataFrame:
    """Pages (or their rows) of the given parameters; those without one stay. None or empty: all."""
    if not parameters:
        return df
    return df.where(F.col("parameter").isNull() | F.col("parameter").isin(list(parameters)))


def label_of(cells: Column | str = "cells") -> Column:
    """The trimmed first cell of a row whose other cells are blank, else null."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    first = trim_blank(F.get(cells, F.lit(0))["text"])
    alone = F.forall(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: is_blank(c["text"]))
    return F.when((F.size(cells) > 0) & (F.length(first) > 0) & alone, first)


def with_timeline(rows: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds ``timeline``: the latest label at or above each data row of the same page."""
    label = F.when(~F.col("is_header"), label_of())
    page = Window.partitionBy(*keys, "page_no", "parameter").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("timeline", F.last(label, ignorenulls=True).over(page))


def filter_timelines(rows: DataFrame, timelines: Sequence[str] | None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Data rows whose timeline is one of those given, and rows above a page's first label."""
    if not timelines:
        return rows
    wanted = F.col("timeline").isNull() | F.col("timeline").isin(list(timelines)) | F.col("is_header")
    return with_timeline(rows, keys).where(wanted).drop("timeline")


def select_by(df: DataFrame, selections: DataFrame) -> DataFrame:
    """Pages or rows for each selection (row_id, doc_id, parameters, timelines, excluded_*):
    a row for each mapping that uses the document, page filter applied."""
    params = F.coalesce("parameters", F.array().cast("array<string>"))
    joined = df.join(selections, "doc_id")
    return joined.where(F.col("parameter").isNull() | (F.size(params) == 0) | F.array_contains(params, F.col("parameter")))


def timelines_by(rows: DataFrame, item: Sequence[str] = ("row_id", "doc_id")) -> DataFrame:
    """As ``filter_timelines``, with each row's own list in ``timelines``."""
    lines = F.coalesce("timelines", F.array().cast("array<string>"))
    wanted = F.col("timeline").isNull() | F.col("is_header") | (F.size(lines) == 0) | F.array_contains(lines, F.col("timeline"))
    return with_timeline(rows, item).where(wanted).drop("timeline")


def combine(pages: DataFrame, rows: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One table for each item: the data rows of all pages, the header rows of the first page.

    ``section`` is 'header' or 'data'; ``seq`` counts from 1 in it; ``n_section`` is its size."""
    first = pages.groupBy(*item).agg(F.min("page_no").alias("first_page"))
    kept = rows.join(first, list(item)).where(~F.col("is_header") | (F.col("page_no") == F.col("first_page"))).drop("first_page")
    return renumbered(kept.withColumn("section", F.when(F.col("is_header"), "header").otherwise("data")), item)


def renumbered(rows: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    whole = Window.partitionBy(*item, "section")
    order = ["page_no", "row_no"]
    return rows.withColumns({"seq": F.row_number().over(whole.orderBy(*order)), "n_section": F.count(F.lit(1)).over(whole)})


def reference_rows(combined: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each item the cells that give its columns: the first header row's, else the first data row's."""
    rank = F.struct((F.col("section") != "header").alias("data"), "seq")
    return combined.groupBy(*item).agg(
        F.min_by("cells", rank).alias("ref"),
        F.min_by("cells", F.when(F.col("section") == "header", F.col("seq"))).alias("head"),
        F.count_if(F.col("section") == "data").alias("n_rows"),
    )


def with_columns_of(combined: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Adds ``widths`` and ``names`` (of the first header row) of each item to its rows."""
    ref = reference_rows(combined, item)
    columns = ref.select(
        *item,
        F.transform("ref", lambda c: c["width_twips"]).alias("widths"),
        F.transform(F.coalesce("head", F.slice("ref", 1, 0)), lambda c: c["text"]).alias("names"),
    )
    return combined.join(columns, list(item))


def numbers_to(n: Column) -> Column:
    """1 to n; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast(NO_INTS))


def resolve_cols(wanted: Column, n_cols: Column, names: Column) -> Column:
    """Column places from a list of strings: numbers, or, if any is no number, names of the first
    header row (first hit). What is out of range goes; nothing left, or no list, means all."""
    as_int = F.transform(wanted, lambda x: x.try_cast("double").try_cast("int"))
    by_name = F.filter(F.transform(wanted, lambda x: F.array_position(names, x).cast("int")), lambda p: p > 0)
    chosen = F.when(F.exists(as_int, lambda x: x.isNull()), by_name).otherwise(as_int)
    valid = F.filter(chosen, lambda p: (p >= 1) & (p <= n_cols))
    return F.when(wanted.isNull() | (F.size(valid) == 0), numbers_to(n_cols)).otherwise(valid)


def project_cells(cells: Column, cols: Column) -> Column:
    """The cells at the given places; null where a row is too short."""
    return F.transform(cols, lambda i: F.get(cells, i - 1))


def slice_rows(combined: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Data rows from start to end, both counted from 1; header rows stay."""
    low, high = max(1, start or 1), end
    inside = F.col("seq") >= low
    if high is not None:
        inside = inside & (F.col("seq") <= high)
    return combined.where((F.col("section") == "header") | inside)


def included_cols(widths: Column, excluded: Column) -> Column:
    """Places left after exclusion; if none is left, all."""
    everything = numbers_to(F.size(widths))
    left = F.array_except(everything, F.coalesce(excluded, F.array().cast(NO_INTS)))
    return F.when(F.size(left) == 0, everything).otherwise(left)


def exclude(combined: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Drops excluded rows and header rows (numbers of the combined table, after all filters),
    renumbers, and adds ``cols``, the places left. Needs excluded_cols, excluded_rows,
    excluded_header_rows, and widths from ``with_columns_of``."""
    gone = F.when(F.col("section") == "header", F.col("excluded_header_rows")).otherwise(F.col("excluded_rows"))
    kept = combined.where(~F.array_contains(F.coalesce(gone, F.array().cast(NO_INTS)), F.col("seq")))
    return renumbered(kept, item).withColumn("cols", included_cols(F.col("widths"), F.col("excluded_cols")))


def prepare(pages: DataFrame, rows: DataFrame, selections: DataFrame, item: Sequence[str] = ("row_id", "doc_id")) -> DataFrame:
    """All of a selection: pages by parameter, rows by timeline, one table, exclusions."""
    mine = selections.select(*item, "parameters")
    kept_rows = timelines_by(select_by(rows, selections), item)
    return exclude(with_columns_of(combine(select_by(pages, mine), kept_rows, item), item), item)
