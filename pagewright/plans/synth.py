"""Reports made of DataFrames: RTF texts built by column expressions.

A report's lines are (doc_id, page_no, parameter, line, kind, cells): kind is 'header', 'label' or
'data', cells an array of plain texts. One file is one row of the result, as a report is one file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import replace_all


def rtf_text(c: Column) -> Column:
    """Plain text as RTF: backslash and braces are escaped."""
    return replace_all(c, ("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"))


def row_rtf(cells: Column, edges: Column, header: Column) -> Column:
    """One table row; ``edges`` are the cells' right edges in twips, with any merge marks."""
    bounds = F.array_join(edges, "")
    body = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("\\pard\\intbl\\ql "), rtf_text(c), F.lit("\\cell"))), "\n")
    return F.concat(F.lit("\\trowd"), F.when(header, "\\trhdr").otherwise(""), bounds, F.lit("\n"), body, F.lit("\\row\n"))


def plain_edges(widths: Sequence[int]) -> Column:
    total, out = 0, []
    for w in widths:
        total += w
        out.append(F.lit(f"\\cellx{total}"))
    return F.array(*out)


def report_from_lines(lines: DataFrame, widths: Sequence[int]) -> DataFrame:
    """(doc_id, text): the RTF of each document."""
    row = row_rtf(F.col("cells"), plain_edges(widths), F.col("kind") == "header")
    pages = lines.groupBy("doc_id", "page_no", "parameter").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", row.alias("rtf")))), lambda r: r["rtf"]), "").alias("body")
    )
    named = F.when(
        F.col("parameter").isNotNull(),
        F.concat(F.lit("{\\header\\trowd\\cellx9000 Parameter: "), rtf_text(F.col("parameter")), F.lit("\\cell\\row}")),
    ).otherwise("")
    page = F.concat(F.lit("\\sectd"), named, F.lit("\n"), F.col("body"))
    ordered = F.sort_array(F.collect_list(F.struct("page_no", page.alias("rtf"))))
    text = F.concat(F.lit("{\\rtf1\\ansi\n"), F.array_join(F.transform(ordered, lambda p: p["rtf"]), "\\sect\n"), F.lit("}"))
    return pages.groupBy("doc_id").agg(text.alias("text"))


def orders_lines(orders: DataFrame) -> DataFrame:
    """Orders as one report: a page for each priority, with a total above the first label, a label
    for each year and the number of orders by status; then a page without a parameter."""
    year = F.concat(F.lit("Year "), F.year("o_orderdate").cast("string"))
    counts = orders.groupBy(F.col("o_orderpriority").alias("parameter"), year.alias("tl"), F.col("o_orderstatus").alias("c1")).agg(F.count(F.lit(1)).alias("n"))
    pages = counts.select("parameter").distinct().selectExpr("parameter", "cast(row_number() over (order by parameter) as int) AS page_no")

    def line(df: DataFrame, kind: str, k: int, tl: Column, c1: Column, c2: Column) -> DataFrame:
        return df.select("parameter", F.lit(kind).alias("kind"), F.struct(F.lit(k).alias("k"), tl.alias("tl"), F.lit(kind != "label").alias("d"), c1.alias("c1")).alias("line"), F.array(c1, c2).alias("cells"))

    blank = F.lit("")
    by_parameter = counts.groupBy("parameter").agg(F.sum("n").alias("n"))
    lines = (
        line(by_parameter, "header", 0, blank, F.lit("Status"), F.lit("N"))
        .unionByName(line(by_parameter, "data", 1, blank, F.lit("Total"), F.col("n").cast("string")))
        .unionByName(line(counts.select("parameter", "tl").distinct(), "label", 2, F.col("tl"), F.col("tl"), blank))
        .unionByName(line(counts, "data", 2, F.col("tl"), F.col("c1"), F.col("n").cast("string")))
    ).join(pages, "parameter")
    status = counts.groupBy("c1").agg(F.sum("n").alias("n")).withColumn("parameter", F.lit(None).cast("string"))
    last = line(status.limit(1), "header", 0, blank, F.lit("Status"), F.lit("N")).unionByName(line(status, "data", 1, blank, F.col("c1"), F.col("n").cast("string")))
    last = last.withColumn("page_no", F.lit(1_000_000))
    return lines.unionByName(last.select(lines.columns)).withColumn("doc_id", F.lit("orders"))


def orders_report(orders: DataFrame) -> DataFrame:
    return report_from_lines(orders_lines(orders), (3000, 1500))
