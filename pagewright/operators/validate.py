"""Checks of a mapping against the bookmarks, the report catalog and the reports' contents.

Each rule gives a struct (severity, message, hint) or null; a row's rules are folded into one
severity, message and hint. Catalog-sized sides are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import errors
from pagewright.functions.text import trim_blank
from pagewright.operators.mapping import duplicates

NO_STRINGS = "array<string>"
RULE = "struct<severity:string,message:string,hint:string>"
# The rules' messages and hints below.


def _rule(when: Column, severity: str, message: Column, hint: str) -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), message.alias("message"), F.lit(hint).alias("hint")))


def _listed(a: Column) -> Column:
    return F.array_join(a, ", ")


def rules(config: DataFrame, bookmarks: DataFrame, catalog: DataFrame, info: DataFrame | None = None, selections: DataFrame | None = None) -> DataFrame:
    """row_id, bookmark, table and v1 to v9: one column a rule, null where it does not fire."""
    rows = config.select("row_id", trim_blank("bookmark").alias("bookmark"), trim_blank("table").alias("table"))
    known_b = bookmarks.select(F.col("name").alias("bookmark"), F.lit(True).alias("has_bookmark")).distinct()
    known_t = catalog.select(F.col("table_name").alias("table"), F.lit(True).alias("has_table")).distinct()
    sizes = known_b.agg((F.count(F.lit(1)) > 0).alias("any_bookmark")).join(known_t.agg((F.count(F.lit(1)) > 0).alias("any_table")))
    same_b = duplicates(config, "bookmark").select(F.col("name").alias("bookmark"), F.col("rows").alias("b_rows"))
    same_t = duplicates(config, "table").select(F.col("name").alias("table"), F.col("rows").alias("t_rows"))
    joined = rows.join(known_b, "bookmark", "left").join(known_t, "table", "left").join(same_b, "bookmark", "left").join(same_t, "table", "left").join(F.broadcast(sizes))
    if info is None:
        joined = joined.withColumns({"n_cols": F.lit(0), "known_p": F.array().cast(NO_STRINGS), "known_l": F.array().cast(NO_STRINGS), "image": F.lit(False)})
    else:
        known = info.select(F.col("doc_id").alias("table"), "n_cols", F.col("parameters").alias("known_p"), F.col("timelines").alias("known_l"), F.col("is_image").alias("image"))
        joined = joined.join(known, "table", "left")
    if selections is None:
        joined = joined.withColumns({"excluded_cols": F.array().cast("array<int>"), "sel_p": F.array().cast(NO_STRINGS), "sel_l": F.array().cast(NO_STRINGS)})
    else:
        joined = joined.join(selections.select("row_id", "excluded_cols", F.col("parameters").alias("sel_p"), F.col("timelines").alias("sel_l")), "row_id", "left")
    b, t = F.col("bookmark"), F.col("table")
    has_b, has_t = b != "", t != ""
    readable = F.coalesce(F.col("has_table") & ~F.col("image"), F.lit(False))
    bad_p = F.array_except("sel_p", "known_p")
    bad_l = F.array_except("sel_l", "known_l")
    bad_c = F.filter("excluded_cols", lambda c: (c < 1) | (c > F.col("n_cols")))

    def unknown(bad: Column, known: str) -> Column:
        return F.coalesce(readable & (F.size(known) > 0) & (F.size(bad) > 0), F.lit(False))

    out_of_range = F.format_string(
        "Excluded column index %s is out of range for bookmark '%s' (table has %d column%s).", _listed(bad_c), b, F.col("n_cols"), F.when(F.col("n_cols") == 1, "").otherwise("s")
    )
    return joined.select(
        "row_id", "bookmark", "table",
        _rule(has_b & ~has_t, "warning", F.lit("Bookmark set but no table selected"), "Select an RTF table in the Table column for this row.").alias("v1"),
        _rule(has_t & ~has_b, "warning", F.lit("Table set but no bookmark selected"), "Select a bookmark in the Bookmark column for this row.").alias("v2"),
        _rule(
            has_b & F.col("any_bookmark") & F.col("has_bookmark").isNull(), "error",
            F.format_string("Bookmark '%s' not found in the Word document.", b), errors.BookmarkMissing.hint,
        ).alias("v3"),
        _rule(
            has_b & F.col("b_rows").isNotNull(), "error",
            F.format_string("Bookmark '%s' is mapped in multiple rows: %s.", b, _listed(F.col("b_rows"))), errors.BookmarkDuplicate.hint,
        ).alias("v4"),
        _rule(
            has_t & F.col("any_table") & F.col("has_table").isNull(), "error",
            F.format_string("Cannot read RTF file '%s'. not found in RTF folder", F.element_at(F.split(t, "/"), -1)), errors.RtfUnreadable.hint,
        ).alias("v5"),
        _rule(
            has_t & F.col("t_rows").isNotNull(), "warning", F.format_string("Table '%s' is mapped in multiple rows: %s", t, _listed(F.col("t_rows"))),
            "This is allowed but unusual. Verify that both bookmarks should receive the same table.",
        ).alias("v6"),
        _rule(
            unknown(bad_p, "known_p"), "warning", F.concat(F.lit("Unknown parameter(s): "), _listed(bad_p)),
            "These parameter values were not found in the RTF file. They may have been renamed or removed.",
        ).alias("v7"),
        _rule(
            unknown(bad_l, "known_l"), "warning", F.concat(F.lit("Unknown timeline(s): "), _listed(bad_l)),
            "These timeline labels were not found in the RTF file. Re-open the table and reselect timelines.",
        ).alias("v8"),
        _rule(
            F.coalesce(readable & (F.col("n_cols") > 0) & (F.size(bad_c) > 0), F.lit(False)), "warning", out_of_range, errors.ExclusionOutOfRange.hint
        ).alias("v9"),
    )


def folded(checked: DataFrame) -> DataFrame:
    """row_id, type ('error', 'warning' or ''), message, hint: errors hide the warnings' messages,
    but the hints of both are joined, each once; a row without names has neither."""
    fired = F.filter(F.array(*(F.col(f"v{i}") for i in range(1, 10))), lambda r: r.isNotNull())

    def messages(kind: str) -> Column:
        return F.transform(F.filter("fired", lambda r: r["severity"] == kind), lambda r: r["message"])

    hints = F.array_join(F.array_distinct(F.transform("fired", lambda r: r["hint"])), " ")
    rows = checked.withColumn("fired", F.when((F.col("bookmark") == "") & (F.col("table") == ""), F.array().cast(f"array<{RULE}>")).otherwise(fired))
    has_error, has_any = F.size(messages("error")) > 0, F.size("fired") > 0
    return rows.select(
        "row_id",
        F.when(has_error, "error").when(has_any, "warning").otherwise("").alias("type"),
        F.when(has_error, F.array_join(messages("error"), "; ")).otherwise(F.array_join(messages("warning"), "; ")).alias("message"),
        F.when(has_any, hints).alias("hint"),
    )


def validate(config: DataFrame, bookmarks: DataFrame, catalog: DataFrame, info: DataFrame | None = None, selections: DataFrame | None = None) -> DataFrame:
    return folded(rules(config, bookmarks, catalog, info, selections))
