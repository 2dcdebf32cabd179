"""HTML and Word renderings of combined tables, as column expressions.

Cells stay an array on their row: a row's markup is a transform over it, and a table's is one
ordered aggregate by item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import escape_html, escape_xml, is_blank, twips_to_px
from pagewright.operators.select import combine, numbers_to, prepare, project_cells, select_by, timelines_by, with_columns_of

PREVIEW_ROWS = 200
RULE = "border-bottom:2px solid black;"
#: Markup of previews and of Word tables.
TABLE_STYLE = "font-family:'Times New Roman',Times,serif;font-size:10pt;border-collapse:collapse"
NOTICE_STYLE = "padding:4px 0;text-align:center;font-style:italic;color:#888;border-top:1px solid #ccc;"
BOTTOM = '<w:tcBorders><w:bottom w:val="single" w:sz="8" w:space="0" w:color="000000"/></w:tcBorders>'
FONT = '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/><w:sz w:val="20"/><w:szCs w:val="20"/>'
W_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _text(c: Column) -> Column:
    return F.coalesce(c["text"], F.lit(""))


def _align(c: Column, i: Column) -> Column:
    """A cell's own alignment, else left in the first shown column and center in the others."""
    return F.coalesce(c["align"], F.when(i == 0, "left").otherwise("center"))


def _span(c: Column) -> Column:
    return F.coalesce(c["colspan"], F.lit(1))


def _ruled(c: Column, last: Column) -> Column:
    return last | ~is_blank(_text(c))


def html_header_row(cells: Column, last: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        span = F.when(_span(c) > 1, F.format_string(' colspan="%d"', _span(c))).otherwise("")
        style = F.concat(F.when(_ruled(c, last), RULE).otherwise(""), F.lit("padding:0;text-align:"), _align(c, i))
        return F.when(_span(c) == 0, "").otherwise(F.concat(F.lit("<th"), span, F.lit(' style="'), style, F.lit('"><b>'), escape_html(_text(c)), F.lit("</b></th>")))

    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, one), ""), F.lit("</tr>"))


def html_data_row(cells: Column, last: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        return F.concat(
            F.lit('<td style="'), F.when(last, RULE).otherwise(""), F.lit("padding:0;text-align:"), _align(c, i), F.lit('">'), escape_html(_text(c)), F.lit("</td>")
        )

    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, one), ""), F.lit("</tr>"))


def _xml_cell(properties: Column, align: Column, bold: str, text: Column) -> Column:
    return F.concat(
        F.lit("<w:tc><w:tcPr>"), properties, F.lit('<w:jc w:val="'), align, F.lit('"/></w:tcPr><w:p><w:pPr><w:jc w:val="'), align,
        F.lit(f'"/><w:spacing w:before="0" w:after="0"/></w:pPr><w:r><w:rPr>{bold}{FONT}</w:rPr><w:t xml:space="preserve">'),
        escape_xml(text), F.lit("</w:t></w:r></w:p></w:tc>"),
    )


def xml_header_row(cells: Column, last: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        span = F.when(_span(c) > 1, F.format_string('<w:gridSpan w:val="%d"/>', _span(c))).otherwise("")
        borders = F.when(_ruled(c, last), BOTTOM).otherwise("")
        return F.when(_span(c) == 0, "").otherwise(_xml_cell(F.concat(span, borders), _align(c, i), "<w:b/>", _text(c)))

    return F.concat(F.lit("<w:tr><w:trPr><w:tblHeader/></w:trPr>"), F.array_join(F.transform(cells, one), ""), F.lit("</w:tr>"))


def xml_data_row(cells: Column, last: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        return _xml_cell(F.when(last, BOTTOM).otherwise(""), _align(c, i), "", _text(c))

    return F.concat(F.lit("<w:tr>"), F.array_join(F.transform(cells, one), ""), F.lit("</w:tr>"))


def scale_widths(widths: Column, total: Column) -> Column:
    """Widths in proportion to a total: rounded half to even, one at least, the remainder on the
    first widest. Widths of sum zero, or a null total, stay as they are."""
    from_sum = F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)
    scaled = F.transform(widths, lambda w: F.greatest(F.lit(1).cast("long"), F.bround(w * (total / from_sum)).cast("long")))
    rest = total.cast("long") - F.aggregate(scaled, F.lit(0).cast("long"), lambda a, w: a + w)
    widest = F.array_position(scaled, F.array_max(scaled)) - 1
    fixed = F.transform(scaled, lambda w, i: F.when(i == widest, w + rest).otherwise(w))
    return F.when(total.isNotNull() & (from_sum > 0), fixed).otherwise(F.transform(widths, lambda w: w.cast("long")))


def _shown(combined: DataFrame) -> DataFrame:
    """Adds what a table's rows need: cells of the chosen columns, their widths, the last-row flag."""
    cols = F.col("cols") if "cols" in combined.columns else numbers_to(F.size("widths"))
    return combined.withColumns(
        {
            "shown": F.when(F.size("widths") > 0, project_cells(F.col("cells"), cols)).otherwise(F.col("cells")),
            "shown_widths": F.filter(project_cells(F.col("widths"), cols), lambda w: w.isNotNull()),
            "last": F.col("seq") == F.col("n_section"),
        }
    )


def _joined(section: str, markup: str) -> Column:
    rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("seq", markup))))
    return F.array_join(F.transform(rows, lambda r: r[markup]), "")


def html_rows(combined: DataFrame) -> DataFrame:
    """The combined rows with ``html``; data rows beyond the preview's limit are gone, and a table
    that is cut has no bottom border."""
    last = F.col("last") & ((F.col("section") == "header") | (F.col("n_section") <= PREVIEW_ROWS))
    rows = _shown(combined).where((F.col("section") == "header") | (F.col("seq") <= PREVIEW_ROWS))
    return rows.withColumn("html", F.when(F.col("section") == "header", html_header_row(F.col("shown"), last)).otherwise(html_data_row(F.col("shown"), last)))


def notice(n_cols: Column, n_rows: Column) -> Column:
    """The row that says how many rows are not shown; empty if all are."""
    text = F.format_string(f'<tr><td colspan="%d" style="{NOTICE_STYLE}">%d rows not shown - table truncated for preview</td></tr>', n_cols, n_rows - PREVIEW_ROWS)
    return F.when(n_rows > PREVIEW_ROWS, text).otherwise("")


def _html_tables(rows: DataFrame, item: Sequence[str], widths: str, style: str, n_notice: Column) -> DataFrame:
    n_data = F.max(F.when(F.col("section") == "data", F.col("n_section")))
    parts = rows.groupBy(*item).agg(
        _joined("header", "html").alias("head"),
        _joined("data", "html").alias("body"),
        F.coalesce(n_data, F.lit(0)).cast("int").alias("n_data"),
        F.first(widths).alias("w"),
        F.first(n_notice).alias("n_cols"),
    )
    group = F.array_join(F.transform("w", lambda w: F.format_string('<col style="width:%dpx">', twips_to_px(w))), "")
    table = F.concat(
        F.lit(f'<table style="{style}"><colgroup>'), group, F.lit("</colgroup><thead>"), F.col("head"), F.lit("</thead><tbody>"),
        F.col("body"), notice(F.col("n_cols"), F.col("n_data")), F.lit("</tbody></table>"),
    )
    return parts.select(*item, table.alias("html"))


def html_tables(combined: DataFrame, item: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(item, html) of combined rows that have ``widths`` and, after exclusions, ``cols``."""
    return _html_tables(html_rows(combined), item, "shown_widths", TABLE_STYLE, F.size("shown_widths"))


def selection_rows(combined: DataFrame) -> DataFrame:
    """The combined rows with ``html`` of the selection pane: nothing is hidden; what is excluded is
    grey; each cell names the columns it spans, each row its number and kind."""
    none = F.array().cast("array<int>")
    cols = F.coalesce("excluded_cols", none)
    row_off = F.array_contains(F.coalesce(F.when(F.col("section") == "header", F.col("excluded_header_rows")).otherwise(F.col("excluded_rows")), none), F.col("seq"))
    last = F.col("last") & ((F.col("section") == "header") | (F.col("n_section") <= PREVIEW_ROWS))

    def grey(off: Column) -> Column:
        return F.when(off, "opacity:0.3;").otherwise("")

    def first_column(i: Column) -> Column:
        """Columns that the cells before the i-th one take."""
        before = F.slice("cells", F.lit(1), i)
        return F.aggregate(before, F.lit(1), lambda n, c: n + _span(c))

    def header(c: Column, i: Column) -> Column:
        start = first_column(i)
        spanned = F.sequence(start, start + F.greatest(_span(c), F.lit(1)) - 1)
        named = F.when(_span(c) > 1, F.concat(F.lit("["), F.array_join(spanned.cast("array<string>"), ","), F.lit("]"))).otherwise(start.cast("string"))
        span = F.when(_span(c) > 1, F.format_string(' colspan="%d"', _span(c))).otherwise("")
        style = F.concat(F.when(_ruled(c, last), RULE).otherwise(""), grey(row_off | F.arrays_overlap(spanned, cols)), F.lit("padding:0;text-align:"), _align(c, i))
        cell = F.concat(F.lit("<th"), span, F.lit(' style="'), style, F.lit(";cursor:pointer\" data-col='"), named, F.lit("'><b>"), escape_html(_text(c)), F.lit("</b></th>"))
        return F.when(_span(c) == 0, "").otherwise(cell)

    def data(c: Column, i: Column) -> Column:
        style = F.concat(F.when(last, RULE).otherwise(""), grey(row_off | F.array_contains(cols, i + 1)), F.lit("padding:0;text-align:"), _align(c, i))
        return F.concat(F.lit('<td style="'), style, F.lit("\" data-col='"), (i + 1).cast("string"), F.lit("'>"), escape_html(_text(c)), F.lit("</td>"))

    is_header = F.col("section") == "header"
    body = F.array_join(F.when(is_header, F.transform("cells", header)).otherwise(F.transform("cells", data)), "")
    opening = F.when(is_header, F.concat(F.format_string('<tr data-row="%d" data-rowtype="header"', F.col("seq")), F.when(row_off, ' style="opacity:0.3"').otherwise(""))).otherwise(
        F.concat(F.format_string('<tr data-row="%d" data-rowtype="data" style="cursor:pointer', F.col("seq")), F.when(row_off, ";opacity:0.3").otherwise(""), F.lit('"'))
    )
    rows = _shown(combined).where(is_header | (F.col("seq") <= PREVIEW_ROWS))
    return rows.withColumn("html", F.concat(opening, F.lit(">"), body, F.lit("</tr>")))


def selection_html(pages: DataFrame, rows: DataFrame, selections: DataFrame) -> DataFrame:
    """(row_id, doc_id, html) of the selection pane: filters apply, exclusions only grey."""
    item = ("row_id", "doc_id")
    combined = combine(select_by(pages, selections.select("row_id", "doc_id", "parameters")), timelines_by(select_by(rows, selections)), item)
    return _html_tables(selection_rows(with_columns_of(combined, item)), item, "widths", f"{TABLE_STYLE};user-select:none", F.size("widths"))


def output_html(pages: DataFrame, rows: DataFrame, selections: DataFrame) -> DataFrame:
    """(row_id, doc_id, html) of the output pane: exclusions are gone."""
    return html_tables(prepare(pages, rows, selections), ("row_id", "doc_id"))


def full_html(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, html) of whole reports."""
    return html_tables(with_columns_of(combine(pages, rows)))


def xml_rows(combined: DataFrame) -> DataFrame:
    """The combined rows with ``xml``, and ``ragged`` where a shown cell is missing."""
    rows = _shown(combined)
    markup = F.when(F.col("section") == "header", xml_header_row(F.col("shown"), F.col("last"))).otherwise(xml_data_row(F.col("shown"), F.col("last")))
    return rows.withColumns({"xml": markup, "ragged": F.exists("shown", lambda c: c.isNull())})


RAGGED = "a row has fewer cells than the table has columns"


def xml_opening(widths: Column) -> Column:
    """What stands in a ``w:tbl`` before its rows."""
    total = F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w)
    grid = F.array_join(F.transform(widths, lambda w: F.format_string('<w:gridCol w:w="%d"/>', w)), "")
    return F.concat(F.lit(f'<w:tbl xmlns:w="{W_NS}"><w:tblPr><w:tblW w:w="'), total.cast("string"), F.lit('" w:type="dxa"/></w:tblPr><w:tblGrid>'), grid, F.lit("</w:tblGrid>"))


def xml_tables(combined: DataFrame, item: Sequence[str] = ("doc_id",), text_width: str | None = None) -> DataFrame:
    """(item, xml, error): a ``w:tbl`` for each item, as wide as its column ``text_width`` says in
    twips, if one is given. A table with a row too short for its columns has no xml but an error."""
    given = F.lit(None).cast("long") if text_width is None else F.col(text_width).cast("long")
    parts = xml_rows(combined).groupBy(*item).agg(
        _joined("header", "xml").alias("head"), _joined("data", "xml").alias("body"),
        F.first("shown_widths").alias("w"), F.max("ragged").alias("ragged"), F.first(given).alias("given"),
    )
    opening = xml_opening(scale_widths(F.col("w"), F.col("given")))
    table = F.concat(opening, F.col("head"), F.col("body"), F.lit("</w:tbl>"))
    return parts.select(*item, F.when(~F.col("ragged"), table).alias("xml"), F.when(F.col("ragged"), RAGGED).alias("error"))


def output_xml(pages: DataFrame, rows: DataFrame, selections: DataFrame, item: Sequence[str] = ("row_id", "doc_id"), text_width: str | None = None) -> DataFrame:
    return xml_tables(prepare(pages, rows, selections, item), item, text_width)
