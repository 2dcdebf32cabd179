"""Selection, combination, exclusion, info, rendering on the two-page report."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import info, mapping, match, render, select, validate
from pagewright.sources import rtf


def row(*cells, header=False):
    return "\\trowd" + "\\trhdr" * header + "".join(f"\\cellx{(i + 1) * 1500}" for i in range(len(cells))) + "".join(f" {c}\\cell" for c in cells) + "\\row\n"


def page(parameter, *rows):
    head = f"{{\\header\\trowd\\cellx9000 Parameter: {parameter}\\cell\\row}}" if parameter else ""
    return "\\sectd" + head + row("Visit", "N", header=True) + "".join(rows)


REPORT = "{\\rtf1" + "\\sect".join(
    [
        page("ALT", row("pre", 1), row("Week 1", ""), row("a", 2), row("Week 2", ""), row("b", 3)),
        page("AST", row("c", 4), row("Week 2", ""), row("d", 5)),
    ]
) + "}"


@pytest.fixture(scope="module")
def report(spark):
    texts = spark.createDataFrame([("t1", REPORT), ("empty", "{\\rtf1}"), ("bad", "{\\rtf1\\sectd\\trowd x\\cell\\row}"), ("none", None)], "doc_id string, text string")
    lexed = rtf.lex(texts).persist()
    return rtf.pages_of(lexed), rtf.rows_of(lexed), rtf.errors_of(lexed)


def data(df):
    rows = df.where("section = 'data'").orderBy("doc_id", "seq").collect()
    return [r.cells[0].text for r in rows]


def prepared(spark, report, **given):
    names = ("excluded_cols", "excluded_rows", "excluded_header_rows", "parameters", "timelines")
    kinds = "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, parameters array<string>, timelines array<string>"
    return select.prepare(report[0], report[1], spark.createDataFrame([(1, "t1", *(given.get(n) for n in names))], kinds))


@pytest.mark.parametrize(
    ("given", "kept"),
    [
        ({}, ["pre", "Week 1", "a", "Week 2", "b", "c", "Week 2", "d"]),
        ({"parameters": ["ALT"]}, ["pre", "Week 1", "a", "Week 2", "b"]),
        ({"parameters": []}, ["pre", "Week 1", "a", "Week 2", "b", "c", "Week 2", "d"]),
        ({"timelines": ["Week 1"]}, ["pre", "Week 1", "a", "c"]),
        ({"timelines": ["Week 9"]}, ["pre", "c"]),
        ({"parameters": ["AST"], "excluded_rows": [1]}, ["Week 2", "d"]),
    ],
)
def test_prepare(spark, report, given, kept):
    assert data(prepared(spark, report, **given)) == kept


def test_all_columns_excluded_means_all(spark, report):
    assert prepared(spark, report, excluded_cols=[1, 2]).select("cols").first()[0] == [1, 2]
    assert prepared(spark, report, excluded_cols=[1]).select("cols").first()[0] == [2]


def test_errors_do_not_stop_others(report):
    assert [(r.doc_id, r.error) for r in report[2].collect()] == [("bad", "parse_row: a row defines no cell")]


def test_table_info(spark, report):
    out = info.table_info(spark.createDataFrame([("t1",), ("empty",)], "table_name string"), report[0], report[1])
    rows = {r.doc_id: r for r in out.collect()}
    assert rows["t1"][1:] == (2, 8, ["Visit", "N"], ["ALT", "AST"], ["Week 1", "Week 2"], False)
    assert rows["empty"][1:] == (0, 0, [], [], [], False)


def test_html_and_xml(spark, report):
    combined = prepared(spark, report, parameters=["AST"], excluded_header_rows=[1])
    (html,) = render.html_tables(combined, ("row_id", "doc_id")).collect()
    assert html.html.count("<tr>") == 3 and "<thead></thead>" in html.html and html.html.count("border-bottom") == 2
    (xml,) = render.xml_tables(combined.withColumn("w", F.lit(8640)), ("row_id", "doc_id"), "w").collect()
    assert xml.error is None and xml.xml.count("<w:tr>") == 3 and '<w:tblW w:w="8640"' in xml.xml and xml.xml.count('<w:gridCol w:w="4320"/>') == 2


def test_ragged_rows(spark):
    texts = spark.createDataFrame([("r", "{\\rtf1" + page(None, row("a", 1), row("Week 1")) + "}")], "doc_id string, text string")
    lexed = rtf.lex(texts)
    combined = select.with_columns_of(select.combine(rtf.pages_of(lexed), rtf.rows_of(lexed)))
    (xml,) = render.xml_tables(combined).collect()
    assert xml.xml is None and xml.error
    (html,) = render.html_tables(combined).collect()
    assert html.html.count("<td") == 4
    assert info.timelines(rtf.rows_of(lexed)).first().timelines == ["Week 1"]


@pytest.mark.parametrize(
    ("widths", "total", "scaled"),
    [([1000, 1500, 1200], 8640, [2335, 3503, 2802]), ([1, 1, 1], 100, [34, 33, 33]), ([0, 0], 100, [0, 0]), ([5, 6], None, [5, 6]), ([1, 100000], 100, [1, 99])],
)
def test_scale_widths(spark, widths, total, scaled):
    df = spark.createDataFrame([(widths, total)], "w array<int>, t long")
    assert df.select(render.scale_widths(F.col("w"), F.col("t"))).first()[0] == scaled


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("T_14_1_Chol", "Table 14.1 cholesterol", 0.933333), ("T_14_1_Chol", "t14.1", 0.265455), ("T_14_01", "T_14_1", 0.642857),
        ("Demog", "demographics", 0.166667), ("t_14_1", "T_14_1", 1.0), ("", "", 0.0),
    ],
)
def test_match_score(spark, a, b, score):
    from pagewright.functions import text

    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(F.round(text.match_score("a", "b"), 6)).first()[0] == score
    text.register(spark)
    assert df.selectExpr("round(match_score(a, b), 6)").first()[0] == score


def test_fill_and_add(spark):
    cfg = spark.createDataFrame([(1, "T_14_1", ""), (2, "", "x9"), (3, "", ""), (4, "kept", "kept")], "row_id int, bookmark string, `table` string")
    marks = spark.createDataFrame([(1, "T_14_1"), (2, "other"), (3, "kept"), (4, "late"), (5, "later"), (6, "last")], "ord int, name string")
    tables = spark.createDataFrame([("t 14.1 b",), ("t 14.1 a",), ("",)], "table_name string")
    rows = {r.row_id: r for r in match.fill_suggestions(cfg, marks, tables, 0.12).collect()}
    assert rows[1].table == "t 14.1 a" and rows[1].filled and not rows[3].filled and rows[4].table == "kept"
    assert match.best_match(marks, "name", tables.where("false"), "table_name").where("match is null and score = 0").count() == 6
    added = {r.row_id: r.bookmark for r in match.add_missing_bookmarks(cfg, marks).collect()}
    assert added == {1: "T_14_1", 2: "other", 3: "late", 4: "kept", 5: "later", 6: "last"}


def test_grid(spark):
    cfg = mapping.blank(spark)
    assert cfg.count() == 5 and mapping.add_row(cfg).count() == 6 and mapping.remove_last_row(cfg).count() == 4
    assert mapping.remove_last_row(cfg.where("row_id = 1")).count() == 1


def test_validation(spark):
    cfg = spark.createDataFrame([(1, "B1", "T1"), (2, "B1", "T2"), (3, "B2", "T1"), (4, "B3", ""), (5, "", "")], "row_id int, bookmark string, `table` string")
    none = spark.createDataFrame([], "name string"), spark.createDataFrame([], "table_name string")
    rows = {r.row_id: r for r in validate.validate(cfg, *none).collect()}
    assert [rows[i].type for i in range(1, 6)] == ["error", "error", "warning", "warning", ""]
    assert rows[1].message == "Bookmark 'B1' is mapped in multiple rows: 1, 2." and "unusual" in rows[1].hint
    assert rows[5].message == "" and rows[5].hint is None
