"""Sources and sinks: folders of reports, pictures, Word documents, sheets, logs, the stream."""


import io
import re
import zipfile
from xml.etree import ElementTree


from pagewright import errors
from pagewright.plans.catalogue import template_bytes
from pagewright.sources import config, docx, rtf
from tests.test_engine import REPORT

SELECTION = "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, parameters array<string>, timelines array<string>"
PNG = "89504E470D0A1A0A"


def picture(extra="\\picwgoal1000\\pichgoal500"):
    return f"{{\\rtf1\\sectd {{\\pict\\pngblip{extra}\n{PNG[:8]}\n{PNG[8:]}}}}}"


def test_folder(spark, tmp_path):
    (tmp_path / "t_14.1.rtf").write_text(REPORT)
    (tmp_path / "latin.RTF").write_bytes(b"{\\rtf1\\sectd\\trowd\\cellx9 caf\xe9\\cell\r\n\\row}")
    (tmp_path / "x.txt").write_text("no")
    assert {r.table_name for r in rtf.catalog(spark, str(tmp_path)).collect()} == {"t_14.1", "latin"}
    texts = rtf.read_texts(spark, str(tmp_path))
    lexed = {(r.doc_id, r.page_no): len(r.rows) for r in rtf.lex(texts).collect()}
    assert lexed == {("t_14.1", 1): 6, ("t_14.1", 2): 4, ("latin", 1): 1}
    assert rtf.rows_of(rtf.lex(texts)).where("doc_id = 'latin'").first().cells[0].text == "café"
    rtf.register(spark)
    assert spark.sql(r"SELECT cell_text(r'{\b Bold}') AS t").first().t == "Bold"
    source = spark.read.format("rtf_report").load(str(tmp_path))
    assert sorted(source.select("doc_id", "page_no").collect()) == sorted(rtf.lex(texts).select("doc_id", "page_no").collect())


def test_pictures(spark):
    cases = {
        "ok": picture(), "no_size": picture(""), "odd": "{\\rtf1{\\pict\\pngblip 895}}", "empty": "{\\rtf1{\\pict\\pngblip}}", "wmf_first": "{\\rtf1{\\pict\\wmf 00}{\\pict\\pngblip 89}}",
        "trailing": "{\\rtf1{\\pict\\pngblip 8950{\\*\\blipuid ab}4E47}}", "table": REPORT, "null": None,
    }
    found = {r.doc_id: r for r in rtf.images(spark.createDataFrame(list(cases.items()), "doc_id string, text string")).collect()}
    assert set(found) == {"ok", "no_size", "odd", "empty", "wmf_first", "trailing"}
    assert bytes(found["ok"].png) == bytes.fromhex(PNG) and (found["ok"].width_twips, found["ok"].height_twips) == (1000, 500)
    assert found["no_size"].width_twips is None and bytes(found["trailing"].png) == b"\xab\x4e\x47"
    assert all(found[k].png is None for k in ("odd", "empty", "wmf_first"))


def test_generation(spark, tmp_path):
    templates = spark.createDataFrame([("a.docx", template_bytes(["B1", "B2", "_hidden"]))], "docx_id string, content binary")
    texts = spark.createDataFrame(
        [("t1", "/r/t1.rtf", REPORT), ("p1", "/r/p1.rtf", picture()), ("p2", "/r/p2.rtf", "{\\rtf1{\\pict\\pngblip 895}}"), ("bad", "/r/bad.rtf", "{\\sectd\\trowd x\\cell\\row}")],
        "doc_id string, path string, text string",
    )
    rows = [(1, "B1", "t1"), (2, "B1", "p1"), (3, "nope", "t1"), (4, "B2", "gone"), (5, "B2", "p2"), (6, "B2", "bad"), (7, "", "t1"), (8, "nope", "p1")]
    cfg = spark.createDataFrame(rows, "row_id int, bookmark string, `table` string")
    made = docx.generate(templates, cfg, texts, spark.createDataFrame([(1, "t1", None, None, None, ["ALT"], None)], SELECTION)).persist()
    status = {r.row_id: r.kind for r in docx.status_of(made).collect()}
    assert status == {1: None, 2: None, 3: "xml_inject_failed", 4: "rtf_unreadable", 5: "image_extract_failed", 6: "rtf_parse_failed", 8: "image_inject_failed"}
    docx.register(spark)
    made.select("docx_id", "content").write.format("docx_report").mode("append").save(str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "a.docx") as z:
        body = ElementTree.fromstring(z.read(docx.DOCUMENT))[0]
        assert z.read("word/media/image1.png") == bytes.fromhex(PNG)
        assert b"rIdImg1" in z.read(docx.RELS) and b"image/png" in z.read(docx.TYPES)
    # later rows stand nearer to the bookmark
    kinds = [c.tag.rsplit("}", 1)[-1] for c in body]
    assert kinds == ["p", "p", "tbl", "p", "p", "sectPr"]
    extent = next(body[1].iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}extent"))
    assert (extent.get("cx"), extent.get("cy")) == ("5943600", "2971800")
    assert len(list(body[2].iter(f"{docx.W}tr"))) == 6


def test_bookmarks(spark):
    templates = spark.createDataFrame([("a", template_bytes(["B1", "_x", "B2", "B1"]))], "docx_id string, content binary")
    assert [(r.ord, r.name) for r in docx.bookmarks(templates).orderBy("ord").collect()] == [(1, "B1"), (3, "B2"), (4, "B1")]
    document = docx.Document(template_bytes(["B1"]))
    assert docx.bookmark_names(document.document) == [("B1", "0")] and document.contexts == {"B1": "body"}


def test_sheets(spark, tmp_path):
    data = config.xlsx_bytes(["bookmark", "TABLE", "Timelines"], [("B1", "t_14.1.rtf", "Week 1; Week 2 "), ("B2", "t_14.1", None), (None, "", " ")])
    (tmp_path / "m.xlsx").write_bytes(data)
    cfg, selections = config.from_sheet(config.read_xlsx(spark, str(tmp_path / "m.xlsx")))
    assert [tuple(r) for r in cfg.orderBy("row_id").collect()] == [(1, "B1", "t_14.1"), (2, "B2", "t_14"), (3, "", "")]
    assert {r.row_id: r.timelines for r in selections.collect()} == {1: ["Week 1", "Week 2"], 2: None}
    sheet = config.to_sheet(cfg, selections)
    rows = config.xlsx_rows(config.export_xlsx(sheet))
    assert rows[:2] == [["Bookmark", "Table", "Parameters", "Timelines"], ["B1", "t_14.1.rtf", "", "Week 1; Week 2"]]
    (tmp_path / "m.csv").write_text("Bookmark,Table\nB1,a.rtf\n")
    assert config.from_sheet(config.read_csv(spark, str(tmp_path / "m.csv")))[0].first().table == "a"


def test_log(spark):
    cfg = spark.createDataFrame([(1, "B", "t"), (2, "C", "u"), (3, "", "v")], "row_id int, bookmark string, `table` string")
    selections = spark.createDataFrame([(1, "t", None, None, None, ["ALT"], [])], SELECTION)
    status = spark.createDataFrame([(2, "x", "broken", None)], "row_id int, kind string, message string, hint string")
    blocks = config.log_blocks(cfg, selections, status)
    lines = [r.value for r in config.log_text(blocks, "me", None, "/r").orderBy("ord").collect()]
    assert "Word file : (not set)" in lines[0] and "Parameters: ALT\nTimelines : (all)" in lines[1] and "ERROR - broken" in lines[2] and len(lines) == 3
    assert "(no table mappings defined)" in [r.value for r in config.log_text(blocks.where("false"), "me", None, None).collect()]


def test_stream(spark, tmp_path):
    from pagewright.streaming import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rtf").write_text(REPORT)
    seen = []
    watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "c"), lambda df, n: seen.append(rtf.rows_of(df).count())).awaitTermination()
    assert seen == [10]


def test_errors():
    e = errors.ExclusionOutOfRange("B", [3, 4], 1)
    assert "3, 4" in str(e) and "1 column)" in str(e) and errors.formatted(e).startswith(f"{e}\nHint: ")
    assert str(errors.RtfUnreadable("/a/b.rtf", ValueError("no"))) == "Cannot read RTF file 'b.rtf'. no"
    assert "inside a table cell" in str(errors.BookmarkBadContext("B", "table")) and "(x)" in str(errors.BookmarkBadContext("B", "x"))
    assert errors.hint_of(ValueError()) is None and errors.formatted(ValueError("v")) == "v"
    assert errors.BookmarkDuplicate("B", [1, 2]).as_row()["fields"]["rows"] == "1, 2"



def test_folder_notices(spark, tmp_path):
    (tmp_path / "none").mkdir()
    gone, kind, said = rtf.load_folder(spark, str(tmp_path / "gone"))
    assert (gone.count(), gone.columns, kind, said) == (0, ["table_name", "path"], "error", "Folder not found. Check the path and try again.")
    assert rtf.load_folder(spark, str(tmp_path / "none"))[1:] == ("warning", "No RTF files found in that folder.")
    (tmp_path / "none" / "a.rtf").write_text(REPORT)
    found, kind, said = rtf.load_folder(spark, str(tmp_path / "none"))
    assert (found.first().table_name, kind, said) == ("a", "message", "Found 1 RTF files.")


def test_reports_are_lexed_once(spark, tmp_path, monkeypatch):
    """What was lexed before is read from the folder; a changed text is lexed again."""
    texts = [("a", REPORT), ("b", REPORT), ("bad", "{\\sectd\\trowd x\\cell\\row}"), ("null", None)]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    order = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    expected, kept = order(rtf.lex(df)), f"file://{tmp_path}/kept"
    seen, plain = [], rtf.lex
    monkeypatch.setattr(rtf, "lex", lambda t, *a, **k: seen.append(sorted(r.text or "" for r in t.collect())) or plain(t, *a, **k))
    assert order(rtf.lex_once(df, kept)) == expected and order(rtf.lex_once(df, kept)) == expected
    more = df.unionByName(spark.createDataFrame([("c", "{\\rtf1\\sectd\\trowd\\cellx9 new\\cell\\row}")], df.schema))
    assert {r.doc_id for r in rtf.lex_once(more, kept).collect()} == {"a", "b", "bad", "c"}
    assert [len(x) for x in seen] == [3, 0, 1]
    assert order(rtf.lex_once(df)) == expected
    assert rtf.lex_once(df, kept, True).count() == len(expected), "escapes decoded are another table"


def test_progress_and_strict(spark):
    inside = '<w:tbl><w:tr><w:tc><w:p><w:bookmarkStart w:id="9" w:name="CELL"/></w:p></w:tc></w:tr></w:tbl>'
    data = template_bytes(["B1"])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts[docx.DOCUMENT] = parts[docx.DOCUMENT].replace(b"<w:sectPr>", inside.encode() + b"<w:sectPr>")
    for where in ("header", "footer"):
        parts[f"word/{where}1.xml"] = f'<w:hdr xmlns:w="{docx.W_NS}"><w:p><w:bookmarkStart w:id="1" w:name="IN_{where}"/></w:p></w:hdr>'.encode()
    parts["word/media/image2.png"] = b"old"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    document = docx.Document(out.getvalue())
    assert [document.add_image(b"x")[0] for _ in range(2)] == [3, 4] and document.parts["word/media/image2.png"] == b"old"
    templates = spark.createDataFrame([("a.docx", out.getvalue())], "docx_id string, content binary")
    texts = spark.createDataFrame([("t1", "/r/t1.rtf", REPORT)], "doc_id string, path string, text string")
    cfg = spark.createDataFrame([(4, "IN_footer", "t1"), (1, "B1", "t1"), (2, "CELL", "t1"), (3, "IN_header", "t1"), (5, "", "t1")], "row_id int, bookmark string, `table` string")
    none = spark.createDataFrame([], SELECTION)
    calls = []
    loose = docx.told(docx.generate(templates, cfg, texts, none), cfg, lambda *a: calls.append(a))
    assert {r.row_id: r.kind for r in loose.collect()} == {1: None, 2: None, 3: "xml_inject_failed", 4: "xml_inject_failed"}
    assert calls == [(i, 4, f"Injecting {b}…") for i, b in enumerate(["B1", "CELL", "IN_header", "IN_footer"], 1)]
    strict = {r.row_id: r.message for r in docx.status_of(docx.generate(templates, cfg, texts, none, strict=True)).collect()}
    assert strict[1] is None and all(w in strict[k] for k, w in {2: "inside a table cell", 3: "in a page header", 4: "in a page footer"}.items())


def test_generation_lexes_once(spark):
    """No plan of a generation holds the lexer: reports were lexed and written before."""
    templates = spark.createDataFrame([("a.docx", template_bytes(["B1"])), ("b.docx", template_bytes(["B1"], None))], "docx_id string, content binary")
    texts = spark.createDataFrame([("t1", "/r/t1.rtf", REPORT)], "doc_id string, path string, text string")
    cfg = spark.createDataFrame([(1, "B1", "t1"), (2, "B1", "t1")], "row_id int, bookmark string, `table` string")
    items = docx.rendered(templates, cfg, texts, spark.createDataFrame([], SELECTION))
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "_pictures" in plan and "CartesianProduct" not in plan
    widths = {(r.docx_id, r.row_id): sum(int(w) for w in re.findall(r'gridCol w:w="(\d+)"', r.xml)) for r in items.collect()}
    assert widths == {("a.docx", 1): 9360, ("a.docx", 2): 9360, ("b.docx", 1): 8640, ("b.docx", 2): 8640}
