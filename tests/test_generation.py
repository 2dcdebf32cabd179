"""Word files that are written in pieces: the same bytes as from whole tables, and nothing large at once."""

import contextlib
import hashlib
import io
import re
import tracemalloc
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa

from pagewright import errors
from pagewright.arrow import ARROW_BYTES
from pagewright.plans.catalogue import template_bytes
from pagewright.sources import docx, rtf
from tests.test_documents import SELECTION, picture

ROWS = 1500


def report(*odd: str) -> str:
    """Two header rows and many data rows, with all that markup escapes; the odd ones in the middle."""
    row = lambda head, *cells: f"\\trowd{head}\\cellx1500\\cellx4000\n" + "".join(f"\\pard\\intbl {c}\\cell\n" for c in cells) + "\\row\n"
    data = [row("", f"é {i} <&> \"'", "tab\there") for i in range(ROWS)]
    return "{\\rtf1\\sectd\n" + row("\\trhdr", "A", "B") * 2 + "".join(data[: ROWS // 2]) + "".join(row("", x, "y") for x in odd) + "".join(data[ROWS // 2 :]) + "}"


def with_prefix(data: bytes, prefix: str) -> bytes:
    """The template with another prefix for its markup."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as to:
        for n in z.namelist():
            text = z.read(n)
            if n == docx.DOCUMENT:
                text = re.sub(rb"(<|</| |xmlns:)w(?=[:=])", rb"\1" + prefix.encode(), text)
            to.writestr(n, text)
        to.writestr("word/late.bin", b"late")
    return out.getvalue()


def parts_of(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        return {n: z.read(n) for n in z.namelist()}


def inputs(spark, texts, rows, templates):
    return (
        spark.createDataFrame(templates, "docx_id string, content binary"), spark.createDataFrame(rows, "row_id int, bookmark string, `table` string"),
        spark.createDataFrame([(n, f"/r/{n}.rtf", t) for n, t in texts.items()], "doc_id string, path string, text string"),
    )


def whole(templates, rendered) -> dict[str, dict[str, bytes]]:
    """The parts of each document, from whole tables put into its tree."""
    out = {}
    for docx_id, content in templates:
        document = docx.Document(content)
        for r in sorted((r for r in rendered if r.docx_id == docx_id), key=lambda r: r.row_id):
            with contextlib.suppress(errors.BookmarkMissing):
                document.inject_table(r.bookmark, r.xml) if r.kind == "table" else document.inject_image(r.bookmark, bytes(r.png), r.width_twips, r.height_twips)
        out[docx_id] = parts_of(document.close())
    return out


def test_pieces_make_the_same_document(spark, monkeypatch):
    """every part is as from whole tables, and no value that comes to the writing task is large."""
    plain = docx._write
    limit = 2 * docx.PIECE

    def write(batches):
        def small(b):
            assert all(k == 0 or len(d) <= limit for k, d in zip(b.column("ord").to_pylist(), b.column("data").to_pylist()))
            return b

        return plain(map(small, batches))

    monkeypatch.setattr(docx, "_write", write)
    large = "{\\rtf1\\sectd {\\pict\\pngblip " + (bytes(range(256)) * 300).hex() + "}}"
    texts = {"t1": report(), "p1": picture(), "p2": large, "none": "{\\rtf1}"}
    rows = [(1, "B2", "t1"), (2, "B1", "t1"), (3, "B2", "p1"), (4, "B2", "t1"), (5, "B1", "p2"), (6, "nope", "t1"), (7, "B1", "none"), (8, "B2", "p2")]
    templates = [("a.docx", template_bytes(["B1", "B2"])), ("b.docx", with_prefix(template_bytes(["B2", "B1"], None), "x")), ("c.docx", template_bytes([]))]
    args = (*inputs(spark, texts, rows, templates), spark.createDataFrame([(4, "t1", [2], [1, 700], None, None, None)], SELECTION))
    made = {r.docx_id: r for r in docx.generate(*args).collect()}
    expected = whole(templates, docx.rendered(*args).collect())
    for name, found in expected.items():
        got = parts_of(made[name].content)
        assert set(got) == set(found)
        assert [n for n in found if got[n] != found[n]] == [], name
        assert [s.kind for s in made[name].status][5] == "xml_inject_failed" and len(made[name].status) == 8
    assert b"<x:tr>" in expected["b.docx"][docx.DOCUMENT] and expected["a.docx"][docx.DOCUMENT].count(b"<w:tr>") == 3 * ROWS + 6 - 2


def test_parts_are_hashed_from_a_stream():
    """a part is not held to be hashed, nor a document to be written."""
    text = template_bytes(["B"])
    document = docx.Document(text)
    document.inject_table("B", f"{docx.TABLE}</w:tbl>").append(ElementTree.ProcessingInstruction("rows", "0"))
    skeleton, piece = document.close(), b"<w:tr />" * 2048
    schema, n = pa.schema([("docx_id", pa.string()), ("ord", pa.int32()), ("part", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("status", docx._STATUS)]), 4000
    packed = zlib.compress(piece)

    def batches(n):
        yield pa.RecordBatch.from_pylist([{"docx_id": "a", "ord": 0, "size": n * len(piece), "data": skeleton, "status": []}], schema=schema)
        for _ in range(0, n, 100):
            yield pa.RecordBatch.from_pylist([{"docx_id": "a", "ord": 1, "data": packed}] * 100, schema=schema)

    assert [b.num_rows for b in docx._write(batches(100))] == [1], "what is imported once is not measured"
    tracemalloc.start()
    try:
        (made,) = docx._write(batches(n))
        (found,) = docx._digests([made.select(["docx_id", "content"])])
        assert tracemalloc.get_traced_memory()[1] < n * len(piece) // 20
    finally:
        tracemalloc.stop()
    with zipfile.ZipFile(io.BytesIO(made.column("content")[0].as_py())) as z, z.open(docx.DOCUMENT) as part:
        digest = hashlib.file_digest(part, "sha256").hexdigest()
        assert z.getinfo(docx.DOCUMENT).file_size > n * len(piece)
    assert dict(zip(found.column("part").to_pylist(), found.column("data_sha256").to_pylist()))[docx.DOCUMENT] == digest


def test_failures_of_tables_in_pieces(spark):
    """a table that is no XML fails with the message of the whole table, wherever its piece is."""
    texts = {"good": report(), "bad": report("first \x01 bad", "more \x02"), "lines": report("a é\r\nb \x0c end"), "short": report().replace("\\pard\\intbl tab\there\\cell\n", "", 1)}
    rows = [(1, "B", "good"), (2, "B", "bad"), (3, "B", "lines"), (4, "B", "short"), (5, "nope", "bad"), (6, "nope", "good")]
    args = (*inputs(spark, texts, rows, [("a.docx", template_bytes(["B"]))]), spark.createDataFrame([], SELECTION))
    expected = {}
    for r in docx.rendered(*args).collect():
        try:
            if r.xml is not None:
                ElementTree.fromstring(r.xml)
            said = r.problem or (None if r.bookmark == "B" else errors.BookmarkMissing(r.bookmark))
        except ElementTree.ParseError as e:
            said = e
        expected[r.row_id] = said and errors.XmlInjectFailed(r.bookmark, said).message
    made = docx.generate(*args).collect()[0]
    assert {s.row_id: s.message for s in made.status} == expected
    assert "line 1, column" in expected[2] and expected[4] is not None and expected[1] is None and expected[2].split("'")[2] == expected[5].split("'")[2]
    assert parts_of(made.content)[docx.DOCUMENT].count(b"<w:tr>") == ROWS + 2


def test_a_table_for_many_rows_is_written_once(spark, monkeypatch):
    """mapping rows carry no table's rows, and those are stored once for all that want them."""
    plain, keep, seen = docx._place, docx.stored, {}

    def place(strict, batches):
        def small(b):
            assert all(len(i["frame"]) < 1000 for items in b.column("items").to_pylist() for i in items)
            return b

        return plain(strict, map(small, batches))

    def stored(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(docx, "_place", place)
    monkeypatch.setattr(docx, "stored", stored)
    n = 300
    rows = [(i, "B" if i % 3 else "nope", "t1") for i in range(1, n + 1)]
    args = (*inputs(spark, {"t1": report()}, rows, [("a.docx", template_bytes(["B"]))]), spark.createDataFrame([], SELECTION))
    (made,) = docx.generate(*args).collect()
    assert [s.kind for s in made.status] == [None if i % 3 else "xml_inject_failed" for i in range(1, n + 1)]
    pieces = seen["pieces"].collect()
    assert len({(p.key, p.section, p.seq) for p in pieces}) == len(pieces) > 1 and len({p.key for p in pieces}) == 1
    xml = parts_of(made.content)[docx.DOCUMENT]
    assert xml.count(b"<w:tbl>") == n - n // 3 and xml.count(b"<w:tr>") == (ROWS + 2) * (n - n // 3)

def test_reports_are_lexed_page_by_page():
    """a report's pages are flat before the next one is parsed; one that is wrong late is still one error."""
    rows = "".join(f"\\trowd\\cellx1500\\cellx4000\n\\pard\\intbl c {i}\\cell\n\\pard\\intbl d\\cell\n\\row\n" for i in range(300))
    text = "{\\rtf1" + f"\\sect\\sectd{rows}" * 20 + "}"
    batch = pa.RecordBatch.from_pylist([{"doc_id": "a", "text": text}, {"doc_id": "b", "text": text + "\\sect\\sectd\\trowd x\\cell\\row"}])
    list(rtf._lex(False, False, [batch]))
    peaks = []
    for made in (lambda: rtf.lexed_rows("a", text, False), lambda: list(rtf._lex(False, False, [batch.slice(0, 1)]))):
        tracemalloc.start()
        try:
            made()
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
    assert peaks[1] < peaks[0] // 3
    found = [p for b in rtf._lex(False, False, [batch]) for p in b.to_pylist()]
    assert found[:-1] == rtf.lexed_rows("a", text, False) and [p["page_no"] for p in found[:-1]] == list(range(1, 21))
    assert found[-1] == {"doc_id": "b", "page_no": None, "parameter": None, "rows": [], "error": "parse_row: a row defines no cell"}


def test_long_reports_do_not_share_a_batch(spark, monkeypatch):
    """however many reports a partition has, what crosses to Python at once is small."""
    plain, rows_key, bytes_key = rtf._lex, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

    def lex(decode_escapes, mark_empty, batches):
        def small(b):
            assert b.num_rows == 1 or b.nbytes <= 2 * ARROW_BYTES, b.nbytes
            return b

        return plain(decode_escapes, mark_empty, map(small, batches))

    monkeypatch.setattr(rtf, "_lex", lex)
    was = spark.conf.get(rows_key), spark.conf.get(bytes_key)
    try:
        spark.conf.unset(rows_key)
        spark.conf.unset(bytes_key)
        texts = spark.range(24).coalesce(1).selectExpr("cast(id AS string) AS doc_id", "concat('{\\\\rtf1\\\\sectd ', repeat('x', 1000000), '}') AS text")
        assert rtf.lex(texts).count() == 24
    finally:
        spark.conf.set(rows_key, was[0])
        spark.conf.set(bytes_key, was[1])
