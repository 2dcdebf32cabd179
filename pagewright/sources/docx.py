"""Word templates: bookmarks, text widths, and documents with tables and images put in.

A template is one zip file. Its own parts are changed inside one task, with a mark where each table's
rows are to stand; the rows and pictures come to the task that writes the file in small pieces, in
the document's order, so that no task holds a table or a document.
"""

from __future__ import annotations

import functools
import hashlib
import io
import re
import uuid
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from pagewright import errors
from pagewright.functions.text import emu_to_twips
from pagewright.operators.mapping import valid_rows
from pagewright.operators.render import RAGGED, W_NS, output_xml, scale_widths, xml_opening, xml_rows
from pagewright.operators.select import prepare
from pagewright.scratch import stored
from pagewright.sources import rtf

#: Namespaces and part names of the file format.
W = f"{{{W_NS}}}"
REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
CT_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
DOC_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
DOCUMENT, RELS, TYPES = "word/document.xml", "word/_rels/document.xml.rels", "[Content_Types].xml"
for _prefix, _uri in (("w", W_NS), ("r", DOC_REL), ("wp", f"{DRAWING}/wordprocessingDrawing"), ("a", f"{DRAWING}/main"), ("pic", f"{DRAWING}/picture")):
    ElementTree.register_namespace(_prefix, _uri)
EMU_PER_TWIP, EMU_PER_INCH = 635, 914400
DEFAULT_WIDTH = 6 * EMU_PER_INCH
MARGIN_PART = re.compile(r"word/(header|footer)\d*\.xml")
LEVELS = 20


def parse(data: bytes) -> ElementTree.Element:
    """An element tree that will be written with the prefixes it was read with."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(data), events=("start-ns",)):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.fromstring(data)


def text_width(document: ElementTree.Element) -> int:
    """EMU between the margins of the first section that states both; else six inches."""
    size = document.find(f".//{W}sectPr/{W}pgSz")
    margin = document.find(f".//{W}sectPr/{W}pgMar")
    if size is None or margin is None:
        return DEFAULT_WIDTH
    try:
        wide, left, right = int(size.get(f"{W}w")), int(margin.get(f"{W}left")), int(margin.get(f"{W}right"))
    except (TypeError, ValueError):
        return DEFAULT_WIDTH
    return (wide - left - right) * EMU_PER_TWIP


def bookmark_names(document: ElementTree.Element) -> list[tuple[str, str]]:
    """(name, id) in document order, repeats included, without hidden ones."""
    found = ((b.get(f"{W}name"), b.get(f"{W}id")) for b in document.iter(f"{W}bookmarkStart"))
    return [(n, i) for n, i in found if n and not n.startswith("_")]


def half_even(x: float) -> int:
    return round(x)


class Document:
    """An open template: put tables and images after bookmarks' paragraphs, then ``close``."""

    def __init__(self, data: bytes):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            self.parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
        self.document, self.rels, self.types = (parse(self.parts[n]) for n in (DOCUMENT, RELS, TYPES))
        self.parents = {c: p for p in self.document.iter() for c in p}
        self.places: dict[str, ElementTree.Element] = {}
        self.contexts: dict[str, str] = {}
        for b in self.document.iter(f"{W}bookmarkStart"):
            name = b.get(f"{W}name")
            if name is None or name.startswith("_"):
                continue
            place = self.ancestor(b, "p")
            if place is not None:
                self.places[name] = place
                self.contexts[name] = self.context(place)
        for n in self.parts:  # no place to put anything, but a reason why
            if m := MARGIN_PART.fullmatch(n):
                for b in parse(self.parts[n]).iter(f"{W}bookmarkStart"):
                    self.contexts.setdefault(b.get(f"{W}name"), m[1])
        self.images = sum(n.startswith("word/media/") and n.endswith(".png") for n in self.parts)
        self.width = text_width(self.document)

    def ancestor(self, node: ElementTree.Element, tag: str) -> ElementTree.Element | None:
        """The nearest one of that tag, the node itself included, within ``LEVELS`` steps."""
        for _ in range(LEVELS):
            if node is None or node.tag == f"{W}{tag}":
                return node
            node = self.parents.get(node)
        return None

    def context(self, node: ElementTree.Element) -> str:
        """'body', 'table' or 'textbox'."""
        while node is not None:
            if node.tag in (f"{W}tc", f"{W}txbxContent"):
                return "table" if node.tag == f"{W}tc" else "textbox"
            node = self.parents.get(node)
        return "body"

    def _after(self, bookmark: str, new: ElementTree.Element) -> None:
        place = self.places.get(bookmark)
        if place is None:
            raise errors.BookmarkMissing(bookmark)
        parent = self.parents[place]
        parent.insert(list(parent).index(place) + 1, new)
        self.parents[new] = parent

    def inject_table(self, bookmark: str, xml: str) -> ElementTree.Element:
        """The table becomes the next sibling of the bookmark's paragraph."""
        table = ElementTree.fromstring(xml)
        self._after(bookmark, table)
        return table

    def image_size(self, width: int | None, height: int | None) -> tuple[int, int]:
        """As wide as the text, in proportion; square without both measures."""
        if width is not None and height is not None and width > 0:
            return self.width, half_even(self.width * (height / width))
        return self.width, self.width

    def add_image(self, png: bytes) -> tuple[int, str]:
        """(number, relationship id) of a new image part."""
        number = self.images + 1
        while f"word/media/image{number}.png" in self.parts:  # never over an image that is there
            number += 1
        self.images = number
        name, rel = f"image{number}.png", f"rIdImg{number}"
        self.parts[f"word/media/{name}"] = png
        ElementTree.SubElement(self.rels, f"{{{REL_NS}}}Relationship", {"Id": rel, "Type": f"{DOC_REL}/image", "Target": f"media/{name}"})
        if not any(d.get("Extension") == "png" for d in self.types.iter(f"{{{CT_NS}}}Default")):
            ElementTree.SubElement(self.types, f"{{{CT_NS}}}Default", {"Extension": "png", "ContentType": "image/png"})
        return number, rel

    def inject_image(self, bookmark: str, png: bytes, width: int | None, height: int | None) -> str:
        """The name of the image's part."""
        if bookmark not in self.places:
            raise errors.BookmarkMissing(bookmark)
        cx, cy = self.image_size(width, height)
        number, rel = self.add_image(png)
        self._after(bookmark, drawing(number, rel, cx, cy))
        return f"word/media/image{number}.png"

    def close(self) -> bytes:
        for name, tree in ((DOCUMENT, self.document), (RELS, self.rels), (TYPES, self.types)):
            if name != DOCUMENT:
                ElementTree.register_namespace("", REL_NS if name == RELS else CT_NS)
            self.parts[name] = ElementTree.tostring(tree, encoding="UTF-8", xml_declaration=True)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in self.parts.items():
                z.writestr(name, data)
        return out.getvalue()


def drawing(number: int, rel: str, cx: int, cy: int) -> ElementTree.Element:
    """A paragraph with one inline picture."""
    wp, a, pic = f"{{{DRAWING}/wordprocessingDrawing}}", f"{{{DRAWING}/main}}", f"{{{DRAWING}/picture}}"
    add = ElementTree.SubElement
    named = {"id": str(number), "name": f"Image{number}"}
    size = {"cx": str(cx), "cy": str(cy)}
    p = ElementTree.Element(f"{W}p")
    inline = add(add(add(p, f"{W}r"), f"{W}drawing"), f"{wp}inline")
    add(inline, f"{wp}extent", size)
    add(inline, f"{wp}docPr", named)
    picture = add(add(add(inline, f"{a}graphic"), f"{a}graphicData", {"uri": f"{DRAWING}/picture"}), f"{pic}pic")
    own = add(picture, f"{pic}nvPicPr")
    add(own, f"{pic}cNvPr", named)
    add(own, f"{pic}cNvPicPr")
    fill = add(picture, f"{pic}blipFill")
    add(fill, f"{a}blip", {f"{{{DOC_REL}}}embed": rel})
    add(add(fill, f"{a}stretch"), f"{a}fillRect")
    shape = add(picture, f"{pic}spPr")
    frame = add(shape, f"{a}xfrm")
    add(frame, f"{a}off", {"x": "0", "y": "0"})
    add(frame, f"{a}ext", size)
    add(add(shape, f"{a}prstGeom", {"prst": "rect"}), f"{a}avLst")
    return p


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(docx_id, content) of the Word files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("docx_id"), "content")


def _xml(batches):
    for b in batches:
        found = []
        for content in b.column("content").to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found.append(z.read(DOCUMENT).decode("utf-8"))
        yield pa.RecordBatch.from_arrays([b.column("docx_id"), pa.array(found, pa.string())], names=["docx_id", "xml"])


def _parts(batches):
    for b in batches:
        for docx_id, content in zip(b.column("docx_id").to_pylist(), b.column("content").to_pylist()):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = [n for n in z.namelist() if not n.endswith("/")]
                data = [z.read(n) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([docx_id] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["docx_id", "part", "data"])


def parts(documents: DataFrame) -> DataFrame:
    """(docx_id, part, data): the parts of Word files."""
    return documents.select("docx_id", "content").mapInArrow(_parts, "docx_id string, part string, data binary")


def _digests(batches):
    for b in batches:
        for docx_id, content in zip(b.column("docx_id").to_pylist(), b.column("content")):
            names, found = [], []
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                for n in z.namelist():
                    if not n.endswith("/"):
                        with z.open(n) as part:
                            names.append(n)
                            found.append(hashlib.file_digest(part, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([docx_id] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(found, pa.string())], names=["docx_id", "part", "data_sha256"])


def part_digests(documents: DataFrame) -> DataFrame:
    """(docx_id, part, data_sha256): as ``parts``, read through without holding any part."""
    return documents.select("docx_id", "content").mapInArrow(_digests, "docx_id string, part string, data_sha256 string")


def document_xml(templates: DataFrame) -> DataFrame:
    return templates.select("docx_id", "content").mapInArrow(_xml, "docx_id string, xml string")


def bookmarks(templates: DataFrame) -> DataFrame:
    """(docx_id, ord, name, id) in document order, repeats kept, hidden ones left out."""
    starts = "//*[name()='w:bookmarkStart'][@*[name()='w:name']][@*[name()='w:id']]"
    names = F.xpath("xml", F.lit(f"{starts}/@*[name()='w:name']"))
    ids = F.xpath("xml", F.lit(f"{starts}/@*[name()='w:id']"))
    listed = document_xml(templates).select("docx_id", F.posexplode(F.arrays_zip(names.alias("name"), ids.alias("id"))).alias("p", "b"))
    found = listed.select("docx_id", (F.col("p") + 1).alias("ord"), F.col("b.name").alias("name"), F.col("b.id").alias("id"))
    return found.where((F.col("name") != "") & ~F.startswith("name", F.lit("_")))


def text_widths(templates: DataFrame) -> DataFrame:
    """(docx_id, emu, twips): the width between the margins, six inches where it is not stated."""

    def number(element: str, attribute: str):
        path = f"//*[name()='w:sectPr']/*[name()='w:{element}']/@*[name()='w:{attribute}']"
        return F.get(F.xpath("xml", F.lit(path)), F.lit(0)).try_cast("int")

    emu = F.coalesce((number("pgSz", "w") - number("pgMar", "left") - number("pgMar", "right")) * EMU_PER_TWIP, F.lit(DEFAULT_WIDTH))
    return document_xml(templates).select("docx_id", emu.alias("emu")).withColumn("twips", emu_to_twips("emu"))


#: Characters of markup in a piece of a table, and bytes in one of a picture.
PIECE = 1 << 14
TABLE = f'<w:tbl xmlns:w="{W_NS}">'
PIECES = (
    "key string, section int, seq int, widths array<int>, twips long, ragged boolean, n_bytes long, lines int, tail int, "
    "problem string, line int, col int, data binary"
)
STATUS = "array<struct<row_id:int,kind:string,message:string,hint:string>>"
_STATUS = pa.list_(pa.struct([("row_id", pa.int32()), ("kind", pa.string()), ("message", pa.string()), ("hint", pa.string())]))
_PLACED = pa.schema([("made", pa.string()), ("docx_id", pa.string()), ("ord", pa.int32()), ("key", pa.string()), ("part", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("status", _STATUS)])
PLACED = f"made string, docx_id string, ord int, key string, part string, size long, data binary, status {STATUS}"
MARK = re.compile(rb"<\?rows (\d+)\?>")


def rewritten(rows: str, prefix: str) -> str:
    """A table's rows as they stand in a document that is parsed and written again, its namespace
    under that prefix."""
    if not rows:
        return rows
    ElementTree.register_namespace(prefix, W_NS)
    out = ElementTree.tostring(ElementTree.fromstring(f"{TABLE}{rows}</w:tbl>"), encoding="unicode")
    return out[out.index(">") + 1 : out.rindex("</")]


def _piece(key, section, seq, widths, twips, ragged, rows) -> dict:
    raw = "".join(rows)
    plain = raw.replace("\r\n", "\n").replace("\r", "\n")
    found = {"key": key, "section": section, "seq": seq, "widths": widths, "twips": twips, "ragged": ragged, "problem": None, "line": None, "col": None}
    found |= {"lines": plain.count("\n"), "tail": len(plain) - plain.rfind("\n") - 1}
    try:
        data = rewritten(raw, "w").encode()
    except ElementTree.ParseError as e:
        line, col = e.position
        data, found["problem"] = b"", str(e).rsplit(": line ", 1)[0]
        found |= {"line": line, "col": col - len(TABLE) if line == 1 else col}
    return found | {"n_bytes": len(data), "data": zlib.compress(data, 1)}


def _pieces(schema: pa.Schema, batches):
    """Rows of tables cut into pieces, each of one table's rows in their order."""
    names = ("key", "section", "seq", "widths", "twips", "ragged", "xml")
    first, rows, ragged, size, last = None, [], False, 0, 0
    for b in batches:
        done = []
        for key, section, seq, widths, twips, off, xml in zip(*(b.column(n).to_pylist() for n in names)):
            if first is not None and (size >= PIECE or (key, section, seq) != (*first[:2], last + 1)):
                done.append(_piece(*first, ragged, rows))
                first = None
            if first is None:
                first, rows, ragged, size = (key, section, seq, widths, twips), [], False, 0
            rows.append(xml or "")
            ragged, size, last = ragged or bool(off), size + len(rows[-1]), seq
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if first is not None:
        yield pa.RecordBatch.from_pylist([_piece(*first, ragged, rows)], schema=schema)


def xml_pieces(pages: DataFrame, rows: DataFrame, selections: DataFrame) -> DataFrame:
    """The rows of the Word tables of ``selections`` (key, doc_id, ..., twips), in pieces that are
    compressed. A piece that is no XML tells what is wrong, and where in it."""
    shown = xml_rows(prepare(pages, rows, selections, ("key", "doc_id")))
    section = F.when(F.col("section") == "header", 0).otherwise(1)
    listed = shown.select("key", section.alias("section"), F.col("seq").cast("int").alias("seq"), F.col("shown_widths").cast("array<int>").alias("widths"), "twips", "ragged", "xml")
    return listed.mapInArrow(functools.partial(_pieces, _arrow_of(PIECES)), PIECES)


def _arrow_of(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])


def xml_frames(pieces: DataFrame) -> DataFrame:
    """(key, frame, n_bytes, error): each table without its rows, and how many bytes these are.
    The place of an error is that in the whole table, as if it were parsed at once."""
    place = F.struct("section", "seq", "lines", "tail", "problem", "line", "col")
    parts = pieces.groupBy("key").agg(
        F.first("widths").alias("w"), F.first("twips").alias("given"), F.max("ragged").alias("ragged"), F.sum("n_bytes").alias("n_bytes"),
        F.count("problem").alias("n_wrong"), F.sort_array(F.collect_list(place)).alias("places"),
    )
    parts = parts.withColumn("opening", xml_opening(scale_widths(F.col("w"), F.col("given"))))
    at = lambda line, col, said: F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"), said.cast("string").alias("said"))

    def walk(s, p):
        said = F.concat(p["problem"], F.lit(": line "), (s["line"] + p["line"] - 1).cast("string"), F.lit(", column "), (p["col"] + F.when(p["line"] == 1, s["col"]).otherwise(0)).cast("string"))
        after = at(s["line"] + p["lines"], p["tail"] + F.when(p["lines"] == 0, s["col"]).otherwise(0), F.lit(None))
        return F.when(s["said"].isNotNull(), s).when(p["problem"].isNotNull(), at(s["line"], s["col"], said)).otherwise(after)

    wrong = F.when(F.col("n_wrong") > 0, F.aggregate("places", at(F.lit(1), F.length("opening"), F.lit(None)), walk)["said"])
    error = F.when(F.col("ragged"), RAGGED).otherwise(wrong)
    return parts.select("key", error.alias("error"), "n_bytes", F.concat("opening", F.lit("</w:tbl>")).alias("frame"))


def _status(row: dict, n: int, document: Document, strict: bool, images: dict[int, str]) -> errors.ReportError | None:
    """Puts one mapping row, the n-th, into the document; what went wrong, if anything. A mark stands
    for a table's rows; ``images`` gets the part of a picture, which is empty as yet."""
    name = row["bookmark"]
    if row["kind"] == "missing":
        return errors.RtfUnreadable(row["path"], "file not found in RTF folder")
    if strict and (where := document.contexts.get(name, "body")) != "body":
        return errors.BookmarkBadContext(name, where)
    if row["kind"] == "unread":
        return errors.RtfParseFailed(row["path"], *(row["problem"] or "unknown").split(": ", 1))
    if row["kind"] == "image":
        if row["key"] is None:
            return errors.ImageExtractFailed(row["path"])
        try:
            images[n] = document.inject_image(name, b"", row["width_twips"], row["height_twips"])
        except errors.ReportError as e:
            return errors.ImageInjectFailed(name, e)
        return None
    if row["problem"] is not None:
        return errors.XmlInjectFailed(name, row["problem"])
    try:
        table = document.inject_table(name, row["frame"])
    except (errors.ReportError, ElementTree.ParseError) as e:
        return errors.XmlInjectFailed(name, e)
    if row["key"] is not None:
        table.append(ElementTree.ProcessingInstruction("rows", str(n)))  # a parsed template has no others
    return None


def _place(strict: bool, batches):
    for b in batches:
        for docx_id, content, items in zip(*(b.column(n).to_pylist() for n in ("docx_id", "content", "items"))):
            document, status, images, made = Document(content), [], {}, uuid.uuid4().hex
            for n, row in enumerate(items):
                e = _status(row, n, document, strict, images)
                status.append({"row_id": row["row_id"], "kind": e and e.kind, "message": e and e.message, "hint": e and e.hint})
            for part in images.values():
                del document.parts[part]
            content = document.close()
            tables = [int(n) for n in MARK.findall(document.parts[DOCUMENT])]
            size = len(document.parts[DOCUMENT]) + sum(items[n]["n_bytes"] for n in tables)
            none = {"made": made, "docx_id": docx_id, "key": None, "part": None, "size": None, "data": None, "status": None}
            rows = [none | {"ord": 0, "size": size, "data": content, "status": status}]
            rows += [none | {"ord": k, "key": items[n]["key"]} for k, n in enumerate(tables, 1)]
            rows += [none | {"ord": k, "key": items[n]["key"], "part": part} for k, (n, part) in enumerate(images.items(), len(tables) + 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=_PLACED)


class _Written:
    """A Word file while it is written: rows of tables and pictures come in the document's order."""

    def __init__(self, docx_id: str, content: bytes, size: int, status: list):
        self.docx_id, self.status, self.size = docx_id, status, size
        self.source, self.out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        names = self.source.namelist()
        self.rest = names[names.index(DOCUMENT) + 1 :]
        self.copy(names[: names.index(DOCUMENT)])
        self.texts = MARK.split(self.source.read(DOCUMENT))[::2]
        found = re.search(rb"<(?:([^\s:<>?!/]+):)?document\b", self.texts[0])
        self.prefix = (found[1] or b"").decode()
        self.at, self.part, self.entry = 0, DOCUMENT, self.open(DOCUMENT, size if self.prefix == "w" else 2 * size)

    def open(self, name: str, size: int = 0):
        info = zipfile.ZipInfo(name)
        info.compress_type, info.external_attr, info.file_size = zipfile.ZIP_DEFLATED, 0o600 << 16, size  # a hint for files beyond 2 GB
        return self.zip.open(info, "w")

    def copy(self, names: list[str]) -> None:
        for n in names:
            with self.open(n) as to:
                to.write(self.source.read(n))

    def text(self, upto: int) -> None:
        """The document's own markup before that table."""
        for t in self.texts[self.at : upto]:
            self.entry.write(t)
        self.at = max(self.at, upto)

    def add(self, k: int, part: str | None, data: bytes) -> None:
        if part is None:
            self.text(k)
            rows = zlib.decompress(data)
            self.entry.write(rows if self.prefix == "w" else rewritten(rows.decode(), self.prefix).encode())
            return
        if part != self.part:
            self.end()
            self.part, self.entry = part, self.open(part)
        self.entry.write(data)

    def end(self) -> None:
        """Closes the part that is open; after the document come the template's other parts."""
        if self.part == DOCUMENT:
            self.text(len(self.texts))
        self.entry.close()
        if self.part == DOCUMENT:
            self.copy(self.rest)

    def batch(self) -> pa.RecordBatch:
        self.end()
        self.zip.close()
        content = pa.array([self.out.getvalue()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([self.docx_id], pa.string()), content, pa.array([self.status], _STATUS)], names=["docx_id", "content", "status"])


def _write(batches):
    now = None
    for b in batches:
        for docx_id, k, part, size, data, status in zip(*(b.column(n).to_pylist() for n in ("docx_id", "ord", "part", "size", "data", "status"))):
            if k > 0:
                now.add(k, part, data)
                continue
            if now is not None:
                yield now.batch()
            now = _Written(docx_id, data, size, status)
    if now is not None:
        yield now.batch()


SELECTED = ("excluded_cols", "excluded_rows", "excluded_header_rows", "parameters", "timelines")


def _wanted(templates: DataFrame, config: DataFrame, texts: DataFrame, selections: DataFrame, kept: str | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The mapping rows for each template with the key of their table, the distinct tables, the lexed
    reports, and (doc_id, path, is_image, unread) of all reports."""
    valid = config.where((F.col("bookmark") != "") & (F.col("table") != "")).select("row_id", "bookmark", F.col("table").alias("doc_id"))
    known = texts.select("doc_id", "path", rtf.is_image("text").alias("is_image"))
    lexed = rtf.lex_once(texts.where(~rtf.is_image("text")).join(valid.select("doc_id").distinct(), "doc_id", "left_semi"), kept)
    # a row for each template: as many as files, without their content
    widths = F.broadcast(text_widths(templates).select("docx_id", F.col("twips").cast("long").alias("twips")))
    chosen = valid.join(selections.select("row_id", *SELECTED), "row_id", "left")
    key = F.sha2(F.to_json(F.struct("doc_id", *SELECTED, "twips")), 256)
    wanted = stored(chosen.crossJoin(widths).withColumn("key", key), "wanted")
    distinct = wanted.select("key", "doc_id", *SELECTED, "twips").dropDuplicates(["key"])
    failed = rtf.errors_of(lexed).withColumnRenamed("error", "unread")
    return wanted.select("docx_id", "row_id", "bookmark", "doc_id", "key"), distinct, lexed, known.join(failed, "doc_id", "left")


#: The table of a report without rows.
EMPTY = f'{TABLE}<w:tblPr><w:tblW w:w="0" w:type="dxa"/></w:tblPr><w:tblGrid></w:tblGrid></w:tbl>'


def _kind() -> Column:
    return F.when(F.col("path").isNull(), "missing").when(F.col("is_image"), "image").when(F.col("unread").isNotNull(), "unread").otherwise("table")


def rendered(templates: DataFrame, config: DataFrame, texts: DataFrame, selections: DataFrame, kept: str | None = None) -> DataFrame:
    """(docx_id, row_id, bookmark, kind, xml, png, ...): each mapping row with both names and what is
    to be put at its bookmark. ``texts``: doc_id, path, text of the reports; ``selections`` are
    keyed by row_id; ``kept``: the folder of lexed reports, if they are to be kept.

    Reports are lexed once, and a table is rendered once for all mapping rows and templates that
    want the same selection of a report in the same width. A table is one value here; ``generate``
    takes it in pieces."""
    wanted, distinct, lexed, reports = _wanted(templates, config, texts, selections, kept)
    tables = output_xml(rtf.pages_of(lexed), rtf.rows_of(lexed), distinct, ("key", "doc_id"), "twips").select("key", "xml", "error")
    joined = wanted.join(reports.join(rtf.images(texts), "doc_id", "left"), "doc_id", "left").join(tables, "key", "left")
    return joined.select(
        "docx_id", "row_id", "bookmark", _kind().alias("kind"),
        F.when((_kind() == "table") & F.col("xml").isNull() & F.col("error").isNull(), F.lit(EMPTY)).otherwise(F.col("xml")).alias("xml"),
        "png", "width_twips", "height_twips", F.coalesce("unread", "error").alias("problem"), F.coalesce("path", "doc_id").alias("path"),
    )


def generate(templates: DataFrame, config: DataFrame, texts: DataFrame, selections: DataFrame, strict: bool = False, kept: str | None = None) -> DataFrame:
    """(docx_id, content, status): each template with all mapping rows put in, in row order.

    A failure is kept in ``status`` (kind null: fine) and the others go on. With ``strict``, a
    bookmark in a table cell, text box, page header or page footer is refused. ``texts``,
    ``selections`` and ``kept`` are as in ``rendered``.

    A table's rows are written once, in pieces, for all that want it. One task finds what stands
    where in a template, another writes the file, to which the pieces come one after another."""
    wanted, distinct, lexed, reports = _wanted(templates, config, texts, selections, kept)
    pieces = stored(xml_pieces(rtf.pages_of(lexed), rtf.rows_of(lexed), distinct), "pieces")
    pictures = stored(rtf.images(texts).withColumn("picture", F.sha2("png", 256)), "pictures")
    joined = wanted.join(reports.join(pictures.drop("png"), "doc_id", "left"), "doc_id", "left").join(xml_frames(pieces).withColumnRenamed("key", "table"), F.col("key") == F.col("table"), "left")
    item = F.struct(
        "row_id", "bookmark", _kind().alias("kind"), F.when(_kind() == "image", F.col("picture")).otherwise(F.col("table")).alias("key"), F.coalesce("frame", F.lit(EMPTY)).alias("frame"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "width_twips", "height_twips", F.coalesce("unread", "error").alias("problem"), F.coalesce("path", "doc_id").alias("path"),
    )
    grouped = joined.select("docx_id", item.alias("item")).groupBy("docx_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    placed = stored(templates.select("docx_id", "content").join(grouped, "docx_id", "left").withColumn("items", F.coalesce("items", F.array())).mapInArrow(functools.partial(_place, strict), PLACED), "placed")
    starts = F.sequence(F.lit(0), F.expr(f"(length(png) - 1) div {PIECE}"))
    cut = pictures.where("png IS NOT NULL").groupBy(F.col("picture").alias("key")).agg(F.first("png").alias("png")).select("key", "png", F.explode(starts).alias("k"))
    drawn = cut.select("key", F.lit(0).alias("section"), F.col("k").cast("int").alias("seq"), F.expr(f"substring(png, int(k * {PIECE} + 1), {PIECE})").alias("data"))
    put = placed.where("ord > 0").drop("data").join(pieces.select("key", "section", "seq", "data").unionByName(drawn), "key")
    first = placed.where("ord = 0").withColumns({"section": F.lit(0), "seq": F.lit(0)})
    whole = first.unionByName(put).repartition("made").sortWithinPartitions("made", "ord", "section", "seq")
    return whole.select("docx_id", "ord", "part", "size", "data", "status").mapInArrow(_write, f"docx_id string, content binary, status {STATUS}")


def status_of(generated: DataFrame) -> DataFrame:
    return generated.select("docx_id", F.inline("status"))


def told(generated: DataFrame, config: DataFrame, progress) -> DataFrame:
    """Calls ``progress(i, n, message)`` once for each mapping row with both names, in row order, as
    the rows' statuses come in, and gives the statuses back. A mapping is a grid: its rows pass
    through the driver one by one."""
    status = stored(status_of(generated), "status")
    rows = stored(valid_rows(config).select("row_id", "bookmark"), "told")
    n = rows.count()
    done = rows.join(status.select("row_id").distinct(), "row_id").orderBy("row_id")
    for i, r in enumerate(done.toLocalIterator(), 1):
        progress(i, n, f"Injecting {r.bookmark}\u2026")
    return status


class _DocxWriter(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["path"]

    def write(self, rows):
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        where.create_dir(folder, recursive=True)
        for r in rows:
            # a retried task writes the same bytes to the same name
            with where.open_output_stream(f"{folder}/{r['docx_id']}") as f:
                f.write(bytes(r["content"]))
        return WriterCommitMessage()


class DocxSink(DataSource):
    """``df.write.format("docx_report").save(folder)``: a file for each (docx_id, content)."""

    @classmethod
    def name(cls) -> str:
        return "docx_report"

    def schema(self) -> str:
        return "docx_id string, content binary"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _DocxWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSink)
