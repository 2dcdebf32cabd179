"""RTF reports as DataFrames: catalog, texts, lexed pages and rows, embedded images.

The lexer is the one opaque step: each file crosses to Python once, as an Arrow batch, and comes
back as pages of rows. All that follows is column expressions on those tables.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright import schema
from pagewright.arrow import small_batches
from pagewright.functions.text import strip_extension
from pagewright.scratch import stored
from pagewright.sources import lexer

GLOB = "*.[rR][tT][fF]"
_CELL = pa.struct(
    [("text", pa.string()), ("width_twips", pa.int32()), ("align", pa.string()), ("is_merge_first", pa.bool_()), ("is_merge_cont", pa.bool_()), ("colspan", pa.int32())]
)
_ROW = pa.struct([("row_no", pa.int32()), ("is_header", pa.bool_()), ("cells", pa.list_(_CELL))])
#: The same shape as ``schema.LEXED``.
LEXED = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("parameter", pa.string()), ("rows", pa.list_(_ROW)), ("error", pa.string())])


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1; line ends as line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_id", strip_extension(F.element_at(F.split("path", "/"), -1)))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, path) of the folder's RTF files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder)
    return _named(files.select("path")).select(F.col("doc_id").alias("table_name"), "path")


# What is said about a folder.
FOLDER_MISSING = "Folder not found. Check the path and try again."
FOLDER_EMPTY = "No RTF files found in that folder."


def load_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, str, str]:
    """The folder's catalog, and what to tell about it: a kind (error, warning or message) and a text.
    The catalog of a folder that does not exist is empty."""
    try:
        found = catalog(spark, folder)
        n = found.count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "table_name string, path string"), "error", FOLDER_MISSING
    return (found, "message", f"Found {n} RTF files.") if n else (found, "warning", FOLDER_EMPTY)


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, text) of each RTF file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).load(folder).select("path", "content")
    return _named(files).select("doc_id", "path", decoded(F.col("content")).alias("text"))


def lexed_rows(doc_id, text: str | None, decode_escapes: bool, form=dict) -> list:
    """A row for each page, or one that tells the error; each is brought into a form before the next
    page is parsed."""
    found = []
    try:
        for n, p in enumerate(lexer.parse_pages(text or "", decode_escapes), 1):
            found.append(form({"doc_id": doc_id, "page_no": n, "parameter": p["parameter"], "rows": [{"row_no": k, **r} for k, r in enumerate(p["rows"], 1)], "error": None}))
    except lexer.LexError as e:
        return [form({"doc_id": doc_id, "page_no": None, "parameter": None, "rows": [], "error": f"{e.stage}: {e}"})]
    return found


class _Columns:
    """Lexed pages as flat lists: the cells of all rows, the rows of all pages."""

    def __init__(self):
        self.cells: dict[str, list] = {f.name: [] for f in _CELL}
        self.rows: dict[str, list] = {"row_no": [], "is_header": []}
        self.pages: dict[str, list] = {n: [] for n in ("doc_id", "page_no", "parameter", "error")}
        self.row_ends, self.cell_ends = [0], [0]

    def add(self, page: dict) -> None:
        for name, values in self.pages.items():
            values.append(page[name])
        for row in page["rows"]:
            for name, values in self.rows.items():
                values.append(row[name])
            for name, values in self.cells.items():
                values += [c[name] for c in row["cells"]]
            self.cell_ends.append(len(self.cells["text"]))
        self.row_ends.append(len(self.rows["row_no"]))

    def batch(self) -> pa.RecordBatch:
        cells = pa.StructArray.from_arrays([pa.array(self.cells[f.name], f.type) for f in _CELL], fields=list(_CELL))
        listed = pa.ListArray.from_arrays(pa.array(self.cell_ends, pa.int32()), cells)
        parts = [pa.array(self.rows["row_no"], pa.int32()), pa.array(self.rows["is_header"], pa.bool_()), listed]
        rows = pa.ListArray.from_arrays(pa.array(self.row_ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_ROW)))
        own = {n: pa.array(v, LEXED.field(n).type) for n, v in self.pages.items()} | {"rows": rows}
        return pa.RecordBatch.from_arrays([own[n] for n in LEXED.names], schema=LEXED)


def _batch(page: dict) -> pa.RecordBatch:
    columns = _Columns()
    columns.add(page)
    return columns.batch()


def _lex(decode_escapes: bool, mark_empty: bool, batches):
    for b in batches:
        for doc_id, text in zip(b.column("doc_id"), b.column("text")):
            pages = lexed_rows(doc_id.as_py(), text.as_py(), decode_escapes, _batch)
            if mark_empty and not pages:
                pages = [_batch({"doc_id": doc_id.as_py(), "page_no": 0, "parameter": None, "rows": [], "error": None})]
            yield from pages


def lex(texts: DataFrame, decode_escapes: bool = False, mark_empty: bool = False) -> DataFrame:
    """Pages with their rows, from (doc_id, text). A report that cannot be read is one row whose
    ``page_no`` is null and whose ``error`` tells why; the job goes on. With ``mark_empty``, one
    without pages is a row whose ``page_no`` is 0."""
    small_batches(texts.sparkSession)
    rows = texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(functools.partial(_lex, decode_escapes, mark_empty), schema.LEXED)


def lex_once(texts: DataFrame, folder: str | None = None, decode_escapes: bool = False) -> DataFrame:
    """As ``lex``, with the result written, so that all that follows reads it and lexes nothing again.

    ``folder`` keeps it beyond the session: reports whose text was lexed into it before are read from
    there, only the others are lexed and appended. The text's digest is the key, so a changed report
    is lexed again, and reports of the same text are lexed once. Without a folder the table is a
    scratch one."""
    if folder is None:
        return stored(lex(texts, decode_escapes), "lexed")
    spark = texts.sparkSession
    kept = f"digest string, decoded boolean, {schema.LEXED}"

    def known() -> DataFrame:
        try:
            found = spark.read.schema(kept).parquet(folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([], kept)
        return found.where(F.col("decoded") == decode_escapes)

    keyed = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    new = keyed.join(known().select("digest").distinct(), "digest", "left_anti").dropDuplicates(["digest"])
    lexed = lex(new.select(F.col("digest").alias("doc_id"), "text"), decode_escapes, mark_empty=True)
    lexed.select(F.col("doc_id").alias("digest"), F.lit(decode_escapes).alias("decoded"), *lexed.columns).write.mode("append").parquet(folder)
    once = known().drop("decoded", "doc_id").dropDuplicates(["digest", "page_no"])  # a repeated append is harmless
    found = keyed.drop("text").join(once, "digest").where(F.col("page_no").isNull() | (F.col("page_no") > 0))
    return found.select("doc_id", "page_no", "parameter", "rows", "error")


def pages_of(lexed: DataFrame) -> DataFrame:
    return lexed.where(F.col("page_no").isNotNull()).select("doc_id", "page_no", "parameter")


def rows_of(lexed: DataFrame) -> DataFrame:
    """doc_id, page_no, parameter, row_no, is_header, cells."""
    return lexed.where(F.col("page_no").isNotNull()).select("doc_id", "page_no", "parameter", F.inline("rows"))


def errors_of(lexed: DataFrame) -> DataFrame:
    return lexed.where(F.col("error").isNotNull()).select("doc_id", "error")


def is_image(text: Column | str) -> Column:
    """Whether a PNG is embedded anywhere."""
    return F.col(text).rlike(r"\\pngblip(?![a-zA-Z])") if isinstance(text, str) else text.rlike(r"\\pngblip(?![a-zA-Z])")


def _pictures(batches):
    for b in batches:
        found = []
        for text in b.column("text").to_pylist():
            try:
                found.append(lexer.picture(text or ""))
            except lexer.LexError:
                found.append(None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "picture"])


def hex_bytes(hexadecimal: Column) -> Column:
    """Bytes of hex digits; null if there are none or their number is odd."""
    n = F.length(hexadecimal)
    return F.when((n > 0) & (n % 2 == 0), F.unhex(hexadecimal))


def images(texts: DataFrame) -> DataFrame:
    """(doc_id, png, width_twips, height_twips): the first picture of each report that has any PNG
    mark. The digits are what follows the picture's last control word; png is null where nothing
    can be extracted."""
    small_batches(texts.sparkSession)
    marked = texts.where(is_image("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = marked.mapInArrow(_pictures, "doc_id string, picture string")

    def goal(word: str) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract(picture, '\\\\\\\\{word}([0-9]+)', 1), '') AS INT)")

    after = F.regexp_extract("picture", r"(?s)^.*\\[a-zA-Z]+-?[0-9]*(.*)$", 1)
    return found.select(
        "doc_id",
        hex_bytes(F.regexp_replace(after, "[^0-9a-fA-F]", "")).alias("png"),
        goal("picwgoal").alias("width_twips"),
        goal("pichgoal").alias("height_twips"),
    )


def data_uri(png: Column | str) -> Column:
    png = F.col(png) if isinstance(png, str) else png
    return F.concat(F.lit("data:image/png;base64,"), F.base64(png))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _RtfReader(DataSourceReader):
    def __init__(self, options):
        from pyarrow import fs

        self.decode_escapes = str(options.get("decodeEscapes", "false")).lower() == "true"
        self.per_task = int(options.get("filesPerTask", 16))
        self.folder = options["path"]
        where, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        listed = where.get_file_info(fs.FileSelector(path))
        self.paths = sorted(f.path for f in listed if f.is_file and f.base_name.lower().endswith(".rtf"))

    def partitions(self):
        return [_Files(self.paths[k : k + self.per_task]) for k in range(0, len(self.paths), self.per_task)] or [_Files([])]

    def read(self, partition):
        from pyarrow import fs

        folder = self.folder
        where = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                data = f.read()
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                text = data.decode("latin-1")
            name = re.sub(r"([^.]+)\.[A-Za-z0-9]+$", r"\1", path.rsplit("/", 1)[-1])
            for r in lexed_rows(name, re.sub(r"\r\n?", "\n", text), self.decode_escapes):
                rows = [(x["row_no"], x["is_header"], [tuple(c.values()) for c in x["cells"]]) for x in r["rows"]]
                yield (r["doc_id"], r["page_no"], r["parameter"], rows, r["error"])


class RtfReportSource(DataSource):
    """``spark.read.format("rtf_report").load(folder)``: the lexed pages of a folder's reports."""

    @classmethod
    def name(cls) -> str:
        return "rtf_report"

    def schema(self) -> str:
        return schema.LEXED

    def reader(self, schema) -> DataSourceReader:
        return _RtfReader(self.options)


def _cell_texts(raw):
    return raw.map(lambda r: None if r is None else lexer.cell_text(r))


def register(spark: SparkSession) -> None:
    """The ``rtf_report`` source, and ``cell_text(raw)`` for SQL."""
    spark.dataSource.register(RtfReportSource)
    spark.udf.register("cell_text", F.pandas_udf(_cell_texts, "string"))
