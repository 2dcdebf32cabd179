"""Import, export and log of mappings.

A sheet is a DataFrame of text columns, from CSV, Parquet or an ``.xlsx`` file.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import join_list, split_list, strip_extension, trim_blank
from pagewright.operators.mapping import valid_rows

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
NO_STRINGS = "array<string>"


def _named(df: DataFrame, wanted: str) -> Column | None:
    """The first column of that name, in any case."""
    found = next((c for c in df.columns if c.lower() == wanted), None)
    return None if found is None else F.col(f"`{found}`").cast("string")


def from_sheet(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(config, selections) of a sheet with row_id. Bookmark and Table are needed, in any case; the
    table loses its last extension; nulls become empty; Parameters and Timelines are lists split at
    ``;``. Nothing of earlier selections is kept."""
    bookmark, table = _named(sheet, "bookmark"), _named(sheet, "table")
    if bookmark is None or table is None:
        raise ValueError("the sheet must have 'Bookmark' and 'Table' columns")
    name = strip_extension(F.coalesce(table, F.lit("")))
    config = sheet.select("row_id", F.coalesce(bookmark, F.lit("")).alias("bookmark"), name.alias("table"))

    def items(column: str) -> Column:
        given = _named(sheet, column)
        split = F.array().cast(NO_STRINGS) if given is None else split_list(given)
        return F.when(F.size(split) > 0, split).alias(column)

    none = F.lit(None).cast("array<int>")
    selections = sheet.where(name != "").select(
        "row_id", name.alias("doc_id"), none.alias("excluded_cols"), none.alias("excluded_rows"), none.alias("excluded_header_rows"), items("parameters"), items("timelines")
    )
    return config, selections


def to_sheet(config: DataFrame, selections: DataFrame) -> DataFrame:
    """row_id, Bookmark, Table (with .rtf), Parameters, Timelines (joined by ``; ``)."""
    joined = config.join(selections.select("row_id", "parameters", "timelines"), "row_id", "left")
    return joined.select(
        "row_id",
        F.col("bookmark").alias("Bookmark"),
        F.when(F.col("table") != "", F.concat("table", F.lit(".rtf"))).otherwise(F.col("table")).alias("Table"),
        join_list("parameters").alias("Parameters"),
        join_list("timelines").alias("Timelines"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet; rows are numbered in file order."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return numbered(rows)


def numbered(rows: DataFrame) -> DataFrame:
    """A sheet of the size of a mapping grid: one window without partitions numbers it."""
    from pyspark.sql import Window

    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("row_id", F.row_number().over(Window.orderBy("__at")).cast("int")).drop("__at")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_rows(data: bytes) -> list[list[str | None]]:
    """The first sheet's cells as texts; the standard library is enough for that."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        name = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{MAIN}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                v, kind = c.find(f"{MAIN}v"), c.get("t")
                text = None if v is None else v.text
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                cells[_column(c.get("r")) if c.get("r") else k] = text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """An Excel sheet, all columns as text. One file, read on the driver: a grid, not data."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    rows = xlsx_rows(data)
    names = [n or f"column{i}" for i, n in enumerate(rows[0])]
    body = [(i, *((r[k] if k < len(r) else None) for k in range(len(names)))) for i, r in enumerate(rows[1:], 1)]
    return spark.createDataFrame(body, ", ".join(["row_id int", *(f"`{n}` string" for n in names)]))


def xlsx_bytes(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet with inline strings."""
    from xml.sax.saxutils import escape

    def cells(values):
        return "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for v in values)

    lines = "".join(f"<row>{cells(r)}</row>" for r in [names, *rows])
    main, rel = MAIN.strip("{}"), "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{text}')
    return out.getvalue()


def export_xlsx(sheet: DataFrame) -> bytes:
    """The workbook of an exported sheet; it has a row for each mapping."""
    names = [c for c in sheet.columns if c != "row_id"]
    return xlsx_bytes(names, [tuple(r[c] for c in names) for r in sheet.orderBy("row_id").collect()])


def log_blocks(config: DataFrame, selections: DataFrame, status: DataFrame) -> DataFrame:
    """(row_id, block): what became of each mapping with both names. ``status``: row_id, kind
    (null: ok), message, hint."""
    rows = (
        valid_rows(config, trimmed=True)
        .join(selections.select("row_id", "parameters", "timelines"), "row_id", "left")
        .join(status.select("row_id", "kind", F.col("message").alias("said"), F.col("hint").alias("help")), "row_id", "left")
    )
    # The log's labels.
    head = F.format_string("Row       : %d\nBookmark  : %s\nTable     : %s.rtf\n", "row_id", trim_blank("bookmark"), trim_blank("table"))
    failed = F.concat(F.lit("Status    : ERROR - "), F.col("said"), F.coalesce(F.concat(F.lit("\nHint      : "), F.col("help")), F.lit("")))
    fine = F.concat(F.lit("Parameters: "), join_list("parameters", "(all)"), F.lit("\nTimelines : "), join_list("timelines", "(all)"))
    return rows.select("row_id", F.concat(head, F.when(F.col("kind").isNotNull(), failed).otherwise(fine), F.lit("\n")).alias("block"))


def log_text(blocks: DataFrame, user: str, word_file: str | None, folder: str | None, at: datetime | None = None) -> DataFrame:
    """(ord, value): the lines of the log, for ``orderBy("ord").select("value").coalesce(1).write.text``."""
    spark = blocks.sparkSession
    at = at or datetime.now()
    head = [
        "  Document Generation Log", f"Generated : {at:%Y-%m-%d %H:%M:%S}", f"User      : {user}",
        f"Word file : {word_file or '(not set)'}", f"RTF folder: {folder or '(not set)'}", "",
    ]
    first = spark.createDataFrame([(-1, "\n".join(head))], "ord int, value string")
    none = blocks.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("ord"), F.lit("(no table mappings defined)").alias("value"))
    return first.unionByName(none).unionByName(blocks.select(F.col("row_id").alias("ord"), F.col("block").alias("value")))
