"""Registered queries of previews, Word tables and Word documents, with SQL that spells their markup.

The reports are the customers of each nation: a page for each market segment, two header rows, the
first merged over all columns, and a row for each customer. They grow with the customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright import errors
from pagewright.functions import text as T
from pagewright.operators import info, mapping, match, render, select
from pagewright.plans.catalogue import query, table, template_bytes
from pagewright.plans.synth import rtf_text
from pagewright.scratch import stored
from pagewright.sources import docx, rtf

SELECTION = "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, parameters array<string>, timelines array<string>"
PICKED = ["BUILDING", "MACHINERY"]


def nation_customers(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"])


def customer_texts(spark, sf_dir) -> DataFrame:
    """(doc_id, path, text): a report for each nation that has customers."""
    edges, merged = "\\cellx1500\\cellx3000\\cellx4000", "\\clmgf\\cellx1500\\clmrg\\cellx3000\\clmrg\\cellx4000"
    cell = lambda c, mark="": F.concat(F.lit(f"\\pard\\intbl{mark} "), rtf_text(c), F.lit("\\cell\n"))
    end = F.lit("\\row\n")
    row = F.concat(F.lit(f"\\trowd{edges}\n"), cell(F.col("c_name"), "\\ql"), cell(F.concat("c_mktsegment", F.lit(' & "co"'))), cell(F.col("c_custkey").cast("string"), "\\qr"), end)
    head = F.concat(
        F.lit(f"\\trowd\\trhdr{merged}\n"), cell(F.col("n_name"), "\\qc"), F.lit("\\cell\n\\cell\n"), end,
        F.lit(f"\\trowd\\trhdr{edges}\n"), *(cell(F.lit(x)) for x in ("Customer", "Segment", "Key")), end,
    )
    said = F.concat(F.lit("{\\header\\trowd\\cellx9000 Parameter: "), "c_mktsegment", F.lit("\\cell\\row}"))
    rows = nation_customers(spark, sf_dir).select("n_name", "c_mktsegment", "c_custkey", row.alias("rtf"))
    in_order = lambda place: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "rtf"))), lambda r: r["rtf"]), "")
    pages = rows.groupBy("n_name", "c_mktsegment").agg(in_order("c_custkey").alias("body")).select("n_name", "c_mktsegment", F.concat(F.lit("\\sect\\sectd"), said, head, "body").alias("rtf"))
    texts = pages.groupBy(F.col("n_name").alias("doc_id")).agg(F.concat(F.lit("{\\rtf1\\ansi\n"), in_order("c_mktsegment"), F.lit("}")).alias("text"))
    return texts.select("doc_id", F.concat(F.lit("/reports/"), "doc_id", F.lit(".rtf")).alias("path"), "text")


class Customers:
    """The customers' reports, lexed once."""

    def __init__(self, spark, sf_dir):
        self.lexed = rtf.lex_once(customer_texts(spark, sf_dir))
        self.pages, self.rows = rtf.pages_of(self.lexed), rtf.rows_of(self.lexed)


def selections(spark, sf_dir) -> DataFrame:
    """For each nation the same selection, with something of everything."""
    ints = lambda *x: F.array(*map(F.lit, x))
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("row_id"), F.col("n_name").alias("doc_id"), ints(2).alias("excluded_cols"), ints(3, 1).alias("excluded_rows"),
        ints(1).alias("excluded_header_rows"), ints(*PICKED).alias("parameters"), F.lit(None).cast("array<string>").alias("timelines"),
    )


# The markup that previews, Word tables and Word documents must have.
BASE = """WITH c AS (
  SELECT n_nationkey::INTEGER AS nk, n_name AS doc, c_name AS name, c_mktsegment AS seg, c_custkey AS k,
         row_number() OVER (PARTITION BY n_name ORDER BY c_mktsegment, c_custkey) AS q, count(*) OVER (PARTITION BY n_name) AS n
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {where}
)"""
RULE = "border-bottom:2px solid black;"
STYLE = "font-family:''Times New Roman'',Times,serif;font-size:10pt;border-collapse:collapse"
COLS = '<colgroup><col style="width:100px"><col style="width:100px"><col style="width:67px"></colgroup>'
NOTICE = (
    "CASE WHEN {n} > 200 THEN '<tr><td colspan=\"{span}\" style=\"padding:4px 0;text-align:center;font-style:italic;color:#888;border-top:1px solid #ccc;\">' || ({n} - 200) "
    "|| ' rows not shown - table truncated for preview</td></tr>' ELSE '' END"
)
PICKED_SQL = "c_mktsegment IN ('BUILDING', 'MACHINERY')"
GREY = "opacity:0.3;"


def html_sql(where: str, keep: str, style: str, cols: str, head: str, row: str, span: int) -> str:
    """A table for each report; ``row`` may use the row's place ``s`` of ``m``, ``q`` and ``rule``."""
    return (
        BASE.format(where=where)
        + f""", e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY q) AS s, count(*) OVER (PARTITION BY doc) AS m FROM c WHERE {keep}),
r AS (SELECT doc, string_agg({row}, '' ORDER BY s) AS body, any_value(m) AS m FROM (SELECT *, CASE WHEN s = m AND m <= 200 THEN '{RULE}' ELSE '' END AS rule FROM e) WHERE s <= 200 GROUP BY doc),
t AS (SELECT nk AS row_id, doc AS doc_id, '<table style="{style}">{cols}<thead>' || {head} || '</thead><tbody>' || coalesce(body, '') || {NOTICE.format(n="coalesce(m, 0)", span=span)} || '</tbody></table>' AS html
  FROM (SELECT DISTINCT nk, doc FROM c) LEFT JOIN r USING (doc))"""
    )


def th(text: str, align: str, extra: str = "", after: str = "", grey: str = "") -> str:
    return f"<th{extra} style=\"{RULE}{grey}padding:0;text-align:{align}{after}\"><b>{text}</b></th>"


FULL_HEAD = "'<tr>" + th("' || doc || '", "center", ' colspan="3"') + "</tr><tr>" + th("Customer", "left") + th("Segment", "center") + th("Key", "center") + "</tr>'"
SEG_HTML = "seg || ' &amp; \"co\"'"
FULL_ROW = (
    "'<tr><td style=\"' || rule || 'padding:0;text-align:left\">' || name || '</td><td style=\"' || rule || 'padding:0;text-align:center\">' || " + SEG_HTML
    + " || '</td><td style=\"' || rule || 'padding:0;text-align:right\">' || k || '</td></tr>'"
)
FULL_SQL = html_sql("true", "true", STYLE, COLS, FULL_HEAD, FULL_ROW, 3) + " SELECT doc_id, sha256(html) AS html_sha256 FROM t"
OUT_HEAD = "'<tr>" + th("Customer", "left") + th("Key", "center") + "</tr>'"
OUT_ROW = "'<tr><td style=\"' || rule || 'padding:0;text-align:left\">' || name || '</td><td style=\"' || rule || 'padding:0;text-align:right\">' || k || '</td></tr>'"
OUT_COLS = '<colgroup><col style="width:100px"><col style="width:67px"></colgroup>'
OUT_SQL = html_sql(PICKED_SQL, "q NOT IN (1, 3)", STYLE, OUT_COLS, OUT_HEAD, OUT_ROW, 2) + " SELECT row_id, doc_id, sha256(html) AS html_sha256 FROM t"


def pane_th(text: str, align: str, place: str, extra: str = "", grey: str = "") -> str:
    return th(text, align, extra, f";cursor:pointer\" data-col=''{place}''", grey).replace("''\"><b>", "''><b>")


PANE_HEAD = (
    "'<tr data-row=\"1\" data-rowtype=\"header\" style=\"opacity:0.3\">" + pane_th("' || doc || '", "center", "[1,2,3]", ' colspan="3"', GREY) + "</tr><tr data-row=\"2\" data-rowtype=\"header\">"
    + pane_th("Customer", "left", "1") + pane_th("Segment", "center", "2", "", GREY) + pane_th("Key", "center", "3") + "</tr>'"
)
OFF = f"CASE WHEN q IN (1, 3) THEN '{GREY}' ELSE '' END"
PANE_ROW = (
    "'<tr data-row=\"' || s || '\" data-rowtype=\"data\" style=\"cursor:pointer' || CASE WHEN q IN (1, 3) THEN ';opacity:0.3' ELSE '' END || '\">'"
    f" || '<td style=\"' || rule || {OFF} || 'padding:0;text-align:left\" data-col=''1''>' || name || '</td><td style=\"' || rule || '{GREY}padding:0;text-align:center\" data-col=''2''>' || {SEG_HTML}"
    f" || '</td><td style=\"' || rule || {OFF} || 'padding:0;text-align:right\" data-col=''3''>' || k || '</td></tr>'"
)
PANE_SQL = html_sql(PICKED_SQL, "true", f"{STYLE};user-select:none", COLS, PANE_HEAD, PANE_ROW, 3) + " SELECT row_id, doc_id, sha256(html) AS html_sha256 FROM t"

BORDER = '<w:tcBorders><w:bottom w:val="single" w:sz="8" w:space="0" w:color="000000"/></w:tcBorders>'
RUN = '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/><w:sz w:val="20"/><w:szCs w:val="20"/>'
MAIN_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def tc(text: str, align: str, border: str, span: str = "", bold: str = "") -> str:
    """A table cell; ``border`` and ``text`` are SQL."""
    return (
        f"'<w:tc><w:tcPr>{span}' || {border} || '<w:jc w:val=\"{align}\"/></w:tcPr><w:p><w:pPr><w:jc w:val=\"{align}\"/><w:spacing w:before=\"0\" w:after=\"0\"/></w:pPr>"
        f"<w:r><w:rPr>{bold}{RUN}</w:rPr><w:t xml:space=\"preserve\">' || {text} || '</w:t></w:r></w:p></w:tc>'"
    )


def head_tc(text: str, align: str, span: str = "") -> str:
    return tc(text, align, f"'{BORDER}'", span, "<w:b/>")


HEAD_ROW = "'<w:tr><w:trPr><w:tblHeader/></w:trPr>' || {} || '</w:tr>'"
UNDER = f"CASE WHEN s = m THEN '{BORDER}' ELSE '' END"


def xml_sql(where: str, keep: str, widths: tuple[int, ...], head: str, row: str) -> str:
    """A Word table for each report."""
    grid = "".join(f'<w:gridCol w:w="{w}"/>' for w in widths)
    return (
        BASE.format(where=where)
        + f""", e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY q) AS s, count(*) OVER (PARTITION BY doc) AS m FROM c WHERE {keep}),
r AS (SELECT doc, string_agg({row}, '' ORDER BY s) AS body FROM e GROUP BY doc),
t AS (SELECT nk AS row_id, doc AS doc_id, '<w:tbl xmlns:w="{MAIN_NS}"><w:tblPr><w:tblW w:w="{sum(widths)}" w:type="dxa"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>' || {head} || coalesce(body, '') || '</w:tbl>' AS xml
  FROM (SELECT DISTINCT nk, doc FROM c) LEFT JOIN r USING (doc))"""
    )


SECOND = " || ".join([head_tc("'Customer'", "left"), head_tc("'Segment'", "center"), head_tc("'Key'", "center")])
XML_HEAD = HEAD_ROW.format(head_tc("doc", "center", '<w:gridSpan w:val="3"/>')) + " || " + HEAD_ROW.format(SECOND)
XML_ROW = f"'<w:tr>' || {tc('name', 'left', UNDER)} || {tc("seg || ' &amp; &quot;co&quot;'", 'center', UNDER)} || {tc('k', 'right', UNDER)} || '</w:tr>'"
OUT_XML_HEAD = HEAD_ROW.format(head_tc("'Customer'", "left") + " || " + head_tc("'Key'", "center"))
OUT_XML_ROW = f"'<w:tr>' || {tc('name', 'left', UNDER)} || {tc('k', 'right', UNDER)} || '</w:tr>'"


def hashed(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.sha2(column, 256).alias(f"{column}_sha256"))


@query(FULL_SQL)
def full_html(spark, sf_dir):
    r = Customers(spark, sf_dir)
    return hashed(render.full_html(r.pages, r.rows), "html", "doc_id")


@query(OUT_SQL)
def output_html(spark, sf_dir):
    r = Customers(spark, sf_dir)
    return hashed(render.output_html(r.pages, r.rows, selections(spark, sf_dir)), "html", "row_id", "doc_id")


@query(PANE_SQL)
def selection_html(spark, sf_dir):
    r = Customers(spark, sf_dir)
    return hashed(render.selection_html(r.pages, r.rows, selections(spark, sf_dir)), "html", "row_id", "doc_id")


@query(xml_sql("true", "true", (1500, 1500, 1000), XML_HEAD, XML_ROW) + " SELECT doc_id, sha256(xml) AS xml_sha256 FROM t")
def xml_tables(spark, sf_dir):
    r = Customers(spark, sf_dir)
    return hashed(render.xml_tables(select.with_columns_of(select.combine(r.pages, r.rows))), "xml", "doc_id")


@query(xml_sql(PICKED_SQL, "q NOT IN (1, 3)", (5616, 3744), OUT_XML_HEAD, OUT_XML_ROW) + " SELECT row_id, doc_id, sha256(xml) AS xml_sha256 FROM t")
def output_xml(spark, sf_dir):
    """The selections' Word tables, widths scaled from 1500 and 1000 to 9360 twips."""
    r = Customers(spark, sf_dir)
    out = render.output_xml(r.pages, r.rows, selections(spark, sf_dir).withColumn("w", F.lit(9360)), text_width="w")
    return hashed(out, "xml", "row_id", "doc_id")


@query(
    "SELECT n_name AS doc_id, c_mktsegment AS parameter, i::INTEGER AS col_no, ['left', '(none)', 'right'][i] AS align, count(*) AS n "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN range(1, 4) t(i) GROUP BY ALL"
)
def cell_alignment(spark, sf_dir):
    cells = Customers(spark, sf_dir).rows.where("not is_header").select("doc_id", "parameter", F.posexplode("cells").alias("p", "c"))
    return cells.groupBy("doc_id", "parameter", (F.col("p") + 1).alias("col_no"), F.coalesce("c.align", F.lit("(none)")).alias("align")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS doc_id, 'é' || n_name || '≥' AS decoded, 'e9' || n_name || '?5' AS plain FROM nation")
def decode_escapes(spark, sf_dir):
    """A question mark and one more character after a ``\\uN`` stand in for it and go."""
    text = F.concat(F.lit("{\\rtf1\\sectd\\trowd\\cellx9 \\'e9"), "n_name", F.lit("\\u8805?5\\cell\\row}"))
    texts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), text.alias("text"))
    first = lambda d: rtf.rows_of(rtf.lex(texts, d)).select("doc_id", F.get("cells", F.lit(0))["text"].alias("decoded" if d else "plain"))
    return first(True).join(first(False), "doc_id")


def picture_texts(spark, sf_dir) -> DataFrame:
    """A report with one picture for each nation; that of the first has no size, that of the second an
    odd number of digits."""
    key = F.col("n_nationkey")
    digits = F.when(key == 1, "895").otherwise(F.hex(F.encode(F.concat(F.lit("png of "), "n_name"), "UTF-8")))
    size = F.when(key == 0, "").otherwise(F.concat(F.lit("\\picwgoal"), (key * 100).cast("string"), F.lit("\\pichgoal900")))
    text = F.concat(F.lit("{\\rtf1\\sectd {\\pict\\pngblip"), size, F.lit("\n"), digits, F.lit("\n}}"))
    name = F.concat(F.lit("img "), "n_name")
    return table(spark, sf_dir, "nation").select(name.alias("doc_id"), F.concat(F.lit("/reports/"), name, F.lit(".rtf")).alias("path"), text.alias("text"))


def documents(spark, sf_dir, strict: bool = False) -> DataFrame:
    """One document: after each nation's bookmark its customers (nations of an even key) or its
    picture (odd keys); and each failure once: an unknown bookmark for a table and for a picture, a
    report that is not there, one that cannot be read. Nations without customers get no table."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    cfg = nation.select(
        (key + 1).cast("int").alias("row_id"), F.col("n_name").alias("bookmark"),
        F.when((key % 2 == 0) & (key > 0), F.col("n_name")).otherwise(F.concat(F.lit("img "), "n_name")).alias("table"),
    )
    wrong = spark.createDataFrame([(101, "nowhere", "bad"), (102, "NATION_3", "bad"), (103, "NATION_3", "gone"), (104, "nowhere", "img NATION_3"), (105, "HEAD", "gone2"), (106, "HEAD", "bad")], cfg.schema)
    bad = spark.createDataFrame([("bad", "/reports/bad.rtf", "{\\rtf1\\sectd\\trowd x\\cell\\row}")], "doc_id string, path string, text string")
    names = [r.n_name for r in nation.orderBy("n_nationkey").collect()]
    template = spark.createDataFrame([("t.docx", template_bytes(["_GoBack", *names], 12240))], "docx_id string, content binary")
    texts = stored(customer_texts(spark, sf_dir).unionByName(picture_texts(spark, sf_dir)).unionByName(bad), "reports")
    return docx.generate(template, cfg.unionByName(wrong), texts, spark.createDataFrame([], SELECTION), strict)


#: The picture of nation nk: cx is the text's width of 9360 twips in EMU; number: its place among the pictures.
PICTURES = "pics AS (SELECT n_nationkey AS nk, n_name, row_number() OVER (ORDER BY n_nationkey) AS number FROM nation WHERE (n_nationkey % 2 = 1 AND n_nationkey <> 1) OR n_nationkey = 0)"
DRAWING_SQL = (
    "'<w:p><w:r><w:drawing><wp:inline><wp:extent cx=\"5943600\" cy=\"' || cy || '\"/><wp:docPr id=\"' || number || '\" name=\"Image' || number || '\"/><a:graphic><a:graphicData "
    "uri=\"http://schemas.openxmlformats.org/drawingml/2006/picture\"><pic:pic><pic:nvPicPr><pic:cNvPr id=\"' || number || '\" name=\"Image' || number || '\"/><pic:cNvPicPr/></pic:nvPicPr>"
    "<pic:blipFill><a:blip r:embed=\"rIdImg' || number || '\"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x=\"0\" y=\"0\"/><a:ext cx=\"5943600\" cy=\"' || cy || '\"/></a:xfrm>"
    "<a:prstGeom prst=\"rect\"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>'"
)
DOCUMENT_SQL = (
    xml_sql("n_nationkey % 2 = 0 AND n_nationkey > 0", "true", (3510, 3510, 2340), XML_HEAD, XML_ROW)
    + f""", {PICTURES}, drawn AS (SELECT nk, {DRAWING_SQL} AS xml FROM (SELECT *, CASE WHEN nk = 0 THEN 5943600 ELSE round_even(5943600 * (900 / (nk * 100)), 0)::BIGINT END AS cy FROM pics)),
put AS (SELECT row_id AS nk, xml FROM t UNION ALL SELECT nk, xml FROM drawn),
body AS (SELECT string_agg('<w:p><w:bookmarkStart w:id="' || (n_nationkey + 1) || '" w:name="' || n_name || '"/><w:bookmarkEnd w:id="' || (n_nationkey + 1) || '"/></w:p>' || coalesce(xml, ''), '' ORDER BY n_nationkey) AS b
  FROM nation LEFT JOIN put ON nk = n_nationkey),
doc AS (SELECT '<w:body><w:p><w:bookmarkStart w:id="0" w:name="_GoBack"/><w:bookmarkEnd w:id="0"/></w:p>' || b || '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:left="1440" w:right="1440"/></w:sectPr></w:body></w:document>' AS x FROM body)
SELECT 't.docx' AS docx_id, sha256('<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<w:document xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
  || ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:w="{MAIN_NS}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing">'
  || replace(replace(replace(x, ' xmlns:w="{MAIN_NS}"', ''), '/>', ' />'), '&quot;', '"')) AS xml_sha256 FROM doc"""
)


@query(DOCUMENT_SQL)
def generate_docx(spark, sf_dir):
    """The whole text of the written document."""
    return docx.part_digests(documents(spark, sf_dir)).where(F.col("part") == docx.DOCUMENT).select("docx_id", F.col("data_sha256").alias("xml_sha256"))


@query(
    f"""WITH {PICTURES}, rels AS (SELECT string_agg('<Relationship Id="rIdImg' || number || '" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/image' || number || '.png" />', '' ORDER BY number) AS r FROM pics)
SELECT 't.docx' AS docx_id, 'word/media/image' || number || '.png' AS part, sha256('png of ' || n_name) AS data_sha256 FROM pics
UNION ALL SELECT 't.docx', 'word/_rels/document.xml.rels', sha256('<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' || r || '</Relationships>') FROM rels
UNION ALL SELECT 't.docx', '[Content_Types].xml', sha256('<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) || '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml" /><Default Extension="png" ContentType="image/png" /></Types>')"""
)
def generate_docx_parts(spark, sf_dir):
    """The pictures, relationships and content types of the written document."""
    return docx.part_digests(documents(spark, sf_dir)).where(F.col("part") != docx.DOCUMENT)


UNREAD_HINT = "The RTF file may be malformed or use unsupported SAS ODS features. Try opening it in a text editor to inspect the structure."
MISSING_HINT = "Check that the file exists, is not open in another application, and is a valid RTF file."
EXTRACT_HINT = "Check that the RTF contains a valid embedded PNG image (\\pngblip). WMF and EMF formats are not supported."
INJECT_HINT = "Check that the Word document is not password-protected and that the bookmark context is valid."
UNREAD = "Failed to parse RTF file ''bad.rtf'' (stage: parse_row). a row defines no cell"
FAILURES_SQL = f"""
SELECT 2 AS row_id, 'image_extract_failed' AS kind, 'Could not extract image from RTF file ''img ' || n_name || '.rtf''.' AS message, '{EXTRACT_HINT}' AS hint FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 101, 'rtf_parse_failed', '{UNREAD}', '{UNREAD_HINT}' UNION ALL SELECT 102, 'rtf_parse_failed', '{UNREAD}', '{UNREAD_HINT}'
UNION ALL SELECT 103, 'rtf_unreadable', 'Cannot read RTF file ''gone''. file not found in RTF folder', '{MISSING_HINT}'
UNION ALL SELECT 104, 'image_inject_failed', 'Failed to inject image at bookmark ''nowhere''. Bookmark ''nowhere'' not found in the Word document.', '{INJECT_HINT}' WHERE EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_3')
UNION ALL SELECT 105, 'rtf_unreadable', 'Cannot read RTF file ''gone2''. file not found in RTF folder', '{MISSING_HINT}' UNION ALL SELECT 106, 'rtf_parse_failed', '{UNREAD}', '{UNREAD_HINT}'"""


@query(FAILURES_SQL)
def generation_failures(spark, sf_dir):
    return docx.status_of(documents(spark, sf_dir)).where("kind IS NOT NULL").select("row_id", "kind", "message", "hint")


CONTEXT_HINT = "Move the bookmark to the document body (not inside any table, header, footer, or text box)."


def _placed_template() -> bytes:
    """Bookmarks in the body, a table cell, a text box, a page header and a page footer."""
    import io
    import zipfile

    mark = lambda n: f'<w:p><w:bookmarkStart w:id="1" w:name="{n}"/></w:p>'
    inside = f"<w:tbl><w:tr><w:tc>{mark('CELL')}</w:tc></w:tr></w:tbl><w:p><w:txbxContent>{mark('BOX')}</w:txbxContent></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(template_bytes(["BODY"]))) as z, zipfile.ZipFile(out, "w") as to:
        for n in z.namelist():
            to.writestr(n, z.read(n).replace(b"<w:sectPr>", inside.encode() + b"<w:sectPr>"))
        for part in ("header", "footer"):
            to.writestr(f"word/{part}1.xml", f'<w:hdr xmlns:w="{MAIN_NS}">{mark(part.upper())}</w:hdr>')
    return out.getvalue()


@query(
    "SELECT row_id, CASE WHEN place IS NOT NULL THEN 'bookmark_bad_context' END AS kind, 'Bookmark ''' || name || ''' is ' || place || '. Injecting a table or image here will produce invalid output.' AS message, "
    f"CASE WHEN place IS NOT NULL THEN '{CONTEXT_HINT}' END AS hint FROM (VALUES (1, 'BODY', NULL), (2, 'CELL', 'inside a table cell'), (3, 'BOX', 'inside a text box'), "
    "(4, 'HEADER', 'in a page header'), (5, 'FOOTER', 'in a page footer')) v(row_id, name, place)"
)
def bookmark_contexts(spark, sf_dir):
    templates = spark.createDataFrame([("t.docx", _placed_template())], "docx_id string, content binary")
    rows = [(i, n, "customers") for i, n in enumerate(("BODY", "CELL", "BOX", "HEADER", "FOOTER"), 1)]
    cfg = spark.createDataFrame(rows, "row_id int, bookmark string, `table` string")
    texts = spark.createDataFrame([("customers", "/reports/customers.rtf", "{\\rtf1\\sectd\\trowd\\cellx9 x\\cell\\row}")], "doc_id string, path string, text string")
    return docx.status_of(docx.generate(templates, cfg, texts, spark.createDataFrame([], SELECTION), strict=True)).select("row_id", "kind", "message", "hint")


@query("SELECT 'img ' || n_name AS doc_id, 'data:image/png;base64,' || to_base64(encode('png of ' || n_name)) AS uri FROM nation WHERE n_nationkey <> 1")
def image_data_uri(spark, sf_dir):
    found = rtf.images(picture_texts(spark, sf_dir)).where("png IS NOT NULL")
    return found.select("doc_id", rtf.data_uri("png").alias("uri"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[' || (c_custkey % 7) || ',' || c_custkey || ']' END AS json FROM customer")
def int_json(spark, sf_dir):
    key = F.col("c_custkey").cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", T.int_json(F.when(key % 3 != 0, F.array(key % 7, key))).alias("json"))


@query("SELECT c_custkey, concat_ws(chr(10) || 'Hint: ', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS said FROM customer")
def formatted_errors(spark, sf_dir):
    hint = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", errors.formatted_column(F.col("c_name"), hint).alias("said"))


def grid(spark, sf_dir) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    return s.select(
        F.col("s_suppkey").cast("int").alias("row_id"), F.when(k == 0, "").when(k == 1, "  ").otherwise(F.col("s_name")).alias("bookmark"),
        F.when(k == 2, "").otherwise(F.concat(F.lit("t"), F.col("s_nationkey").cast("string"))).alias("table"),
    )


GRID_SQL = (
    "SELECT s_suppkey::INTEGER AS row_id, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE s_name END AS bookmark, CASE WHEN s_suppkey % 4 = 2 THEN '' ELSE 't' || s_nationkey END AS \"table\" FROM supplier"
)


@query(f"SELECT row_id, bookmark, \"table\", trim(bookmark) <> '' AS valid_trimmed FROM ({GRID_SQL}) WHERE bookmark <> '' AND \"table\" <> ''")
def valid_rows(spark, sf_dir):
    g = grid(spark, sf_dir)
    trimmed = mapping.valid_rows(g, trimmed=True).select("row_id", F.lit(True).alias("t"))
    return mapping.valid_rows(g).join(trimmed, "row_id", "left").select("row_id", "bookmark", "table", F.coalesce("t", F.lit(False)).alias("valid_trimmed"))


@query(
    f"SELECT 'blank' AS step, i::INTEGER AS row_id, '' AS bookmark, '' AS \"table\" FROM range(1, 6) t(i) UNION ALL SELECT 'added', * FROM ({GRID_SQL}) "
    "UNION ALL SELECT 'added', (max(s_suppkey) + 1)::INTEGER, '', '' FROM supplier "
    f"UNION ALL SELECT 'removed', * FROM ({GRID_SQL}) WHERE row_id < (SELECT max(s_suppkey) FROM supplier) UNION ALL SELECT 'only', 1, 'B', 't'"
)
def mapping_grid(spark, sf_dir):
    g = grid(spark, sf_dir)
    only = spark.createDataFrame([(1, "B", "t")], g.schema)
    steps = {"blank": mapping.blank(spark), "added": mapping.add_row(g), "removed": mapping.remove_last_row(g), "only": mapping.remove_last_row(only)}
    named = [df.select(F.lit(step).alias("step"), "row_id", "bookmark", "table") for step, df in steps.items()]
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(named[3])


@query("SELECT s_suppkey::INTEGER AS row_id, '1,' || (s_suppkey + 5) AS cols, CASE WHEN s_suppkey % 2 = 0 THEN '(none)' ELSE '2,3' END AS rows FROM supplier WHERE s_suppkey NOT IN (2, 5)")
def exclusions_in_order(spark, sf_dir):
    """Exclusion sets sorted and without repeats, after two rows were reset."""
    key = F.col("s_suppkey").cast("int")
    chosen = table(spark, sf_dir, "supplier").select(
        key.alias("row_id"), F.array(key + 5, F.lit(1), key + 5).alias("excluded_cols"), F.when(key % 2 == 1, F.array(F.lit(3), F.lit(2))).alias("excluded_rows"), F.array(F.lit(1)).alias("excluded_header_rows")
    )
    out = mapping.in_order(mapping.reset_rows(chosen, [2, 5]))
    listed = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("(none)"))
    return out.select("row_id", listed("excluded_cols").alias("cols"), listed("excluded_rows").alias("rows"))


@query(
    "SELECT sum(hit)::BIGINT AS n_filled, CASE WHEN sum(hit) > 0 THEN 'Auto-match filled ' || sum(hit)::BIGINT || ' cell' || CASE WHEN sum(hit) = 1 THEN '' ELSE 's' END ELSE 'No confident matches to fill' END AS message "
    "FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS hit FROM supplier)"
)
def fill_message(spark, sf_dir):
    return match.filled_message(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3 == 0).alias("filled")))


@query("SELECT n_name AS name, '(none)' AS match, 0.0::DOUBLE AS score FROM nation")
def match_without_candidates(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    blank = nation.select(F.lit("").alias("table_name"))
    return match.best_match(nation, "n_name", blank, "table_name").select("name", F.coalesce("match", F.lit("(none)")).alias("match"), "score")


def first_cells(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "section", F.col("seq").cast("long").alias("seq"), F.get("cells", F.lit(0))["text"].alias("c1"))


@query(
    BASE.format(where="c_mktsegment = 'BUILDING'") + " SELECT doc AS doc_id, 'data' AS section, q AS seq, name AS c1 FROM c "
    "UNION ALL SELECT DISTINCT doc, 'header', 1, doc FROM c UNION ALL SELECT DISTINCT doc, 'header', 2, 'Customer' FROM c"
)
def customers_combined(spark, sf_dir):
    """Reports that grow with the customers: one page each, combined."""
    r = Customers(spark, sf_dir)
    return first_cells(select.combine(select.filter_pages(r.pages, ["BUILDING"]), select.filter_pages(r.rows, ["BUILDING"])), "doc_id")


@query(
    BASE.format(where=PICKED_SQL) + ", e AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY q) AS s FROM c WHERE q NOT IN (1, 3)) "
    "SELECT nk AS row_id, doc AS doc_id, 'data' AS section, s AS seq, name AS c1, '1,3' AS cols FROM e UNION ALL SELECT DISTINCT nk, doc, 'header', 1, 'Customer', '1,3' FROM c"
)
def customers_selected(spark, sf_dir):
    """The same with pages, rows, header rows and columns left out."""
    r = Customers(spark, sf_dir)
    out = select.prepare(r.pages, r.rows, selections(spark, sf_dir)).withColumn("listed", F.array_join(F.col("cols").cast("array<string>"), ","))
    return first_cells(out, "row_id", "doc_id", F.col("listed").alias("cols"))


@query(
    BASE.format(where="true") + " SELECT doc AS doc_id, 3 AS n_cols, count(*)::INTEGER AS n_rows, doc || '|' || doc || '|' || doc AS col_names, "
    "string_agg(DISTINCT seg, '|' ORDER BY seg) AS parameters, 0 AS n_timelines, false AS is_image FROM c GROUP BY doc"
)
def customers_info(spark, sf_dir):
    r = Customers(spark, sf_dir)
    out = info.table_info(r.pages.select(F.col("doc_id").alias("table_name")).distinct(), r.pages, r.rows)
    joined = lambda c: F.array_join(c, "|").alias(c)
    return out.select("doc_id", "n_cols", "n_rows", joined("col_names"), joined("parameters"), F.size("timelines").alias("n_timelines"), "is_image")
