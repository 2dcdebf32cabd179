"""The registered queries of the report engine and their SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import info, mapping, match, render, select, validate
from pagewright.plans import synth
from pagewright.scratch import stored
from pagewright.sources import config as config_io
from pagewright.sources import docx, rtf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its own name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Report:
    """The orders report, written as RTF and lexed again."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.lexed = rtf.lex_once(synth.orders_report(table(spark, sf_dir, "orders")))
        self.pages, self.rows = rtf.pages_of(self.lexed), rtf.rows_of(self.lexed)


def pair(df: DataFrame, *extra) -> DataFrame:
    """The two cells of each row as columns."""
    return df.select(*extra, F.get("cells", F.lit(0))["text"].alias("c1"), F.get("cells", F.lit(1))["text"].alias("c2"))


def combined_pairs(df: DataFrame) -> DataFrame:
    return pair(df, "section", F.col("seq").cast("long").alias("seq"))


# The messages and markup that the SQL below spells are those that results must show.
#: rep: page_no, parameter, row_no, hdr, tl (null above a page's first label), c1, c2
REP = """
WITH base AS (
  SELECT o_orderpriority AS parameter, 'Year ' || year(o_orderdate) AS tl, o_orderstatus AS c1, count(*) AS n FROM orders GROUP BY ALL
), pg AS (SELECT parameter, row_number() OVER (ORDER BY parameter) AS page_no FROM (SELECT DISTINCT parameter FROM base)),
raw AS (
  SELECT parameter, 0 AS k, '' AS o, 0 AS d, NULL AS tl, 'Status' AS c1, 'N' AS c2 FROM pg
  UNION ALL SELECT parameter, 1, '', 0, NULL, 'Total', sum(n)::BIGINT::VARCHAR FROM base GROUP BY parameter
  UNION ALL SELECT DISTINCT parameter, 2, tl, 0, tl, tl, '' FROM base
  UNION ALL SELECT parameter, 2, tl, 1, tl, c1, n::VARCHAR FROM base
), named AS (SELECT page_no, raw.* FROM raw JOIN pg USING (parameter)),
bare AS (
  SELECT (SELECT count(*) + 1 FROM pg) AS page_no, NULL AS parameter, 0 AS k, '' AS o, 0 AS d, NULL AS tl, 'Status' AS c1, 'N' AS c2
  UNION ALL SELECT (SELECT count(*) + 1 FROM pg), NULL, 1, '', 0, NULL, c1, sum(n)::BIGINT::VARCHAR FROM base GROUP BY c1
), rep AS (
  SELECT page_no::INTEGER AS page_no, parameter, row_number() OVER (PARTITION BY page_no ORDER BY k, o, d, c1)::INTEGER AS row_no, k = 0 AS hdr, tl, c1, c2
  FROM (SELECT * FROM named UNION ALL SELECT * FROM bare)
)"""


def combined_sql(where: str = "true", headers: str = "true", rows: str = "true") -> str:
    """The combined table of the pages and rows that pass, after exclusion by number."""
    return (
        REP
        + f""", kept AS (SELECT * FROM rep WHERE {where}),
comb AS (
  SELECT CASE WHEN hdr THEN 'header' ELSE 'data' END AS section, row_number() OVER (PARTITION BY hdr ORDER BY page_no, row_no) AS seq, c1, c2, tl, page_no
  FROM kept WHERE NOT hdr OR page_no = (SELECT min(page_no) FROM kept)
), excl AS (
  SELECT section, row_number() OVER (PARTITION BY section ORDER BY seq) AS seq, c1, c2 FROM comb
  WHERE (section = 'header' AND ({headers})) OR (section = 'data' AND ({rows}))
)"""
    )


PICK = "(parameter IS NULL OR parameter IN ('1-URGENT', '3-MEDIUM'))"
LINES = "(hdr OR tl IS NULL OR tl IN ('Year 1996', 'Year 1998'))"
PARAMETERS, TIMELINES = ["1-URGENT", "3-MEDIUM"], ["Year 1996", "Year 1998"]


def selection(spark: SparkSession, **given) -> DataFrame:
    """One selection of the orders report."""
    names = ("excluded_cols", "excluded_rows", "excluded_header_rows", "parameters", "timelines")
    kinds = "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, parameters array<string>, timelines array<string>"
    return spark.createDataFrame([(1, "orders", *(given.get(n) for n in names))], kinds)


def prepared(spark: SparkSession, sf_dir: str, **given) -> DataFrame:
    r = Report(spark, sf_dir)
    return select.prepare(r.pages, r.rows, selection(spark, **given))


def shown_pairs(df: DataFrame) -> DataFrame:
    cells = select.project_cells(F.col("cells"), F.col("cols"))
    return df.select("section", F.col("seq").cast("long").alias("seq"), F.array_join(F.transform(cells, lambda c: c["text"]), "|").alias("shown"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parameters and one year of the orders report, combined, cell by cell."""
    out = prepared(spark, sf_dir, parameters=PARAMETERS, timelines=["Year 1996"])
    return out.select("doc_id", "section", "seq", F.posexplode("cells").alias("col_no", "cell")).select("doc_id", "section", "seq", "col_no", "cell.text")


@query(REP + " SELECT page_no, coalesce(parameter, '') AS parameter, row_no, hdr AS is_header, c1, c2 FROM rep")
def parse_report_cells(spark, sf_dir):
    r = Report(spark, sf_dir)
    return pair(r.rows, "page_no", F.coalesce("parameter", F.lit("")).alias("parameter"), "row_no", "is_header")


@query(REP + " SELECT string_agg(parameter, '; ' ORDER BY page_no) AS parameters FROM pg")
def report_parameters(spark, sf_dir):
    return info.parameters(Report(spark, sf_dir).pages).select(F.array_join("parameters", "; ").alias("parameters"))


@query(REP + " SELECT string_agg(tl, '; ' ORDER BY p, r) AS timelines FROM (SELECT tl, min(page_no) AS p, min(struct_pack(page_no, row_no)) AS r FROM rep WHERE tl = c1 GROUP BY tl)")
def report_timelines(spark, sf_dir):
    return info.timelines(Report(spark, sf_dir).rows).select(F.array_join("timelines", "; ").alias("timelines"))


@query(REP + " SELECT page_no, row_no, c1, c2 FROM rep WHERE parameter = '2-HIGH' OR parameter IS NULL")
def filter_by_parameter(spark, sf_dir):
    return pair(select.filter_pages(Report(spark, sf_dir).rows, ["2-HIGH"]), "page_no", "row_no")


@query(REP + " SELECT DISTINCT page_no, coalesce(parameter, '(none)') AS parameter FROM rep WHERE parameter IS NULL")
def filter_keeps_null_parameter(spark, sf_dir):
    kept = select.filter_pages(Report(spark, sf_dir).pages, ["no such parameter"])
    return kept.select("page_no", F.coalesce("parameter", F.lit("(none)")).alias("parameter"))


@query(REP + " SELECT page_no, row_no, c1, c2 FROM rep WHERE hdr OR tl IS NULL OR tl = 'Year 1996'")
def filter_by_timeline(spark, sf_dir):
    return pair(select.filter_timelines(Report(spark, sf_dir).rows, ["Year 1996"]), "page_no", "row_no")


@query(
    REP + ", lab AS (SELECT page_no, row_no, hdr, c1, c2, CASE WHEN NOT hdr AND c2 = '' THEN c1 END AS label FROM rep) "
    "SELECT page_no, row_no, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY page_no ORDER BY row_no ROWS UNBOUNDED PRECEDING), '') AS timeline FROM lab"
)
def timeline_resets_per_page(spark, sf_dir):
    return select.with_timeline(Report(spark, sf_dir).rows).select("page_no", "row_no", F.coalesce("timeline", F.lit("")).alias("timeline"))


@query(combined_sql() + " SELECT section, c1, c2, count(*) AS n FROM comb GROUP BY ALL")
def combine_pages(spark, sf_dir):
    r = Report(spark, sf_dir)
    return combined_pairs(select.combine(r.pages, r.rows)).groupBy("section", "c1", "c2").agg(F.count(F.lit(1)).alias("n"))


@query(combined_sql(PICK) + " SELECT section, seq, c1, c2 FROM comb")
def combined_row_numbers(spark, sf_dir):
    r = Report(spark, sf_dir)
    return combined_pairs(select.combine(select.filter_pages(r.pages, PARAMETERS), select.filter_pages(r.rows, PARAMETERS)))


@query(
    REP + " SELECT 'orders' AS doc_id, 2 AS n_cols, (SELECT count(*)::INTEGER FROM rep WHERE NOT hdr) AS n_rows, 'Status|N' AS col_names, "
    "(SELECT string_agg(parameter, '|' ORDER BY page_no) FROM pg) AS parameters, (SELECT count(DISTINCT tl)::INTEGER FROM rep) AS n_timelines, false AS is_image "
    "UNION ALL SELECT 'missing', 0, 0, '', '', 0, false"
)
def table_info(spark, sf_dir):
    r = Report(spark, sf_dir)
    catalog = spark.createDataFrame([("orders",), ("missing",)], "table_name string")
    out = info.table_info(catalog, r.pages, r.rows)
    return out.select("doc_id", "n_cols", "n_rows", F.array_join("col_names", "|").alias("col_names"), F.array_join("parameters", "|").alias("parameters"), F.size("timelines").alias("n_timelines"), "is_image")


@query(combined_sql() + " SELECT section, seq, c2 AS shown FROM excl")
def exclude_columns(spark, sf_dir):
    return shown_pairs(prepared(spark, sf_dir, excluded_cols=[1]))


@query(combined_sql(f"{PICK} AND {LINES}", "true", "seq NOT IN (1, 4)") + " SELECT section, seq, c1 || '|' || c2 AS shown FROM excl")
def exclude_rows(spark, sf_dir):
    return shown_pairs(prepared(spark, sf_dir, parameters=PARAMETERS, timelines=TIMELINES, excluded_rows=[1, 4]))


@query(combined_sql("true", "seq <> 1") + " SELECT section, seq, c1 || '|' || c2 AS shown FROM excl")
def exclude_header_rows(spark, sf_dir):
    return shown_pairs(prepared(spark, sf_dir, excluded_header_rows=[1]))


@query(combined_sql() + " SELECT section, seq, c1 || '|' || c2 AS shown FROM excl")
def exclude_all_columns_falls_back(spark, sf_dir):
    return shown_pairs(prepared(spark, sf_dir, excluded_cols=[1, 2]))


@query(
    "SELECT 'names' AS spec, '2' AS cols UNION ALL SELECT 'numbers', '2;1;2' UNION ALL SELECT 'truncated', '2' UNION ALL SELECT 'mixed', '1' "
    "UNION ALL SELECT 'unknown', '1;2' UNION ALL SELECT 'range', '1' UNION ALL SELECT 'all', '1;2'"
)
def resolve_cols_by_name(spark, sf_dir):
    r = Report(spark, sf_dir)
    ref = select.reference_rows(select.combine(r.pages, r.rows)).select(F.transform("head", lambda c: c["text"]).alias("names"))
    specs = [("names", ["N"]), ("numbers", ["2", "1", "2"]), ("truncated", ["2.7"]), ("mixed", ["Status", "2"]), ("unknown", ["x"]), ("range", ["1", "9"]), ("all", None)]
    wanted = spark.createDataFrame(specs, "spec string, wanted array<string>")
    cols = select.resolve_cols(F.col("wanted"), F.size("names"), F.col("names"))
    return wanted.join(ref).select("spec", F.array_join(cols.cast("array<string>"), ";").alias("cols"))


@query(combined_sql() + " SELECT section, seq, c1, c2 FROM comb WHERE section = 'header' OR seq BETWEEN 3 AND 7")
def slice_rows(spark, sf_dir):
    r = Report(spark, sf_dir)
    return combined_pairs(select.slice_rows(select.combine(r.pages, r.rows), 3, 7))


def nation_rows(spark, sf_dir) -> DataFrame:
    """A report whose header merges each region's name over its nations' columns."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    place = F.row_number().over(select.Window.partitionBy("r_regionkey").orderBy("n_nationkey"))
    marked = joined.select("r_name", "n_nationkey", place.alias("k"), F.count(F.lit(1)).over(select.Window.partitionBy("r_regionkey")).alias("n"))
    edge = F.concat(F.when(F.col("k") == 1, "\\clmgf").otherwise("\\clmrg"), F.lit("\\cellx"), (F.col("k") * 500).cast("string"))
    cell = F.concat(F.when(F.col("k") == 1, F.col("r_name")).otherwise(""), F.lit("\\cell "))
    parts = marked.groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("k", edge.alias("e"), cell.alias("c")))).alias("p"))
    row = F.concat(F.lit("\\trowd\\trhdr"), F.array_join(F.transform("p", lambda x: x["e"]), ""), F.lit(" "), F.array_join(F.transform("p", lambda x: x["c"]), ""), F.lit("\\row"))
    texts = parts.select(F.col("r_name").alias("doc_id"), F.concat(F.lit("{\\rtf1\\sectd "), row, F.lit("}")).alias("text"))
    return rtf.rows_of(rtf.lex(texts))


@query(
    "SELECT r_name AS doc_id, (k - 1)::INTEGER AS col_no, r_name AS text, (CASE WHEN k = 1 THEN n ELSE 0 END)::INTEGER AS colspan "
    "FROM (SELECT r_name, row_number() OVER w AS k, count(*) OVER (PARTITION BY r_name) AS n FROM nation JOIN region ON n_regionkey = r_regionkey "
    "WINDOW w AS (PARTITION BY r_name ORDER BY n_nationkey))"
)
def merged_cells_fill_and_colspan(spark, sf_dir):
    return nation_rows(spark, sf_dir).select("doc_id", F.posexplode("cells").alias("col_no", "c")).select("doc_id", "col_no", "c.text", "c.colspan")


@query("SELECT r_name AS doc_id, string_agg('500', ',') AS widths FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cell_widths_diff(spark, sf_dir):
    return nation_rows(spark, sf_dir).select("doc_id", F.array_join(F.transform("cells", lambda c: c["width_twips"].cast("string")), ",").alias("widths"))


@query(
    """WITH w AS (SELECT p_partkey, [p_size, p_size + 7, 2 * p_size] AS w, 4 * p_size + 7 AS total FROM part),
s AS (SELECT p_partkey, list_transform(w, lambda x: greatest(1, round_even(x * (8640 / total), 0)::BIGINT)) AS s FROM w),
f AS (SELECT p_partkey, s, 8640 - list_sum(s) AS rest, list_position(s, list_max(s)) AS place FROM s)
SELECT p_partkey, (s[1] + CASE WHEN place = 1 THEN rest ELSE 0 END)::BIGINT AS w1, (s[2] + CASE WHEN place = 2 THEN rest ELSE 0 END)::BIGINT AS w2,
       (s[3] + CASE WHEN place = 3 THEN rest ELSE 0 END)::BIGINT AS w3 FROM f"""
)
def scale_widths(spark, sf_dir):
    size = F.col("p_size")
    scaled = table(spark, sf_dir, "part").select("p_partkey", render.scale_widths(F.array(size, size + 7, 2 * size), F.lit(8640)).alias("w"))
    return scaled.select("p_partkey", *(F.get("w", F.lit(i)).alias(f"w{i + 1}") for i in range(3)))


TOKENS_SQL = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"
KEY_SQL = "array_to_string(list_filter({0}, lambda t: regexp_full_match(t, '[0-9]+')), '.')"
SCORE_SQL = """
  SELECT a, b, ka = kb AND ka <> '' AS same, CASE WHEN len(list_distinct(list_concat(ta, tb))) = 0 THEN 0
           ELSE len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) END AS jac,
         CASE WHEN greatest(length(a), length(b)) = 0 THEN 0 ELSE 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)) END AS edit
  FROM (SELECT *, {ka} AS ka, {kb} AS kb FROM (SELECT a, b, {ta} AS ta, {tb} AS tb FROM names CROSS JOIN cands))
""".format(ta=TOKENS_SQL.format("a"), tb=TOKENS_SQL.format("b"), ka=KEY_SQL.format("ta"), kb=KEY_SQL.format("tb"))


def scored_sql(names: str, candidates: str) -> str:
    return (
        f"WITH names AS (SELECT DISTINCT a FROM ({names})), cands AS (SELECT DISTINCT b FROM ({candidates}) WHERE b <> ''), raw AS ({SCORE_SQL}), "
        "scored AS (SELECT a, b, same, CASE WHEN same THEN least(1.0, 0.9 + 0.1 * jac) ELSE 0.6 * jac + 0.4 * edit END AS score FROM raw), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, same DESC, b) AS k FROM scored)"
    )


BRANDS = "SELECT 'T_' || replace(p_brand, '#', '_') || '_' || p_type AS a FROM part"
BRAND_TABLES = "SELECT DISTINCT 'Table ' || p_brand || ' ' || lower(p_type) AS b FROM part"


def brand_names(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("T_"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), "p_type").alias("a"))
    return names, part.select(F.concat(F.lit("Table "), "p_brand", F.lit(" "), F.lower("p_type")).alias("b")).distinct()


@query(scored_sql("SELECT n_name AS a FROM nation", "SELECT r_name AS b FROM region") + " SELECT a AS name, b AS candidate, round(score, 6) AS score FROM scored")
def match_score_pairs(spark, sf_dir):
    out = match.scores(table(spark, sf_dir, "nation"), "n_name", table(spark, sf_dir, "region"), "r_name")
    return out.select("name", "candidate", F.round("score", 6).alias("score"))


@query(scored_sql(BRANDS, BRAND_TABLES) + " SELECT a AS name, b AS match, round(score, 6) AS score FROM ranked WHERE k = 1")
def best_match(spark, sf_dir):
    names, tables = brand_names(spark, sf_dir)
    return match.best_match(names, "a", tables, "b").select("name", "match", F.round("score", 6).alias("score"))


SUPPLIER_CONFIG = (
    "SELECT s_suppkey::INTEGER AS row_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS bookmark, "
    "CASE s_suppkey % 3 WHEN 0 THEN 'tab ' || s_name WHEN 1 THEN '' ELSE 'kept' END AS tab FROM supplier"
)


def supplier_config(spark, sf_dir) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 3
    return s.select(
        F.col("s_suppkey").cast("int").alias("row_id"), F.when(k == 0, "").otherwise(F.col("s_name")).alias("bookmark"),
        F.when(k == 0, F.concat(F.lit("tab "), "s_name")).when(k == 1, "").otherwise("kept").alias("table"),
    )


@query(
    f"WITH cfg AS ({SUPPLIER_CONFIG}), "
    + scored_sql("SELECT CASE WHEN bookmark <> '' THEN bookmark ELSE tab END AS a FROM cfg WHERE (bookmark = '') <> (tab = '')", "SELECT n_name AS b FROM nation")[5:]
    + " SELECT row_id, CASE WHEN bookmark = '' AND tab <> '' AND score >= 0.12 THEN b ELSE bookmark END AS bookmark, "
    "CASE WHEN tab = '' AND bookmark <> '' AND score >= 0.12 THEN b ELSE tab END AS \"table\", "
    "coalesce((bookmark = '') <> (tab = '') AND score >= 0.12, false) AS filled "
    "FROM cfg LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r ON a = CASE WHEN bookmark <> '' THEN bookmark ELSE tab END AND (bookmark = '') <> (tab = '')"
)
def fill_suggestions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return match.fill_suggestions(supplier_config(spark, sf_dir), nation.select(F.col("n_name").alias("name")), nation.select(F.col("n_name").alias("table_name")), 0.12)


@query(f"SELECT c_name, {KEY_SQL.format(TOKENS_SQL.format('c_name'))} AS key FROM customer")
def numeric_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", T.numeric_key("c_name").alias("key"))


CUSTOMER_NATIONS = "SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500"


def part_config(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Bookmarks: the nations in key order. Mapping: a row for each region; odd ones are blank."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    bookmarks = nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    first = nation.groupBy("n_regionkey").agg(F.min("n_name").alias("n"))
    cfg = region.join(first, region["r_regionkey"] == first["n_regionkey"]).select(
        (F.col("r_regionkey") + 1).cast("int").alias("row_id"), F.when(F.col("r_regionkey") % 2 == 1, "").otherwise(F.concat(F.lit(" "), "n")).alias("bookmark"), F.lit("t").alias("table")
    )
    return bookmarks, cfg


PART_CONFIG = (
    "cfg AS (SELECT (r_regionkey + 1)::INTEGER AS row_id, CASE WHEN r_regionkey % 2 = 1 THEN '' ELSE ' ' || min(n_name) END AS bookmark, 't' AS tab "
    "FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey), "
    "miss AS (SELECT n_nationkey AS ord, n_name AS name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_name NOT IN (SELECT trim(bookmark) FROM cfg))"
)


@query(f"WITH {PART_CONFIG} SELECT ord, name FROM miss")
def missing_bookmarks_anti(spark, sf_dir):
    return match.missing_bookmarks(*part_config(spark, sf_dir))


@query(
    f"WITH {PART_CONFIG}, blank AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS k FROM cfg WHERE bookmark = '') "
    "SELECT cfg.row_id, coalesce(name, bookmark) AS bookmark, tab AS \"table\" FROM cfg LEFT JOIN blank USING (row_id) LEFT JOIN miss ON miss.k = blank.k "
    "UNION ALL SELECT ((SELECT max(row_id) FROM cfg) + k - (SELECT count(*) FROM blank))::INTEGER, name, '' FROM miss WHERE k > (SELECT count(*) FROM blank)"
)
def assign_blank_rows(spark, sf_dir):
    bookmarks, cfg = part_config(spark, sf_dir)
    return match.add_missing_bookmarks(cfg, bookmarks)


def checked_config(spark, sf_dir) -> dict[str, DataFrame]:
    """A mapping with every fault: from suppliers, against nations and regions."""
    s, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(nation, s["s_nationkey"] == nation["n_nationkey"])
    k = F.col("s_suppkey") % 5
    cfg = joined.select(
        F.col("s_suppkey").cast("int").alias("row_id"),
        F.when(k == 0, "").when(k == 1, F.col("s_name")).otherwise(F.col("n_name")).alias("bookmark"),
        F.when(k == 2, "").when(k == 3, "orders").otherwise(F.concat(F.lit("t"), F.col("s_nationkey").cast("string"))).alias("table"),
    )
    info_rows = region.select(
        F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.lit(2).alias("n_cols"), F.array(F.lit("ALT"), F.lit("AST")).alias("parameters"),
        F.array(F.lit("Week 1")).alias("timelines"), (F.col("r_regionkey") == 4).alias("is_image"),
    )
    selections = s.select(
        F.col("s_suppkey").cast("int").alias("row_id"), F.array(F.lit(2), (F.col("s_suppkey") % 4).cast("int")).alias("excluded_cols"),
        F.array(F.lit("ALT"), F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string"))).alias("parameters"), F.array(F.lit("Week 1"), F.lit("Week 2")).alias("timelines"),
    )
    return {
        "config": cfg, "bookmarks": nation.select(F.col("n_name").alias("name")),
        "catalog": info_rows.select(F.col("doc_id").alias("table_name")), "info": info_rows, "selections": selections,
    }


CHECKED_SQL = """
WITH cfg AS (
  SELECT s_suppkey::INTEGER AS row_id, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN s_name ELSE n_name END AS b,
         CASE s_suppkey % 5 WHEN 2 THEN '' WHEN 3 THEN 'orders' ELSE 't' || s_nationkey END AS t
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), db AS (SELECT b, string_agg(row_id::VARCHAR, ', ' ORDER BY row_id) AS rb FROM cfg WHERE b <> '' GROUP BY b HAVING count(*) > 1),
dt AS (SELECT t, string_agg(row_id::VARCHAR, ', ' ORDER BY row_id) AS rt FROM cfg WHERE t <> '' GROUP BY t HAVING count(*) > 1),
j AS (
  SELECT cfg.*, rb, rt, b IN (SELECT n_name FROM nation) AS kb, t IN (SELECT 't' || r_regionkey FROM region) AS kt, t IN ('t0', 't1', 't2', 't3') AS readable
  FROM cfg LEFT JOIN db USING (b) LEFT JOIN dt USING (t)
), r AS (
  SELECT row_id, b, t,
    CASE WHEN b <> '' AND t = '' THEN 'Bookmark set but no table selected' END AS v1,
    CASE WHEN b = '' AND t <> '' THEN 'Table set but no bookmark selected' END AS v2,
    CASE WHEN b <> '' AND NOT kb THEN 'Bookmark ''' || b || ''' not found in the Word document.' END AS v3,
    'Bookmark ''' || b || ''' is mapped in multiple rows: ' || rb || '.' AS v4,
    CASE WHEN t <> '' AND NOT kt THEN 'Cannot read RTF file ''' || t || '''. not found in RTF folder' END AS v5,
    'Table ''' || t || ''' is mapped in multiple rows: ' || rt AS v6,
    CASE WHEN readable THEN 'Unknown parameter(s): P' || (row_id % 3) END AS v7,
    CASE WHEN readable THEN 'Unknown timeline(s): Week 2' END AS v8,
    CASE WHEN readable AND row_id % 4 IN (0, 3) THEN 'Excluded column index ' || (row_id % 4) || ' is out of range for bookmark ''' || b || ''' (table has 2 columns).' END AS v9
  FROM j
)"""


def _rule_query(n: int, name: str):
    @query(f"{CHECKED_SQL} SELECT row_id, v{n} AS message FROM r WHERE v{n} IS NOT NULL")
    def run(spark, sf_dir):
        out = validate.rules(**checked_config(spark, sf_dir))
        return out.where(F.col(f"v{n}").isNotNull()).select("row_id", F.col(f"v{n}.message").alias("message"))

    for where in (QUERIES, ORACLES):
        where[f"validate_{name}"] = where.pop("run")


for _n, _name in enumerate(
    ("no_table", "no_bookmark", "bookmark_unknown", "bookmark_duplicate", "table_unknown", "table_duplicate", "parameters", "timelines", "exclusions"), 1
):
    _rule_query(_n, _name)


@query(
    CHECKED_SQL + """ SELECT row_id, CASE WHEN b = '' AND t = '' THEN '' WHEN coalesce(v3, v4, v5) IS NOT NULL THEN 'error'
WHEN coalesce(v1, v2, v6, v7, v8, v9) IS NOT NULL THEN 'warning' ELSE '' END AS type,
CASE WHEN b = '' AND t = '' THEN '' WHEN coalesce(v3, v4, v5) IS NOT NULL THEN concat_ws('; ', v3, v4, v5) ELSE concat_ws('; ', v1, v2, v6, v7, v8, v9) END AS message FROM r"""
)
def validate_severity(spark, sf_dir):
    return validate.validate(**checked_config(spark, sf_dir)).select("row_id", "type", "message")


@query("SELECT n_name AS name, string_agg(s_suppkey::VARCHAR, ', ' ORDER BY s_suppkey) AS rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1")
def duplicate_rows_listing(spark, sf_dir):
    s, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    cfg = s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("row_id"), F.col("n_name").alias("bookmark"))
    return mapping.duplicates(cfg, "bookmark").select("name", F.array_join("rows", ", ").alias("rows"))


HTML_CELLS = (
    "'<td style=\"' || rule || 'padding:0;text-align:left\">' || c1 || '</td><td style=\"' || rule || 'padding:0;text-align:left\">' || c2 || '</td>'"
)


@query(
    combined_sql(f"{PICK} AND {LINES}") + ", z AS (SELECT *, CASE WHEN seq = max(seq) OVER (PARTITION BY section) THEN 'border-bottom:2px solid black;' ELSE '' END AS rule FROM excl) "
    "SELECT section, seq, CASE WHEN section = 'header' THEN '<tr><th style=\"border-bottom:2px solid black;padding:0;text-align:left\"><b>' || c1 || "
    "'</b></th><th style=\"border-bottom:2px solid black;padding:0;text-align:left\"><b>' || c2 || '</b></th></tr>' ELSE '<tr>' || " + HTML_CELLS + " || '</tr>' END AS html FROM z"
)
def html_rows(spark, sf_dir):
    return render.html_rows(prepared(spark, sf_dir, parameters=PARAMETERS, timelines=TIMELINES)).select("section", F.col("seq").cast("long").alias("seq"), "html")


def customer_rows(spark, sf_dir) -> DataFrame:
    """A combined table of all customers, in key order."""
    c = table(spark, sf_dir, "customer")
    cell = lambda v, a: F.struct(v.alias("text"), F.lit(1500).alias("width_twips"), F.lit(a).cast("string").alias("align"), F.lit(False).alias("is_merge_first"), F.lit(False).alias("is_merge_cont"), F.lit(1).alias("colspan"))
    place = F.row_number().over(select.Window.partitionBy("section").orderBy("c_custkey"))
    rows = c.select("c_custkey", F.col("c_mktsegment").alias("doc_id"), F.lit("data").alias("section"), F.array(cell(F.col("c_name"), None), cell(F.col("c_mktsegment"), "right")).alias("cells"))
    by_segment = select.Window.partitionBy("doc_id")
    numbered = rows.withColumns({"seq": F.row_number().over(by_segment.orderBy("c_custkey")), "n_section": F.count(F.lit(1)).over(by_segment)})
    return numbered.withColumns({"widths": F.array(F.lit(1500), F.lit(1500)), "page_no": F.lit(1)}).drop("c_custkey")


@query(
    """WITH c AS (SELECT c_mktsegment AS s, c_name AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS q, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer),
r AS (SELECT s, q, total, '<tr><td style="' || CASE WHEN q = total AND total <= 200 THEN 'border-bottom:2px solid black;' ELSE '' END || 'padding:0;text-align:left">' || n
  || '</td><td style="' || CASE WHEN q = total AND total <= 200 THEN 'border-bottom:2px solid black;' ELSE '' END || 'padding:0;text-align:right">' || s || '</td></tr>' AS h FROM c WHERE q <= 200)
SELECT s AS doc_id, sha256('<table style="font-family:''Times New Roman'',Times,serif;font-size:10pt;border-collapse:collapse"><colgroup><col style="width:100px"><col style="width:100px"></colgroup><thead></thead><tbody>'
  || string_agg(h, '' ORDER BY q) || CASE WHEN any_value(total) > 200 THEN '<tr><td colspan="2" style="padding:4px 0;text-align:center;font-style:italic;color:#888;border-top:1px solid #ccc;">'
  || (any_value(total) - 200) || ' rows not shown - table truncated for preview</td></tr>' ELSE '' END || '</tbody></table>') AS html_sha256 FROM r GROUP BY s"""
)
def html_truncated_preview(spark, sf_dir):
    return render.html_tables(customer_rows(spark, sf_dir)).select("doc_id", F.sha2("html", 256).alias("html_sha256"))


XML_SQL = (
    "'<w:tr><w:tc><w:tcPr>' || rule || '<w:jc w:val=\"left\"/></w:tcPr><w:p><w:pPr><w:jc w:val=\"left\"/><w:spacing w:before=\"0\" w:after=\"0\"/></w:pPr><w:r><w:rPr>' || font "
    "|| '</w:rPr><w:t xml:space=\"preserve\">' || n || '</w:t></w:r></w:p></w:tc><w:tc><w:tcPr>' || rule || '<w:jc w:val=\"right\"/></w:tcPr><w:p><w:pPr><w:jc w:val=\"right\"/>"
    "<w:spacing w:before=\"0\" w:after=\"0\"/></w:pPr><w:r><w:rPr>' || font || '</w:rPr><w:t xml:space=\"preserve\">' || s || '</w:t></w:r></w:p></w:tc></w:tr>'"
)


@query(
    f"""WITH c AS (SELECT c_mktsegment AS s, c_name AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS q, count(*) OVER (PARTITION BY c_mktsegment) AS total FROM customer),
d AS (SELECT *, CASE WHEN q = total THEN '<w:tcBorders><w:bottom w:val="single" w:sz="8" w:space="0" w:color="000000"/></w:tcBorders>' ELSE '' END AS rule,
  '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman"/><w:sz w:val="20"/><w:szCs w:val="20"/>' AS font FROM c)
SELECT s AS doc_id, q AS seq, sha256({XML_SQL}) AS xml_sha256 FROM d"""
)
def ooxml_rows(spark, sf_dir):
    return render.xml_rows(customer_rows(spark, sf_dir)).select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2("xml", 256).alias("xml_sha256"))


@query("SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_html("html"), 256).alias("escaped"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def escape_xml(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.escape_xml("html"), 256).alias("escaped"))


@query(
    combined_sql(PICK) + """, z AS (SELECT *, max(seq) OVER (PARTITION BY section) AS n,
  CASE WHEN section = 'data' AND seq IN (2, 5) THEN true ELSE false END AS off FROM excl)
SELECT section, seq, CASE WHEN section = 'header' THEN '<tr data-row="' || seq || '" data-rowtype="header"><th style="border-bottom:2px solid black;padding:0;text-align:left;cursor:pointer" data-col=''1''><b>' || c1
  || '</b></th><th style="border-bottom:2px solid black;opacity:0.3;padding:0;text-align:left;cursor:pointer" data-col=''2''><b>' || c2 || '</b></th></tr>'
ELSE '<tr data-row="' || seq || '" data-rowtype="data" style="cursor:pointer' || CASE WHEN off THEN ';opacity:0.3' ELSE '' END || '"><td style="' || CASE WHEN seq = n THEN 'border-bottom:2px solid black;' ELSE '' END
  || CASE WHEN off THEN 'opacity:0.3;' ELSE '' END || 'padding:0;text-align:left" data-col=''1''>' || c1 || '</td><td style="' || CASE WHEN seq = n THEN 'border-bottom:2px solid black;' ELSE '' END
  || 'opacity:0.3;padding:0;text-align:left" data-col=''2''>' || c2 || '</td></tr>' END AS html FROM z"""
)
def selection_pane_opacity(spark, sf_dir):
    r, item = Report(spark, sf_dir), ("row_id", "doc_id")
    chosen = selection(spark, parameters=PARAMETERS, excluded_cols=[2], excluded_rows=[2, 5])
    rows = select.combine(select.select_by(r.pages, chosen.select("row_id", "doc_id", "parameters")), select.timelines_by(select.select_by(r.rows, chosen)), item)
    return render.selection_rows(select.with_columns_of(rows, item)).select("section", F.col("seq").cast("long").alias("seq"), "html")


@query(
    "SELECT p_partkey, round(p_size * 37 * 96.0 / 1440)::INTEGER AS px, p_size::BIGINT * 37 * 635 AS emu, round_even(p_size * 1000 / 635, 0)::INTEGER AS twips FROM part"
)
def twips_to_px_emu(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", T.twips_to_px(size * 37).alias("px"), T.twips_to_emu(size * 37).alias("emu"), T.emu_to_twips(size * 1000).alias("twips"))


SHEET_SQL = "SELECT s_suppkey::INTEGER AS row_id, s_name AS bm, 't_' || s_nationkey || '.' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.rtf' ELSE '' END AS tab, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE 'ALT; P' || s_suppkey || ' ;x y' END AS ps FROM supplier"


def sheet(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.cast("int").alias("row_id"), F.col("s_name").alias("BookMark"),
        F.concat(F.lit("t_"), F.col("s_nationkey").cast("string"), F.lit("."), key.cast("string"), F.when(key % 2 == 0, ".rtf").otherwise("")).alias("TABLE"),
        F.when(key % 4 == 0, " ").otherwise(F.concat(F.lit("ALT; P"), key.cast("string"), F.lit(" ;x y"))).alias("Parameters"),
    )


STRIP_SQL = r"regexp_replace(tab, '([^.]+)\.[A-Za-z0-9]+$', '\1')"


@query(f"WITH s AS ({SHEET_SQL}) SELECT row_id, bm AS bookmark, {STRIP_SQL} AS \"table\", CASE WHEN trim(ps) = '' THEN '' ELSE 'ALT|P' || row_id || '|x y' END AS parameters FROM s")
def import_config_split(spark, sf_dir):
    cfg, selections = config_io.from_sheet(sheet(spark, sf_dir))
    return cfg.join(selections, "row_id", "left").select("row_id", "bookmark", "table", F.array_join(F.coalesce("parameters", F.array().cast("array<string>")), "|").alias("parameters"))


@query(f"WITH s AS ({SHEET_SQL}) SELECT row_id, bm AS \"Bookmark\", {STRIP_SQL} || '.rtf' AS \"Table\", CASE WHEN trim(ps) = '' THEN '' ELSE 'ALT; P' || row_id || '; x y' END AS \"Parameters\", '' AS \"Timelines\" FROM s")
def export_config_join(spark, sf_dir):
    return config_io.to_sheet(*config_io.from_sheet(sheet(spark, sf_dir)))


@query(f"WITH s AS ({SHEET_SQL}) SELECT row_id, {STRIP_SQL} AS name FROM s")
def strip_extension(spark, sf_dir):
    return sheet(spark, sf_dir).select("row_id", T.strip_extension("TABLE").alias("name"))


@query(
    f"WITH s AS ({SHEET_SQL}) SELECT row_id, 'Row       : ' || row_id || chr(10) || 'Bookmark  : ' || bm || chr(10) || 'Table     : ' || {STRIP_SQL} || '.rtf' || chr(10) || "
    "CASE WHEN row_id % 3 = 0 THEN 'Status    : ERROR - broken' || chr(10) || 'Hint      : mend it' ELSE 'Parameters: ' || CASE WHEN trim(ps) = '' THEN '(all)' ELSE 'ALT; P' || row_id || '; x y' END "
    "|| chr(10) || 'Timelines : (all)' END || chr(10) AS block FROM s"
)
def generation_log(spark, sf_dir):
    cfg, selections = config_io.from_sheet(sheet(spark, sf_dir))
    status = cfg.select("row_id", F.when(F.col("row_id") % 3 == 0, "x").alias("kind"), F.when(F.col("row_id") % 3 == 0, "broken").alias("message"), F.when(F.col("row_id") % 3 == 0, "mend it").alias("hint"))
    return config_io.log_blocks(cfg, selections, status)


@query("SELECT n_name AS doc_id, hex(encode(n_comment)) AS png, n_nationkey * 100 AS width_twips, 900 AS height_twips FROM (SELECT n_name, n_nationkey, 'png of ' || n_name AS n_comment FROM nation)")
def image_detect_extract(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    digits = F.hex(F.encode(F.concat(F.lit("png of "), "n_name"), "UTF-8"))
    group = F.concat(F.lit("{\\pict\\pngblip\\picwgoal"), (F.col("n_nationkey") * 100).cast("string"), F.lit("\\pichgoal900\n"), digits, F.lit("\n}"))
    texts = nation.select(F.col("n_name").alias("doc_id"), F.concat(F.lit("{\\rtf1\\sectd "), group, F.lit("}")).alias("text"))
    return rtf.images(texts).select("doc_id", F.hex("png").alias("png"), "width_twips", "height_twips")


def template_bytes(names: list[str], width: int | None = 12240) -> bytes:
    """A Word template with a paragraph for each bookmark."""
    import io
    import zipfile

    from xml.sax.saxutils import quoteattr

    w = f'xmlns:w="{render.W_NS}"'
    marks = "".join(f'<w:p><w:bookmarkStart w:id="{i}" w:name={quoteattr(n)}/><w:bookmarkEnd w:id="{i}"/></w:p>' for i, n in enumerate(names))
    section = "" if width is None else f'<w:sectPr><w:pgSz w:w="{width}" w:h="15840"/><w:pgMar w:left="1440" w:right="1440"/></w:sectPr>'
    parts = {
        docx.TYPES: f'<Types xmlns="{docx.CT_NS}"><Default Extension="xml" ContentType="application/xml"/></Types>',
        docx.DOCUMENT: f"<w:document {w}><w:body>{marks}{section}</w:body></w:document>",
        docx.RELS: f'<Relationships xmlns="{docx.REL_NS}"/>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def nation_template(spark, sf_dir) -> DataFrame:
    """One template whose bookmarks are the nations' names, with a hidden one; the names of 25
    nations are a fixed-size list."""
    names = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    return spark.createDataFrame([("t.docx", template_bytes(["_GoBack", *names]))], "docx_id string, content binary")


@query("SELECT 't.docx' AS docx_id, n_nationkey + 2 AS ord, n_name AS name, (n_nationkey + 1)::VARCHAR AS id FROM nation")
def docx_bookmarks(spark, sf_dir):
    return docx.bookmarks(nation_template(spark, sf_dir))


@query("SELECT 't.docx' AS docx_id, (12240 - 2880) * 635 AS emu, 12240 - 2880 AS twips UNION ALL SELECT 'plain.docx', 5486400, 8640")
def docx_text_width(spark, sf_dir):
    plain = spark.createDataFrame([("plain.docx", template_bytes(["B"], None))], "docx_id string, content binary")
    return docx.text_widths(nation_template(spark, sf_dir).unionByName(plain))


GENERATED = """SELECT s_suppkey::INTEGER AS row_id, CASE s_suppkey % 4 WHEN 0 THEN 'xml_inject_failed' WHEN 1 THEN NULL WHEN 2 THEN 'rtf_unreadable' END AS kind,
CASE s_suppkey % 4 WHEN 0 THEN 'Failed to inject table at bookmark ''' || s_name || '''. Bookmark ''' || s_name || ''' not found in the Word document.'
WHEN 2 THEN 'Cannot read RTF file ''' || s_name || '''. file not found in RTF folder' END AS message FROM supplier WHERE s_suppkey % 4 <> 3"""


def generated(spark, sf_dir) -> DataFrame:
    """All suppliers mapped to their nations' bookmarks, with each kind of failure."""
    s, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey") % 4
    cfg = s.join(nation, s["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").cast("int").alias("row_id"), F.when(k == 0, F.col("s_name")).otherwise(F.col("n_name")).alias("bookmark"),
        F.when(k == 2, F.col("s_name")).when(k == 3, "").otherwise("orders").alias("table"),
    )
    selections = spark.createDataFrame([], "row_id int, doc_id string, excluded_cols array<int>, excluded_rows array<int>, excluded_header_rows array<int>, parameters array<string>, timelines array<string>")
    texts = stored(synth.orders_report(table(spark, sf_dir, "orders")).select("doc_id", F.lit("/reports/orders.rtf").alias("path"), "text"), "reports")
    return docx.generate(nation_template(spark, sf_dir), cfg, texts, selections)


@query(GENERATED)
def generate_docx_status(spark, sf_dir):
    return docx.status_of(generated(spark, sf_dir)).select("row_id", "kind", "message")


LINES_SQL = """SELECT 'supplier ' || l_suppkey AS doc_id, l_returnflag AS parameter, count(*) AS n_rows, sum(length(l_orderkey::VARCHAR) + length(l_linenumber::VARCHAR) + length(l_linestatus))::BIGINT AS n_chars
FROM lineitem GROUP BY ALL"""


@query(LINES_SQL)
def lex_line_items(spark, sf_dir):
    """All line items as one report for each supplier, lexed again: the lexer's throughput."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("doc_id"), F.col("l_returnflag").alias("parameter"), F.lit("data").alias("kind"),
        F.struct("l_orderkey", "l_linenumber").alias("line"), F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_linestatus").alias("cells"),
    ).withColumn("page_no", F.ascii("parameter"))
    rows = rtf.rows_of(rtf.lex(synth.report_from_lines(items, (1500, 800, 800))))
    chars = F.aggregate("cells", F.lit(0), lambda n, c: n + F.length(c["text"]))
    return rows.groupBy("doc_id", "parameter").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(chars).alias("n_chars"))
