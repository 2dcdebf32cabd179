"""Command line: put the reports of a folder into Word templates.

    python -m pagewright generate TEMPLATE.docx REPORTS/ MAPPING.csv|MAPPING.xlsx OUT/
    python -m pagewright preview REPORTS/ NAME
    python -m pagewright match TEMPLATE.docx REPORTS/
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.operators import match, render
from pagewright.scratch import stored
from pagewright.sources import config, docx, rtf


def generate(spark: SparkSession, template: str, reports: str, mapping: str, out: str) -> None:
    sheet = config.read_xlsx(spark, mapping) if mapping.lower().endswith(".xlsx") else config.read_csv(spark, mapping)
    cfg, selections = config.from_sheet(sheet)
    _, kind, said = rtf.load_folder(spark, reports)
    print(said)
    if kind == "error":
        raise SystemExit(1)
    docx.register(spark)
    made = stored(docx.generate(docx.read_templates(spark, template), cfg, rtf.read_texts(spark, reports), selections), "made")
    made.select("docx_id", "content").write.format("docx_report").mode("append").save(out)
    status = docx.told(made, cfg, lambda i, n, message: print(f"{i}/{n} {message}"))
    log = config.log_text(config.log_blocks(cfg, selections, status), "-", template, reports)
    log.orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/log")
    status.orderBy("row_id").show(100, truncate=False)


def preview(spark: SparkSession, reports: str, name: str) -> None:
    lexed = rtf.lex_once(rtf.read_texts(spark, reports).where(F.col("doc_id") == name))
    for row in render.full_html(rtf.pages_of(lexed), rtf.rows_of(lexed)).limit(1).collect():
        print(row.html)


def suggest(spark: SparkSession, template: str, reports: str) -> None:
    marks = docx.bookmarks(docx.read_templates(spark, template))
    match.best_match(marks, "name", rtf.catalog(spark, reports), "table_name").orderBy("name").show(1000, truncate=False)


def main() -> None:
    parser = argparse.ArgumentParser(prog="pagewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)
    for f, names in ((generate, ("template", "reports", "mapping", "out")), (preview, ("reports", "name")), (suggest, ("template", "reports"))):
        p = commands.add_parser("match" if f is suggest else f.__name__)
        p.set_defaults(run=f)
        for n in names:
            p.add_argument(n)
    args = vars(parser.parse_args())
    args.pop("run")(SparkSession.builder.appName("pagewright").getOrCreate(), **args)


if __name__ == "__main__":
    main()
