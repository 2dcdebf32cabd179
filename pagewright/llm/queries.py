"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.chat_format import chat_format, digests_of, message_records
from pagewright.llm.exact_dedup import exact_dedup
from pagewright.llm.html_extract import html_extract
from pagewright.llm.line_dedup import line_dedup
from pagewright.llm.packing import best_fit_packing
from pagewright.llm.piece_codec import piece_codec
from pagewright.llm.quality_rules import STOP_WORDS, quality_rules
from pagewright.llm.simhash_dedup import near_duplicates
from pagewright.llm.substring_dedup import substring_dedup
from pagewright.llm.token_counts import token_counts

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
LIMIT = 2048
INST = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call starts an empty cache, so that its cost is that of a first run."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", INST), (-7, 1, "assistant", INST)], rows.schema)
    return digests_of(chat_format(message_records(rows.unionByName(extra)), "conv_id", "record"), "conv_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_TOKENIZER), digests=True, reread=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER)).withColumnRenamed("id", "doc_id")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_counts, op3_line_dedup, op4_exact_dedup, op5_chat_format, op6_substring_dedup, op7_piece_codec,
        op8_simhash_dedup, op9_best_fit_packing, op10_html_extract,
    )
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT *, CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) ELSE [] END AS wins FROM w
), rep AS (
  SELECT *, CASE WHEN len(list_distinct(wins)) = len(wins) THEN MAP {{}} ELSE list_histogram(wins) END AS seen FROM win
), pos AS (
  SELECT *, list_filter(range(1, len(wins) + 1), lambda i: coalesce(seen[wins[i]], 1) > 1) AS twice FROM rep
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_distinct(flatten(list_transform(twice, lambda i: range(i, i + 5)))))::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
  FROM pos
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars >= 200 * n_words AND 100 * word_chars <= 1200 * n_words AND 100 * n_symbols <= 20 * n_words
       AND (n_words < 50 OR 100 * n_stop_words >= 5 * n_words) AND 100 * n_dup_lines <= 50 * n_lines AS kept, n_lines, n_stop_words
FROM b
"""
EXACT_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
ORACLES = {"op1_quality_rules": QUALITY_SQL, "op4_exact_dedup": EXACT_SQL}
