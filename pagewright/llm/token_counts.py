"""Token counts: a digest cache.

The normalised content's digest and the tokenizer's version digest are the key of a stored table
of counts. A run joins its documents' digests to it, encodes only the distinct contents that miss
(one document of each), appends them to the cache, and joins the counts back. The cache is a
Parquet folder with a part for each tokenizer, read once, and only the rows of the run's digests go
on; a repeated append of a key after a retry is harmless, since equal keys have equal counts and
are reduced to one.

Normalisation must not change the count: null becomes empty, and for tokenizers that drop white
space, white space at both ends goes. Defined cases: an empty table gives an empty result; rows
that repeat an id each get their count; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import word_bpe
from pagewright.llm.shared import scratch_path, small_batches, stored, text_of

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file; a changed file misses all that was counted before."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    drops = path.endswith(".json") and word_bpe.drops_space(path)
    return F.btrim(text, F.lit(" \t\n\r")) if drops else text


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def counter(path: str):
    """texts -> tokens of each, without begin, end or added special tokens."""
    if path.endswith(".model"):
        model = _pieces(path)
        return lambda texts: list(map(len, model.encode(texts, num_threads=1)))
    return word_bpe.table(path).counts


def _encode(path: str, batches):
    count = counter(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(count(b.column("text").to_pylist()), pa.int64())], names=["digest", "n_tokens"])


def open_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; a digest may be there more than once."""
    try:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return found.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def token_counts(df: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens. ``cache``: the folder of stored counts, with a part
    for each tokenizer; None starts an empty one in the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    text = text_of(text_col)
    content = normalised(text, tokenizer)
    digest = F.unhex(F.sha2(content, 256))
    base = stored(df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "contents")
    distinct = base.groupBy("digest").agg(F.min("id").alias("rep"))
    known = stored(open_cache(spark, cache, version).join(distinct.select("digest"), "digest", "left_semi"), "known")
    misses = distinct.join(known, "digest", "left_anti").withColumnRenamed("digest", "miss")
    texts = df.select(F.col(id_col).alias("id"), digest.alias("digest"), content.alias("text"))
    wanted = texts.join(misses.hint("shuffle_hash"), (F.col("digest") == F.col("miss")) & F.col("id").eqNullSafe(F.col("rep"))).select("digest", "text")
    counted = stored(wanted.mapInArrow(functools.partial(_encode, tokenizer), "digest binary, n_tokens long"), "counted")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # written, so that the join is a plain one and the rows of one digest may be split
    counts = stored(known.unionByName(counted).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return base.join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
