"""A folder of reports as a stream.

The lexer keeps no state between files, so no watermark is needed; what orders rows within a page
(labels by forward fill) is done per file or in a batch of ``foreachBatch``, since windows without
time do not run on streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions.text import strip_extension
from pagewright.sources import rtf


def lexed_stream(spark: SparkSession, folder: str, decode_escapes: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Pages with their rows of each report that is put into the folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", rtf.GLOB)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    texts = files.select(strip_extension(F.element_at(F.split("path", "/"), -1)).alias("doc_id"), rtf.decoded(F.col("content")).alias("text"))
    return rtf.lex(texts, decode_escapes)


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``handle(lexed, batch number)`` for each batch of new reports; all batch operators work
    on what it is given."""
    return lexed_stream(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
