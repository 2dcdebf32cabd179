"""How much one Arrow batch to or from Python holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and, for very long texts, by bytes. A setting of the
    session: a lower one stays, and nothing but the size of batches depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
