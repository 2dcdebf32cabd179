"""Scratch tables in the folder named by ``spark.checkpoint.dir``.

All executors and the driver see that folder, so a lost executor costs a re-run of its tasks and
no data.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Part of the driver's heap limit beyond which its garbage is collected when a table is written.
HEAP_GROWN = 0.6
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only where one machine does it all, an unnamed one is a
    temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table; one that is gone is no error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    # the session may have ended: the shared folder's owner clears it then
    with contextlib.suppress(Exception):
        delete(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted when the ``scratch`` block or the driver ends."""
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    atexit.register(_at_exit, spark, path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the scratch tables that are made inside the block when it ends; what is still needed
    must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def _room(spark: SparkSession) -> None:
    """Gives memory that the driver's heap has grown into back: plans and task figures of the queries
    that are over are garbage, but a heap near its limit is only filled, not made smaller."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() * HEAP_GROWN:
        spark.sparkContext._jvm.java.lang.System.gc()


@contextlib.contextmanager
def _no_shuffle_left(spark: SparkSession):
    """What a query inside shuffles is deleted when it ends, not when the driver happens to collect
    its garbage."""
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written table in the shared folder, which cuts its lineage, and the table's path.
    Shuffle files that led to it are not needed again and go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _no_shuffle_left(spark):
        df.write.option("compression", "zstd").parquet(path)
    _room(spark)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]
