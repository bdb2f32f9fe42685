"""Tables that cut lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import Files

#: Bytes of one Arrow batch at most, but for a single longer row.
BATCH_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder; a folder of this machine only where the session names none and runs on this machine alone, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Limits the bytes of the batches that Python workers get, where the session sets no limit: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def settle(spark: SparkSession) -> None:
    """Executors collect their garbage and give the heap beyond it back to the system, as workers do at the end of a task.

    A heap that one job made large otherwise stays so while later jobs' Python workers need memory beside it. Two
    tasks for each core reach every executor, if none of them is busy with other jobs; one that is keeps its heap.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once, in folders by the columns ``by``, and read again: a lost executor costs no more than a read."""
    bounded(df.sparkSession)
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at, fs = _file_system(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def create(spark: SparkSession, path: str, data: bytes) -> bool:
    """Writes a whole small file if no file is there; whether it did."""
    where, name = path.rsplit("/", 1)
    return Files(spark, where).create(name, data)


def read(spark: SparkSession, path: str) -> bytes:
    where, name = path.rsplit("/", 1)
    return Files(spark, where).read(name)


def drop(df: DataFrame) -> None:
    """Deletes what ``saved`` wrote for ``df``; call it once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        remove(df.sparkSession, path)
