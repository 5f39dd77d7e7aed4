"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset a local folder serves a local master
    (as in tests); on a cluster that is an error, since each executor would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "corpusloom-checkpoints")
    return where.rstrip("/")


def folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, rows: int | None = None, by: str | None = None, codec: str | None = None, large: bool = False) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts lineage, survives lost executors. The table goes
    when the application ends, or earlier by discard(). Where a bound of its (narrow) rows is known it is written in
    files of about a million. With `by` each value of that column has a folder of its own, and readers of one value skip the others. `codec`
    names a compression other than the session's. Where rows take megabytes (`large`) a row group has few of them: writers and
    readers hold as much as a row group at once, and would else count on small rows."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 1_000_000)))
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    groups = {"parquet.block.row.count.limit": "4"} if large else {}
    (df.write.partitionBy(by) if by else df.write).options(**groups).parquet(path, compression=codec)
    at, system = folder(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again."""
    for df in tables:
        at, system = folder(df.sparkSession, df._stored_at)
        system.delete(at, True)


def released(spark: SparkSession) -> None:
    """Has the driver's JVM look for what nothing refers to any more: only then do the shuffle files of ended jobs go, and a loop
    of jobs would keep those of all its rounds."""
    spark._jvm.System.gc()


def small_groups(spark: SparkSession, most: str = "8m") -> None:
    """Bounds the bytes of a batch of a group's rows on their way to Python, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
