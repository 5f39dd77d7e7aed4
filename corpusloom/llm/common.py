"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import discard, folder, shared_dir, stored  # noqa: F401

#: Words of the contracts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_by(df: DataFrame, key: str, n: int) -> DataFrame:
    """df as a table in the shared folder in n hash buckets of `key`, within Spark's limit of buckets: groups of it are found
    where they are, without another shuffle. Its files last as long as the application; its name leaves the catalogue
    at once, since the result is resolved already."""
    spark, name = df.sparkSession, f"corpusloom_{uuid.uuid4().hex}"
    n = table_buckets(spark, n)
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    at, system = folder(spark, path)
    system.deleteOnExit(at)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return out


def table_buckets(spark: SparkSession, wanted: int) -> int:
    """As many of the wanted buckets as a table may have; rows of several keys share one beyond."""
    return max(1, min(wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))


#: A side of a join of at most so many rows is broadcast; beyond, the join shuffles.
SMALL = 200_000


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted or proven number of (narrow) rows is small."""
    return F.broadcast(df) if rows <= SMALL else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def trim() -> None:
    """Gives the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_held: dict = {}


def worker_keeps(key, make: Callable[[], Any] = lambda: None) -> Any:
    """What this Python worker keeps from task to task under a key. There is one such thing at a time: what another operator
    kept goes first, and its memory back to the system."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = make()
    return _held[key]


def small_handover(spark: SparkSession, most: str = "8m") -> None:
    """Bounds the bytes of a batch that an executor hands to Python at once, unless the session has a bound of its own;
    what holds then is bounded by rows of any length, not by their number."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def small_batches(batch: pa.RecordBatch, text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `most` bytes of text (a single long text may exceed it)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
