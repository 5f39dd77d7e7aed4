"""Places in a stated order without a task that meets all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import quantiles
from .store import stored

#: Rows of a range, about.
ROWS_A_RANGE = 500_000


def _ranges(df: DataFrame, order: str, parts: int | None) -> tuple[DataFrame, int]:
    """(df with `__range`, the number of ranges): rows fall into ranges at approximate quantiles of a numeric column, nulls
    into the last. Without `parts` there are as many as the rows ask for, as many as shuffle partitions at least."""
    spark = df.sparkSession
    if parts is None:
        rows = df.count()
        parts = min(1 << 16, max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_RANGE)))
    marks = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], min(20 * parts, 1 << 20))).first()[0]
    bounds = sorted(set(marks or []))
    if not bounds:
        return df.withColumn("__range", F.lit(0)), 1
    below = _below(bounds, F.col(order)) if len(bounds) <= 256 else _below_many(spark, bounds)(F.col(order).cast("double"))
    return df.withColumn("__range", F.when(F.col(order).isNull(), F.lit(len(bounds))).otherwise(below)), len(bounds) + 1


def _below(bounds: list, value: Column) -> Column:
    """How many of the rising bounds lie below the value, by halving: a tree of comparisons."""

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(bounds[middle]), branch(middle + 1, high)).otherwise(branch(low, middle))

    return branch(0, len(bounds))


def _below_many(spark, bounds: list):
    """_below for more bounds than an expression should hold. What it gives need only rise with the value, so doubles serve."""
    given = spark.sparkContext.broadcast(np.array([float(b) for b in bounds]))

    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(given.value, values.to_numpy(dtype=float)).astype(np.int32))

    return run


def numbered(df: DataFrame, order: str, out: str, ties: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """`out`: the 0-based place of each row by the numeric column `order` (nulls last), then `ties`.

    df is run once and stored; its bounds, the rows of each range and the result are read from there. Places within a range
    are moved by the rows of those before; the driver holds one bound a range.
    """
    df, _ = _ranges(stored(df), order, parts)
    counts = df.groupBy("__range").count()
    # One row a range.
    before = counts.select(F.col("__range").alias("__r"), (F.sum("count").over(W.orderBy("__range")) - F.col("count")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__range").orderBy(F.asc_nulls_last(order), *ties))
    return df.withColumn("__own", own).join(F.broadcast(before), F.col("__range") == F.col("__r")).withColumn(out, (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__range", "__r", "__before", "__own")


def at_places(df: DataFrame, column: str, places: list[float]) -> DataFrame:
    """(point, value) for each share in `places`, by quantiles.exact; no row for an empty column."""
    values, _ = quantiles.exact(df, column, places)
    return df.sparkSession.createDataFrame([(float(p), x) for p, x in zip(places, values) if x is not None], "point double, value double")


def prefixed(n: str, letter: str):
    return F.format_string(f"{letter}%05d", F.col(n))
