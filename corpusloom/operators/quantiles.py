"""Exact quantiles in two passes: a mergeable sketch brackets each wanted rank, counts settle it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of a sketch (KLL), and how far from a wanted share its answer lies at most, with room to spare.
SKETCH, SPREAD = 2048, 0.006


def _values(spark: SparkSession, sketch: bytes, shares: list[float]) -> list[float]:
    """What a sketch gives for some shares; no job runs."""
    return spark.range(1).select(F.kll_sketch_get_quantile_double(F.lit(sketch), F.array(*map(F.lit, shares))).alias("q")).first()["q"]


def _bracket(spark: SparkSession, sketch: bytes, below: int, inside: int, ranks: tuple[int, int], spread: float) -> tuple[float, float]:
    """Values between which two ranks lie, out of the sketch of `inside` values that have `below` values below them."""
    low, high = ((r - below) / inside for r in (ranks[0], ranks[1] + 1))
    return tuple(_values(spark, sketch, [min(1.0, max(0.0, x)) for x in (low - spread, high + spread)]))


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _at_ranks(df: DataFrame, v: Column, brackets: list[tuple[float, float]], ranks: list[int]) -> list[float | None]:
    """The values at some ranks, None where a rank lies in no bracket: one pass, which counts the values between brackets and
    hands on the distinct values within."""
    spans = _disjoint(brackets)
    segment = F.lit(0)
    for low, high in spans:
        segment = segment + F.when(v > F.lit(high), 2).when(v >= F.lit(low), 1).otherwise(0)
    held = df.select(v.alias("v"), segment.alias("segment")).filter("v is not null")
    found = held.groupBy("segment", F.when(F.col("segment") % 2 == 1, F.col("v")).alias("value")).agg(F.count("*").alias("n")).toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("segment", "value", "n"))), key=lambda r: r[:1] if r[1] is None else r[:2])
    ends = np.cumsum([r[2] for r in rows])
    return [rows[int(np.searchsorted(ends, k, "right"))][1] for k in ranks]


def exact(df: DataFrame, column: str, places: list[float], also: dict[str, Column] | None = None, most: int = 1_000_000, sketch: int = SKETCH, spread: float = SPREAD) -> tuple[list[float | None], dict]:
    """(the value at each share in `places`, linearly between the two values next to it in the order of a numeric column; values
    of the aggregates `also`, read off in the first pass).

    Nulls and NaN are left out of the order; an empty column gives None at each place. Where more than about `most` values lie
    in brackets, passes with sketches of these alone narrow them first, so the driver holds that many distinct values at most.
    A rank that its bracket misses is looked for again in a wider one: the result is exact.
    """
    spark, also = df.sparkSession, also or {}
    plain = F.col(column).cast("double")
    v = F.when(~F.isnan(plain), plain)
    first = df.agg(F.count(v).alias("__n"), F.kll_sketch_agg_double(v, F.lit(sketch)).alias("__sketch"), *(c.alias(k) for k, c in also.items())).first()
    n, others = first["__n"], {k: first[k] for k in also}
    if not n:
        return [None] * len(places), others
    wanted = [(int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)) for p in places]
    inside = [n] * len(places)
    brackets = [_bracket(spark, first["__sketch"], 0, n, r, spread) for r in wanted]
    # Each pass leaves a few hundredths of what is in a bracket; one of a single value is settled.
    while sum(2.5 * spread * m for m, (low, high) in zip(inside, brackets) if low < high) > most:
        within = [v.between(F.lit(low), F.lit(high)) for low, high in brackets]
        row = df.agg(*(c for i, (low, _) in enumerate(brackets) for c in (F.count_if(v < F.lit(low)), F.count_if(within[i]), F.kll_sketch_agg_double(F.when(within[i], v), F.lit(sketch))))).first()
        now = [(row[3 * i], row[3 * i + 1]) for i in range(len(places))]
        if not all(b <= r[0] and r[1] < b + m for (b, m), r in zip(now, wanted)):
            return exact(df, column, places, also, most, sketch, 4 * spread)
        last, inside = inside, [m for _, m in now]
        brackets = [_bracket(spark, row[3 * i + 2], b, m, r, spread) for i, ((b, m), r) in enumerate(zip(now, wanted))]
        if sum(inside) >= sum(last):
            break
    found = _at_ranks(df, v, brackets, [k for r in wanted for k in r])
    if None in found:
        return exact(df, column, places, also, most, sketch, 4 * spread)
    at = [p * (n - 1) for p in places]
    return [low + (high - low) * (x - int(x)) for x, low, high in zip(at, found[::2], found[1::2])], others
