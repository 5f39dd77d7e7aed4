"""Joins of rows with figures of their keys where a few keys may hold a large part of all rows, without adaptive execution."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a sketch follows; the share of all rows, and the rows, from which a key counts as popular: a task can hold fewer.
TRACKED, SHARE, LEAST = 10_000, 0.001, 50_000
#: Among how many values of a salt the rows of popular keys are dealt.
SALTS = 1000


def popular_hashes(rows: DataFrame, *key_sets: list[str], share: float = SHARE, tracked: int = TRACKED, least: int = LEAST) -> list[list[int]]:
    """For each set of key columns the hashes of the keys that hold at least about `share` of the rows and `least` rows, by a sketch
    of frequent items (Space-Saving): 1 / share of them at most, and none of 2 x share is missed while share is above
    2 / tracked. One pass for all sets; partitions are sketched where they are."""
    most = int(1 / share) + 1
    top = lambda keys, i: F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {most}, {max(tracked, most)})").alias(f"top{i}")
    found = rows.agg(F.count("*").alias("n"), *(top(keys, i) for i, keys in enumerate(key_sets))).first()
    return [sorted(x["item"] for x in found[f"top{i}"] or [] if x["count"] >= max(least, share * found["n"])) for i in range(len(key_sets))]


def with_figures(rows: DataFrame, figures: DataFrame, keys: list[str], spread: str | None = None, how: str = "inner", null_safe: bool = False, popular: list[int] | None = None) -> DataFrame:
    """rows joined (inner, left or left_semi) with figures, which has one row a key at most, on columns of the same names.

    Figures of popular keys, 1 / SHARE at most, are broadcast. The others are shuffled, and so are all rows; rows of popular keys
    are dealt there by a salt drawn from the column `spread` (all columns without it), so that no task has many rows of one key. Without popular
    keys it is a plain join. Unless `popular` is given, the rows are run once more to find them; store them if that is dear. With
    `null_safe` nulls are equal to nulls; otherwise rows with a null key have no figures.
    """
    if popular is None:
        (popular,) = popular_hashes(rows, keys)
    names = [c for c in figures.columns if c not in keys]
    packed = lambda df, tag: df.select(*(F.col(k).alias(f"__{tag}_{k}") for k in keys), F.struct(F.lit(True).alias("__there"), *names).alias(f"__{tag}"))

    def meet(left: DataFrame, right: DataFrame, tag: str, *more: Column) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"__{tag}_{k}")) if null_safe else F.col(k) == F.col(f"__{tag}_{k}") for k in keys]
        return left.join(right, functools.reduce(Column.__and__, [*same, *more]), "left")

    among = F.xxhash64(*keys).isin(popular) if popular else F.lit(False)
    if popular:
        salted = rows.withColumn("__salt", F.when(among, F.pmod(F.xxhash64(*([spread] if spread else rows.columns)), F.lit(SALTS)) + 1).otherwise(0))
        near = meet(salted, F.broadcast(packed(figures.filter(among), "near")), "near")
        # 0 by an expression that the optimizer cannot fold: so the salt stays one of the columns that the join is dealt by.
        far = packed(figures.filter(~among), "far").withColumn("__zero", F.pmod(F.xxhash64(*(f"__far_{k}" for k in keys)), F.lit(1)))
        met = meet(near, far, "far", F.col("__salt") == F.col("__zero"))
        figure = F.coalesce("__near", "__far")
    else:
        met, figure = meet(rows, packed(figures, "far"), "far"), F.col("__far")
    if how != "left":
        met = met.filter(figure.isNotNull())
    return met.select(*rows.columns, *(figure[c].alias(c) for c in names if how != "left_semi"))
