"""Routing of invalid rows, unification of sources and logged normalization."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ids import numbered, prefixed
from .popular import with_figures

RULES: dict[str, Callable[[Column], Column]] = {
    "unicode_nfc": tx.nfc, "trim": tx.strip, "collapse_spaces": tx.collapse, "normalize_comma_space": tx.comma_space,
    "lowercase": F.lower, "remove_double_quotes": tx.without_quotes,
}
SIDES = ("ESP", "SHIWILU")

def removal_reason(esp: Column, shi: Column) -> Column:
    """The first rule that a pair breaks; null for a valid pair."""
    return (
        F.when(esp.isNull(), "ESP es NaN").when(shi.isNull(), "SHIWILU es NaN")
        .when(tx.strip(esp) == "", "ESP vacío tras strip").when(tx.strip(shi) == "", "SHIWILU vacío tras strip")
        .when(tx.strip(shi) == "--", "SHIWILU es placeholder '--'")
    )


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, removed) of ESP, SHIWILU, row_index: valid pairs get sequential ids, removed ones a reason."""
    judged = df.withColumn("removal_reason", removal_reason(F.col("ESP"), F.col("SHIWILU")))
    valid = numbered(judged.filter("removal_reason is null"), "row_index", "n")
    removed = judged.filter("removal_reason is not null").select(F.col("row_index").alias("original_index"), "ESP", "SHIWILU", "removal_reason")
    return valid.select(prefixed("n", "P").alias("pair_id"), "ESP", "SHIWILU"), removed


def unify(df: DataFrame) -> DataFrame:
    """Concatenated sources -> sequential ids by source, then row."""
    place = df.withColumn("__place", F.col("source_ordinal").cast("long") * (1 << 48) + F.col("ord"))
    return numbered(place, "__place", "n").select(prefixed("n", "U").alias("pair_id"), "ESP", "SHIWILU", "source", "source_pair_id")


def cross_duplicates(df: DataFrame) -> DataFrame:
    """Rows whose lowered, stripped pair occurs in more than one source."""
    keyed = df.withColumns({"__e": tx.match_key(F.col("ESP")), "__s": tx.match_key(F.col("SHIWILU"))})
    keys = keyed.filter("__e is not null and __s is not null").groupBy("__e", "__s").agg(F.countDistinct("source").alias("n")).filter("n > 1").drop("n")
    group = F.concat(F.substring("__e", 1, 20), F.lit("|"), F.substring("__s", 1, 20))
    return with_figures(keyed, keys, ["__e", "__s"], how="left_semi").withColumn("duplicate_group", group).drop("__e", "__s")


def by_side(rules: list[str] | dict[str, list[tuple[str, Callable]]] | None) -> dict[str, list[tuple[str, Callable]]]:
    if isinstance(rules, dict):
        return {side: list(rules.get(side, ())) for side in SIDES}
    return {side: [(r, RULES[r]) for r in (RULES if rules is None else rules) if r in RULES] for side in SIDES}


def normalize(df: DataFrame, rules: list[str] | dict[str, list[tuple[str, Callable]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalized, log): originals stay beside the results; the log has a row for each rule that changed a cell.

    `rules`: names in their order for both sides, unknown ones ignored, or (name, function) lists by side.
    """
    steps, last, changes = df, {}, []
    for side, chain in by_side(rules).items():
        before = side
        for i, (rule, apply) in enumerate(chain):
            after = f"__{side}{i + 1}"
            steps = steps.withColumn(after, apply(F.col(before)))
            changes.append(F.struct(F.lit(side).alias("column"), F.lit(rule).alias("rule_name"), F.col(before).alias("before"), F.col(after).alias("after")))
            before = after
        last[side] = F.col(before)
    extra = [c for c in ("source", "source_pair_id") if c in df.columns]
    result = steps.select("pair_id", *(F.col(n).alias(f"{n}_original") for n in last), *(c.alias(f"{n}_normalizado") for n, c in last.items()), *extra)
    if not changes:
        return result, df.sparkSession.createDataFrame([], "pair_id string, column string, rule_name string, before string, after string")
    log = steps.select("pair_id", F.explode(F.filter(F.array(*changes), lambda x: x["before"] != x["after"])).alias("x")).select("pair_id", "x.*")
    return result, log


def first_of_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Exact duplicates removed, the first by `order` kept (off by default in pipelines)."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")
