"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target of words, none above `cap`, the ones nearest to 1 in relative
entropy are least(cap, exp(lambda of its source * words of the document)): longer documents are tilted up where a source
must grow and down where it must shrink. The dual is convex in lambda; its Newton iterations are distributed sums over
the documents (by way of how many documents of a source have a size, which changes no sum), bracketed so that they
cannot leave the solution. The rates are then rounded into whole copies by the hash of each document, and a pool of
about `pool` documents per source absorbs what rounding leaves over.

Sources are a distributed table throughout: nothing that has a row a source meets the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, hinted, n_words, stored

def ordered(sources: DataFrame, name: str = "__source") -> DataFrame:
    """Adds `ordinal`, the 0-based place of each (distinct) source by code point, null last: ranges of names are numbered
    each on its own and moved by the rows of the ranges before, so no task meets all sources."""
    placed = stored(sources.repartitionByRange(F.col(name).isNull(), F.col(name)).withColumn("__at", F.spark_partition_id()))
    counts = placed.groupBy("__at").count()  # a row a range
    before = counts.select("__at", (F.sum("count").over(W.orderBy("__at")) - F.col("count")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__at").orderBy(F.col(name).isNull(), name))
    return placed.withColumn("__own", own).join(F.broadcast(before), "__at").withColumn("ordinal", (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__at", "__own", "__before")


def with_targets(sources: DataFrame, cap: int) -> DataFrame:
    """sources (weight, source_size, ...) with `target`. All sizes are shared by weight; a target stops at cap x its size
    and the excess is shared again by weight among the rest until none is above. Each round is one sum over the sources."""
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = total / weights if weights else 0.0
    while True:
        above = F.col("source_size") * cap < F.col("weight") * F.lit(level)
        full, free, n_full = sources.agg(F.sum(F.when(above, F.col("source_size") * cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if not n_full or not free or (raised := (total - (full or 0)) / free) <= level:
            break
        level = raised
    return sources.withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.col("weight") * F.lit(float(level))))


def tilted(lam: Column, size: Column, cap: int) -> Column:
    """The rate of a document of `size` words, 0 for one without words or where lambda is null."""
    return F.when(size > 0, F.exp(F.least(F.lit(math.log(cap)), lam * size))).otherwise(0.0)


def balance(sizes: DataFrame, sources: DataFrame, cap: int, n_sources: int | None = None, tolerance: float = 1e-9, most_steps: int = 100) -> DataFrame:
    """(ordinal, lam): the dual's solution for each source that has words and a target above 0.

    sizes: (ordinal, size, n), n documents of `size` > 0 words; sources: (ordinal, target). Newton steps on the logarithm
    of a source's tilted words; a step that would leave the bracket of the steps so far halves it instead. Each
    iteration is one distributed sum, whose lambdas are written to the shared folder.
    """
    limit = F.lit(math.log(cap))
    sums = sizes.groupBy("ordinal").agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("s1"), F.sum((F.col("size") * F.col("size")).cast("double") * F.col("n")).alias("s2"), F.min("size").alias("least"))
    start = sums.join(sources.filter("target > 0"), "ordinal")
    # Beyond this lambda all documents are at the cap.
    highest, full = limit / F.col("least"), F.col("target") >= F.col("s1") * cap * (1 - 1e-12)
    first = F.least(highest, F.log(F.col("target") / F.col("s1")) * F.col("s1") / F.col("s2"))
    state = stored(start.select("ordinal", "target", F.when(full, highest).otherwise(first).alias("lam"), F.lit(None).cast("double").alias("low"), highest.alias("high"), full.alias("done")), n_sources)
    for _ in range(most_steps):
        if state.filter("not done").isEmpty():
            break
        rate = tilted(F.col("lam"), F.col("size"), cap)
        moving = F.col("lam") * F.col("size") < limit
        words, slope = F.col("size") * F.col("n") * rate, F.when(moving, F.col("size") * F.col("size") * F.col("n") * rate).otherwise(0.0)
        open_ = state.filter("not done").select("ordinal", "lam")
        got = sizes.join(open_, "ordinal").groupBy("ordinal").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        near = F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")
        high = F.when(F.col("words") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
        low = F.when(F.col("words") <= F.col("target"), F.col("lam")).otherwise(F.col("low"))
        newton = F.col("lam") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        half = F.when(low.isNull(), F.col("lam") * 4 - 1e-9).otherwise((low + high) / 2)
        inside = (F.col("slope") > 0) & (newton < high) & (low.isNull() | (newton > low))
        moved = F.when(F.col("done") | near, F.col("lam")).when(inside, newton).otherwise(half)
        last, state = state, stored(state.join(got, "ordinal", "left").select("ordinal", "target", moved.alias("lam"), low.alias("low"), high.alias("high"), (F.col("done") | near).alias("done")), n_sources)
        discard(last)
    return state.select("ordinal", "lam")


def _settle(cap: int):
    def run(pool: pd.DataFrame) -> pd.DataFrame:
        """Greedy, by descending size: one copy more or less where that brings the source's words nearer."""
        pool = pool.sort_values(["size", "h"], ascending=[False, True])
        gap, moves = pool["gap"].iloc[0], []
        for size, rows, copies in zip(pool["size"], pool["rows"], pool["copies"]):
            words = size * rows
            move = 1 if copies < cap and abs(gap - words) < abs(gap) else -1 if copies > 0 and abs(gap + words) < abs(gap) else 0
            gap -= move * words
            moves.append(move)
        return pd.DataFrame({"m_ordinal": pool["ordinal"], "m_h": pool["h"], "m_size": pool["size"], "move": moves}).loc[lambda x: x["move"] != 0]

    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", pool: int = 512, keep_columns: bool = True) -> DataFrame:
    """Copies of each document so that each source's words come near its target.

    Sources by code point, null last, weigh `weights` in turn and share 100 % of all words (runs of other than ASCII
    white space; a null text has 0). Returns docs' columns (or only the id and the source) and size, source_size,
    target, copies (0 to cap), taken (size * copies); columns of those names in docs are replaced. Documents of 0
    words get no copy. Decisions depend on id, source and size alone: reruns agree, repeated rows get equal copies,
    null ids are an id like any other. An empty table gives an empty table.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in docs.columns if c not in added]
    measured = docs.select(
        F.struct(*(keep if keep_columns else [id_col, source_col])).alias("__row"),  # apart from the names below
        n_words(F.col(text_col).cast("string")).alias("__size"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(17)).alias("__h"),
        F.col(source_col).cast("string").alias("__source"),
    )
    lean = stored(measured.select(*([] if keep_columns else ["__row"]), "__size", "__h", "__source"))
    if not keep_columns:
        measured = lean
    by_size = stored(lean.groupBy("__source", F.col("__size").alias("size")).agg(F.count("*").alias("n")))
    sums = by_size.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    weighted = stored(ordered(sums).withColumn("weight", share))
    n_sources = weighted.count()
    sources = with_targets(weighted, cap)
    same = F.col("__source").eqNullSafe(F.col("t_source"))
    named = sources.withColumnRenamed("__source", "t_source")
    sizes = stored(by_size.filter("size > 0").join(hinted(named.select("t_source", "ordinal"), n_sources), same).select("ordinal", "size", "n"))
    rated = hinted(stored(named.join(balance(sizes, sources.select("ordinal", "target"), cap, n_sources), "ordinal", "left"), n_sources), n_sources)
    unit = lambda salt: F.pmod(F.xxhash64("__h", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.coalesce(F.round(tilted(F.col("lam"), F.col("__size"), cap), 9), F.lit(0.0))
    first = F.when(F.col("__size") > 0, F.least(F.floor(rate + unit(1)), F.lit(cap)).cast("int")).otherwise(0)

    def rounded(rows: DataFrame) -> DataFrame:
        return rows.join(rated, same, "left").withColumn("first", first)

    dealt = rounded(lean.select("__size", "__h", "__source"))
    gaps = dealt.groupBy("ordinal").agg((F.first("target") - F.sum(F.col("__size") * F.col("first"))).alias("gap"))
    pooled = (
        dealt.filter((F.col("__size") > 0) & (unit(2) * F.col("source_rows") < pool))
        .groupBy("ordinal", F.col("__h").alias("h"), F.col("__size").alias("size"), F.col("first").alias("copies"))
        .agg(F.count("*").alias("rows"))
        .join(hinted(gaps, n_sources), "ordinal")
    )
    moves = pooled.groupBy("ordinal").applyInPandas(_settle(cap), "m_ordinal long, m_h long, m_size long, move int")
    moves = hinted(moves, n_sources * pool)  # about `pool` rows a source at most
    out = rounded(measured).join(moves, (F.col("ordinal") == F.col("m_ordinal")) & (F.col("__h") == F.col("m_h")) & (F.col("__size") == F.col("m_size")), "left")
    copies = (F.col("first") + F.coalesce("move", F.lit(0))).cast("int")
    return out.select(
        "__row.*",
        F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("__size") * copies).cast("long").alias("taken"),
    )
