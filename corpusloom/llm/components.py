"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(links: DataFrame) -> DataFrame:
    """links (a long, b long), in any direction, repeats and loops allowed -> (a, b): b is the smallest member of a's
    component, for every a that is linked and not itself the smallest. Each round writes its links to the shared
    folder and sends the driver one count; the number of rounds grows with the logarithm of the longest chain."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        moved = large.join(least, F.col("a") == F.col("k")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, stored(moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), 2 * before[0])
        discard(last)
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
