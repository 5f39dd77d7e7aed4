"""Shards of near-equal bytes by best-fit-decreasing bin packing.

Indivisible groups (equal texts) sorted by size enter the bin with the tightest remaining capacity that holds them,
found in a balanced tree of remaining capacities. The capacity is the smallest at which the shards at hand suffice.
Every group is packed. Groups of one size follow each other in that order, and the tightest bin stays the tightest while
it holds another one, so they are packed as a run: the driver sees how many groups have a size, not the groups. Sizes
that differ are few: d of them hold d (d + 1) / 2 bytes at least, so 100 TB have 14 million at the very most. The
groups of a size are told apart by their rank by digest, which is found in cells of bounded size.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import hinted, stored


class CapacityTree:
    """A treap of (remaining capacity, bin), balanced by fixed pseudo-random priorities."""

    __slots__ = ("root", "_draw")

    def __init__(self):
        self.root, self._draw = None, random.Random(5).random

    def _split(self, node, key):
        """Trees of the keys below and not below `key`."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._merge(a[2], b)
            return a
        b[1] = self._merge(a, b[1])
        return b

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, None, None, self._draw()]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key with capacity for `size`."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        up, node = None, right
        while node[1] is not None:
            up, node = node, node[1]
        if up is None:
            right = node[2]
        else:
            up[1] = node[2]
        self.root = self._merge(left, right)
        return node[0]


#: (size, rank of the first, how many, bin) of groups of one size.
Segment = tuple[int, int, int, int]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[Segment] | None:
    """The bins of runs (size, how many) in descending order of sizes, a bin being opened only where no open one has room;
    None if that takes more than `most_bins`."""
    tree, out, bins = CapacityTree(), [], 0
    for size, left in runs:
        at = 0
        while left:
            found = tree.take_tightest(size)
            if found is None:
                if bins == most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            fit = min(left, found[0] // size)
            out.append((size, at, fit, found[1]))
            tree.add((found[0] - fit * size, found[1]))
            at, left = at + fit, left - fit
    return out


def pack(runs: list[tuple[int, int]], shards: int) -> list[Segment]:
    """The shards of runs (descending): groups above a fair share get shards of their own, the rest enters by best fit
    with the smallest capacity (to 1/20000) for which the remaining shards suffice."""
    out, first, total = [], 0, sum(size * n for size, n in runs)
    rest = list(runs)
    while rest and first < shards - 1 and rest[0][0] * (shards - first) > total:
        (size, n), place = rest[0], sum(k for s, _, k, _ in out if s == rest[0][0])
        out.append((size, place, 1, first))
        total -= size
        first += 1
        rest[:1] = [(size, n - 1)] if n > 1 else []
    if not rest:
        return out
    bins, skipped = shards - first, sum(k for s, _, k, _ in out if s == rest[0][0])
    low = max(rest[0][0], -(-total // bins))
    step = max(1, low // 20_000)
    high, best = low, None
    while (best := best_fit_decreasing(rest, high, bins)) is None:
        low, high = high + 1, high + step
        step *= 2
    while high - low >= max(1, low // 20_000):
        mid = (low + high) // 2
        got = best_fit_decreasing(rest, mid, bins)
        low, high, best = (mid + 1, high, best) if got is None else (low, mid, got)
    # Ranks go on behind those of equal groups that have shards of their own.
    return out + [(size, at + (skipped if size == rest[0][0] else 0), n, first + b) for size, at, n, b in best]


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_a_cell: int = 1_000_000) -> DataFrame:
    """Shards 0 to shards-1 of near-equal bytes with equal texts together, and gapless slots within them.

    Returns id_col, size (UTF-8 bytes plus 16; a null text has 16), text_crc32 (0 for null), law ('bytes'), shard,
    slot (from 0, by slot part and id), grown_shard (null: this law has none). Null and empty texts are groups of
    their own; texts are equal if their SHA-256 is. Null ids are kept; repeated rows share a shard and get slots of
    their own; an empty table gives an empty table; other columns are not read. A group larger than a fair share fills
    a shard alone.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = stored(docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("__key"),
    ))
    groups = stored(rows.groupBy("__key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).toArrow()  # a row a size
    by_size = sorted(zip(*(sizes.column(c).to_pylist() for c in ("bytes", "n"))), reverse=True)
    n_rows = sum(sizes.column("rows").to_pylist())
    segments = np.array(pack(by_size, shards) if by_size else [], np.int64).reshape(-1, 4)
    names = ("__bytes", "__from", "__n", "shard")
    dealt = spark.createDataFrame(pa.table({c: segments[:, i].astype(np.int32) if c == "shard" else segments[:, i] for i, c in enumerate(names)}))
    # The rank of a group among those of its size, by digest: cells are ranges of its first 16 bits.
    crowded = max((n for _, n in by_size), default=1)
    cells = 1 << min(16, max(0, -(-crowded // rows_a_cell) - 1).bit_length())
    cell = F.shiftright(F.conv(F.concat(F.lit("0"), F.substring(F.hex("__key"), 1, 4)), 16, 10).cast("int"), 16 - (cells - 1).bit_length())
    celled = groups.select("__key", "bytes", cell.alias("cell"))
    held = celled.groupBy("bytes", "cell").count()
    offset = held.select("bytes", "cell", (F.sum("count").over(W.partitionBy("bytes").orderBy("cell")) - F.col("count")).alias("offset"))
    own = F.row_number().over(W.partitionBy("bytes", "cell").orderBy("__key"))
    ranked = celled.withColumn("own", own).join(hinted(offset, len(by_size) * cells), ["bytes", "cell"]).withColumn("rank", F.col("offset") + F.col("own") - 1)
    within = (F.col("bytes") == F.col("__bytes")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__from") + F.col("__n"))
    shard_of = stored(ranked.join(hinted(dealt, len(segments)), within).select("__key", "shard"))
    # A cell has about `rows_a_cell` rows at most.
    slot_parts = max(64, -(-n_rows // rows_a_cell))
    part = F.pmod(F.xxhash64("__id", "__key", F.lit(3)), F.lit(slot_parts)).cast("int")
    placed = rows.join(shard_of, "__key").select("__id", "size", "text_crc32", "shard", part.alias("part"))
    # Slots: within small parts of a shard, moved by the rows of the parts before; no task meets a whole shard.
    counts = placed.groupBy("shard", "part").count()  # shards x slot_parts rows
    before = counts.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    own_slot = F.row_number().over(W.partitionBy("shard", "part").orderBy("__id", "text_crc32", "size"))
    return (
        placed.withColumn("own", own_slot)
        .join(hinted(before, shards * slot_parts), ["shard", "part"])
        .select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
