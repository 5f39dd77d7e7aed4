"""SimHash fingerprints and their links within a Hamming distance, by BK-trees.

Two 64-bit fingerprints that differ in at most 3 bits agree on one of four 16-bit blocks, so a link lies within one of
the shards (block, value). Each shard's fingerprints form a BK-tree, whose children are keyed by their distance to the
parent; a search follows only the edges within the radius. A shard above `most` fingerprints is divided again by
the same rule over the bits that its members do not share, at most until 2^16 can be left, so no tree grows with the
corpus. Shards hold distinct fingerprints: copies of a document meet before. A tree hands on the links of each member
to the smallest member that it reaches, not all pairs; components of these links are found by distributed stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import hinted, shuffle_partitions, small_batches, small_handover, stored, worker_keeps
from .components import stars


def _shingle_hashes(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, seed 42, of the shingles of each text's words, A-Z lowered; where those of each text start, and the end).
    Fewer words than a shingle: the whole sequence; none: no shingle."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    starts = []
    for text in texts:
        starts.append(len(hashes))
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, 42))
            continue
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        first = [0, *(blanks[: len(words) - shingle] + 1).tolist()]
        end = [*blanks[shingle - 1 :].tolist(), len(joined)]
        hashes += [digest(joined[a:b], 42) for a, b in zip(first, end)]
    return np.array(hashes, np.uint64), np.array([*starts, len(hashes)])


def _majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signed 64 bits for each text: those set in over half of its hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    for piece in np.array_split(filled, max(1, len(hashes) // 200_000)):
        if len(piece):
            low, high = bounds[piece[0]], bounds[piece[-1] + 1]
            bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, bounds[piece] - low, axis=0, dtype=np.int32)
            kept = (2 * ones > sizes[piece][:, None]).astype(np.uint8)
            out[piece] = np.packbits(kept, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


def fingerprints_of(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Signed 64-bit SimHash of each text: over the XXH64 (seed 42) of the shingles of its words, A-Z lowered, a bit
    is 1 if set in over half. Fewer words than a shingle: the whole sequence; none: 0."""
    return _majority(*_shingle_hashes(texts, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) for every row; a null text has no words and fingerprint 0."""
    small_handover(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("simhash")
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(batch.column(1).to_pylist(), shingle))], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


#: Values are signed; bits are counted as of 64-bit words.
_BITS = (1 << 64) - 1


class BKTree:
    """Signed 64-bit integers under Hamming distance."""

    __slots__ = ("values", "children")

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members at most `radius` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = ((self.values[at] ^ value) & _BITS).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        return found

    def add(self, value: int) -> int:
        new, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while at < new:
            d = ((self.values[at] ^ value) & _BITS).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                break
            at = child
        return new


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member of its component) of one shard's distinct values, for members that are linked."""
    tree, root = BKTree(), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        mine = tree.add(value)
        root.append(mine)
        for other in near:
            a, b = find(mine), find(other)
            if a != b:
                # The smaller value stays a root.
                if tree.values[a] < tree.values[b]:
                    root[b] = a
                else:
                    root[a] = b
    return [(tree.values[i], tree.values[r]) for i in range(len(root)) if (r := find(i)) != i]


def near_links(nodes: DataFrame, radius: int = 3, most: int = 2048) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` of nodes at most `radius` bits apart."""
    spark = nodes.sparkSession
    blocks = radius + 1
    rows, bits, parts = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest")), 64, []
    while True:
        options = _blocks(bits, blocks)
        rows = rows.select("fp", F.explode(F.array(*options)).alias("o")).select("o.key", "fp", "o.rest")
        bits -= bits // blocks
        counts = rows.groupBy("key").count()
        sized = rows.join(counts.filter("count > 1"), "key")
        if bits <= 16:
            parts.append(sized.select("key", "fp"))
            break
        sized = stored(sized)
        parts.append(sized.filter(F.col("count") <= most).select("key", "fp"))
        rows = sized.filter(F.col("count") > most).drop("count")
        if rows.isEmpty():
            break
    todo = parts[0]
    for p in parts[1:]:
        todo = todo.unionByName(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        links: list[tuple[int, int]] = []
        for batch in batches:
            for k, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    links += tree_links(held, radius) if len(held) > 1 else []
                    key, held = k, []
                held.append(fp)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])
                links = []
        links += tree_links(held, radius) if len(held) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    return todo.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _rooted(prints: DataFrame, radius: int, id_col: str) -> DataFrame:
    """(fp, root, least): the smallest fingerprint of each fingerprint's component, and its own smallest id."""
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = stars(near_links(nodes, radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """Fingerprint and component of every row.

    Returns id_col, fingerprint (16 lowercase hex digits), component_id: the smallest id reachable over links of at
    most `radius` differing bits, itself included. Null and empty texts have fingerprint 0, linked like any other.
    Repeated rows and ids are kept; a null id never is the smallest unless its component has no other. An empty table
    gives an empty table; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle))
    rooted = _rooted(prints, radius, id_col)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a text in one_of_each, each of its own hash.
SKETCH = 6


def sketches_of(words: list[list[bytes]]) -> np.ndarray:
    """SKETCH independent SimHash values, signed, of the distinct words of each text."""
    digest = xxhash.xxh64_intdigest
    distinct = [[digest(w, 42) for w in set(ws)] for ws in words]
    bounds = np.cumsum([0, *map(len, distinct)])
    hashes, out = np.array([h for hs in distinct for h in hs], np.uint64), []
    for i in range(SKETCH):
        h = hashes + np.uint64((0x9E3779B97F4A7C15 * i) & _BITS)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(h ^ (h >> np.uint64(31)), bounds))
    return np.stack(out, axis=1)


_FPS = [f"f{i}" for i in range(SKETCH)]


def shard_links(sketches: list[list[int]], by: int, radius: int, total: int) -> list[tuple[int, int, int]]:
    """(position, position, bits apart) of pairs that connect the sketches of one shard of fingerprint `by`: a BK-tree gives
    those within `radius` bits in it, and pairs of at most `total` bits over all fingerprints count, the nearest first."""
    tree, root, out = BKTree(), [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(sketches):
        near = []
        for j in tree.within(own[by], radius):
            apart = sum(((x ^ y) & _BITS).bit_count() for x, y in zip(own, sketches[j]))
            if apart <= total:
                near.append((apart, j))
        tree.add(own[by])
        root.append(i)
        for apart, j in sorted(near):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((i, j, apart))
    return out


def sketch_links(sketches: DataFrame, radius: int = 3, total: int = 44, most: int = 512) -> DataFrame:
    """Pairs (f0, ..., g0, ..., apart) of distinct sketches that connect all that are near: at most `radius` bits apart in one of
    the fingerprints and `total` bits in all. The shards are those of near_links, for each fingerprint."""
    spark = sketches.sparkSession
    blocks, bits, parts = radius + 1, 64, []
    rows = sketches.select(*_FPS, F.explode(F.array(*(F.struct(F.lit(i).alias("by"), F.lit(i).cast("long").alias("key"), F.col(f).alias("rest")) for i, f in enumerate(_FPS)))).alias("o")).select(*_FPS, "o.*")
    while True:
        options, bits = _blocks(bits, blocks), bits - bits // blocks
        rows = rows.select(*_FPS, "by", F.explode(F.array(*options)).alias("o")).select(*_FPS, "by", "o.key", "o.rest")
        if bits <= 16:
            parts.append(rows.drop("rest"))
            break
        crowded = stored(rows.groupBy("key").count().filter(F.col("count") > most).select("key"))
        n = crowded.count()
        if not n:
            parts.append(rows.drop("rest"))
            break
        parts.append(rows.join(hinted(crowded, n), "key", "left_anti").drop("rest"))
        rows = rows.join(hinted(crowded, n), "key", "left_semi")
    todo = parts[0]
    for p in parts[1:]:
        todo = todo.unionByName(p)
    schema = ", ".join(f"{c} long" for c in (*_FPS, *(f"g{i}" for i in range(SKETCH)), "apart"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in schema.split(", ")]
        keys, held = np.empty(0, np.int64), np.empty((0, 1 + SKETCH), np.int64)
        for batch in [*batches, None]:
            if batch is not None:
                columns = [batch.column(c).to_numpy().astype(np.int64) for c in ("key", "by", *_FPS)]
                keys, held = np.concatenate([keys, columns[0]]), np.concatenate([held, np.stack(columns[1:], axis=1)])
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
            if batch is None:
                cuts.append(len(keys))
            found = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    own, by = held[a:b, 1:].tolist(), int(held[a, 0])
                    found += [[*own[i], *own[j], n] for i, j, n in shard_links(own, by, radius, total)]
            keys, held = keys[cuts[-1] :], held[cuts[-1] :]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=names)

    return todo.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", *_FPS).mapInArrow(run, schema).distinct()


def _blocks(bits: int, blocks: int) -> list[Column]:
    """For each block of the `bits` of column rest: struct<key, rest>, of the block's value under column key and of the
    other bits."""
    sizes = [bits // blocks + (i < bits % blocks) for i in range(blocks)]
    offsets = [sum(sizes[:i]) for i in range(blocks)]
    rest, options = F.col("rest"), []
    for i, (size, off) in enumerate(zip(sizes, offsets)):
        value = F.shiftrightunsigned(rest, off).bitwiseAND(F.lit((1 << size) - 1))
        low = rest.bitwiseAND(F.lit((1 << off) - 1))
        high = F.shiftleft(F.shiftrightunsigned(rest, off + size), off) if off + size < 64 else F.lit(0).cast("long")
        options.append(F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), high.bitwiseOR(low).alias("rest")))
    return options


def _same_text(texts: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) between nodes that have at least `similarity` of their shingles (node, shingles) in common."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = links.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return both.filter((union == 0) | (F.col("common") >= F.lit(similarity) * union)).select("a", "b")


def _shingles(nodes: DataFrame, own: DataFrame, key: list[str], links: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the distinct shingles of the texts of linked nodes."""
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    wanted = stored(nodes.join(linked, "node", "left_semi").select("node", *(F.col(f"row.{c}").alias(c) for c in key)))
    texts = own.join(hinted(wanted, wanted.count()), key).select("node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("simhash")
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                hashes, bounds = _shingle_hashes(batch.column(1).to_pylist(), words)
                lists = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "shingles"])

    # Equal rows give a node more than once.
    return stored(texts.mapInArrow(run, "node binary, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")))


def _checked(nodes: DataFrame, links: DataFrame, texts: DataFrame, similarity: float, radius: int, total: int) -> DataFrame:
    """(node, root): components of all near pairs that hold. First each node's nearest of the links (a, b, apart) is looked at,
    then those that would still join two components. A link that fails may have stood for other pairs that hold, so at last
    every near pair of two components that can hold is looked at."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = stored(_same_text(texts, nearest, similarity))
    roots = stars(first)
    root = lambda c: roots.select(F.col("a").alias(c), F.col("b").alias(f"root_{c}"))
    placed = links.select("a", "b").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = placed.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    held = stored(first.unionByName(_same_text(texts, rest, similarity)))
    roots = stars(held)
    apart = stored(_apart(nodes, links, texts, roots, similarity, radius, total).join(both.select("a", "b"), ["a", "b"], "left_anti"))
    more = stored(_same_text(texts, apart, similarity))
    if not more.isEmpty():
        roots = stars(held.unionByName(more))
    return roots.select(F.col("a").alias("node"), F.col("b").alias("root"))


#: Words of a parity of 64 bits each: a bit is 1 if it stands for an odd number of a set's shingles.
_ODD = [f"odd{i}" for i in range(8)]


def _apart(nodes: DataFrame, links: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, radius: int, total: int) -> DataFrame:
    """(a, b): the near pairs of nodes in different components (roots: a, its root b) that can have `similarity` of their
    shingles in common.

    Near pairs are connected by links, so only a group of linked nodes with several components has any. Its shingles are
    ordered: first those of one component alone, then the rarest. Two sets that hold share one that is early in both, and
    from the first that they share on each has enough others left. Those of one component never pair anything, and those
    that most of a group has come last: its members don't meet in pairs for them. What differs surely, shingles of one
    component and odd bits of a parity of the others, must leave enough, too."""
    placed = texts.select("node").join(stars(links).select(F.col("a").alias("node"), F.col("b").alias("group")), "node", "left")
    placed = placed.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    placed = stored(placed.select("node", F.coalesce("group", "node").alias("group"), F.coalesce("root", "node").alias("root")))
    several = stored(placed.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("group"))
    # Numbers in place of digests; a group's hash is but a key, as no near pair is of two groups.
    open_ = stored(placed.join(hinted(several, several.count()), "group").withColumn("at", F.monotonically_increasing_id()))
    n = open_.count()
    labels = open_.groupBy("root").agg(F.min("at").alias("label"))
    open_ = hinted(stored(open_.join(hinted(labels, n), "root").select("node", "at", "label", F.xxhash64("group").alias("group"))), n)
    each = texts.join(open_, "node").select("group", "label", "at", F.size("shingles").alias("n"), F.explode("shingles").alias("one"))
    across = each.groupBy("group", "one").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("group", "one", "times")
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(one, 32) & 63 as int))")
    parity = [F.bit_xor(F.when(F.pmod("one", F.lit(len(_ODD))) == i, bit).otherwise(0)).alias(o) for i, o in enumerate(_ODD)]
    shared = each.join(across, ["group", "one"]).groupBy("group", "label", "at", "n").agg(F.sort_array(F.collect_list(F.struct("times", "one"))).alias("shared"), *parity)
    # A little less, so that rounding loses no pair.
    spare = F.size("shared") - F.ceil(F.lit(similarity) * F.col("n") - 1e-6).cast("int")
    early = shared.filter(spare >= 0).select("group", "label", "at", "n", F.size("shared").alias("size"), *_ODD, F.posexplode(F.slice("shared", F.lit(1), spare + 1)).alias("nth", "one"))
    prints = open_.select("node", "at").join(nodes.select("node", *_FPS), "node")
    parts = stored(early.join(prints, "at").select("group", "label", "at", "node", "n", F.col("one.one").alias("one"), (F.col("size") - F.col("nth")).alias("left"), (F.col("n") - F.col("size")).alias("own"), *_FPS, *_ODD))
    a, b = (parts.select("group", "one", *(F.col(c).alias(f"{c}_{x}") for c in ("label", "at", "node", "n", "left", "own", *_FPS, *_ODD))) for x in "ab")
    bits, odd = ([F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in names] for names in (_FPS, _ODD))
    both = F.col("n_a") + F.col("n_b")
    enough = F.lit(similarity / (1 + similarity)) * both - 1e-6
    can = [
        F.struct("n_a", "at_a") < F.struct("n_b", "at_b"), F.col("label_a") != F.col("label_b"), F.col("n_a") >= F.lit(similarity) * F.col("n_b") - 1e-6,
        F.least("left_a", "left_b") >= enough, sum(odd, F.col("own_a") + F.col("own_b")) <= both - 2 * enough, F.least(*bits) <= radius, sum(bits[1:], bits[0]) <= total,
    ]
    met = a.join(b, ["group", "one"])
    for c in can:
        met = met.filter(c)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 3, total: int = 44) -> DataFrame:
    """One row of docs (all its columns) of each group of near copies: that of the smallest id, null ids last; of rows of
    one group that share that id the one of the smallest text, null first. Rows of different groups never stand for each
    other, whatever their ids.

    Texts of the same words (A-Z lowered) are copies. Others are linked if they have at least `similarity` of their
    shingles of `words` words in common, which is counted exactly for the pairs that the fingerprints propose: SKETCH
    SimHash values of the distinct words, of which one differs in at most `radius` bits and all in at most `total` (of texts
    with 0.8 of their five-word shingles in common, nearly all do). Null, empty and blank texts have the same words, none.
    """
    small_handover(docs.sparkSession)
    text = F.col(text_col).cast("string")
    # Two hashes of the text tell the rows of one id apart; a null id is an id of its own.
    row = {"__none": F.col(id_col).isNull(), "__id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__h1": F.coalesce(F.xxhash64(text), F.lit(0)), "__h2": F.xxhash64(F.lit(1), text)}
    own = docs.withColumns(row)
    rows = list(row)
    kept = [F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *(row[c].alias(c) for c in rows)]
    keyed = docs.select(F.struct(*kept).alias("__row"), text.alias("__text"))
    schema = T.StructType([keyed.schema["__row"], *(T.StructField(f, T.LongType()) for f in _FPS), T.StructField("node", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("simhash")
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                words_ = [t.as_buffer().to_pybytes().lower().split() if t.is_valid else [] for t in batch.column(1)]
                prints = sketches_of(words_)
                same = [xxhash.xxh3_128_digest(b" ".join(ws)) for ws in words_]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, i]) for i in range(SKETCH)), pa.array(same, pa.binary())], names=schema.names)

    prints = stored(keyed.mapInArrow(run, schema))
    by = F.struct("__row.none", "__row.id")
    nodes = stored(prints.groupBy("node").agg(*(F.first(f).alias(f) for f in _FPS), F.min(by).alias("least"), F.min(F.struct(*(f"__row.{c}" for c in rows))).alias("row")))
    # Nodes of one sketch are linked to the smallest of them, which stands for them in the trees.
    sketches = nodes.groupBy(*_FPS).agg(F.min("node").alias("head"), F.count("*").alias("n"))
    heads = sketches.filter("n > 1").select(*_FPS, "head")
    members = nodes.join(heads, _FPS).filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"), F.lit(0).cast("long").alias("apart"))
    side = lambda c, names: sketches.select(*(F.col(f).alias(n) for f, n in zip(_FPS, names)), F.col("head").alias(c))
    others = [f"g{i}" for i in range(SKETCH)]
    near = sketch_links(sketches.select(*_FPS), radius, total).join(side("a", _FPS), _FPS).join(side("b", others), others).select("a", "b", "apart")
    links = stored(members.union(near))
    texts = _shingles(nodes, own.select(*rows, text.alias("__text")), rows, links, words)
    roots = _checked(nodes, links, texts, similarity, radius, total)
    rooted = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The distinct texts of each group's smallest id, mostly one.
    least = rooted.groupBy("root").agg(F.min("least").alias("__by"))
    named = prints.select("node", by.alias("__by"), *(F.col(f"__row.{c}").alias(c) for c in rows)).distinct()
    first = stored(named.join(rooted.join(least, "root").filter(F.col("least") == F.col("__by")).select("node", "root", "__by"), ["node", "__by"]).select("root", *rows))
    several = first.join(first.groupBy("root").count().filter("count > 1"), "root").drop("count")
    smallest = F.row_number().over(W.partitionBy("root").orderBy(text_col))
    tied = own.select(*rows, text.alias(text_col)).join(several, rows).withColumn("__nth", smallest).filter("__nth = 1").select(*rows)
    single = first.join(first.groupBy("root").count().filter("count = 1"), "root").select(*rows)
    survivors = single.unionByName(tied)
    # Rows that go, and rows that equal others, of which one stays, are few beside the rest, which is not shuffled for them.
    by_row = stored(prints.groupBy(*(F.col(f"__row.{c}").alias(c) for c in rows)).agg(F.count("*").alias("n")).join(survivors.withColumn("stays", F.lit(True)), rows, "left").filter("n > 1 or stays is null"))
    n = by_row.count()
    alone = own.join(hinted(by_row.select(*rows), n), rows, "left_anti")
    again = own.join(hinted(by_row.filter("stays").select(*rows), n), rows, "left_semi")
    once = again.withColumn("__nth", F.row_number().over(W.partitionBy(*rows).orderBy(*rows))).filter("__nth = 1")
    return alone.select(*docs.columns).unionByName(once.select(*docs.columns))
