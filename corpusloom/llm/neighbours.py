"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph, which recursive spectral bisection with swap refinement cuts
into partitions of equal size with few edges between them. A softmax classifier learns the partition of a vector. The
partitions grow in number with the square root of the rows; beyond `most_parts` each is cut again in the same way, from
a sample of its own, and a vector's leaf is the most probable part of its most probable partition. Every row is indexed
under its leaf; a query goes to as many of its most probable leaves as reach the wanted recall on sample vectors held
out of the fit, and to more where these hold fewer than k candidates; all their rows are ranked by exact distance. Rows
and queries of a leaf are dealt into blocks of bounded size, so a hot leaf is many tasks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import hinted, stored


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row (approximate ties), as positions."""
    norms = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 512):
        d = norms[None, :] - 2 * (x[s : s + 512] @ x.T)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out[s : s + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, members: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of equal size with few graph edges between: the second eigenvector cut at its median, then swaps."""
    place = np.full(graph.shape[0], -1)
    place[members] = np.arange(len(members))
    to = place[graph[members]]
    src = np.repeat(np.arange(len(members)), graph.shape[1])
    dst = to.ravel()
    ok = dst >= 0
    src, dst = np.concatenate([src[ok], dst[ok]]), np.concatenate([dst[ok], src[ok]])
    n = len(members)
    degree = np.bincount(src, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(rounds):
        v = 0.5 * v + 0.5 * (np.bincount(dst, v[src] / degree[src], minlength=n) + v / degree)
        v -= degree * (v.sum() / degree.sum())
        v /= np.linalg.norm(v) or 1.0
    side = np.zeros(n, bool)
    side[np.argsort(v / degree, kind="stable")[n // 2 :]] = True
    for _ in range(8):
        across = np.bincount(src, side[src] != side[dst], minlength=n)
        gain = 2 * across - np.bincount(src, minlength=n)
        a = np.flatnonzero(~side)
        b = np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = int(np.argmin(np.append(gain[a[:m]] + gain[b[:m]] > 2, False)))
        swap = max(0, swap // 2)
        if not swap:
            break
        side[a[:swap]], side[b[:swap]] = True, False
    return members[~side], members[side]


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """A partition (0 to parts-1, a power of two) of each node; sizes differ by one at most a level."""
    rng = np.random.default_rng(seed)
    groups = [np.arange(graph.shape[0])]
    while len(groups) < parts:
        groups = [half for g in groups for half in bisect(graph, g, rng)]
    out = np.zeros(graph.shape[0], np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


class Router:
    """Softmax regression of the partition on the standardised vector."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int, steps: int = 200):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros((z.shape[1], parts))
        first, second = np.zeros_like(self.w), np.zeros_like(self.w)
        for i in range(1, steps + 1):  # Adam over the whole sample
            p = np.exp(self._logits(z))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = z.T @ p / len(z) + 1e-4 * self.w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            self.w -= 0.1 * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.99**i)) + 1e-9)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        logits = z @ self.w
        return logits - logits.max(1, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of the partitions."""
        logits = self._logits(np.c_[(x - self.mean) / self.scale, np.ones(len(x))])
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


class Tree:
    """Partitions, each with parts of its own or whole. Leaf l of partition p is number p * width + l."""

    def __init__(self, top: Router, below: dict[int, Router] | None = None, width: int = 1):
        self.top, self.below, self.width = top, below or {}, width
        self.leaves = top.w.shape[1] * width

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of all leaves."""
        first = self.top.scores(x)
        if self.width == 1:
            return first
        out = np.full((len(x), first.shape[1], self.width), -np.inf)
        for p in range(first.shape[1]):
            out[:, p, : self.below[p].w.shape[1] if p in self.below else 1] = first[:, [p]] + (self.below[p].scores(x) if p in self.below else 0)
        return out.reshape(len(x), -1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the most probable part of its most probable partition."""
        first = self.top.scores(x).argmax(1)
        out = first * self.width
        for p in np.unique(first) if self.width > 1 else ():
            if p in self.below:
                at = np.flatnonzero(first == p)
                out[at] += self.below[p].scores(x[at]).argmax(1)
        return out


def cut(x: np.ndarray, parts: int, k: int) -> Router | None:
    """The router of a sample cut into `parts` balanced partitions (or as many, a power of two, as it has 2k rows for)."""
    while parts > 1 and len(x) < 2 * k * parts:
        parts //= 2
    if parts < 2:
        return None
    return Router(x, balanced_parts(neighbour_graph(x.astype(np.float32), min(k, len(x) - 1)), parts), parts)


def wanted_parts(rows: int) -> int:
    """A quarter of the square root of the rows, as a power of two, 2 at least."""
    return max(2, 1 << round(np.log2(max(1.0, np.sqrt(rows) / 4))))


def visits_for(tree: Tree, asked: np.ndarray, known: np.ndarray, k: int, wanted: float) -> int:
    """The fewest leaves in which the wanted share of the k nearest known vectors of those asked lies."""
    home, k = tree.home(known), min(k, len(known))
    norms, depth = (known * known).sum(1), []
    for s in range(0, len(asked), 64):
        q = asked[s : s + 64]
        near = np.argpartition(norms[None, :] - 2 * (q @ known.T), k - 1, axis=1)[:, :k]
        # Leaves that are more probable than the neighbour's.
        scores = tree.scores(q)
        depth.append((scores[:, None, :] > np.take_along_axis(scores, home[near], axis=1)[:, :, None]).sum(2))
    places = np.bincount(np.concatenate(depth).ravel(), minlength=tree.leaves)
    return int(np.searchsorted(np.cumsum(places), wanted * places.sum())) + 1


def exact_nearest(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple]:
    """(query, candidate, distance): the k nearest candidates of each query but its own, ties to the smaller id."""
    out, norms = [], (c * c).sum(1)
    for s in range(0, len(q), 128):
        part = q[s : s + 128]
        rough = norms[None, :] + (part * part).sum(1)[:, None] - 2 * (part @ c.T)
        for i, row in enumerate(rough):
            row[c_ids == q_ids[s + i]] = np.inf
            if k < len(row):
                limit = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= limit + 1e-9 * (norms.max() + (part[i] ** 2).sum()))
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            d = np.sqrt(((c[near] - part[i]) ** 2).sum(1))
            for j in np.lexsort((c_ids[near], d))[:k]:
                out.append((q_ids[s + i], c_ids[near[j]], d[j]))
    return out


def nearest_neighbours(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", most_sampled: int = 16_384, most_parts: int = 256, wanted: float = 0.95, block: int = 8192, parts: int | None = None,
) -> DataFrame:
    """The k nearest rows, by Euclidean distance in double precision, of each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id, score (the exact distance). Candidates are all rows but those of the
    query's own id; ties go to the smaller id; a query has k rows, or as many as there are candidates. Rows with a null
    id, and vectors that are null, empty, zero, hold null or non-finite components or have another length than most rows
    (ties: the smaller), take no part. The partitions (`parts`, or as many as the rows ask for) are learnt from
    `most_sampled` distinct vectors of smallest hash, and those below `most_parts` from as many of their own; every row
    is indexed. Repeated rows are candidates each; of queries with equal ids the smaller vector counts. An empty table
    gives an empty table. The driver holds the routers and the size of each leaf.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    lengths = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid, rows = valid.filter(F.size("v") == lengths["n"]), lengths["count"]
    parts = parts or wanted_parts(rows)
    lot = lambda salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    # Equal vectors meet before they are ordered, so a popular one is one of the sample.
    sample = valid.filter(lot(1) * rows <= 16 * most_sampled).select("v").distinct().orderBy(lot(2), "v").limit(most_sampled).toPandas()
    x = np.stack(sample["v"].to_numpy())
    apart = np.arange(len(x)) % 8 == 7 if len(x) >= 32 else np.zeros(len(x), bool)  # held out of the fit
    fitted = x if not apart.any() else x[~apart]
    top, width = cut(fitted, min(parts, most_parts), k), max(1, parts // most_parts)
    tree = Tree(top) if top else Tree(Router(fitted, np.zeros(len(fitted), int), 1, steps=0))
    if width > 1:
        tree = Tree(tree.top, _cut_again(_placed(valid, tree), width, k, most_sampled, lot), width)
    placed = stored(_placed(valid, tree))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a leaf
    held = np.array([counts.get(p, 0) for p in range(tree.leaves)])
    visits = visits_for(tree, x[apart][:1000], fitted, k, wanted) if apart.any() else tree.leaves

    def route(frames):
        for f in frames:
            for s in range(0, len(f), 1024):
                own = f.iloc[s : s + 1024]
                ranked = np.argsort(-tree.scores(np.stack(own["v"].to_numpy())), axis=1, kind="stable")
                enough = (np.cumsum(held[ranked], axis=1) - own["times"].to_numpy()[:, None] < k).sum(1) + 1
                yield own[["id", "v"]].assign(part=[r[: max(visits, n)].astype(np.int32) for r, n in zip(ranked, enough)])

    asked = placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("times"))
    queries = stored(asked.mapInPandas(route, "id long, v array<double>, part array<int>").select("id", "v", F.explode("part").alias("part")))
    # Blocks of each leaf that is visited.
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    crowds = hinted(stored(blocks(placed, "rbs").join(blocks(queries, "qbs"), "part").withColumnRenamed("part", "__part")), tree.leaves)
    block_of = lambda columns, n: F.pmod(F.xxhash64(*columns), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = F.col("part") == F.col("__part")
    rows_ = placed.join(crowds, here).select("id", "v", "part", block_of(("id", "v"), F.col("rbs")).alias("rb"), spread("qbs").alias("qb"))
    queries_ = queries.join(crowds, here).select("id", "v", "part", spread("rbs").alias("rb"), block_of(("id",), F.col("qbs")).alias("qb"))

    def rank(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(c) and len(q):
            found = exact_nearest(np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy()), q["id"].to_numpy(), c["id"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    near = rows_.groupBy("part", "rb", "qb").cogroup(queries_.groupBy("part", "rb", "qb")).applyInPandas(rank, "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", order).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(valid: DataFrame, tree: Tree) -> DataFrame:
    """(id, v, part): every row under its leaf."""

    def place(frames):
        for f in frames:
            if len(f):
                yield f.assign(part=tree.home(np.stack(f["v"].to_numpy())).astype(np.int32))

    return valid.mapInPandas(place, "id long, v array<double>, part int")


def _cut_again(placed: DataFrame, width: int, k: int, most_sampled: int, lot) -> dict[int, Router]:
    """A router for each partition, from about `most_sampled` of its distinct vectors; each is fitted in a task."""
    placed = stored(placed)
    held = placed.groupBy("part").count().withColumnsRenamed({"part": "__part"})  # a row a partition
    chosen = placed.join(F.broadcast(held), F.col("part") == F.col("__part")).filter(lot(3) * F.col("count") <= most_sampled).select("part", "v").distinct()

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        router = cut(np.stack(f["v"].to_numpy()), width, k)
        return pd.DataFrame({"part": [int(f["part"].iloc[0])], "router": [pickle.dumps(router)]})

    return {r["part"]: router for r in chosen.groupBy("part").applyInPandas(fit, "part int, router binary").collect() if (router := pickle.loads(r["router"]))}
