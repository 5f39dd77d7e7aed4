"""A sentence encoder without a pretrained model: latent semantic vectors by a distributed randomized SVD.

Texts are rows of TF-IDF weights over hashed words, of unit length, stored once. A random block of directions is multiplied by
A'A in one pass over the rows; the block is made orthogonal to all before it and multiplied again. The blocks span a Krylov
space; the driver solves the small problem within it, whose figures are features x directions, bounded by parameters and not
by the corpus. A text is encoded as the sum of its words' right singular vectors, each weighed by its smoothed inverse
frequency a / (a + p), at unit length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .store import discard, stored

#: Weights that are multiplied by directions at once.
_CHUNK = 50_000
#: Features whose sums travel in one row.
_SLAB = 4096


def features(text: Column, n: int) -> Column:
    """Places of the words of a text among n hashed features, repeats included; none for null."""
    found = F.transform(F.filter(tokens(F.lower(text)), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))
    return F.coalesce(found, F.array().cast("array<int>"))


def frequencies(rows: DataFrame, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(texts, texts with each feature, occurrences of each feature) of a table with `at` array<int>: n figures each."""
    count = lambda at: rows.select(F.explode(at).alias("i")).groupBy("i").agg(F.count("*").alias("n")).toArrow()  # noqa: E731  n rows at most
    for out, found in ((texts := np.zeros(n, np.int64), count(F.array_distinct("at"))), (times := np.zeros(n, np.int64), count(F.col("at")))):
        out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return rows.count(), texts, times


def _matrix(lists: pa.Array, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of rows of unit length, in the order of rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    code, times = np.unique(row * n + flat, return_counts=True)
    row, at = code // n, code % n
    weight = times * idf[at]
    length = np.sqrt(np.bincount(row, weight**2, len(lists)))
    return row, at, weight / np.where(length > 0, length, 1)[row]


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sums of the rows of each)."""
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
    return at[order][starts], np.add.reduceat(rows[order], starts, axis=0)


def gram_product(rows: DataFrame, idf: np.ndarray, directions: np.ndarray, most_tasks: int = 4096) -> np.ndarray:
    """A'A times directions (features x some), in one pass over the rows; sums meet in two rounds, by slabs of features."""
    spark, (n, width) = rows.sparkSession, directions.shape
    given = spark.sparkContext.broadcast((idf, directions))
    schema = "slab int, salt int, sums binary"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, q), out, any_ = given.value, None, False
        for batch in batches:
            if out is None:
                out = np.zeros((n, width))
            row, at, w = _matrix(batch.column(0), n, weights)
            # Chunks end where rows do, so that a row's product is whole; a row of more words is a chunk of its own.
            ends = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1 if len(row) else np.empty(0, np.int64)
            lo = 0
            while lo < len(row):
                hi = int(ends[max(np.searchsorted(ends, lo + _CHUNK, "right") - 1, np.searchsorted(ends, lo, "right"))])
                r, a, x = row[lo:hi], at[lo:hi], w[lo:hi, None]
                _, y = _summed(r, x * q[a])
                back = np.searchsorted(np.unique(r), r)
                places, sums = _summed(a, x * y[back])
                out[places] += sums
                lo, any_ = hi, True
        if any_:
            salt = TaskContext.get().partitionId() % 64
            slabs = range(-(-n // _SLAB))
            yield pa.RecordBatch.from_arrays([pa.array(list(slabs), pa.int32()), pa.array([salt] * len(slabs), pa.int32()), pa.array([out[s * _SLAB : (s + 1) * _SLAB].tobytes() for s in slabs])], names=["slab", "salt", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.table([table.column("slab").slice(0, 1), table.column("salt").slice(0, 1), pa.array([total.tobytes()])], names=["slab", "salt", "sums"])

    parts = rows.coalesce(most_tasks).select("at").mapInArrow(multiply, schema)
    summed = parts.groupBy("slab", "salt").applyInArrow(add, schema).groupBy("slab").applyInArrow(add, schema)
    out = np.zeros((n, width))
    for r in summed.collect():  # n / 4096 rows
        out[r["slab"] * _SLAB : (r["slab"] + 1) * _SLAB] = np.frombuffer(r["sums"]).reshape(-1, width)
    given.destroy()
    return out


def singular_vectors(rows: DataFrame, idf: np.ndarray, k: int, block: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest singular values, falling, their right singular vectors) of the weights, by block Krylov steps."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), block)) * (idf > 0)[:, None])
    basis, images = [], []
    for step in range(steps):
        image = gram_product(rows, idf, q)
        basis.append(q)
        images.append(image)
        if step + 1 < steps:
            known = np.concatenate(basis, axis=1)
            for _ in range(2):  # twice is enough
                image = image - known @ (known.T @ image)
            q, spread = np.linalg.qr(image)
            if np.abs(np.diag(spread)).max() < 1e-12:
                break  # the rows span no more
    v, w = np.concatenate(basis, axis=1), np.concatenate(images, axis=1)
    small = v.T @ w
    values, turned = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[best], 0)), v @ turned[:, best]


class LatentEncoder:
    """Singular values, word vectors by feature, and the weight of each feature when texts are encoded."""

    def __init__(self, values: np.ndarray, vectors: np.ndarray, weights: np.ndarray):
        self.values, self.vectors, self.weights = values, vectors, weights

    def encode(self, lists: list[np.ndarray]) -> np.ndarray:
        """Vectors of texts given as features; zeros for a text without a known word."""
        sizes = np.array([len(x) for x in lists], np.int64)
        out = np.zeros((len(lists), self.vectors.shape[1]))
        has = np.flatnonzero(sizes)
        for lo in range(0, len(has), 256):
            some = has[lo : lo + 256]
            at = np.concatenate([lists[i] for i in some])
            out[some] = np.add.reduceat(self.vectors[at] * self.weights[at, None], np.cumsum(sizes[some]) - sizes[some], axis=0)
        length = np.linalg.norm(out, axis=1)
        return out / np.where(length > 1e-12, length, 1)[:, None]

    def column(self, spark) -> Callable[[Column], Column]:
        """The encoder as a column function; the model, whose size the parameters bound, is broadcast once."""
        given, n = spark.sparkContext.broadcast((self.values, self.vectors.astype(np.float32), self.weights)), len(self.weights)

        @F.pandas_udf("array<float>")
        def run(at: pd.Series) -> pd.Series:
            return pd.Series(list(LatentEncoder(*given.value).encode(at.tolist()).astype(np.float32)))

        return lambda text: run(features(text, n))


def fit(texts: DataFrame, column: str, k: int = 64, n: int = 1 << 16, block: int = 32, steps: int = 5, a: float = 1e-3, without: tuple[str, ...] = ("query:", "passage:"), seed: int = 7) -> LatentEncoder:
    """Fits an encoder on all texts of a column: k latent dimensions of n hashed words, at most block x steps.

    Null texts and texts without words are rows without weights. An empty corpus gives an encoder of zeros. Words in
    `without` (the roles that embed_pairs puts before texts) weigh nothing. One pass over the stored rows a step, and one for the
    frequencies; the driver holds 2 x n x block x steps numbers.
    """
    spark = texts.sparkSession
    rows = stored(texts.select(features(F.col(column), n).alias("at")))
    count, with_it, times = frequencies(rows, n)
    idf = np.where(with_it > 0, np.log((1 + count) / (1 + with_it)) + 1, 0.0)
    total = max(1, int(times.sum()))
    weights = np.where(times > 0, a / (a + times / total), 0.0)
    off = spark.range(1).select(features(F.lit(" ".join(without)), n).alias("at")).first()["at"]
    weights[off] = 0
    if not times.any():
        return LatentEncoder(np.zeros(k), np.zeros((n, k)), weights)
    values, vectors = singular_vectors(rows, idf, k, block, steps, seed)
    discard(rows)
    return LatentEncoder(values, vectors, weights)
