"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled rows gives the examples; the space is spanned by all their words. A word weighs
its inverse document frequency (counted over all documents) times its relevance: a floor that every word has, and up to
1 more by how far its counts in toxic and clean examples are from chance (signed root of the log-likelihood ratio). No
word is left out. Neighbours are found in an inverted index over blocks of examples: the short lists of rare words are
added up for all examples, the long lists of common words carry the maximum of each block, and only blocks whose bound
reaches the k-th cosine found so far are scored, so the nearest are exact. Distance-weighted votes, calibrated on
leave-one-out votes of the examples by isotonic regression, give the score; the nearest examples are its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small_batches, small_handover, stored, trim, worker_keeps

#: (terms, weights or counts) of one text.
Sparse = tuple[np.ndarray, np.ndarray]


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of each text, runs of letters in lower case; '' may be among them and is none. A null text has none."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), pattern=r"[^\pL]+")


def counted(texts: pa.Array, space: pa.Array) -> list[Sparse]:
    """Terms (places in `space`), rising, and counts of each text's words."""
    lists = word_lists(texts)
    at = pc.index_in(lists.flatten(), value_set=space).fill_null(-1).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    width = max(1, len(space))
    codes, counts = np.unique((doc * width + at)[at >= 0], return_counts=True)
    cuts = np.searchsorted(codes, np.arange(1, len(lists)) * width)
    return list(zip(np.split(codes % width, cuts), np.split(counts, cuts)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class BlockMaxIndex:
    """Unit vectors under cosine, with exact top-k. Terms are 0 to n_terms - 1; `common` is the number of the longest
    lists that are kept by block, with the maximum of each block."""

    def __init__(self, vectors: list[Sparse], n_terms: int, block: int = 64, common: int = 192):
        self.n, self.block = len(vectors), block
        self.blocks = max(1, -(-self.n // block))
        terms = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        weights = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        at = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        lengths = np.bincount(terms, minlength=n_terms)
        chosen = np.argsort(-lengths, kind="stable")[:common]
        chosen = chosen[lengths[chosen] > 1]
        #: Place of a term among the common ones, -1 for the others.
        self.place = np.full(n_terms, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        long = self.place[terms] >= 0
        self.rows = np.zeros((self.blocks * block, len(chosen)))
        self.rows[at[long], self.place[terms[long]]] = weights[long]
        self.most = self.rows.reshape(self.blocks, block, -1).max(1)
        order = np.argsort(terms[~long], kind="stable")
        self.at, self.weights = at[~long][order].astype(np.int32), weights[~long][order]
        self.sizes = np.where(self.place < 0, lengths, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.scored = self.skipped = 0

    def nearest(self, queries: list[Sparse], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (examples, cosines): the k highest above 0, highest first, ties to the smaller example."""
        out = []
        for s in range(0, len(queries), 64):
            out += self._nearest(queries[s : s + 64], k)
        return out

    def _nearest(self, queries: list[Sparse], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        width, block = self.blocks * self.block, self.block
        sums = np.zeros((len(queries), width))
        long = np.zeros((len(queries), self.rows.shape[1]))
        for i, (terms, weights) in enumerate(queries):
            place = self.place[terms]
            known = place >= 0
            long[i, place[known]] = weights[known]
            sizes = self.sizes[terms]
            at = _ranges(self.starts[terms], sizes)
            if len(at):
                sums[i] = np.bincount(self.at[at], self.weights[at] * np.repeat(weights, sizes), width)
        bound = sums.reshape(len(queries), self.blocks, block).max(2) + long @ self.most.T + 1e-9
        found = np.full(sums.shape, -1.0)
        done = np.zeros(bound.shape, bool)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                q, own = np.flatnonzero(wanted[:, b]), slice(b * block, (b + 1) * block)
                found[q, own] = sums[q, own] + long[q] @ self.rows[own].T
            done[wanted] = True

        # The blocks of highest bound give the cosine to beat; the others are scored only if their bound reaches it.
        ahead = min(self.blocks, -(-k // block) + 1)
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, ahead - 1, axis=1)[:, :ahead], True, axis=1)
        score(first)
        k_th = -np.partition(-found, k - 1, axis=1)[:, k - 1] if k <= width else np.full(len(queries), -1.0)
        score((bound >= np.maximum(k_th, 0)[:, None]) & ~done)
        self.scored, self.skipped = self.scored + int(done.sum()), self.skipped + int((~done).sum())
        # Rounded, so that the order of equal cosines does not hang on the last bit.
        found = np.round(found, 10)
        best = np.sort(np.argpartition(-found, k - 1, axis=1)[:, :k], axis=1) if k < width else np.arange(width)[None, :].repeat(len(queries), 0)
        out = []
        for row, near in zip(found, best):
            if k < width:  # all that tie with the last
                last = row[near].min()
                near = np.flatnonzero(row >= last) if last > 0 else np.flatnonzero(row > 0)
            near = near[row[near] > 0]
            near = near[np.lexsort((near, -row[near]))][:k]
            out.append((near, row[near]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: both ends of each pool and its value, rising; in between it is read off linearly."""
    order = np.argsort(x, kind="stable")
    out: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        if out and out[-1][1] == a:
            out[-1][2] += b * c
            out[-1][3] += c
        else:
            out.append([a, a, b * c, c])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            _, end, total, times = out.pop()
            out[-1][1:] = [end, out[-1][2] + total, out[-1][3] + times]
    return np.array([e for o in out for e in o[:2]]), np.array([o[2] / o[3] for o in out for _ in (0, 1)])


def relevance(toxic: np.ndarray, rows: np.ndarray, n_toxic: float, n_rows: float, floor: float = 0.05, chance: float = 3.5, whole: float = 2.0) -> np.ndarray:
    """floor to floor + 1 for each word, from the examples that hold it (toxic of rows, out of n_toxic of n_rows): the
    root of its log-likelihood ratio against independence counts from `chance` on and is whole `whole` above."""
    rate = n_toxic / n_rows if n_rows else 0.0
    g = np.zeros(len(rows))
    for seen, expected in (
        (toxic, rows * rate), (rows - toxic, rows * (1 - rate)), (n_toxic - toxic, (n_rows - rows) * rate), (n_rows - n_toxic - rows + toxic, (n_rows - rows) * (1 - rate)),
    ):
        ok = (seen > 0) & (expected > 0)
        g[ok] += 2 * seen[ok] * np.log(seen[ok] / expected[ok])
    return floor + np.clip((np.sqrt(np.maximum(g, 0)) - chance) / whole, 0, 1)


class NeighbourVotes:
    """Scores sparse counts by their nearest labelled examples."""

    def __init__(self, weight: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int, int, object]], k: int = 25, sharpness: float = 8.0, clean_scale: float = 1.0):
        """weight: of each term. examples: (terms, counts, rows, toxic rows, an id for evidence) of distinct vectors;
        the empty vector may be among them and gives the rate of texts without neighbours. Clean rows count
        `clean_scale` times (examples may hold a larger share of the toxic rows than of the clean)."""
        self.weight, self.k, self.sharpness = weight, k, sharpness
        bad = lambda es: float(sum(e[3] for e in es))
        good = lambda es: clean_scale * sum(e[2] - e[3] for e in es)
        self.prior = (bad(examples) + 0.5) / (bad(examples) + good(examples) + 1.0) if examples else 0.0
        empty = [e for e in examples if not len(e[0])]
        self.bare = (bad(empty) + self.prior) / (bad(empty) + good(empty) + 1.0)
        filled = [e for e in examples if len(e[0])]
        vectors = [self.unit(e[0], e[1]) for e in filled]
        # Alike examples share blocks: by heaviest term.
        order = sorted(range(len(filled)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), len(filled[i][0]), str(filled[i][4])))
        vectors = [vectors[i] for i in order]
        self.names = [filled[i][4] for i in order]
        rows, toxic = (np.array([filled[i][c] for i in order], float) for c in (2, 3))
        self.toxic, self.clean = toxic, rows - toxic
        self.clean_scale = clean_scale
        self.index = BlockMaxIndex(vectors, len(weight))
        self.steps = None
        xs, ys, ws = [], [], []
        for i, (near, cosines) in enumerate(self.index.nearest(vectors, k + 1)):
            for label, times in ((1, toxic[i]), (0, clean_scale * (rows[i] - toxic[i]))):
                if times:
                    xs.append(self._vote(near, cosines, (i, label)))
                    ys.append(label)
                    ws.append(times)
        if xs:
            self.steps = isotonic(np.array(xs), np.array(ys, float), np.array(ws, float))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> Sparse:
        raw = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt((raw * raw).sum())
        return terms, raw / norm if norm else raw

    def _vote(self, near: np.ndarray, cosines: np.ndarray, own: tuple[int, int] | None = None) -> float:
        toxic, clean = self.toxic[near], self.clean[near]
        if own:  # leave one row out
            toxic, clean = toxic - (near == own[0]) * own[1], clean - (near == own[0]) * (1 - own[1])
        rows = toxic + clean
        # Many equal rows count as their logarithm, so that one text's copies don't outvote all others.
        weight = np.exp(self.sharpness * (cosines - 1)) * np.where(rows > 0, np.log1p(rows) / np.maximum(rows, 1), 0.0)
        up, down = (weight * toxic).sum(), (weight * clean).sum() * self.clean_scale
        return float((up + 0.05 * self.prior) / (up + down + 0.05))

    def score(self, texts: list[Sparse]) -> list[tuple[float, list[tuple[object, float]]]]:
        """The calibrated score and the nearest examples (id, cosine) of each text's terms and counts."""
        out: list = [(self.bare, [])] * len(texts)
        filled = [i for i, (t, _) in enumerate(texts) if len(t)] if self.names else []
        for i, (near, cosines) in zip(filled, self.index.nearest([self.unit(*texts[i]) for i in filled], self.k)):
            if len(near):
                vote = self._vote(near, cosines)
                step = float(np.interp(vote, *self.steps))
                # The vote itself, a little, keeps documents of one step in order.
                out[i] = (min(1.0, max(0.0, 0.98 * step + 0.02 * vote)), [(self.names[j], float(c)) for j, c in zip(near[:3], cosines[:3])])
        return out


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = 40_000, most_examples: int = 8192, k: int = 25) -> tuple[NeighbourVotes, pa.Array]:
    """(votes, words of the space).

    Learns from at most `most_labelled` labelled rows (those of smallest id hash among ids with crc32(id) mod 3 not 1; an
    id labelled more than once has the mean label, ties toxic; null labels are none): all of them count for the
    relevance of words; `most_examples` of them, half of each class at most, are the examples that vote, and their words
    the space. Document frequencies are counted over all documents.
    """
    small_handover(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("__lid")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__toxic"))
    by_hash = [F.xxhash64("__lid"), F.col("__lid")]
    sample = stored(marked.orderBy(*by_hash).limit(most_labelled))
    halves = [sample.filter(F.col("__toxic") == y).orderBy(*by_hash).limit(most_examples // 2).withColumn("__votes", F.lit(True)) for y in (0, 1)]
    chosen = halves[0].unionByName(halves[1]).select(F.col("__lid").alias("__vid"), "__votes")
    of_sample = sample.join(F.broadcast(chosen), F.col("__lid") == F.col("__vid"), "left")  # most_examples rows
    picked = stored(texts.join(F.broadcast(of_sample), F.col("__id") == F.col("__lid")).select("__id", "__text", "__toxic", F.coalesce("__votes", F.lit(False)).alias("__votes")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([word_lists(batch.column(0)).flatten().unique()], names=["word"])

    found = picked.filter("__votes").select("__text").mapInArrow(words, "word string").filter("word <> ''").distinct().toArrow()  # words of the examples
    space = pa.array(sorted(found.column(0).to_pylist()), pa.string())
    known = docs.sparkSession.sparkContext.broadcast(space)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                pairs = counted(batch.column(1), known.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i] for p in pairs], pa.list_(pa.int32())) for i in (0, 1)), *batch.columns[2:]], names=["__id", "terms", "times", "__toxic", "__votes"])

    schema = T.StructType([picked.schema["__id"], *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "times")), picked.schema["__toxic"], picked.schema["__votes"]])
    distinct = stored(
        picked.mapInArrow(sparse, schema).groupBy("terms", "times")
        .agg(F.count("*").alias("rows"), F.sum("__toxic").alias("toxic"), F.min("__id").alias("example"), F.count_if("__votes").alias("n"), F.sum(F.when(F.col("__votes"), F.col("__toxic"))).alias("n_toxic"))
    )
    is_toxic = (2 * F.col("toxic") >= F.col("rows")).cast("long")
    shares = distinct.agg(F.count("*"), F.sum(is_toxic), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "toxic", "n", "n_toxic"))).first()
    at = lambda df, c: (df.column("t").to_numpy(), df.column(c).to_numpy())
    words_of = distinct.select(F.explode("terms").alias("t"), is_toxic.alias("y")).groupBy("t").agg(F.count("*").alias("rows"), F.sum("y").alias("toxic")).toArrow()  # a row a word
    toxic, rows = np.zeros(len(space)), np.zeros(len(space))
    for out, c in ((toxic, "toxic"), (rows, "rows")):
        out[at(words_of, c)[0]] = at(words_of, c)[1]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a term and task, and the number of texts under -1."""
        worker_keeps("toxicity")
        seen, n = np.zeros(len(known.value) + 1, np.int64), 0
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                n += batch.num_rows
                for terms, _ in counted(batch.column(0), known.value):
                    seen[terms] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[some], n), pa.int64())], names=["t", "df"])

    tally = texts.select("__text").mapInArrow(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()  # a row a word
    frequency = np.zeros(len(space) + 1)  # the last: texts
    frequency[at(tally, "df")[0]] = at(tally, "df")[1]
    idf = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 1
    weight = idf * relevance(toxic, rows, shares[1] or 0, shares[0])
    given = distinct.filter("n > 0").select("terms", "times", "n", "n_toxic", "example").toArrow()  # most_examples rows
    columns = [given.column(c).to_pylist() for c in ("n", "n_toxic", "example")]
    lists = [[x.values.to_numpy().astype(np.int64) for x in given.column(c)] for c in ("terms", "times")]
    examples = sorted(zip(*lists, *columns), key=lambda e: str(e[4]))
    discard(sample, picked, distinct)
    voting = (shares[4] - shares[5], shares[5])
    ratio = lambda y: (shares[3] if y else shares[2] - shares[3]) / voting[y] if voting[y] else 1.0
    return NeighbourVotes(weight, examples, k, clean_scale=ratio(0) / ratio(1)), space


_SCORE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())])


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **learning) -> DataFrame:
    """docs with score, predicted (1 from `threshold` on) and evidence (up to three `id:cosine` of the nearest examples)
    beside all its columns (of these names, replaced); `learning` goes to fit().

    Texts without a word of the space, empty and null ones among them, get the rate of such examples; without any labels
    the score is 0. Null and repeated ids and rows are kept; an empty table gives an empty table. Texts are scored where
    they are; none is shuffled.
    """
    votes, space = fit(docs, labels, id_col, text_col, **learning)
    model = docs.sparkSession.sparkContext.broadcast((votes, space))
    del votes, space
    trim()
    keep = [c for c in docs.columns if c not in _SCORE.names]
    at = keep.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("toxicity")
        votes, space = model.value
        for whole in batches:
            for batch in small_batches(whole, text_col):
                found = votes.score(counted(batch.column(at), space))
                scores = [s for s, _ in found]
                made = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([",".join(f"{i}:{c:.4f}" for i, c in e) for _, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*keep, *_SCORE.names])

    return docs.select(*keep).mapInArrow(judge, T.StructType([*(docs.schema[c] for c in keep), *_SCORE]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **learning) -> DataFrame:
    """id_col, held_out (crc32 of the id's text mod 3 is 1; false for a null id), score, predicted and evidence of
    with_toxicity; other columns are not read."""
    scored = with_toxicity(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")), labels.withColumnRenamed(id_col, "__id"), "__id", "__text", threshold, **learning)
    return scored.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), *_SCORE.names)
