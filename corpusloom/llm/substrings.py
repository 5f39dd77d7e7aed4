"""Exact substring dedup by fixed-block anchors.

The documents are dealt, in the order of their ids, into buckets of about equal bytes, once: the later steps find them
where they are, and only hashes travel. Every document is cut into non-overlapping blocks of half a window; every window of `span` words holds one of the blocks of its first occurrence
whole. (1) Blocks are the index, and every rolling window of a block's length is a probe: buckets send their distinct
hashes, dealt by hash, and learn which occur more than once and are a block somewhere. (2) Around each hit the text is
extended to all windows that contain it; the buckets send the hashes of these alone and learn which an earlier bucket
has. (3) Runs of windows that start earlier elsewhere, in an earlier bucket or earlier in their own, are the later
copies of maximal exact repeats; their words go. No pairs of occurrences are made: a bucket names a hash once however
often it holds it, so a passage that a third of all documents share costs one entry a bucket. Answers are one bit an
entry, in the order in which the bucket sent them.

Hashes go from buckets to parts of the hash space. With many of both, pieces would be as many as buckets times parts, so
beyond `fan` parts they take two hops: to one of `fan` superparts, where the pieces of `fan` neighbouring buckets are
put together by part, and from there to the part; answers return the same way. Buckets and parts keep their size.

Step (1)'s hashes may be coarse, since (2) tests whole windows. Windows are taken as equal if two hashes agree, of 64 and 32
bits, each made from another half of the 128-bit hashes of their words: of 10^12 candidate windows of different words that
makes 10^-5 expected false pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, shuffle_partitions, small_batches, small_handover, stored, stored_by, worker_keeps

_U = np.uint64
#: Steps of the two hashes of a window.
_STEP, _STEP2 = 0xA0761D6478BD642F, 0x589965CC75374CC3


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, another that shares nothing with it, number of words of each text): the halves of XXH3-128 of the
    word's bytes; words are runs of other than ASCII white space."""
    counts, found = [], []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        found.append(b"".join(map(xxhash.xxh3_128_digest, words)))
    both = np.frombuffer(b"".join(found), _U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy(), np.array(counts, np.int64)


class Bucket:
    """Hashes of the windows of consecutive documents."""

    def __init__(self, texts: list[bytes], span: int):
        self.span, self.block = span, span // 2
        self.words, self.others, self.counts = word_hashes(texts)
        n, b = len(self.words), self.block
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        #: Words left in the document from each word on, and its place from the document's start.
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.arange(n)
        self.left, self.place = self.first[doc + 1] - at, at - self.first[doc]
        self.short, self.long = self._windows(self.words, _STEP)

    def _windows(self, words: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of a block's length and of the span, by the word they start at."""
        n, b = len(words), self.block
        short = np.zeros(max(0, n - b + 1), _U)
        for k in range(b if n >= b else 0):
            short = short * _U(step) + words[k : n - b + 1 + k]
        return short, short[: max(0, len(short) - b)] * _U(pow(step, b, 1 << 64)) + short[b:] if len(short) > b else np.empty(0, _U)

    def probes(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part << 32 | key) of the distinct rolling windows, sorted; which are a block; which occur again; the
        positions of all rolling windows and, for each, its place among the distinct."""
        where = np.flatnonzero(self.left[: len(self.short)] >= self.block)
        h = _mix(self.short[where])
        code = ((((h >> _U(32)) * _U(parts)) >> _U(32)) << _U(32)) | (h & _U(0xFFFFFFFF))
        distinct, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
        is_block = np.zeros(len(distinct), bool)
        is_block[inverse[self.place[where] % self.block == 0]] = True
        return distinct, is_block, times > 1, where, inverse

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From the positions of hits: (distinct hashes, sorted; the second hash of each; positions of the windows that
        contain a hit; for each its place among the distinct)."""
        n = len(self.long)
        reach = np.zeros(n + self.span, np.int32)
        np.add.at(reach, np.maximum(hits - (self.span - self.block), 0), 1)
        np.add.at(reach, hits + 1, -1)
        where = np.flatnonzero((np.cumsum(reach)[:n] > 0) & (self.left[:n] >= self.span))
        if not len(where):
            return np.empty(0, _U), np.empty(0, np.uint32), where, where
        first, second = _mix(self.long[where]), (_mix(self._windows(self.others, _STEP2)[1][where]) >> _U(32)).astype(np.uint32)
        order = np.lexsort((second, first))
        new = np.ones(len(where), bool)
        new[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        inverse = np.empty(len(where), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return first[order][new], second[order][new], where, inverse

    def removed(self, where: np.ndarray, inverse: np.ndarray, n_distinct: int, earlier: np.ndarray) -> np.ndarray:
        """Words covered by a window that starts earlier, in an earlier bucket or in this one."""
        seen = np.full(n_distinct, len(self.words), np.int64)
        np.minimum.at(seen, inverse, where)
        again = where[earlier[inverse] | (where > seen[inverse])]
        reach = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(reach, again, 1)
        np.add.at(reach, again + self.span, -1)
        return np.cumsum(reach)[:-1] > 0


def _pack(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane, compressed."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(keys), -1).T).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype)[:, 0], dtype=dtype)


def _bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def _unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8))[:n].astype(bool)


_SENT = "part int, bucket int, keys binary, flags binary"
_TOLD = "bucket int, part int, step int, bits binary"


def _load(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a bucket, in the order of ids (null last), then of hashes of texts, then texts."""
    unzip = zstandard.ZstdDecompressor().decompress
    ids, hashes, texts = table.column("id").to_pylist(), table.column("h").to_pylist(), [unzip(z) for z in table.column("z").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, hashes[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _borders(first: int, last: int, parts: int, shift: int) -> np.ndarray:
    """First codes of the parts `first` to `last` - 1 out of `parts`; codes hold their part from bit `shift` on, or
    without a shift are dealt by range."""
    return np.array([p << shift if shift else (p << 64) // parts for p in range(first, last)], _U)


def _split(distinct: np.ndarray, parts: int, inner: int, shift: int) -> list[tuple[int, int, int]]:
    """(superpart, start, end) of the superparts, of `inner` parts each, that sorted codes fall into."""
    above = parts // inner
    ends = np.append(np.searchsorted(distinct, _borders(1, above, above, 0) if not shift else _borders(1, above, above, shift) * _U(inner)), len(distinct))
    starts = np.concatenate([[0], ends[:-1]])
    return [(p, s, e) for p, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())) if e > s]


def _gather(told: pa.Table, step: int, pieces: list[tuple[int, int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    bits = {p: b for p, s, b in zip(*(told.column(c).to_pylist() for c in ("part", "step", "bits"))) if s == step}
    for p, s, e in pieces:
        out[s:e] = _unbits(bits[p], e - s)
    return out


def drop_repeats(docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 6_000_000, most_buckets: int = 1 << 22, fan: int = 4096) -> DataFrame:
    """Removes each word covered by a window of `span` words (even) whose sequence also starts earlier.

    Earlier: in a row of smaller id, or earlier in the same row; null ids come last, and rows of equal ids follow the
    order of a hash of their texts. Windows are judged on the input. Returns id_col (long), n_words, n_removed, kept (the
    words left, joined by one space), one row per input row; a null or blank text has no words and keeps ''. An empty
    table gives an empty table; other columns are not read. Ids that hold more than a bucket (null among them) are
    split by that hash. The driver holds 8 bytes a bucket.
    """
    small_handover(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    sizes = stored(rows.select("id", F.octet_length("text").alias("n")))  # texts are read for this and to be dealt
    total = sizes.agg(F.sum("n")).first()[0] or 0
    wanted = int(min(most_buckets, max(shuffle_partitions(spark), -(-total // bucket_bytes))))
    parts = int(max(shuffle_partitions(spark), -(-total // (2 * bucket_bytes))))
    inner = -(-parts // fan)
    parts = -(-parts // inner) * inner
    layout = spark.sparkContext.broadcast(Layout.of(sizes, wanted, max(1, total // wanted), fan))
    discard(sizes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("substrings")
        zip_one = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in small_batches(whole, "text"):
                ids = batch.column(0)
                at = layout.value.bucket(ids, batch.column(2).to_numpy())
                packed = [zip_one(t.as_buffer()) if len(t.as_buffer()) else zip_one(b"") for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), ids, batch.column(2), pa.array(packed, pa.binary())], names=["bucket", "id", "h", "z"])

    dealt = stored_by(rows.mapInArrow(deal, "bucket int, id long, h long, z binary"), "bucket", max(shuffle_partitions(spark), wanted // 8))

    def send_probes(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        distinct, block, again, _, _ = Bucket(_load(table)[1], span).probes(parts)
        out = [(p, bucket, _pack(distinct[s:e] if inner > 1 else distinct[s:e].astype(np.uint32)), _bits(np.concatenate([block[s:e], again[s:e]]))) for p, s, e in _split(distinct, parts, inner, 32)]
        return _table(out, _SENT)

    def send_candidates(docs_: pa.Table, told: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return _table([], _SENT)
        b = Bucket(_load(docs_)[1], span)
        distinct, second, _, _ = _candidates(b, told)
        out = [(p, docs_.column("bucket")[0].as_py(), _pack(distinct[s:e]), second[s:e].tobytes()) for p, s, e in _split(distinct, parts, inner, 0)]
        return _table(out, _SENT)

    def _candidates(b: Bucket, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        codes, _, _, where, inverse = b.probes(parts)
        hit = _gather(told, 1, _split(codes, parts, inner, 32), len(codes))
        return b.candidates(where[hit[inverse]])

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(docs_: pa.Table, told: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "k": pa.array([], pa.string())}).rename_columns(schema.names)
        ids, texts = _load(docs_)
        b = Bucket(texts, span)
        distinct, _, where, inverse = _candidates(b, told)
        gone = b.removed(where, inverse, len(distinct), _gather(told, 2, _split(distinct, parts, inner, 0), len(distinct)))
        kept, n_removed = [], []
        for i, text in enumerate(texts):
            out = gone[b.first[i] : b.first[i + 1]]
            n_removed.append(int(out.sum()))
            words = text.split()
            kept.append(b" ".join(compress(words, (~out).tolist()) if n_removed[-1] else words).decode())
        return pa.table([pa.array(ids, pa.int64()), pa.array(b.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    told = stored(_exchange(dealt.groupBy("bucket").applyInArrow(send_probes, _SENT), 1, parts, inner, fan))
    earlier = stored(_exchange(dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(send_candidates, _SENT), 2, parts, inner, fan))
    return dealt.groupBy("bucket").cogroup(told.unionByName(earlier).groupBy("bucket")).applyInArrow(remove, schema)


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


class Layout:
    """Which bucket a row belongs to: buckets are ranges of ids, null last, of about equal bytes; an id with more bytes than a
    bucket has buckets of its own, ranges of the hash. Buckets are numbered in that order."""

    def __init__(self, last: np.ndarray, heavy: dict[int | None, int]):
        """last: the last id of each bucket but the last; heavy: into how many buckets an id is split."""
        alone = [i for i in heavy if i is not None]
        low = np.iinfo(np.int64).min
        self.last = np.unique(np.concatenate([last, np.array([x for i in alone for x in ((i - 1, i) if i > low else (i,))], np.int64)]).astype(np.int64))
        #: Buckets of each range of ids, then of null.
        self.width = np.ones(len(self.last) + 2, np.int64)
        self.width[np.searchsorted(self.last, np.array(alone, np.int64))] = [heavy[i] for i in alone]
        self.width[-1] = heavy.get(None, 1)
        self.first = np.cumsum(self.width) - self.width

    @staticmethod
    def of(rows: DataFrame, wanted: int, most: int, fan: int) -> Layout:
        """rows: (id, n bytes). Ranges at quantiles of ids, put together by their bytes; ids above 2 x `most` bytes alone."""
        if wanted < 2:
            return Layout(np.empty(0, np.int64), {})
        heavy = {r["id"]: int(-(-r["n"] // most)) for r in rows.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") > 2 * most).collect()}  # total / most rows
        fine = _quantiles(rows.select("id"), 4 * wanted if wanted <= 1 << 18 else wanted, fan)
        marks = rows.sparkSession.sparkContext.broadcast(fine)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros(len(marks.value) + 1, np.int64)
            for batch in batches:
                known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                np.add.at(held, np.searchsorted(marks.value, batch.column(0).drop_null().to_numpy()), batch.column(1).to_numpy()[known])
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], names=["at", "n"])

        held = np.zeros(len(fine) + 1, np.int64)
        for r in rows.mapInArrow(weigh, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a range
            held[r["at"]] = r["n"]
        # A range ends a bucket where the next one would fill it above its share.
        ends, full = [], 0
        for i, n in enumerate(held[:-1].tolist()):
            full += n
            if full + int(held[i + 1]) > most:
                ends.append(i)
                full = 0
        return Layout(fine[np.array(ends, np.int64)] if ends else np.empty(0, np.int64), heavy)

    def bucket(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.last, ids.fill_null(0).to_numpy())
        at = np.where(ids.is_valid().to_numpy(zero_copy_only=False), at, len(self.last) + 1)
        share = ((hashes.astype(np.int64) >> 32) + (1 << 31)) * self.width[at] >> 32
        return self.first[at] + share


def _quantiles(ids: DataFrame, wanted: int, fan: int) -> np.ndarray:
    """Last ids of about `wanted` - 1 ranges of equal rows: quantiles, and above `fan` of them quantiles between quantiles."""
    marks = lambda n: F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)
    coarse = np.array(sorted(set(ids.agg(marks(max(2, min(wanted, fan)))).first()[0] or [])), np.int64)
    if wanted <= fan:
        return coarse

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).drop_null()
            at = np.searchsorted(coarse, known.to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), known], names=["at", "id"])

    fine = ids.mapInArrow(deal, "at int, id long").groupBy("at").agg(marks(max(2, -(-wanted // fan))).alias("m"))
    return np.unique(np.concatenate([coarse, *(np.array(r["m"], np.int64) for r in fine.collect())]))  # `fan` rows


def _found(step: int, keys: np.ndarray, whose: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Step 1, extra flags telling which keys are blocks and which occur again in their bucket: keys that are a block in
    some bucket and occur twice or more. Step 2, extra being second hashes: keys that an earlier bucket has."""
    if step == 1:
        distinct, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        is_block, twice = np.zeros(len(distinct), bool), times > 1
        is_block[inverse[extra[0]]] = True
        twice[inverse[extra[1]]] = True
        return (is_block & twice)[inverse]
    order = np.lexsort((whose, extra, keys))
    k, e, w = keys[order], extra[order], whose[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    out = np.empty(len(k), bool)
    out[order] = w > w[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _extras(raws: list[bytes], sizes: list[int], step: int) -> np.ndarray:
    """What travels with keys: two rows of flags in step 1, second hashes in step 2."""
    if step == 1:
        return np.concatenate([_unbits(f, 2 * m).reshape(2, m) for f, m in zip(raws, sizes)], axis=1)
    return np.concatenate([np.frombuffer(f, np.uint32) for f in raws])


def _received(table: pa.Table, step: int, dtype) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, buckets, number of keys of each, keys, what travels with them)."""
    keys = [_unpack(k, dtype) for k in table.column("keys").to_pylist()]
    n = np.array([len(k) for k in keys])
    return table.column("part")[0].as_py(), np.array(table.column("bucket").to_pylist(), np.int64), n, np.concatenate(keys), _extras(table.column("flags").to_pylist(), n.tolist(), step)


_SPREAD = "part int, crowd int, sub int, buckets binary, counts binary, keys binary, flags binary"
_FOUND = "part int, crowd int, sub int, buckets binary, counts binary, bits binary"


def _exchange(sent: DataFrame, step: int, parts: int, inner: int, fan: int) -> DataFrame:
    """Answers (_TOLD) to what buckets sent to their superparts (_SENT)."""
    dtype = np.uint32 if step == 1 and inner == 1 else _U
    squeeze = lambda a: zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
    loose = lambda raw, kind: np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)

    def find(table: pa.Table) -> pa.Table:
        part, buckets, n, keys, extra = _received(table, step, dtype)
        hits = np.split(_found(step, keys, np.repeat(buckets, n), extra), np.cumsum(n)[:-1])
        return _table([(int(b), part, step, _bits(h)) for b, h in zip(buckets, hits)], _TOLD)

    def spread(table: pa.Table) -> pa.Table:
        """The pieces of a crowd of buckets, put together by part."""
        part, buckets, n, keys, extra = _received(table, step, dtype)
        crowd, whose = int(buckets[0]) // fan, np.repeat(buckets, n)
        sub = np.searchsorted(_borders(part * inner + 1, (part + 1) * inner, parts, 32 if step == 1 else 0), keys, side="right")
        order = np.argsort(sub, kind="stable")
        out = []
        for at in np.split(order, np.flatnonzero(np.diff(sub[order])) + 1):
            starts = np.flatnonzero(np.diff(whose[at], prepend=-1))
            out.append((part, crowd, int(sub[at[0]]), squeeze(whose[at][starts]), squeeze(np.diff(starts, append=len(at))), squeeze(keys[at]), _bits(extra[:, at]) if step == 1 else extra[at].tobytes()))
        return _table(out, _SPREAD)

    def opened(table: pa.Table) -> tuple[list, list]:
        return tuple([loose(x, np.int64) for x in table.column(c).to_pylist()] for c in ("buckets", "counts"))

    def find_spread(table: pa.Table) -> pa.Table:
        buckets, counts = opened(table)
        n = [int(c.sum()) for c in counts]
        extra = _extras(table.column("flags").to_pylist(), n, step)
        keys = np.concatenate([loose(k, dtype) for k in table.column("keys").to_pylist()])
        whose = np.concatenate([np.repeat(b, c) for b, c in zip(buckets, counts)])
        hits = np.split(_found(step, keys, whose, extra), np.cumsum(n)[:-1])
        named = ("part", "crowd", "sub", "buckets", "counts")
        return _table([(*row, _bits(h)) for row, h in zip(zip(*(table.column(c).to_pylist() for c in named)), hits)], _FOUND)

    def collect(table: pa.Table) -> pa.Table:
        table = table.sort_by("sub")
        buckets, counts = opened(table)
        whose = np.concatenate([np.repeat(b, c) for b, c in zip(buckets, counts)])
        hits = np.concatenate([_unbits(b, int(c.sum())) for b, c in zip(table.column("bits").to_pylist(), counts)])
        order = np.argsort(whose, kind="stable")
        part = table.column("part")[0].as_py()
        return _table([(int(whose[at[0]]), part, step, _bits(hits[at])) for at in np.split(order, np.flatnonzero(np.diff(whose[order])) + 1)], _TOLD)

    if inner == 1:
        return sent.groupBy("part").applyInArrow(find, _TOLD)
    spread_out = sent.groupBy("part", F.floor(F.col("bucket") / fan)).applyInArrow(spread, _SPREAD)
    return spread_out.groupBy("part", "sub").applyInArrow(find_spread, _FOUND).groupBy("part", "crowd").applyInArrow(collect, _TOLD)


def digests(dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return dropped.select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
