"""Alignment of two tokenizers' tokens by union-find over the graph of overlapping tokens.

Tokens of A and B are the two sides of a bipartite graph; two are joined where their byte ranges overlap. The connected
components of a text are exactly its minimal groups: they are cut where tokens of both sides end. The members of a
component are expanded into links, the pairs of an A and a B token whose ranges end together, and pairs of identifiers are
counted over the corpus. The graph of all texts of a batch is solved at once: roots are hooked under smaller roots, then
all paths are halved until each token points at its root.

Texts are encoded in stretches, cut where no token of either side can cross: before a blank or a line feed that follows other
than white space, since A's pre-tokenizer starts anew there and no piece of B has a mark or a line feed behind another
character (checked against the file; if one has, whole texts are stretches). A worker keeps the identifiers of recent
stretches in a bounded table. The links of a document are stored as codes, so texts are read and encoded once; the second
step looks the codes up.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hinted, small_batches, small_handover, stored, worker_keeps
from .token_counts import byte_symbols

#: Points that no token crosses, in a text with a blank before it.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest member of the connected component of each of n nodes, by union-find over the edges (u, v)."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of A, of B) of the pairs of tokens whose byte ranges overlap; both lists of ends rise to the same last end."""
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def _cut_up(ids: list[int], length: np.ndarray, stretches: list[str]) -> list[bytes] | None:
    """The identifiers of each of the stretches that were encoded as one text; None if a token crosses their ends."""
    flat = np.array(ids, np.int32)
    ends, wanted = np.cumsum(length[flat]), np.cumsum([len(s.encode()) for s in stretches])
    at = np.searchsorted(ends, wanted)
    if at[-1] >= len(ends) or (ends[at] != wanted).any():
        return None
    raw, marks = flat.tobytes(), [0, *(4 * (at + 1)).tolist()]
    return [raw[i:j] for i, j in zip(marks, marks[1:])]


class Aligner:
    """Aligns texts under a byte-level BPE file (A, special strings being text) and a piece model (B, which adds a blank).
    `kept` bounds the stretches held."""

    def __init__(self, path_a: str, path_b: str, kept: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        back = {s: b for b, s in byte_symbols().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.raw_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, raw)), np.int64) for raw in (self.raw_a, self.raw_b))
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.lead = len(self.b.encode("a"))
        #: Codes of links are A's identifier x width + B's.
        self.width = len(pieces)
        self.code = np.uint32 if len(self.raw_a) * self.width <= 1 << 32 else np.uint64
        #: How a token shows: of A in and at the head of a group, of B likewise.
        n, m = len(self.raw_a), self.width
        self.shown = [*(f",{i}" for i in range(n)), *(f";{i}" for i in range(n)), *(f",{i}" for i in range(m)), *(f"|{i}" for i in range(m))]
        self.kept = kept
        self.young: dict[str, tuple[bytes, bytes] | None] = {}
        self.old: dict[str, tuple[bytes, bytes] | None] = {}

    def stretches(self, text: str) -> list[str]:
        return (_CUT.split(" " + text) if self.apart else [" " + text]) if text else []

    def _learn(self, new: list[str]) -> None:
        """Identifiers of stretches; None where the bytes of a side differ from the stretch."""
        # Those that end in other than white space are encoded as one text by A: it is cut between them, and the bytes show where.
        joined = [s for s in new if self.apart and not s[-1].isspace()]
        in_a: dict[str, bytes] = {}
        if joined:
            ids = self.a.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids
            in_a = dict(zip(joined, _cut_up(ids, self.length_a, joined) or ()))
        alone = [s for s in new if s not in in_a]
        in_a |= {s: np.array(e.ids, np.int32).tobytes() for s, e in zip(alone, self.a.encode_batch_fast(alone, add_special_tokens=False))}
        # Behind a letter, which any stretch may follow, so that B's own blank is not in the way.
        in_b = [ids[self.lead :] for ids in self.b.encode(["a" + s for s in new], num_threads=1)] if self.apart else self.b.encode([s[1:] for s in new], num_threads=1)
        for s, b in zip(new, in_b):
            a = in_a[s]
            same = b"".join([self.raw_a[i] for i in memoryview(a).cast("i")]) == s.encode() == b"".join([self.raw_b[i] for i in b])
            self.young[s] = (a, array("i", b).tobytes()) if same else None

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Identifiers in A and in B of each text, none if the bytes of a side differ from the text with a blank before it."""
        split = [self.stretches(t) for t in texts]
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        if missing := {s for ss in split for s in ss if s not in young}:
            young.update({s: old[s] for s in missing if s in old})
            if new := [s for s in missing if s not in young]:
                self._learn(new)
        found = [[young[s] for s in ss] for ss in split]
        return [(b"", b"") if None in f else (b"".join([x[0] for x in f]), b"".join([x[1] for x in f])) for f in found]

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, str | None, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, groups, codes of the links) of each text; groups are `a1,a2|b1;a3|b2`, None without tokens."""
        ids = self.encode(texts)
        n_a, n_b = (np.array([len(x[side]) // 4 for x in ids], np.int64) for side in (0, 1))
        a, b = (np.frombuffer(b"".join([x[side] for x in ids]), np.int32) for side in (0, 1))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        if not len(a):
            return [(0, 0, 0, 0, None, np.empty(0, self.code))] * len(texts)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        u, v = overlaps(ends_a, ends_b)
        root = roots(len(a) + len(b), u, v + len(a))
        # Both sides cover all bytes, so the smallest member of a component is of A.
        of_a, of_b = root[: len(a)], root[len(a) :]
        group_ends_a, group_ends_b = (np.append(np.flatnonzero(r[1:] != r[:-1]), len(r) - 1) for r in (of_a, of_b))
        # Ends rise on both sides, so of a component's members only the last two can end together.
        together = ends_a[group_ends_a] == ends_b[group_ends_b]
        linked_a, linked_b = group_ends_a[together], group_ends_b[together]
        codes = a[linked_a].astype(self.code) * self.code(self.width) + b[linked_b].astype(self.code)
        last_group, last_link = np.searchsorted(group_ends_a, last_a), np.searchsorted(linked_a, last_a)
        heads_a, heads_b = (np.concatenate([[True], r[1:] != r[:-1]]) for r in (of_a, of_b))
        n, m = len(self.raw_a), self.width
        shown = np.concatenate([a + n * heads_a, b + (2 * n + m * heads_b)])[np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")]
        last_shown, show = last_a + last_b, self.shown.__getitem__
        out, s, g, k = [], 0, 0, 0
        for i, (e, h, l) in enumerate(zip(last_shown.tolist(), last_group.tolist(), last_link.tolist())):
            text = "".join(map(show, shown[s:e].tolist()))[1:] if e > s else None
            out.append((int(n_a[i]), int(n_b[i]), h - g, l - k, text, codes[k:l]))
            s, g, k = e, h, l
        return out


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)


def _pair_counts(aligned: DataFrame, code, most: int = 4_000_000) -> DataFrame:
    """(code, n) over the links of all documents; a task adds up about `most` links before it hands them on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        held, size = [], 0
        emit = lambda codes, n: pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n)], names=["code", "n"])
        for batch in batches:
            for raw in batch.column(0):
                if raw.is_valid:
                    codes = np.frombuffer(unzip(raw.as_py()), code)
                    held.append((codes, np.ones(len(codes), np.int64)))
                    size += len(codes)
                    if size > most:
                        held = [_counted(held)]
                        size = len(held[0][0])
                        if size > most // 2:
                            yield emit(*held[0])
                            held, size = [], 0
        if held:
            yield emit(*_counted(held))

    return aligned.select("links").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, most: int) -> tuple[int, bool]:
    """(n, whether that is every pair): pairs of at least n links number `most` at most; n is a power of two."""
    by_power = {r["power"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    held, least = 0, 64
    for power in sorted(by_power, reverse=True):
        if (held := held + by_power[power]) > most:
            return 1 << least, False
        least = power
    return 0, True


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, most_pairs: int = 2_000_000) -> DataFrame:
    """Minimal groups of the tokens of two tokenizers over every whole text, and how usual its links are in the corpus.

    A encodes a blank and the text, special strings being text; B encodes the text and adds the blank. Returns id_col (as it
    is, null and repeated ids too), n_a, n_b (tokens), n_groups, n_links (pairs of tokens that end together), n_best (links
    whose pair of identifiers is the most frequent of its B identifier in the corpus, ties included), count_sum (frequencies
    of the links' pairs, added up) and groups (`a1,a2|b1;a3|b2`: identifiers of A and of B of each group in order; with
    `digest` groups_sha256, its SHA-256 in lowercase hex, instead: the text is longer than the document). One row per input
    row. A text that is null or empty, or whose bytes are not those of its joined tokens, has no tokens: zeros and ''. An
    empty table gives an empty table; other columns are not read. Links are counted over all rows.

    The frequencies of up to `most_pairs` pairs, the most frequent ones, are broadcast; links of others, which are all rare,
    meet theirs by a shuffle. The files at the paths must be readable on every executor.
    """
    small_handover(docs.sparkSession)
    spark = docs.sparkSession
    shape = Aligner(path_a, path_b, 0)
    width, code = shape.width, shape.code
    del shape
    named = "groups_sha256" if digest else "groups"
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    row = [T.StructField("__key", T.LongType()), T.StructField("__id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in figures), T.StructField(named, T.StringType())]
    schema = T.StructType([*row, T.StructField("links", T.BinaryType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_keeps(("alignment", path_a, path_b), lambda: Aligner(path_a, path_b))
        zip_one, key = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                gc.disable()  # nothing in here is cyclic, and the tables are large
                found = aligner.align([t.as_py() or "" for t in batch.column(1)])
                gc.enable()
                sizes = [pa.array([f[i] for f in found], pa.int64()) for i in range(4)]
                groups = [(sha256(f[4].encode()).hexdigest() if digest else f[4]) if f[4] is not None else "" for f in found]
                links = [zip_one(f[5].tobytes()) if len(f[5]) else None for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(range(key, key + len(found)), pa.int64()), batch.column(0), *sizes, pa.array(groups, pa.string()), pa.array(links, pa.binary())], names=schema.names)
                key += len(found)

    aligned = stored(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(solve, schema))
    counts = stored(_pair_counts(aligned, code))
    of_b = F.pmod(F.col("code"), F.lit(width)).alias("b")
    highest = counts.groupBy(of_b).agg(F.max("n").alias("highest"))  # a row an identifier of B
    ranked = counts.join(hinted(highest, width), of_b == F.col("b")).select("code", "n", (F.col("n") == F.col("highest")).alias("best"))
    least, every = _most_frequent(counts, most_pairs)
    table = ranked.filter(F.col("n") >= least).toArrow().sort_by("code")
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("code", "n", "best")))
    looked_schema = T.StructType([*row, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("rest", T.ArrayType(T.LongType()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, (codes, n, best) = zstandard.ZstdDecompressor().decompress, known.value
        nothing = np.empty(0, np.int64)
        for batch in batches:
            links = [np.frombuffer(unzip(x), code).astype(np.int64) if x is not None else nothing for x in batch.column("links").to_pylist()]
            flat, last = np.concatenate(links), np.cumsum([0, *map(len, links)])
            at = np.minimum(np.searchsorted(codes, flat), max(0, len(codes) - 1))
            there = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
            held = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(np.where(there, values[at], 0) if len(codes) else there)])[last]).astype(np.int64))
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~there)])[last].astype(np.int32)), pa.array(flat[~there]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in row), held(best.astype(np.int64)), held(n), rest], names=looked_schema.names)

    looked = aligned.mapInArrow(look, looked_schema)
    if not every:
        looked = stored(looked)
        rare = looked.select("__key", F.explode("rest").alias("code")).groupBy("__key", "code").agg(F.count("*").alias("times"))
        more = rare.join(ranked.filter(F.col("n") < least), "code").groupBy("__key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"), F.sum(F.col("times") * F.col("n")).alias("__sum"))
        plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
        looked = looked.join(more, "__key", "left").select("__id", *figures, named, plus("n_best", "__best"), plus("count_sum", "__sum"))
    return looked.select(F.col("__id").alias(id_col), *figures, "n_best", "count_sum", named)
