"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the code points cuts each text where the hash has a fixed pattern, so passages that documents
share are cut alike wherever they stand. A chunk is encoded once for as long as the worker's bounded table holds it.
Chunks of one text are then joined: around each cut the text between two points at which the pre-tokenizer always
starts anew is encoded again and replaces the identifiers of both sides; where the replaced identifiers do not cover
exactly the bytes of that span, the span is widened until they do, so that the result is that of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_handover, worker_keeps
from .token_counts import PreTokens, byte_symbols

WINDOW, MASK, SHORTEST, LONGEST = 16, 1023, 384, 8192
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(_PIECE + WINDOW, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def chunk_bounds(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text, in code points; the last is its length."""
    n = len(text)
    if n <= 2 * SHORTEST:
        return [n]
    up, down = _powers()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    hits = []
    for start in range(0, n, _PIECE):
        part = mixed[max(0, start - WINDOW) : start + _PIECE]
        sums = np.cumsum(part * down[: len(part)])
        sums[WINDOW:] -= sums[:-WINDOW].copy()
        rolled = sums * up[: len(part)]
        skip = min(start, WINDOW)
        hits.append(np.flatnonzero(((rolled[skip:] >> np.uint64(44)) & np.uint64(MASK)) == 0) + start + 1)
    out, last = [], 0
    for hit in np.concatenate(hits).tolist():
        if hit - last < SHORTEST:
            continue
        while hit - last > LONGEST:
            last += LONGEST
            out.append(last)
        if hit - last >= SHORTEST and n - hit >= SHORTEST:
            out.append(hit)
            last = hit
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    return [*out, n]


def _fresh(text: str, p: int) -> bool:
    """A blank after a non-blank: the pre-tokenizer starts a token here whatever stands before and after."""
    return text[p] == " " and not text[p - 1].isspace()


def span_around(text: str, cut: int, wider: int = 0) -> tuple[int, int]:
    """The nearest fresh starts at or before and at or after a cut, `wider` steps further out on both sides."""
    a, b = cut, cut
    for step in range(wider + 1):
        a = cut if step == 0 else a - 1
        while a > 0 and not (a < len(text) and _fresh(text, a)):
            a = max(0, text.rfind(" ", 0, a))
        b = cut if step == 0 else b + 1
        while b < len(text) and not _fresh(text, b):
            b = text.find(" ", b + 1)
            b = len(text) if b < 0 else b
        if a <= 0 and b >= len(text):
            break
    return max(a, 0), min(b, len(text))


class ChunkCodec:
    """Encodes texts by chunks as the tokenizers library encodes them whole; `kept` and `words`
    bound the characters of chunks and the pre-tokens held."""

    def __init__(self, path: str, kept: int = 4_000_000, words: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pieces, self.words, self.most_words = PreTokens(path).pieces, {}, words
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder()
        self.special = {x.content: i for i, x in added.items()}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        back = {s: b for b, s in byte_symbols().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = token.encode() if token in self.special else bytes(back[c] for c in token)
        self.length = np.array([len(x) for x in self.raw], np.int64)
        self.kept, self.held, self.table = kept, 0, {}
        self.encoded = self.reused = self.repaired = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of each text: its pre-tokens from a bounded table, those not in it from the library at once."""
        pieces = [self.pieces(t) for t in texts]
        known = self.words
        if new := {p for ps in pieces for p in ps if p not in known}:
            if len(known) + len(new) > self.most_words:
                known.clear()
                new = {p for ps in pieces for p in ps}
            self._learn_words(list(new))
        return [np.frombuffer(b"".join(map(known.__getitem__, ps)), np.int32) for ps in pieces]

    def _learn_words(self, new: list[str]) -> None:
        """Words with a blank before them are encoded as one text, which the pre-tokenizer cuts at the blanks; the
        bytes of its tokens show where each word ends. Other pre-tokens are texts of their own."""
        known, alone = self.words, []
        spaced = [p for p in new if p[0] == " " and p[1:2].isalpha()]
        if spaced:
            ids = np.array(self.library.encode_batch_fast(["".join(spaced)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(self.length[ids])
            wanted = np.cumsum([len(p.encode()) for p in spaced])
            at = np.searchsorted(ends, wanted)
            if at[-1] < len(ends) and (ends[at] == wanted).all():
                starts = np.concatenate([[0], at[:-1] + 1])
                for p, a, b in zip(spaced, starts.tolist(), (at + 1).tolist()):
                    known[p] = ids[a:b].tobytes()
            else:
                alone = spaced
        alone = alone + [p for p in new if p not in known]
        for p, e in zip(alone, self.library.encode_batch_fast(alone, add_special_tokens=False)):
            known[p] = np.array(e.ids, np.int32).tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, np.ndarray]:
        found, new = {}, []
        for c in chunks:
            if c in found:
                self.reused += 1
            elif (ids := self.table.get(c)) is not None:
                found[c] = ids
                self.reused += 1
            else:
                found[c] = None
                new.append(c)
        for c, ids in zip(new, self._ids(new)):
            found[c] = ids
            if self.held > self.kept:
                self.table.clear()
                self.held = 0
            self.table[c] = ids
            self.held += len(c)
        self.encoded += len(new)
        return found

    def _cover(self, ids: np.ndarray, n_bytes: int, tail: bool) -> int | None:
        """How many identifiers at the head (or tail) cover exactly n_bytes; None if none do."""
        if n_bytes == 0:
            return 0
        part = ids[-n_bytes:][::-1] if tail else ids[:n_bytes]
        sums = np.cumsum(self.length[part])
        k = int(np.searchsorted(sums, n_bytes))
        return k + 1 if k < len(sums) and sums[k] == n_bytes else None

    def _join(self, text: str, bounds: list[int], chunks: list[np.ndarray]) -> np.ndarray:
        wider = 0
        while True:
            spans: list[list[int]] = []
            for cut in bounds[:-1]:
                a, b = span_around(text, cut, wider)
                if spans and a < spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                elif a < b:
                    spans.append([a, b])
            fixed = self._ids([text[a:b] for a, b in spans])
            parts, agreed, k, start = [], True, 0, 0
            for end, ids in zip(bounds, chunks):
                left, right = start, end
                while k < len(spans) and spans[k][1] <= start:
                    k += 1
                if k < len(spans) and spans[k][0] <= start < spans[k][1]:
                    left = min(spans[k][1], end)
                    if spans[k][0] == start:
                        parts.append(fixed[k])
                last = next((s for s in range(k, len(spans)) if left <= spans[s][0] < end), None)
                if last is not None:
                    right = spans[last][0]
                if left < right:
                    head = self._cover(ids, len(text[start:left].encode()), False)
                    tail = self._cover(ids, len(text[right:end].encode()), True)
                    if head is None or tail is None:
                        agreed = False
                        break
                    parts.append(ids[head : len(ids) - tail])
                if last is not None and spans[last][0] > start:
                    parts.append(fixed[last])
                start = end
            if agreed:
                self.repaired += len(spans)
                return np.concatenate(parts) if parts else np.empty(0, np.int32)
            if spans == [[0, len(text)]]:
                return fixed[0]
            wider = 2 * wider + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plans, wanted = [], []
        for text in texts:
            pieces = self.at_special.split(text) if self.at_special and any(x in text for x in self.special) else [text]
            plan = []
            for piece in pieces:
                if piece in self.special:
                    plan.append(np.array([self.special[piece]], np.int32))
                elif piece:
                    bounds = chunk_bounds(piece)
                    chunks = [piece[a:b] for a, b in zip([0, *bounds], bounds)]
                    wanted += chunks
                    plan.append((piece, bounds, chunks))
            plans.append(plan)
        ids = self._learn(wanted)
        out = []
        for plan in plans:
            parts = [x if isinstance(x, np.ndarray) else ids[x[2][0]] if len(x[2]) == 1 else self._join(x[0], x[1], [ids[c] for c in x[2]]) for x in plan]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers of every whole text, and the text decoded from them.

    Returns id_col (as it is, null and repeated ids too), ids array<int>, decoded string, one row per input row. A
    null text is encoded as empty (no ids, decoded ''). An empty table gives an empty table; other columns are not
    read. Strings of added tokens inside texts become their identifiers, as the library does by default.
    """
    small_handover(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = worker_keeps(("bpe", tokenizer_path), lambda: ChunkCodec(tokenizer_path))  # tasks that follow reuse its chunks
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                ids = c.encode([t or "" for t in batch.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                decoded = pa.array([c.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), decoded], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of encode_and_decode's rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


