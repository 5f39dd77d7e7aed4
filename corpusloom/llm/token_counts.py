"""Token counts by heap-and-linked-list byte-pair merging.

Symbols of a pre-token form a doubly linked list; a heap holds each adjacent pair that has a rank. The lowest rank
(leftmost on ties) is popped again and again, stale entries are skipped, and the count is the number of initial
symbols minus the number of merges. No identifier is produced. Counts of pre-tokens are kept in a bounded table per
Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_handover, worker_keeps

#: The pre-token pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Outside these ranges the regex module and the tokenizers library disagree on the class of some code points
#: (compared one by one); texts with such characters are split by the library's own pre-tokenizer.
UNSURE = r"[^\x00-՗ೝ-₎₠-ꟍ]"


@lru_cache(1)
def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(0x100 + len(out) - len(shown))
    return out


class PreTokens:
    """Splits texts as the pre-tokenizer of a byte-level BPE file does."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        self.split, self.unsure = regex.compile(PATTERN).findall, regex.compile(UNSURE).search

    def pieces(self, text: str) -> list[str]:
        if not self.unsure(text):
            return self.split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]


class PairMerger:
    """Counts tokens of a text under a byte-level BPE file. `kept` bounds the table of counted pre-tokens."""

    def __init__(self, path: str, kept: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {s: bytes([b]) for b, s in byte_symbols().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left, right) -> (rank, merged), all as bytes.
        self.pairs = {}
        for rank, (a, b) in enumerate(merges):
            left, right = (b"".join(back[c] for c in x) for x in (a, b))
            self.pairs[left, right] = (rank, left + right)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.at_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces, self.kept = PreTokens(path).pieces, kept
        self.table: dict[str, int] = {}

    def merged_count(self, piece: str) -> int:
        """Initial symbols minus merges of one pre-token."""
        raw = piece.encode()
        n = len(raw)
        symbols: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i, whole = heapq.heappop(heap)
            left, j = symbols[i], after[i]
            # Stale: the left symbol is gone, or one of the two has grown since the pair was pushed.
            if left is None or j >= n or pairs.get((left, symbols[j])) != (rank, whole):
                continue
            symbols[i], symbols[j] = whole, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := pairs.get((whole, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get((symbols[h], whole))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return count

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.at_special and any(x in text for x in self.special):
            parts = self.at_special.split(text)
            total = len(parts) - 1
        get = self.table.get
        for part in parts:
            pieces = self.pieces(part)
            found = [get(p) for p in pieces]
            if None in found:
                total += sum(c if c is not None else self.learn(p) for c, p in zip(found, pieces))
            else:
                total += sum(found)
        return total

    def learn(self, piece: str) -> int:
        if (c := self.table.get(piece)) is None:
            c = self.merged_count(piece)
            if len(piece) <= 64:
                if len(self.table) >= self.kept:
                    self.table.clear()
                self.table[piece] = c
        return c


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Token counts of every whole text.

    Returns id_col (as it is, null and repeated ids too), n_bytes, n_tokens, over_limit (n_tokens > limit), one row
    per input row. A null text counts as empty (0, 0, false); an empty table gives an empty table; other columns are
    not read. The file at tokenizer_path must be readable on every executor, as the library itself must be.
    """
    small_handover(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = worker_keeps(("counts", tokenizer_path), lambda: PairMerger(tokenizer_path))  # tasks that follow reuse its table
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                texts = batch.column(1)
                counts = [m.count(t.as_py()) if t.is_valid else 0 for t in texts]
                sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
