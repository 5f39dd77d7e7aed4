"""Regular-expression search over a stored index of trigrams: a pattern says which trigrams a match must hold, the index which
rows hold them, and only those rows are matched.

Texts and patterns are compared in lower-case ASCII; the four other characters that match an ASCII letter in any case stand
for that letter, and a trigram with any other character is not indexed. So what the index leaves out cannot match.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Characters beyond ASCII that match an ASCII letter in any case, and the letters. Fixed values.
_ALIKE = {"ı": "i", "İ": "i", "ſ": "s", "K": "k"}
_FOLD = str.maketrans(_ALIKE)

#: What a match must hold: None (nothing is known), a trigram, ("and", parts) or ("or", parts).
Need = None | int | tuple


def _grams(text: str) -> set[int]:
    """Codes of the ASCII trigrams of a folded text."""
    raw = np.frombuffer(text.translate(_FOLD).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) < 3:
        return set()
    plain = raw < 128
    whole = plain[:-2] & plain[1:-1] & plain[2:]
    codes = (raw[:-2] << 14) | (raw[1:-1] << 7) | raw[2:]
    return set(np.unique(codes[whole]).tolist())


def _all(parts: list[Need]) -> Need:
    known = [p for p in parts if p is not None]
    return None if not known else known[0] if len(known) == 1 else ("and", tuple(known))


def _any(parts: list[Need]) -> Need:
    return None if any(p is None for p in parts) else _all(parts) if len(parts) == 1 else ("or", tuple(parts))


def _needs(parsed, runs: list[str], parts: list[Need]) -> None:
    """Adds what a sequence needs to `parts`; the last of `runs` is the literal text that ends where the sequence does."""
    for op, value in parsed:
        if op is C.LITERAL:
            runs[-1] += chr(value)
        elif op is C.SUBPATTERN:
            _needs(value[3], runs, parts)
        elif op is C.ATOMIC_GROUP:
            _needs(value, runs, parts)
        elif op is C.AT:
            pass  # a place, not a character
        else:
            runs.append("")
            if op is C.BRANCH:
                parts.append(_any([_need_of(branch) for branch in value[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
                parts.append(_need_of(value[2]))
            runs.append("")


def _need_of(parsed) -> Need:
    runs, parts = [""], []
    _needs(parsed, runs, parts)
    return _all([*(g for run in runs for g in sorted(_grams(run))), *parts])


def need(pattern: str) -> Need:
    """The trigrams that any match of a pattern holds, in any case. A pattern that the parser at hand may read in another way
    than Spark does (classes within classes, what it does not know) needs nothing."""
    if "&&" in pattern or re.search(r"\[[^\]]*\[|\\[0v]", pattern) or "(?" in pattern.replace("(?:", ""):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _need_of(_parser.parse(pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def grams_of(need_: Need) -> set[int]:
    return set() if need_ is None else {need_} if isinstance(need_, int) else set().union(*map(grams_of, need_[1]))


def _holds(need_: Need, held: Column) -> Column:
    if isinstance(need_, int):
        return F.array_contains(held, need_)
    joined, (kind, parts) = F.lit(need_[0] == "and"), need_
    for part in parts:
        joined = (joined & _holds(part, held)) if kind == "and" else (joined | _holds(part, held))
    return joined


class TrigramIndex:
    """`postings` (gram, id), a row for each trigram that a row's text holds, in ranges of both; `rows` holds the texts."""

    def __init__(self, rows: DataFrame, postings: DataFrame, column: str, order: str):
        self.rows, self.postings, self.column, self.order = rows, postings, column, order

    def candidates(self, pattern: str) -> DataFrame | None:
        """(id) of the rows that hold what a pattern needs; None where it needs nothing."""
        wanted = need(pattern)
        if wanted is None:
            return None
        some = self.postings.filter(F.col("gram").isin(sorted(grams_of(wanted))))
        held = some.groupBy("id").agg(F.collect_set("gram").alias("held"))  # a pattern's trigrams at most
        return held.filter(_holds(wanted, F.col("held"))).select("id")

    def matches(self, pattern: str) -> DataFrame:
        """Rows that match a pattern in any case, as a scan finds them; null texts match nothing."""
        found = self.candidates(pattern)
        rows = self.rows if found is None else self.rows.join(found.withColumnRenamed("id", self.order), self.order, "left_semi")
        return rows.filter(F.col(self.column).rlike("(?iu)" + pattern))

    def search(self, pattern: str, limit: int = 10) -> DataFrame:
        """The first `limit` rows that match, in order."""
        return self.matches(pattern).orderBy(self.order).limit(limit)


def build(rows: DataFrame, column: str, order: str) -> TrigramIndex:
    """Indexes the texts of a column by a numeric id `order`; rows of one id are candidates together, and rows without an id are left
    out. The index is a table in the shared folder, in ranges of
    trigrams and ids, so that a common trigram fills files of its own and a rare one reads a few row groups."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid and i.is_valid and (grams := _grams(text.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.int32()), pa.array([i.as_py()] * len(grams), pa.int64())], names=["gram", "id"])

    found = rows.select(F.col(order).cast("long").alias("id"), F.col(column).cast("string").alias("text")).mapInArrow(cut, "gram int, id long")
    return TrigramIndex(rows.filter(F.col(order).isNotNull()), stored(found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")), column, order)
