"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, in DataFrame expressions only.

A paragraph is a line; one of over 240 characters is cut after its sentences. The sketch has three tables of eight
cells; each distinct digest enters one cell of each table, adding to its count and XORing its key and check. Two
sketches subtract cell by cell, and peeling recovers the digests that differ: a cell with count 1 or -1 and a fitting
check holds one digest, which leaves its other cells, and so on until all cells are zero. Where cells remain, a larger
sketch of both documents is tried: digests are dealt into groups of about three, each with twelve cells of its own; a
group that does not peel gets four times as many, and one that still does not is compared directly.
Likeness is the share of common digests in all digests of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import shuffle_partitions

CELLS = 24
_CUT = "(?<=[.!?])\\\\x20"
_EMPTY = "named_struct('c', 0, 'k', 0L, 'h', 0)"


def digests_sql(text: str) -> str:
    """Distinct 64-bit digests of the paragraphs of a text expression."""
    lines = f"filter(split({text}, '\\\\n'), x -> x <> '')"
    pieces = f"flatten(transform({lines}, x -> if(length(x) > 240, split(x, '{_CUT}'), array(x))))"
    return f"array_distinct(transform({pieces}, x -> xxhash64(x)))"


def _check(d: str) -> str:
    return f"cast(xxhash64({d}) & 2147483647 as int)"


def _tables(base: int, bits: int) -> list[int]:
    """The bit from which on each of the three tables reads a digest's cell (of 2^bits)."""
    return [base + n * max(bits, 4) for n in range(3)] if bits < 3 else [base, base + 8, base + 16]


def sketch_sql(digests: str, base: int = 0, bits: int = 3) -> str:
    """Cells of an array of digests: three tables of 2^bits; `base` chooses the bits that place a digest."""
    m = (1 << bits) - 1
    own = lambda shift: f"filter({digests}, d -> (shiftrightunsigned(d, {shift}) & {m}L) = j)"
    put = f"named_struct('c', a.c + 1, 'k', a.k ^ d, 'h', a.h ^ {_check('d')})"
    one = lambda shift: f"transform(sequence(0L, {m}L), j -> aggregate({own(shift)}, {_EMPTY}, (a, d) -> {put}))"
    return f"concat({', '.join(map(one, _tables(base, bits)))})"


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel_sql(cells: str, base: int = 0, bits: int = 3) -> str:
    """struct<cells, plus, minus, done>: digests recovered on either side; all cells are zero if it succeeded."""
    width = 1 << bits
    pure = lambda sign: f"array_distinct(transform(filter(s.cells, x -> x.c = {sign} and x.h = {_check('x.k')}), x -> x.k))"
    take = lambda sign, shift: f"if((shiftrightunsigned(d, {shift}) & {width - 1}L) = j, named_struct('c', a.c - {sign}, 'k', a.k ^ d, 'h', a.h ^ {_check('d')}), a)"
    one = lambda n, shift: f"transform(slice(s.cells, {width * n + 1}, {width}), (x, j) -> aggregate(b.n, aggregate(b.p, x, (a, d) -> {take(1, shift)}), (a, d) -> {take(-1, shift)}))"
    left = f"concat({', '.join(one(n, shift) for n, shift in enumerate(_tables(base, bits)))})"
    go_on = f"named_struct('cells', {left}, 'plus', s.plus + size(b.p), 'minus', s.minus + size(b.n), 'done', false)"
    stop = "named_struct('cells', s.cells, 'plus', s.plus, 'minus', s.minus, 'done', true)"
    step = f"get(transform(array(named_struct('p', {pure(1)}, 'n', {pure(-1)})), b -> if(size(b.p) + size(b.n) = 0, {stop}, {go_on})), 0)"
    return f"aggregate(sequence(1, {3 * width}), named_struct('cells', {cells}, 'plus', 0, 'minus', 0, 'done', false), (s, r) -> if(s.done, s, {step}))"


def _outcome(peeled: str) -> str:
    """struct<ok, plus, minus> of a peeled sketch."""
    return f"get(transform(array({peeled}), q -> named_struct('ok', forall(q.cells, x -> x.c = 0 and x.k = 0L and x.h = 0), 'plus', q.plus, 'minus', q.minus)), 0)"


_NONE = "named_struct('ok', true, 'plus', 0, 'minus', 0)"


def _summed(outcomes: str) -> str:
    return f"aggregate({outcomes}, {_NONE}, (t, o) -> named_struct('ok', t.ok and o.ok, 'plus', t.plus + o.plus, 'minus', t.minus + o.minus))"


def _deal(a: str, b: str, shift: int, n: str, g: str) -> str:
    within = lambda x: f"filter({x}, z -> (shiftrightunsigned(z, {shift}) & ({n} - 1)) = {g})"
    return f"transform(sequence(0L, {n} - 1), {g} -> named_struct('a', {within(a)}, 'b', {within(b)}))"


def retry_sql(a: str, b: str, groups: str) -> str:
    """The outcome of a sketch of `groups` (an expression, a power of two) times twelve cells. Digests are dealt to
    their group in two steps of about the square root of `groups`; where a group's cells do not peel, four times as
    many are tried for it, and where those do not either, its digests are compared directly."""
    outer = f"shiftleft(1L, cast(log2({groups}) as int) div 2)"
    attempt = lambda w, base: f"if(size({w}.a) + size({w}.b) = 0, {_NONE}, {_outcome(peel_sql(subtract_sql(sketch_sql(f'{w}.a', base, 2), sketch_sql(f'{w}.b', base, 2)), base, 2))})"
    again = _summed(f"transform({_deal('w.a', 'w.b', 36, '4L', 'i')}, u -> {attempt('u', 38)})")
    exact = "named_struct('ok', true, 'plus', size(array_except(w.a, w.b)), 'minus', size(array_except(w.b, w.a)))"
    or_else = lambda first, then: f"get(transform(array({first}), y -> if(y.ok, y, {then})), 0)"
    one = or_else(attempt("w", 24), or_else(again, exact).replace("y ->", "yy ->").replace("if(y.ok, y,", "if(yy.ok, yy,"))
    dealt = f"flatten(transform({_deal(a, b, 48, outer, 'g')}, v -> {_deal('v.a', 'v.b', 56, f'({groups} div {outer})', 'e')}))"
    return _summed(f"transform({dealt}, w -> {one})")


def with_likeness(df: DataFrame, out: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """Adds the likeness `out` of two documents from columns of their digests and of their cells."""
    first, groups = f"__{out}1", f"__{out}g"
    df = df.withColumn(first, F.expr(f"if({cells_a} = {cells_b}, {_NONE}, {_outcome(peel_sql(subtract_sql(cells_a, cells_b)))})"))
    df = df.withColumn(groups, F.expr(f"shiftleft(1L, cast(ceil(log2(greatest(2, (size({a}) + size({b})) / 4.0D))) as int))"))
    df = df.withColumn(out, F.expr(f"if({first}.ok, {first}, {retry_sql(a, b, groups)})"))
    union = f"(size({a}) + {out}.minus)"
    return df.withColumn(out, F.expr(f"if({union} = 0, 1.0D, cast(size({a}) - {out}.plus as double) / {union})")).drop(first, groups)


def fingerprint(cells: str) -> Column:
    """The cells as text: 28 hexadecimal digits each."""
    return F.expr(f"lower(array_join(transform({cells}, x -> concat(lpad(hex(x.c), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 8, '0'))), ''))")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text): the text of the next document by descending id (null ids last, equal ids by text), after
    the last that of the first. Ids fall into ranges at approximate quantiles; the row on a border is copied into the
    range above it, so each range finds its neighbours alone and no task meets the whole table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wanted = 4 * shuffle_partitions(docs.sparkSession)
    marks, most = rows.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 20 * wanted), F.max("id")).first()
    bounds = sorted({m for m in (marks or []) if m < most})
    at = F.lit(0)
    on_border = F.lit(False)
    if bounds:
        array = f"array({', '.join(f'{b}L' for b in bounds)})"
        rows = rows.crossJoin(F.broadcast(docs.sparkSession.sql(f"select {array} as __bounds")))  # one row
        # The number of bounds below the id, by halving.
        halve = "if(s.lo >= s.hi, s, if(element_at(__bounds, cast((s.lo + s.hi) div 2 + 1 as int)) < id, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))))"
        at = F.coalesce(F.expr(f"if(id is null, 0, aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(bounds)}), (s, i) -> {halve}).lo)"), F.lit(0))
        rows = rows.withColumn("range", at)
        on_border = F.coalesce(F.expr("get(__bounds, range) = id"), F.lit(False))
    else:
        rows = rows.withColumn("range", at)
    here = F.struct("range", F.lit(0).alias("extra"))
    above = F.when(on_border, F.struct((F.col("range") + 1).alias("range"), F.lit(1).alias("extra")))
    first = F.when(F.col("id").eqNullSafe(F.lit(most).cast("long")), F.struct(F.lit(0).alias("range"), F.lit(2).alias("extra")))
    spread = rows.select("id", "text", F.explode(F.array_compact(F.array(here, above, first))).alias("at")).select("id", "text", "at.range", "at.extra")
    order = W.partitionBy("range").orderBy("extra", F.desc_nulls_last("id"), "text")
    return spread.withColumn("next_text", F.lead("text").over(order)).filter("extra = 0").select("id", "text", "next_text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its last third replaced by the start of the next).

    Returns id_col (long), n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next. A null
    text is empty; two texts without paragraphs are alike (1.0). Equal texts have equal fingerprints. Null and
    repeated ids and rows are kept; an empty table gives an empty table; other columns are not read.
    """
    df = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    for name, text in (("own", "text"), ("new", "edited"), ("other", "next_text")):
        df = df.withColumn(f"{name}_digests", F.expr(digests_sql(text)))
    for name in ("own", "new", "other"):
        df = df.withColumn(f"{name}_cells", F.expr(sketch_sql(f"{name}_digests")))
    df = df.select("id", "n_chars", "edited", *(f"{n}_{k}" for n in ("own", "new", "other") for k in ("digests", "cells")))
    df = with_likeness(df, "near_edited", "own_digests", "new_digests", "own_cells", "new_cells")
    df = with_likeness(df, "near_next", "own_digests", "other_digests", "own_cells", "other_cells")
    return df.select(F.col("id").alias(id_col), "n_chars", "edited", fingerprint("own_cells").alias("fingerprint"), fingerprint("new_cells").alias("edited_fingerprint"), "near_edited", "near_next")


def digests(printed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return printed.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
