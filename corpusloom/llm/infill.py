"""Fill-in-middle: texts cut in three and put together with markers, so that the middle comes last.

A text is decoded to an array of UTF-32 code points, each with a class; neighbours of different classes have a boundary
between them. Two boundaries, chosen by their rank, cut the array into prefix, middle and suffix, which are encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_handover

#: Heads of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Class of each code point. `char`: neighbours always differ. `word`: white space, ASCII marks and all else. `line`:
    how many line feeds came before."""
    if unit == "char":
        return np.arange(len(points)) & 1
    if unit == "word":
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        plain = (points >= 128) | ((points >= 48) & (points <= 57)) | (((points | 32) >= 97) & ((points | 32) <= 122))
        return np.where(blank, 0, np.where(plain, 1, 2))
    if unit == "line":
        feeds = points == 10
        return np.cumsum(feeds) - feeds
    raise ValueError(f"unit must be char, word or line, not {unit}")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places at which a text may be cut, its start and end among them."""
    kind = classes(points, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that hang on a key alone."""
    h = sha256(key.encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def transform(text: str, key: str, unit: str = "char", apply: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(code points, form, those of the prefix and of the middle, output) of a text; forms are those of `fill_in_middle`."""
    points = codepoints(text)
    h1, h2, h3, h4 = draws(key)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= apply:
        return len(points), "plain", None, None, text
    at = boundaries(points, unit)
    i, j = sorted(int(at[h % len(at)]) for h in (h1, h2))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:i], points[i:j], points[j:]))
    if h4 % 100 < suffix_first:
        return len(points), "spm", i, j - i, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return len(points), "psm", i, j - i, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: str, form: str) -> str:
    """The text that a form's output was made of. No marker can be found too early: the texts hold none, and no marker
    overlaps another."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output.removeprefix(first).split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", apply: int = 90, suffix_first: int = 20, seed: int = 1) -> DataFrame:
    """Every whole text in the form in which a model learns to fill in its middle.

    Returns id_col (as it is, null and repeated ids too), n (code points), form, prefix_chars, middle_chars (null if plain) and
    output, one row per input row. What is drawn hangs on `seed` and the id alone (for a null id on `seed:`), so rows of one
    id draw the same and reruns agree. Of 100 draws `apply` are transformed, `suffix_first` of 100 of those as spm
    (`<S>`suffix`<P>`prefix`<M>`middle), the others as psm (`<P>`prefix`<S>`suffix`<M>`middle); the rest, empty or null
    texts (output '') and texts that hold a marker stay plain. Cuts are boundaries of `unit`: char, word or line. An empty
    table gives an empty table; other columns are not read. No shuffle: rows stay where they are.
    """
    classes(np.empty(0, np.uint32), unit)
    small_handover(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "__text"):
                ids, texts = batch.column(0), batch.column(1)
                made = [transform(t.as_py() or "", f"{seed}:{'' if i is None else i}", unit, apply, suffix_first) for i, t in zip(ids.to_pylist(), texts)]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def restored(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of fill_in_middle with the text rebuilt from output and form, in column `restored`, behind the others."""
    schema = T.StructType([*made.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "output"):
                texts = [restore(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return made.mapInArrow(run, schema)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of fill_in_middle's outputs and of the texts rebuilt from them."""
    return restored(made, id_col).select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
