"""String functions with Unicode semantics spelled out, as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space and word characters as Unicode classes (for use inside [...]).
WSC = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
# Words and letter groups that hint at a language.
STOPWORDS = ["el", "la", "los", "las", "de", "del", "y", "que", "no", "me", "mi", "con", "por", "para", "aqui", "ahora", "como", "porque", "una", "un", "en", "se", "yo"]
CLUSTERS = "sh|ku|na|pi|llu|wek|ñi"
DOUBLE_QUOTES = '"“”«»'
# Literals that a CSV reader takes for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WSC}]+|[{WSC}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of two or more blanks become one; a single tab or line end stays."""
    return F.regexp_replace(c, f"[{WSC}]{{2,}}", " ")


def normalize_spaces(c: Column) -> Column:
    return strip(collapse(c))


def comma_space(c: Column) -> Column:
    return F.replace(c, F.lit(" , "), F.lit(", "))


def without_quotes(c: Column) -> Column:
    return F.translate(c, DOUBLE_QUOTES, "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


@functools.cache
def may_change() -> str:
    """A class of the characters that a text not in NFC holds one of: combining marks, those that compose with what is before
    them, and those that are not in NFC themselves; none lies below U+0300."""
    points = [c for c in range(0x300, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    second = {parts[1] for c in points for parts in [unicodedata.decomposition(chr(c)).split()] if len(parts) == 2 and not parts[0].startswith("<")}
    second |= {parts[1] for c in range(0x300) for parts in [unicodedata.decomposition(chr(c)).split()] if len(parts) == 2 and not parts[0].startswith("<")}
    composing = {int(x, 16) for x in second} | set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    found = [c for c in points if c in composing or unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c))]
    spans: list[list[int]] = []
    for c in found:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def nfc(c: Column) -> Column:
    """Only texts that may change are handed to Python: the quick check is an expression, first for characters from U+0300 on."""
    open_ = c.rlike(r"[^\x{0}-\x{2ff}]") & c.rlike(may_change())
    return F.coalesce(_nfc(F.when(open_, c)), c)


def match_key(c: Column) -> Column:
    return strip(F.lower(c))


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"[{WSC}]+"), lambda x: x != "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def clean_text(c: Column) -> Column:
    """Punctuation to blanks, for word vectors; apostrophes and hyphens stay; null becomes ''."""
    return F.coalesce(normalize_spaces(F.regexp_replace(c, r'[!?.,;:¡¿"()“”]', " ")), F.lit(""))


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WSC}]+", "")


def apostrophes(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "'’", ""))


def spanish_score(c: Column) -> Column:
    words = tokens(F.regexp_replace(F.lower(c), f"[^{WORD}]+", " "))
    hits = F.size(F.filter(words, lambda x: x.isin(STOPWORDS)))
    return hits + F.regexp_like(c, F.lit("[áéíóúÁÉÍÓÚ¿¡]")).cast("int") - apostrophes(c)


def other_score(c: Column) -> Column:
    return apostrophes(c) + F.regexp_count(F.lower(c), F.lit(CLUSTERS))


def suspicious(c: Column) -> Column:
    """Up to five distinct characters outside the expected set, sorted."""
    found = F.regexp_extract_all(c, F.lit(rf"([^{WORD}{WSC}'\-.,;:¡!¿?])"), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 5)


def lines(c: Column) -> Column:
    parts = F.split(c, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")
    # A text that ends with a line end has no further line.
    return F.transform(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), strip)


def fixed(c: Column, places: int) -> Column:
    """Rounded on the binary value, as text."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places if places else "0"))


def joined(*issues: Column, sep: str = "; ") -> Column:
    """Non-null issues joined; null if there is none."""
    return F.nullif(F.concat_ws(sep, *issues), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a side is null or zero."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
