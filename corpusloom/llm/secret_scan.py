"""Secrets in texts: three fixed patterns, and strings that look drawn at random.

The second kind is found by two character Markov models of order two, one of random strings and one of ordinary
identifiers, words and numbers, trained from labelled samples. The pieces of a run of identifier characters whose own
log-likelihood ratio is above a threshold are reported, whatever stands beside them in the run. A part of a run that goes on
in a letter, mark or digit outside ASCII is a stretch of a longer word and not judged. Strings of digits alone look like any number,
so the models don't report them. Spans of the fixed patterns always stay; the models only add spans.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, small_handover, worker_keeps

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

_PART = re.compile(r"[^/=_-]+")
_LETTER = re.compile("[A-Za-z]")
_BORDER = "+/=_-"

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = ("0123456789abcdef", _LETTERS + _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789+/", _LETTERS.upper() + "234567", _LETTERS + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789_-")
_WORDS = (
    "account action address after again array batch before begin between block buffer build cache call channel check child city class client clock "
    "close code column command common config connection content context count country create current data date default delete design detail device "
    "direction document domain double element empty encode engine error event example exception export factory false field file filter first float "
    "folder format frame function general global graph group handler header height helper history image import index information input instance integer "
    "interface internal item iterator join kernel label language last layer layout length level library license light limit line link list load local "
    "lock logger main manager mapping market master matrix maximum member memory message method minimum model module month name network node normal number "
    "object offset open option order output owner package page parameter parent parse partition path pattern people percent person place platform point "
    "aber alle auch beim dann dass diese einer freiheit gesellschaft haben ist keit lich machen mit nicht oder schaft sehr sein stadt und ungen verein von zeit "
    "aussi avec beaucoup chez comme dans elle entre est jour leur maison mais ment monde nous pour quelle sont temps tion toujours tout une vous "
    "ahora casa cion como cuando desde donde ella entonces esta hombre los mente mundo muy nosotros para pero porque siempre tiempo todo una vida "
    "that there the then thing and ation ing with would being other hand shore intent blend reason tire stone onto eat hers ness able"
).split()
_ONSETS = "b c d f g h j k l m n p qu r s t v w x y z bl br ch cl cr dr fl fr gl gr ph pl pr sch sh st th tr wh".split()
_VOWELS = "a e i o u ai au ea ee ei eu ia ie io oi ou ui ieu".split()
_CODAS = ["", "", "", *"n r s l t m x z ch ck nd ng ns nt rt sh ss st th ts tz".split()]


def _syllables(r: random.Random) -> str:
    return "".join(r.choice(_ONSETS if r.random() < 0.65 else [""]) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(r.randint(4, 14)))


def _number(r: random.Random) -> str:
    """Digits, digits in groups, or a date with its time."""
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    style = r.randrange(4)
    if style == 0:
        return r.choice("-/_").join(digits(r.randint(2, 6)) for _ in range(r.randint(3, 6)))
    if style == 1:
        return f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(("", f"T{digits(6)}Z", f"T{digits(2)}-{digits(2)}-{digits(2)}", f"_{digits(6)}"))
    return digits(r.randint(8, 40))


#: How often each form of an ordinary sample is drawn.
STYLE_WEIGHTS = (1, 1, 1, 1, 1, 1, 1, 0.1, 0.8)


def labelled_samples(n: int = 16_000, seed: int = 11) -> Iterator[tuple[str, int]]:
    """n random strings (label 1) and n identifiers, paths, rules, joined words, joined syllables, numbers and dates (label 0),
    the same on every call."""
    r = random.Random(seed)
    for _ in range(n):
        yield "".join(r.choices(r.choice(_ALPHABETS), k=r.randint(20, 64))), 1
        words = r.choices(_WORDS, k=r.randint(3, 8))
        style = r.choices(range(9), STYLE_WEIGHTS)[0]
        joined = (
            "_".join(words), "-".join(words), "/".join(words), r.choice((str.lower, str.lower, str.upper))("".join(words)), "".join(w.capitalize() for w in words),
            "_".join(words).upper(), r.choice("=-_") * r.randint(20, 60), _number(r), r.choice((str.lower, str.lower, str.capitalize, str.upper))(_syllables(r)),
        )[style]
        yield joined + (str(r.randint(0, 2030)) if style < 7 and r.random() < 0.3 else ""), 0


class MarkovPair:
    """Log-likelihood ratio of a string under the model of random strings and that of ordinary ones."""

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 0.2):
        counts: tuple[dict, dict] = ({}, {})
        for text, label in samples:
            known = counts[1 if label else 0]
            padded = "\x02\x02" + text
            for i in range(2, len(padded)):
                row = known.setdefault(padded[i - 2 : i], {})
                row[padded[i]] = row.get(padded[i], 0) + 1
        alphabet = {c for known in counts for row in known.values() for c in row}
        m = len(alphabet) + 1
        #: Single-character rates, mixed in where a pair of characters is rare.
        singles = []
        for known in counts:
            total: dict[str, int] = {}
            for row in known.values():
                for c, k in row.items():
                    total[c] = total.get(c, 0) + k
            whole = sum(total.values())
            singles.append({c: (total.get(c, 0) + 1) / (whole + m) for c in alphabet})
        self.default = 0.0
        self.ratio: dict[str, float] = {}
        contexts = {*counts[0], *counts[1]}
        for pair in contexts:
            for c in alphabet:
                p = []
                for known, single in zip(counts, singles):
                    row = known.get(pair, {})
                    p.append((row.get(c, 0) + smoothing * m * single[c]) / (sum(row.values()) + smoothing * m))
                self.ratio[pair + c] = math.log(p[1] / p[0])

    def score(self, text: str) -> float:
        padded, get = "\x02\x02" + text, self.ratio.get
        return sum(get(padded[i - 2 : i + 1], 0.0) for i in range(2, len(padded)))

    def pieces(self, text: str, threshold: float) -> list[tuple[int, int]]:
        """Stretches of a ratio above the threshold, each from its lowest to its highest partial sum; a fall by more
        than the threshold parts two. Each is of whole parts between / = _ - of the text; parts at its ends that count
        against it as a whole are left out, and so are stretches without a letter."""
        padded, get = "\x02\x02" + text, self.ratio.get
        # What follows = begins anew.
        fresh = "\x02\x02" + text.replace("=", "\x02")
        ratios = [get(padded[i : i + 3] if c == "=" else ("\x02\x02" + c if fresh[i + 1] == "\x02" else fresh[i : i + 3]), 0.0) for i, c in enumerate(text)]
        found: list[tuple[int, int]] = []
        total = peak = 0.0
        start = end = 0
        for i, x in enumerate([*ratios, -math.inf]):
            total += x
            if total <= 0 or total < peak - threshold:
                if peak > threshold:
                    found.append((start, end))
                total = peak = 0.0
                start = end = i + 1
            elif total > peak:
                peak, end = total, i + 1
        parts = [(m.start(), m.end()) for m in _PART.finditer(text)] if found else []
        out: list[tuple[int, int]] = []
        at = 0
        for s, e in found:
            while at < len(parts) and parts[at][1] <= s:
                at += 1
            inside = []
            while at < len(parts) and parts[at][0] < e:
                inside.append(parts[at])
                at += 1
            for side in (0, -1):
                while inside and sum(ratios[inside[side][0] : inside[side][1]]) <= 0:
                    inside.pop(side)
            if inside and _LETTER.search(text, inside[0][0], inside[-1][1]):
                out.append((inside[0][0], inside[-1][1]))
        return out


@lru_cache(4)
def default_pair(n: int = 16_000, seed: int = 11) -> MarkovPair:
    return MarkovPair(labelled_samples(n, seed))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping within a kind, then those that fail dropped."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").lower() if ("=" in text or ":" in text) else b""
    if any(k in raw for k in _KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return out


def _in_one_word(c: str) -> bool:
    """Whether a word goes on from an ASCII letter to c: cased letters, marks and digits do that, scripts without case don't."""
    return c > "\x7f" and (c.lower() != c.upper() or unicodedata.category(c)[0] == "M" or c.isdigit())


def _whole_parts(text: str, at: int, stop: int) -> tuple[int, int]:
    """The run at:stop without the part at either end that is a stretch of a longer word."""
    if at and _in_one_word(text[at - 1]):
        while at < stop and text[at] not in _BORDER:
            at += 1
    if stop < len(text) and _in_one_word(text[stop]):
        while stop > at and text[stop - 1] not in _BORDER:
            stop -= 1
    return at, stop


def find_spans(text: str, pair: MarkovPair, threshold: float = 12.0) -> list[tuple[int, str, int]]:
    """Base spans, and the pieces of runs of 16 or more identifier characters with a ratio above the threshold that
    lie outside of them; by start, then kind as in KINDS."""
    out = base_spans(text)
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for s, _, e in out):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    for m in _RUN.finditer(text):
        at, stop = _whole_parts(text, *m.span())
        i = bisect.bisect_right(ends, at)
        # What the base spans leave of the run.
        while at < stop:
            s, e = taken[i] if i < len(taken) else (stop, stop)
            if min(s, stop) - at >= 16:
                out += [(at + a, "markov", at + b) for a, b in pair.pieces(text[at : min(s, stop)], threshold)]
            at, i = max(at, e), i + 1
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def trained(samples: DataFrame | Iterable[tuple[str, int]] | None, most_samples: int = 100_000) -> MarkovPair:
    """The models of labelled samples (text, 1 if drawn at random): at most `most_samples` rows of a table, those of smallest
    hash, without null texts; without samples, of those drawn here."""
    if samples is None:
        return default_pair()
    if isinstance(samples, DataFrame):
        text, label = samples.columns[:2]
        rows = samples.filter(F.col(text).isNotNull()).orderBy(F.xxhash64(text), text, label).limit(most_samples).collect()
        samples = [(r[text], r[label]) for r in rows]
    return MarkovPair(samples)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | list[tuple[str, int]] | None = None, threshold: float = 12.0, redact: str | None = None) -> DataFrame:
    """Spans of secrets in every whole text, in code points with exclusive ends; `samples` go to trained().

    Returns docs' columns and `secret_spans` array<struct<kind,start,end>>; a column of that name in docs is
    replaced. With `redact`, the text's spans are replaced by that string (overlapping spans together by one). A
    null text has no spans and stays null; an empty table gives an empty table; null or repeated ids and rows are kept.
    """
    small_handover(docs.sparkSession)
    keep = [c for c in docs.columns if c != "secret_spans"]
    at = keep.index(text_col)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("secret_spans", T.ArrayType(SPAN))])
    models = docs.sparkSession.sparkContext.broadcast(trained(samples))  # pairs of characters times characters
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("secrets")
        pair = models.value
        for whole in batches:
            for batch in small_batches(whole, text_col):
                texts = batch.column(at).to_pylist()
                spans = [find_spans(t, pair, threshold) if t else [] for t in texts]
                columns = list(batch.columns)
                if redact is not None:
                    columns[at] = pa.array([_redacted(t, s, redact) if s else t for t, s in zip(texts, spans)], batch.schema.field(at).type)
                columns.append(pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans], arrow_span))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "secret_spans"])

    return docs.select(*keep).mapInArrow(run, schema)


def _redacted(text: str, spans: list[tuple[int, str, int]], by: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan_secrets' rows."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(F.concat_ws(",", F.transform(base, one)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secret_spans", one)).alias("spans"),
        count("markov").alias("n_markov"),
    )
