"""Tokenizer alignment, fill-in-middle and packing against brute force, on edge rows, empty tables and small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from corpusloom.llm import alignment, infill, packing, queries

A, B, W = (public_tokenizers.path(x) for x in (queries.TOKENIZER, "piece_bpe_32k.model", "word_bpe_49k.json"))
SMALL = "/root/testdata/sf0.001"
SCRIPTS = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "　", "▁", "é", "é", "̈", "ß", "İ", "ﬁ", "日本", "한", "하", "🙂", "👩‍👩‍👧", "'s", "'LL", "12", "½", "<s>", "</s>", "<unk>", "<0x41>",
           "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<P>", "<S>", "<M>", "<", "S>", "\x00", "​", "Σ", "ΑΣ ", "the", " The", ".", "--", "_"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(n: int = 250) -> list[tuple[int, str]]:
    r = random.Random(11)
    return [(i, "".join(r.choice(SCRIPTS) for _ in range(r.randrange(1, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*odd_rows(), (None, None), (None, ""), (3, "a  b"), (3, "a  b")], "doc_id long, text string").repartition(3)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 11 --------------------------------------------------------------- alignment


def brute_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {s: x for x, s in alignment.byte_symbols().items()}
    solved, counts = [], Counter()
    for i, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_x = [bytes(byte_of[c] for c in a.id_to_token(t)) if t < 50256 else a.id_to_token(t).encode() for t in x]
        raw_y = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in y]
        if not text or not b"".join(raw_x) == (" " + text).encode() == b"".join(raw_y):
            solved.append((i, [], [], "", []))
            continue
        ends_x, ends_y = np.cumsum([len(t) for t in raw_x]).tolist(), np.cumsum([len(t) for t in raw_y]).tolist()
        at_y = dict(zip(ends_y, y))
        links = [(s, at_y[e]) for s, e in zip(x, ends_x) if e in at_y]
        of_x, of_y, groups, i_x, i_y = list(zip(x, ends_x)), list(zip(y, ends_y)), [], 0, 0
        for end in sorted(set(ends_x) & set(ends_y)):
            j_x, j_y = ends_x.index(end, i_x) + 1, ends_y.index(end, i_y) + 1
            groups.append(",".join(str(t) for t, _ in of_x[i_x:j_x]) + "|" + ",".join(str(t) for t, _ in of_y[i_y:j_y]))
            i_x, i_y = j_x, j_y
        counts.update(links)
        solved.append((i, x, y, ";".join(groups), links))
    highest = defaultdict(int)
    for (_, t), n in counts.items():
        highest[t] = max(highest[t], n)
    out = []
    for i, x, y, groups, links in solved:
        best = sum(counts[k] == highest[k[1]] for k in links)
        out.append((i, len(x), len(y), groups.count("|"), len(links), best, sum(counts[k] for k in links), groups))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("most_pairs", [2_000_000, 40])
def test_alignment_of_odd_texts(odd, most_pairs):
    got = alignment.align_tokenizers(odd, A, B, most_pairs=most_pairs).select(*COLUMNS).collect()
    assert in_order(got) == in_order(brute_alignment(rows_of(odd)))
    assert any(r["n_a"] == 0 and r["doc_id"] is not None for r in got) and any(r["n_groups"] < r["n_a"] for r in got)


def test_alignment_of_edge_rows(edge):
    got = alignment.align_tokenizers(edge, A, B).select(*COLUMNS).collect()
    assert in_order(got) == in_order(brute_alignment(rows_of(edge)))


def test_alignment_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = [(*r[:-1], sha(r[-1]) if r[-1] else "") for r in brute_alignment(rows_of(docs))]
    got = queries.op11_tokenizer_alignment(spark, SMALL)
    assert in_order(got.select(*COLUMNS[:-1], "groups_sha256").collect()) == in_order(want)


def test_components_by_search():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 40)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(0, 50))]
        want = list(range(n))
        for _ in range(n):
            for u, v in edges:
                want[u] = want[v] = min(want[u], want[v])
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        assert alignment.roots(n, u, v).tolist() == want
    chain = np.arange(5_000)
    order = np.random.default_rng(1).permutation(5_001)
    assert set(alignment.roots(5_001, order[chain], order[chain + 1]).tolist()) == {0}


def test_stretches_leave_the_table_and_come_back():
    texts = [t for _, t in odd_rows(60)]
    small, large = alignment.Aligner(A, B, 3), alignment.Aligner(A, B)
    whole = alignment.Aligner(A, B)
    whole.apart = False
    for t in texts + texts:
        one, two, three = (x.align([t])[0] for x in (small, large, whole))
        assert one[:5] == two[:5] == three[:5] and (one[5] == two[5]).all()


# 12 --------------------------------------------------------------- fill in middle


def brute_infill(rows):
    out = []
    for i, text in rows:
        text = text or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(text)
        if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
            out.append((i, n, "plain", None, None, text))
            continue
        p, q = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
        if h4 % 100 < 20:
            out.append((i, n, "spm", p, q - p, "<S>" + text[q:] + "<P>" + text[:p] + "<M>" + text[p:q]))
        else:
            out.append((i, n, "psm", p, q - p, "<P>" + text[:p] + "<S>" + text[q:] + "<M>" + text[p:q]))
    return out


@pytest.mark.parametrize("name", ["odd", "edge"])
def test_infill(name, request):
    docs = request.getfixturevalue(name)
    made = infill.fill_in_middle(docs)
    assert in_order(made.collect()) == in_order(brute_infill(rows_of(docs)))
    assert sorted(r["restored"] for r in infill.restored(made).collect()) == sorted(t or "" for _, t in rows_of(docs))


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_infill_cuts_at_boundaries(odd, unit):
    rows = infill.restored(infill.fill_in_middle(odd, unit=unit, apply=100, suffix_first=50)).collect()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert sorted(r["restored"] for r in rows) == sorted(t or "" for _, t in rows_of(odd))
    cuts = [(r["restored"], k) for r in rows if r["form"] != "plain" for k in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"])]
    if unit == "line":
        assert all(k in (0, len(t)) or t[k - 1] == "\n" for t, k in cuts)
    if unit == "word":
        plain = lambda c: c.isascii() and c.isalnum() or not c.isascii()
        assert not any(0 < k < len(t) and plain(t[k - 1]) and plain(t[k]) for t, k in cuts)


def test_infill_of_an_unknown_unit(odd):
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(odd, unit="page")


def test_infill_equals_sql(spark):
    assert compare.difference(spark, entry, "op12_fill_in_middle", "/root/testdata/sf0.01") is None


# 13 --------------------------------------------------------------- packing


def brute_pieces(rows, capacity):
    library, out = Tokenizer.from_file(W), []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("name, capacity, rows_a_group, fan", [("odd", 64, 20, 2), ("odd", 4096, 7, 3), ("edge", 4096, 50_000, 8), ("edge", 100, 40, 8)])
def test_packing(name, capacity, rows_a_group, fan, request):
    docs = request.getfixturevalue(name)
    rows = packing.pack_documents(docs, W, capacity=capacity, rows_a_group=rows_a_group, fan=fan).collect()
    want = brute_pieces(rows_of(docs), capacity)
    assert in_order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == in_order(want)
    used, least = check_sequences(rows, capacity), -(-sum(w[3] for w in want) // capacity)
    assert least <= used <= least + max(2, least // 10)


def test_packing_of_a_table(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), W, rows_a_group=30).collect()
    want = brute_pieces(rows_of(spark.read.parquet(f"{SMALL}/documents.parquet")), 4096)
    assert in_order((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == in_order(want)
    assert check_sequences(rows, 4096) <= -(-sum(w[3] for w in want) // 4096) + 2


def test_best_fit_is_best_fit():
    r = random.Random(5)
    for _ in range(100):
        capacity = r.choice([10, 100])
        sizes = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 60))]
        bins, offsets, used = packing.best_fit(np.array(sizes, np.int64), capacity)
        rooms: list[int] = []
        for n in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
        assert sorted(capacity - x for x in rooms) == sorted(used.tolist())
        for b in range(len(used)):
            held = sorted((o, n) for o, n, k in zip(offsets.tolist(), sizes, bins.tolist()) if k == b)
            assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        # No two bins of which one is at most half full fit each other: higher rounds have one such bin a group.
        assert sum(2 * u <= capacity for u in used.tolist()) <= 1


def test_higher_rounds_save_the_remainders(spark):
    """Eight groups, each with one short piece too many; hosts are found in other groups."""
    rows = [(i, "a " * 60) for i in range(64)] + [(100 + i, "a " * 30) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flat, deep = (check_sequences(packing.pack_documents(docs, W, capacity=100, rows_a_group=g, fan=2, slack=0).collect(), 100) for g in (1_000, 9))
    assert flat == deep == 64


def test_words_leave_the_table_and_come_back():
    texts = [t for _, t in odd_rows(80)]
    small, library = packing.WordIds(W, 3), Tokenizer.from_file(W)
    assert small.apart
    for t in texts + texts:
        assert small.ids([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_new_words_are_encoded_together():
    """Few calls of the library for many words, also beside words that hold the mark between them."""

    class Counted:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **more)

    library, made = Tokenizer.from_file(W), packing.WordIds(W)
    made.library = Counted(made.library)
    texts = [" ".join(f"w{'xyz'[i % 3]}{i},é'{i % 9}\tq" for i in range(k, k + 2500)) for k in (0, 2000)] + ["a\x01b \x01 \x01\x01 c\x01 \u0301x '\x01 İI\x01", "\x01", ""]
    for t in texts:
        assert made.ids([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
    assert made.library.texts < 100


def test_empty_tables(nothing, spark):
    for got, columns in (
        (alignment.align_tokenizers(nothing, A, B, digest=True), ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
        (infill.digests(infill.fill_in_middle(nothing)), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]),
        (packing.pack_documents(nothing, W), ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
    ):
        assert got.columns == columns and got.count() == 0
