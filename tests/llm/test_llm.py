"""Each operator on edge rows against a brute-force version, on empty tables, and where one is possible on a table."""

import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import compare
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from corpusloom.llm import bpe, common, components, fingerprints, mixing, neighbours, queries, secret_scan, sharding, simhash, substrings, token_counts, toxicity

PATH = public_tokenizers.path(queries.TOKENIZER)
DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edge_rows(edge):
    return [(r["doc_id"], r["text"]) for r in edge.collect()]


def table_rows(spark, name="documents"):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select("doc_id", "text").collect()]


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 ---------------------------------------------------------------- substring dedup


def brute_repeats(rows, span=20):
    in_order = lambda t: (np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64), t)
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *in_order((r[1] or "").encode())))
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - span + 1):
            key = tuple(words[s : s + span])
            if key in seen:
                gone[s : s + span] = [True] * span
            seen.add(key)
        out.append((i, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g).decode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_bytes, fan", [(6_000_000, 4096), (2_000, 4096), (2_000, 3)])
def test_substrings(edge, bucket_bytes, fan):
    got = substrings.digests(substrings.drop_repeats(edge, bucket_bytes=bucket_bytes, fan=fan))
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(edge_rows(edge))


def test_substrings_by_two_hops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = substrings.digests(substrings.drop_repeats(docs, bucket_bytes=20_000, fan=4))
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(table_rows(spark))


def test_rows_of_one_id_and_of_none_are_split(spark):
    r = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(25)) for k in range(12)]
    text = lambda: " ".join(r.choice(passages) if r.random() < 0.3 else f"v{r.randrange(10**6)}" for _ in range(40))
    rows = [(None if i % 3 else 5, text()) for i in range(300)] + [(i, text()) for i in range(60)] + [(None, "")] * 40 + [(5, None), (5, passages[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.digests(substrings.drop_repeats(df, bucket_bytes=3_000))
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    sizes = df.selectExpr("doc_id as id", "octet_length(coalesce(text, '')) as n")
    layout = substrings.Layout.of(sizes, 100, 3_000, 4096)
    assert layout.width[-1] > 10 and layout.width.max() > 10 and layout.last.tolist() == sorted(set(layout.last.tolist()))
    ids = pa.array([4, 5, 5, 6, None, None], pa.int64())
    at = layout.bucket(ids, np.array([0, -(1 << 63), (1 << 63) - 1, 0, -(1 << 63), (1 << 63) - 1]))
    assert at.tolist() == sorted(at.tolist()) and len(set(at.tolist())) == 6


def test_windows_of_one_hash_are_told_apart():
    """Where the first hash of all windows is the same, the second decides."""
    words = [f"w{i}".encode() for i in range(60)]
    b = substrings.Bucket([b" ".join(words), b" ".join(words[:30] + words[:30])], 20)
    want = b.candidates(np.arange(40))
    b.long[:] = 7
    first, second, where, inverse = b.candidates(np.arange(40))
    assert len(set(first.tolist())) == 1 and len(first) == len(want[0]) and (where == want[2]).all()
    assert [second[i] for i in inverse] == [want[1][i] for i in want[3]]
    keys, whose = np.full(6, 7, np.uint64), np.array([0, 1, 2, 0, 1, 2])
    assert substrings._found(2, keys, whose, np.array([1, 1, 2, 3, 3, 2], np.uint32)).tolist() == [False, True, False, False, True, False]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_patterned_words_are_told_apart(spark):
    """Words that collide under every polynomial modulo a power of two."""
    common = [f"w{i}" for i in range(19)]
    odd = [thue_morse(n) for n in (1024, 2048)]
    words = [x for o in odd for x in (o, o.translate(str.maketrans("ab", "ba")))]
    first, second, counts = substrings.word_hashes([" ".join(words).encode()])
    assert len(set(first.tolist())) == len(set(second.tolist())) == 4 and counts.tolist() == [4]
    rows = [(i, " ".join([*common, w])) for i, w in enumerate(words)]
    got = substrings.digests(substrings.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows)
    assert {r["n_removed"] for r in got.collect()} == {0}


def test_tables_have_no_more_buckets_than_spark_allows(spark):
    assert common.table_buckets(spark, 800_000) == 100_000 and common.table_buckets(spark, 7) == 7
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        before = [t.name for t in spark.catalog.listTables()]
        docs = spark.read.parquet(f"{SMALL}/documents.parquet")
        made = substrings.digests(substrings.drop_repeats(docs, bucket_bytes=5_000))
        assert [t.name for t in spark.catalog.listTables()] == before
        assert as_rows(made, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(table_rows(spark))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_empty_tables_give_empty_results(nothing):
    got = substrings.digests(substrings.drop_repeats(nothing))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and got.count() == 0
    got = secret_scan.digests(secret_scan.scan_secrets(nothing))
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and got.count() == 0


def test_texts_are_shuffled_once(spark):
    """After the buckets are stored, no exchange carries texts."""
    plan = substrings.drop_repeats(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not [x for x in plan.split("\n") if "Exchange" in x and "bucket" not in x]
    assert plan.count("Exchange") == 1  # of the answers


def test_substrings_sql(spark):
    assert compare.difference(spark, entry, "op1_substring_dedup", f"{DATA}/sf0.01") is None


# 2 ---------------------------------------------------------------- secrets


def test_secrets(edge):
    got = {r["doc_id"]: r for r in secret_scan.digests(secret_scan.scan_secrets(edge)).collect()}
    assert (got[15]["n_assign"], got[15]["n_access"], got[15]["n_hex"]) == (1, 1, 1)
    assert got[15]["spans"] == "assign:0:49,hex:9:49,access:51:71"
    assert got[15]["base_sha256"] == sha(got[15]["spans"]) and got[2]["base_sha256"] == sha("")
    clean = secret_scan.scan_secrets(edge, redact="[secret]")
    assert clean.columns == [*edge.columns, "secret_spans"] and clean.filter("doc_id = 15").first()["text"] == '[secret]" [secret] x'
    assert clean.filter("doc_id = 2").first()["text"] is None


def test_secret_patterns_follow_the_contract():
    spans = lambda t: [(k, s, e) for s, k, e in secret_scan.base_spans(t)]
    assert spans("é TOKEN: 12345678") == [("assign", 2, 17)]
    assert spans("token=token: abcdefghij") == []  # the failing match takes the second keyword with it
    assert spans("toKen=abcdefghij") == []  # the Kelvin sign is no letter of the pattern
    assert spans("AKIAABCDEFGHIJKL AKIAABCDEFGHIJK") == [("access", 0, 16)]
    assert spans("g" + "a" * 31) == [] and spans("G" + "a" * 32) == [("hex", 1, 33)]


def test_base_spans_by_brute_force(spark):
    """The contract's three patterns as they are written there, over a table."""
    patterns = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    }
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts, total = dict(edge_rows(docs)), Counter()
    for r in queries.op2_secret_scan(spark, f"{DATA}/sf0.01").collect():
        found = [(m.start(), n, k, m.end()) for n, (k, (p, ok)) in enumerate(patterns.items()) for m in p.finditer(texts[r["doc_id"]] or "") if ok(m)]
        spans = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        assert r["base_sha256"] == sha(",".join(spans)) and [x for x in r["spans"].split(",") if x and not x.startswith("markov")] == spans
        counts = Counter(k for _, _, k, _ in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(counts[k] for k in patterns)
        total.update(counts)
    assert len(texts) == 1000 and sum(total.values()) > 10, total


def test_models_of_a_table_of_samples(spark, edge):
    samples = spark.createDataFrame([*secret_scan.labelled_samples(800, seed=5), (None, 1)], "text string, label int")
    drawn, ordinary = "Zk3vQ9xT2mLp7Rw8Yb4NdGhpcyBp", "some_ordinary_identifier_name"
    for rows in (samples, list(secret_scan.labelled_samples(800, seed=5))):
        pair = secret_scan.trained(rows)
        assert pair.score(drawn) > 12 > pair.score(ordinary)
    docs = spark.createDataFrame([(1, f"see {drawn} and {ordinary}")], "doc_id long, text string")
    assert secret_scan.digests(secret_scan.scan_secrets(docs, samples=samples)).first()["spans"] == f"markov:4:{4 + len(drawn)}"


def test_markov_models_tell_held_out_samples_apart():
    pair = secret_scan.default_pair()
    held = list(secret_scan.labelled_samples(1000, seed=99))
    flagged = {y: np.mean([pair.score(t) > 12 for t, label in held if label == y]) for y in (0, 1)}
    assert flagged[1] > 0.95 and flagged[0] < 0.002
    drawn = "dGhpcyBpcyBhIHRlc3Q5OTg3NjU0MzIx"
    found = secret_scan.find_spans(f"key {drawn} and some_ordinary_identifier_name", pair)
    assert [(k, s, e) for s, k, e in found] == [("markov", 4, 4 + len(drawn))]


def test_numbers_and_stretches_of_words_are_no_secrets(spark):
    pair, r = secret_scan.default_pair(), random.Random(3)
    spans = lambda t: [t[s:e] for s, k, e in secret_scan.find_spans(t, pair) if k == "markov"]
    numbers = ["".join(r.choices("0123456789", k=r.randint(16, 40))) for _ in range(300)]
    assert not any(map(spans, [*numbers, "2024-05-17T10-22-31", "20240517_102231_0001", "4026-0839-7753-1332"]))
    secret = "Zk3vQ9xT2mLp7Rw8Yb4NdGhpcyBp"
    # A part that goes on in an accented letter is a stretch of a word; the parts beyond a border are not.
    assert spans(f"é{secret}") == spans(f"{secret}ñ") == spans(f"{secret}\u0301") == []
    assert spans(f"contraseña={secret}") == spans(f"密钥{secret}密钥") == spans(f"{secret}/leído") == [secret]
    # Whole documents with one string planted in each: it is found in every one, and next to nothing else is.
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", F.concat("text", F.lit(f" {secret} é{secret}\n"), F.lit("4845168114407329")).alias("text"))
    scanned = secret_scan.scan_secrets(docs.filter("text is not null")).collect()
    pieces = [[r["text"][s["start"] : s["end"]] for s in r["secret_spans"] if s["kind"] == "markov"] for r in scanned]
    assert len(scanned) > 900 and all(p.count(secret) == 1 for p in pieces)
    assert sum(len(p) - 1 for p in pieces) <= 1, [p for p in pieces if len(p) > 1]


def test_secrets_among_words_of_one_run():
    pair, r = secret_scan.default_pair(), random.Random(8)
    spans = lambda t: [t[s:e] for s, k, e in secret_scan.find_spans(t, pair) if k == "markov"]
    drawn = ["".join(r.choices(secret_scan._ALPHABETS[1], k=24)) for _ in range(200)]
    for form in ("{}", "action/module/{}", "action/module/user/home/{}", "name={}", "client_key={}", "{}/module/action", "see action/{}/module."):
        assert np.mean([spans(form.format(d)) == [d] for d in drawn]) >= 0.9, form
    a, b = "dGhpcyBpcyBhIHRlc3Q5OTg3", "Zk3vQ9xT2mLp7Rw8Yb4N"
    assert spans(f"action/{a}/module/user/home/handler/{b}") == [a, b]
    short = ["".join(r.choices(r.choice(secret_scan._ALPHABETS), k=16)) for _ in range(400)]
    assert np.mean([bool(spans(d)) for d in short]) >= 0.85  # 16 characters tell less than 24
    assert spans("0123456789abcdef" * 2 + f"/module/{b}") == [b]  # beside a fixed pattern in one run
    assert spans("action/module/user/home/list_of_documents") == []


# 3 ---------------------------------------------------------------- neighbours


def test_neighbours_on_edges(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100, [0.0] * 4), (101, None), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan")] * 4), (104, [1.0]), (None, [1.0] * 4), (200, rows[0][1]), (300, rows[0][1]), (301, rows[0][1]), (302, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = as_rows(neighbours.nearest_neighbours(df, every=100), "query_id", "rank", "vec_id", "score")
    valid = [(i, v) for i, v in rows if i is not None and i not in (100, 101, 102, 103, 104)]
    want = []
    for q, v in valid:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(c)) ** 2).sum())), i) for i, c in valid if i != q)[:10]
            want += [(q, k + 1, i, s) for k, (s, i) in enumerate(near)]
    assert got == sorted(want, key=repr)
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


def clustered(n, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(24, 16))[r.integers(0, 24, n)] * 4 + r.normal(size=(n, 16))


def test_partitions_are_balanced_and_recall_holds():
    x = clustered(6000)
    part = neighbours.balanced_parts(neighbours.neighbour_graph(x.astype(np.float32), 10), 8)
    assert np.bincount(part).max() - np.bincount(part).min() <= 3
    tree = neighbours.Tree(neighbours.cut(x[:5000], 16, 10))
    visits = neighbours.visits_for(tree, x[5000:], x[:5000], 10, 0.97)
    ranked, home = np.argsort(-tree.scores(x), axis=1), tree.home(x)
    near = neighbours.neighbour_graph(x, 10)
    recall = np.mean([[home[n] in ranked[q, :visits] for n in near[q]] for q in range(5000, 6000)])
    assert tree.leaves == 16 and visits <= 5 and recall >= 0.95
    assert [neighbours.wanted_parts(n) for n in (1, 500, 2000, 51_282, 10**9)] == [2, 4, 8, 64, 8192]


def recall_of(got, ids, x, every=100):
    want = {(q, c) for q, c, _ in neighbours.exact_nearest(x[ids % every == 0], x, ids[ids % every == 0], ids, 10)}
    return len(got & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_table(spark, sf):
    got = {(r["query_id"], r["vec_id"]) for r in queries.op3_nearest_neighbours(spark, f"{DATA}/{sf}").collect()}
    v = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").toPandas()
    assert recall_of(got, v["vec_id"].to_numpy(), np.stack(v["embedding"]).astype(float)) >= 0.9


def test_repeated_ids_over_several_partitions(spark):
    """Rows of a query's own id are no candidates, repeated rows are each one, and k rows come of partitions that hold fewer."""
    x = clustered(300, 4)
    ids = np.arange(300) % 130 * 50
    x[260:] = x[130:170]  # whole rows again
    got = defaultdict(list)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for r in neighbours.nearest_neighbours(df, parts=16, wanted=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and all([n for n, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    exact = 0
    for q, rows in got.items():
        own = min((x[ids == q]).tolist())
        want = sorted((float(np.sqrt(((c - own) ** 2).sum())), int(i)) for i, c in zip(ids, x) if i != q)[:10]
        assert all(i != q for _, i, _ in rows)
        exact += [i for _, i, _ in sorted(rows)] == [i for _, i in want]
    assert exact >= 0.9 * len(got)


@pytest.mark.parametrize("options", [{}, {"parts": 32, "most_parts": 4, "block": 300}])
def test_neighbours_of_clusters_by_few_partitions(spark, options):
    """One and two levels of partitions, small blocks; a vector that many ids share; fewer rows than k in a partition."""
    x = clustered(4000, 2)
    x[500:900] = x[7]
    ids = np.arange(4000) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_neighbours(df, **options).collect()
    assert Counter(Counter(r["query_id"] for r in rows).values()) == {10: 200}
    own = {(r["query_id"], r["vec_id"]): r["score"] for r in rows}
    assert recall_of(set(own), ids, x) >= 0.9
    assert all(s == pytest.approx(np.sqrt(((x[q // 5] - x[c // 5]) ** 2).sum()), abs=1e-12) for (q, c), s in own.items())


# 4, 8 ------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec(spark, edge, nothing, library):
    for df in (edge, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = as_rows(bpe.digests(bpe.encode_and_decode(df, PATH)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        want = []
        for i, text in edge_rows(df):
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want, key=repr)
    assert bpe.encode_and_decode(nothing, PATH).count() == 0


def odd_texts(n, seed):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "'s", "re", "v", "é", "a1", "! ", "\U0001f600", "the", " of", "<|endoftext|>", "՘", "\x85"]
    return ["".join(r.choice(parts) for _ in range(r.choice([5, 60, 200]))) for _ in range(n)]


def test_chunk_joins_agree_with_whole_texts(library, monkeypatch):
    for name, value in (("SHORTEST", 4), ("MASK", 7), ("LONGEST", 40)):
        monkeypatch.setattr(bpe, name, value)
    c, texts = bpe.ChunkCodec(PATH), odd_texts(600, 1)
    assert [x.tolist() for x in c.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert c.repaired > 1000 and c.reused > 0


def test_shared_passages_are_encoded_once():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(3000))
    c = bpe.ChunkCodec(PATH)
    c.encode([f"{word()} {passage}"])
    before = c.encoded
    c.encode([f"{word()} {word()} {passage} {word()}"])
    assert c.encoded - before <= 3 and c.reused >= 5


def test_token_counts(spark, edge, nothing, library):
    for df in (edge, spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")):
        got = as_rows(token_counts.count_tokens(df, PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
        want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in edge_rows(df)]
        assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(nothing, PATH).count() == 0


def test_merges_agree_with_the_library(library):
    m = token_counts.PairMerger(PATH, kept=50)
    for t in [*odd_texts(400, 2), "x" * 3000, "ab" * 2000, " " * 500 + "q"]:
        assert m.count(t) == len(library.encode(t, add_special_tokens=False).ids)


# 5 ---------------------------------------------------------------- mixing


def plain_targets(sources, cap):
    """(key, weight, size) of each source -> target."""
    total, free, out = float(sum(s for _, _, s in sources)), list(sources), {}
    while free:
        weights = sum(w for _, w, _ in free)
        full = [x for x in free if total * x[1] / weights > cap * x[2]]
        if not full:
            out |= {k: total * w / weights for k, w, _ in free}
            break
        out |= {k: float(cap * s) for k, _, s in full}
        total -= sum(cap * s for _, _, s in full)
        free = [x for x in free if x not in full]
    return out


def test_targets_stop_at_the_cap(spark):
    r = random.Random(6)
    cases = [[100, 100, 100], [900, 50, 50], [1, 5, 1000, 0, 7], [r.randint(0, 10 ** r.randint(0, 6)) for _ in range(300)], [0, 0]]
    for sizes in cases:
        rows = [(i, (1, 2, 3)[i % 3], s) for i, s in enumerate(sizes)]
        got = mixing.with_targets(spark.createDataFrame(rows, "ordinal long, weight int, source_size long"), 3)
        assert {x["ordinal"]: pytest.approx(x["target"], abs=1e-6) for x in got.collect()} == plain_targets(rows, 3)
    assert plain_targets([(0, 1, 900), (1, 2, 50), (2, 3, 50)], 3) == {0: 700.0, 1: 150.0, 2: 150.0}


def test_sources_are_ordered_by_code_point(spark):
    names = [None, "", "a", "A", "Z", "ä", "z", "\uffee", "\U0001f600", *(f"s{i}" for i in range(500))]
    got = mixing.ordered(spark.createDataFrame([(n,) for n in names], "__source string")).collect()
    assert [x["__source"] for x in sorted(got, key=lambda x: x["ordinal"])] == [*sorted(names[1:]), None]
    assert sorted(x["ordinal"] for x in got) == list(range(len(names)))


def solved(sizes, target, cap):
    """lambda by halving, from the documents one by one."""
    low, high = -60.0, np.log(cap)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (low, mid) if (sizes * np.minimum(cap, np.exp(np.minimum(mid * sizes, 5)))).sum() > target else (mid, high)
    return low


def test_newton_solves_the_dual(spark):
    r = np.random.default_rng(3)
    docs = {k: np.concatenate([r.integers(1, 400, 60), [1, 20_000]]) for k in range(9)}
    shares = (0.001, 0.3, 0.97, 1.0, 1.3, 2.5, 2.99, 3.0, 1e-9)
    wanted = {k: float(shares[k] * docs[k].sum()) for k in docs}
    sizes = spark.createDataFrame([(k, int(s), int(n)) for k, d in docs.items() for s, n in zip(*np.unique(d, return_counts=True))], "ordinal long, size long, n long")
    sources = spark.createDataFrame([*wanted.items(), (50, 7.0), (51, 0.0)], "ordinal long, target double")
    got = {x["ordinal"]: x["lam"] for x in mixing.balance(sizes, sources, 3).collect()}
    assert set(got) == set(docs)
    for k, d in docs.items():
        rates = lambda lam: np.minimum(3, np.exp(np.minimum(lam * d, 5)))
        assert (d * rates(got[k])).sum() == pytest.approx(wanted[k], rel=1e-8)
        assert np.allclose(rates(got[k]), rates(solved(d, wanted[k], 3)), atol=1e-6)


def test_documents_are_tilted_by_their_words(spark):
    """On a table: copies are the solver's rates rounded up or down, but for the few that settle what is left over."""
    rows = mixing.mix_sources(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), pool=8).collect()
    sizes, off = defaultdict(list), 0
    for r in rows:
        sizes[r["source"]].append(r["size"])
    for name, all_sizes in sizes.items():
        own = [r for r in rows if r["source"] == name]
        d = np.array([s for s in all_sizes if s], float)
        lam = solved(d, own[0]["target"], 3)
        assert (d * np.minimum(3, np.exp(np.minimum(lam * d, 5)))).sum() == pytest.approx(own[0]["target"], rel=1e-6)
        for r in own:
            rate = min(3, np.exp(min(lam * r["size"], 5))) if r["size"] else 0
            off += not np.floor(rate - 1e-6) <= r["copies"] <= np.ceil(rate + 1e-6)
    assert off <= 8 * len(sizes) and len({r["copies"] for r in rows}) >= 3


def test_mixing(spark, edge, nothing):
    got = mixing.mix_sources(edge, keep_columns=False)
    rows = got.collect()
    assert len(rows) == edge.count() and got.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    sizes = Counter()
    for r in edge.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = plain_targets([(n, (1, 2, 3)[i % 3], sizes[n]) for i, n in enumerate(names)], 3)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(edge, keep_columns=False).collect()))
    assert set(mixing.mix_sources(edge).columns) >= set(edge.columns) and mixing.mix_sources(nothing).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = queries.op5_source_mixing(spark, f"{DATA}/sf0.1").withColumn("source_target", F.col("target"))
    for r in rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.001 * r["target"]


# 6 ---------------------------------------------------------------- toxicity


def test_block_max_neighbours_are_exact():
    r = np.random.default_rng(5)

    def drawn(n, terms):
        out = []
        for _ in range(n):
            t = np.sort(r.choice(terms, r.integers(1, 6), replace=False))
            w = r.random(len(t)) + 0.1
            out.append((t, w / np.sqrt((w * w).sum())))
        return out

    vectors = drawn(500, 30)
    vectors[77] = vectors[401] = vectors[3]
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    vectors.sort(key=lambda v: v[0][np.argmax(v[1])])
    dense = np.stack([np.bincount(t, w, 40) for t, w in vectors])
    for common in (0, 7, 100):
        index = toxicity.BlockMaxIndex(vectors, 40, block=16, common=common)
        queries = drawn(300, 32)
        for (t, w), (near, cosines) in zip(queries, index.nearest(queries, 7)):
            all_cosines = np.round(dense[:, t] @ w, 10)
            want = [i for i in np.lexsort((np.arange(500), -all_cosines)) if all_cosines[i] > 0][:7]
            assert near.tolist() == want and np.allclose(cosines, all_cosines[want], atol=1e-9)
        assert common != 100 or index.skipped > index.scored


def test_toxicity_by_brute_force(spark):
    """Scores' order and evidence against plain cosines over all words and all labelled examples."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    marked = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    texts = {r["doc_id"]: Counter("".join(c if unicodedata.category(c)[0] == "L" else " " for c in (r["text"] or "").lower()).split()) for r in docs.collect()}
    groups = defaultdict(list)
    for i in sorted(set(texts) & set(marked)):
        groups[tuple(sorted(texts[i].items()))].append(i)
    held, bad = Counter(), Counter()
    for key, ids in groups.items():
        held.update(w for w, _ in key)
        if 2 * sum(marked[i] for i in ids) >= len(ids):
            bad.update(w for w, _ in key)
    n, n1 = len(groups), sum(2 * sum(marked[i] for i in ids) >= len(ids) for ids in groups.values())
    df = Counter(w for c in texts.values() for w in c)
    weight = {}
    for w in held:
        table = [(bad[w], held[w] * n1 / n), (held[w] - bad[w], held[w] * (n - n1) / n), (n1 - bad[w], (n - held[w]) * n1 / n), (n - n1 - held[w] + bad[w], (n - held[w]) * (n - n1) / n)]
        g = 2 * sum(o * np.log(o / e) for o, e in table if o and e)
        weight[w] = (np.log((len(texts) + 1) / (df[w] + 1)) + 1) * (0.05 + min(1, max(0, (max(g, 0) ** 0.5 - 3.5) / 2)))

    def unit(counts):
        v = {w: (1 + np.log(c)) * weight[w] for w, c in counts.items() if w in weight}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    examples = [(min(ids), unit(dict(key))) for key, ids in groups.items() if key]
    for r in toxicity.toxicity_scores(docs, labels).collect():
        own = unit(texts[r["doc_id"]])
        cosines = sorted((-sum(x * v.get(w, 0) for w, x in own.items()) for _, v in examples))
        got = [float(x.split(":")[1]) for x in r["evidence"].split(",") if x]
        assert got == [pytest.approx(-c, abs=6e-5) for c in cosines[:3] if c < -1e-10]
        of = {i: v for i, v in examples}
        for i, c in (x.split(":") for x in r["evidence"].split(",") if x):
            assert float(c) == pytest.approx(sum(x * of[int(i)].get(w, 0) for w, x in own.items()), abs=6e-5)


def test_toxicity_on_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 0), (5, None), (6, 1), (6, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert toxicity.toxicity_scores(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity_scores(edge, labels.limit(0)).collect()} == {0.0}
    both = toxicity.with_toxicity(edge, labels)
    assert sorted((str(r["doc_id"]), r["score"]) for r in both.collect()) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_toxic_words_of_a_rare_language(spark):
    kept = [i for i in range(27_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = {i: f"vile{i % 40} common{i % 7} row" for i in kept[:1700]} | {i: f"skrald mog{n % 2} raekke" for n, i in enumerate(kept[1700:1708])}
    clean = {i: f"word{i % 50} common{i % 7} row" for i in kept[1708:]}
    docs = spark.createDataFrame([*(toxic | clean).items(), (30_000, "skrald mog1 huset"), (30_001, "word1 huset row")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1) for i in toxic), *((i, 0) for i in clean)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).filter("doc_id >= 30000").collect()}
    assert got == {30_000: 1, 30_001: 0}


def test_toxicity_on_held_out_rows(spark):
    scored = queries.op6_toxicity(spark, f"{DATA}/sf0.1").join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    up, down = (scored[scored["toxic"] == y]["score"].to_numpy() for y in (1, 0))
    assert np.mean([(down < u).mean() + 0.5 * (down == u).mean() for u in up]) > 0.93
    hit = scored[scored["predicted"] == 1]
    assert hit["toxic"].mean() > 0.9 and scored[scored["toxic"] == 1]["predicted"].mean() > 0.85


# 7 ---------------------------------------------------------------- sharding


def plain_best_fit(sizes, capacity):
    """The bin of each size, by a scan over all bins."""
    bins, out = [], []
    for s in sizes:
        fit = min((b for b in range(len(bins)) if bins[b] >= s), key=lambda b: (bins[b], b), default=None)
        if fit is None:
            bins.append(capacity)
            fit = len(bins) - 1
        bins[fit] -= s
        out.append(fit)
    return out


def one_by_one(segments):
    return [b for _, _, n, b in sorted(segments, key=lambda x: (-x[0], x[1])) for _ in range(n)]


def test_best_fit_agrees_with_a_plain_scan():
    r = random.Random(7)
    for most, n in ((60, 400), (8, 900), (100, 50), (1, 7)):
        sizes = sorted((r.randint(1, most) for _ in range(n)), reverse=True)
        runs = sorted(Counter(sizes).items(), reverse=True)
        assert one_by_one(sharding.best_fit_decreasing(runs, 100)) == plain_best_fit(sizes, 100)


def test_groups_above_a_fair_share_fill_shards_alone():
    assert one_by_one(sharding.pack([(100, 3), (1, 30)], 5)) == [0, 1, 2, *[3] * 15, *[4] * 15]
    assert one_by_one(sharding.pack([(100, 1)], 5)) == [0]
    assert one_by_one(sharding.pack([(10, 8)], 4)) == [0, 0, 1, 1, 2, 2, 3, 3]


@pytest.mark.parametrize("sf, rows_a_cell", [("sf0.01", 1_000_000), ("sf0.1", 1_000_000), ("sf0.01", 1)])
def test_every_group_is_packed(spark, sf, rows_a_cell):
    """Each group's shard is that of a plain best fit over all groups, with the least capacity that suffices (to 1/20000)."""
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    groups = Counter(r["text"] for r in docs.select("text").collect())
    size = {t: n * (len((t or "").encode()) + 16) for t, n in groups.items()}
    order = sorted(groups, key=lambda t: (-size[t], hashlib.sha256(t.encode()).digest() if t is not None else b""))
    sizes = [size[t] for t in order]
    shard = {r["text"]: r["shard"] for r in sharding.assign_shards(docs, rows_a_cell=rows_a_cell).join(docs.select("doc_id", "text"), "doc_id").select("text", "shard").distinct().collect()}
    assert len(shard) == len(groups)
    total = sum(sizes)
    for step in range(200):
        capacity = max(sizes[0], -(-total // 40)) + step * (max(sizes[0], -(-total // 40)) // 20_000 + 1)
        if max(plain_best_fit(sizes, capacity)) < 40:
            break
    held = Counter()
    for t in groups:
        held[shard[t]] += size[t]
    assert max(held.values()) <= capacity + capacity // 10_000
    runs = sorted(Counter(sizes).items(), reverse=True)
    assert [shard[t] for t in order] == one_by_one(sharding.pack(runs, 40))
    assert plain_best_fit(sizes, max(held.values()))[:200] == [shard[t] for t in order][:200] or max(held.values()) != capacity


def test_one_text_in_all_rows(spark):
    rows = sharding.assign_shards(spark.range(5000).selectExpr("id as doc_id", "'same' as text")).collect()
    assert {r["shard"] for r in rows} == {0} and sorted(r["slot"] for r in rows) == list(range(5000))


@pytest.mark.parametrize("source", ["edge", "table"])
def test_shards(spark, edge, source):
    df = edge if source == "edge" else spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    rows = sharding.assign_shards(df, shards=40).collect()
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in edge_rows(df))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    shards, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        shards[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if source == "table":
        assert all(len(s) == 1 for s in of_text.values())
        assert len(shards) == 40 and max(shards.values()) < 1.01 * min(shards.values())


def test_no_rows_no_shards(nothing):
    assert sharding.assign_shards(nothing).count() == 0


# 9 ---------------------------------------------------------------- fingerprints


def paragraphs(text):
    return {p for line in text.split("\n") if line for p in (re.split(r"(?<=[.!?]) ", line) if len(line) > 240 else [line])}


@pytest.mark.parametrize("source", ["edge", "table"])
def test_fingerprints(spark, edge, source):
    df = edge if source == "edge" else spark.read.parquet(f"{SMALL}/documents.parquet")
    got = as_rows(fingerprints.digests(fingerprints.fingerprints(df)), "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")
    rows = sorted(((i, t or "") for i, t in edge_rows(df)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        a, b, c = map(paragraphs, (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i, len(text), sha(edited), like(a, b), like(a, c)))
    assert got == sorted(want, key=repr)


def test_equal_texts_have_equal_fingerprints(edge, nothing):
    got = fingerprints.fingerprints(edge).groupBy(F.col("doc_id").isin(16, 17).alias("same")).agg(F.countDistinct("fingerprint").alias("n")).collect()
    assert {r["same"]: r["n"] for r in got if r["same"] is not None}[True] == 1
    assert fingerprints.fingerprints(nothing).count() == 0


def test_peeling_recovers_or_retries(spark):
    sets = [(list(range(n)), list(range(m, n + k))) for n, m, k in ((3, 1, 2), (40, 5, 30), (300, 100, 200), (0, 0, 3), (5, 0, 0))]
    df = spark.createDataFrame(sets, "p array<long>, q array<long>").selectExpr("size(p) as n", "transform(p, x -> xxhash64(x)) as a", "transform(q, x -> xxhash64(x)) as b")
    df = df.withColumn("ca", F.expr(fingerprints.sketch_sql("a"))).withColumn("cb", F.expr(fingerprints.sketch_sql("b")))
    got = [r["near"] for r in fingerprints.with_likeness(df, "near", "a", "b", "ca", "cb").collect()]
    assert sorted(got) == sorted(len(set(p) & set(q)) / len(set(p) | set(q)) for p, q in sets)


# 10 --------------------------------------------------------------- SimHash


def brute_components(rows):
    def print_of(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, f"{prints[i]:016x}", smallest[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash(spark, edge, nothing):
    for df in (edge, spark.read.parquet(f"{SMALL}/documents.parquet")):
        assert as_rows(simhash.simhash_components(df), "doc_id", "fingerprint", "component_id") == brute_components(edge_rows(df))
    assert simhash.simhash_components(nothing).count() == 0


def brute_survivors(rows, words=5, similarity=0.8):
    """The smallest id of each group of texts that chains of 0.8 of common five-word shingles connect."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[tuple((t or "").encode().lower().split())].append(i)
    texts = list(groups)
    shingles = [{ws[i : i + words] for i in range(max(1, len(ws) - words + 1))} if ws else set() for ws in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holds = defaultdict(set)
    for i, x in enumerate(shingles):
        for one in x:
            holds[one].add(i)
    for i, x in enumerate(shingles):
        for j in {j for one in x for j in holds[one] if j < i}:
            if len(x & shingles[j]) >= similarity * len(x | shingles[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, ws in enumerate(texts):
        least[find(i)] += groups[ws]
    return {min(ids) for ids in least.values()}


def test_near_copies_are_found_and_others_kept(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklm", k=r.randint(2, 6)))
    rows = []
    for g in range(150):
        base = [word() for _ in range(r.choice([60, 150, 600]))]
        for copy in range(4):  # the fourth differs in one word of eight
            ws = list(base)
            for at in r.sample(range(len(ws)), 0 if not copy else len(ws) // (8 if copy == 3 else 55)):
                ws[at] = word()
            rows.append((4 * g + copy, " ".join(ws).upper() if copy == 2 else "  ".join(ws)))
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_survivors(rows)
    assert want <= kept and len(kept - want) <= 0.05 * (600 - len(want)) and 600 - len(want) > 250


def test_links_that_fail_hide_no_others(spark):
    """Texts of nearly the same words in two orders: every pair is proposed, and only those of one order hold."""
    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklm", k=9))
    rows = []
    for g in range(40):
        base = [word() for _ in range(400)]
        for order in range(2):
            r.shuffle(base)
            for copy in range(3):
                ws = list(base)
                if copy:
                    a, b = r.sample(range(len(ws)), 2)
                    ws[a], ws[b] = ws[b], ws[a] if g % 2 else word()
                rows.append((len(rows), " ".join(ws)))
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == brute_survivors(rows) and len(kept) == 80


def test_pairs_looked_at_grow_with_the_texts_of_a_group(spark, monkeypatch):
    """One group of near texts, half of which are too far from each other to hold: pairs that can't hold are not looked at."""
    looked, same_text = [], simhash._same_text
    monkeypatch.setattr(simhash, "_same_text", lambda texts, links, *more: (looked.append(links.count()), same_text(texts, links, *more))[1])
    r = random.Random(31)
    base, word = [f"word{i}" for i in range(150)], lambda: "".join(r.choices("abcdefghijklm", k=9))
    rows = []
    for i in range(400):
        ws = list(base)
        for at in r.sample(range(150), i % 9):
            ws[at] = word()
        rows.append((i, " ".join(ws)))
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == brute_survivors(rows) and 100 < len(kept) < 300
    assert len(looked) == 3 and looked[2] < 5 * len(rows)


def test_crowded_sketches_are_divided_again(spark):
    r = random.Random(13)
    base = [r.getrandbits(64) for _ in range(simhash.SKETCH)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    near = lambda flips: [signed(b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, flips)))) for b in base]
    sketches = [near(4) for _ in range(300)] + [[signed(r.getrandbits(64)) for _ in base] for _ in range(50)]
    df = spark.createDataFrame(sketches, simhash._FPS)
    got = [simhash.sketch_links(df, most=most).collect() for most in (512, 20)]
    for links in got:
        root = {tuple(x): tuple(x) for x in sketches}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x in links:
            a, b = tuple(x)[: simhash.SKETCH], tuple(x)[simhash.SKETCH : -1]
            assert sum(((p ^ q) & ((1 << 64) - 1)).bit_count() for p, q in zip(a, b)) == x["apart"] <= 44
            root[find(a)] = find(b)
        assert len({find(tuple(x)) for x in sketches}) == 51 and len(links) < 300 * 24


def test_one_of_each_keeps_a_row_of_every_component(spark):
    rows = [(None, "alpha beta gamma delta"), (None, "red green blue black white"), (None, "red green blue black white"), (None, None), (7, "one two three four"), (7, "north south east west"), (7, "north south east west"), (8, "one two three four"), (9, ""), (None, "one  TWO three four"), (None, "one two three four")]
    rows += [(11, "p q r s"), (11, "p  q r s")]  # one component and id, two texts
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).repartition(3)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    want = [(7, "north south east west"), (7, "one two three four"), (9, ""), (11, "p  q r s"), (None, "alpha beta gamma delta"), (None, "red green blue black white")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.one_of_each(df.filter("text like '%o  TWO%' or text is null or doc_id is null")).count() == 4


@pytest.mark.parametrize("most", [2048, 8])
def test_links_of_crowded_fingerprints(spark, most):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    roots = {x["a"]: x["b"] for x in components.stars(links).collect()}
    groups = defaultdict(set)
    for v in signed:
        groups[roots.get(v, v)].add(v)
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in signed:
        for b in signed:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                parent[find(a)] = find(b)
    want = defaultdict(set)
    for v in signed:
        want[find(v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_stars_on_a_chain(spark):
    chain = spark.range(200).selectExpr("id * 7 % 1009 as a", "(id + 1) * 7 % 1009 as b")
    got = components.stars(chain.unionByName(spark.createDataFrame([(5000, 5000), (6000, 5001)], "a long, b long")))
    assert {r["b"] for r in got.collect()} == {0, 5001} and got.count() == 201


# pipeline ---------------------------------------------------------


def test_pipeline_stages_on_edges(spark, edge, nothing):
    for df in (edge, nothing):
        docs, kept = df, {}
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).persist()
            kept[name] = docs.count()
            if name != "bpe":
                assert docs.columns == df.columns and docs.schema.simpleString() == df.schema.simpleString()
            if df is edge and name == "toxicity":
                assert as_rows(docs, "doc_id", "text") == as_rows(df, "doc_id", "text")  # none of them is toxic
            if df is edge and name == "near-duplicates":
                numbered = {10**9 + n if i is None else i: (i, t) for n, (i, t) in sorted(enumerate(edge_rows(df)), reverse=True)}
                assert as_rows(docs, "doc_id", "text") == sorted((numbered[i] for i in brute_survivors([(n, t) for n, (_, t) in numbered.items()])), key=repr)
            if df is edge and name == "secrets":
                assert docs.filter("doc_id = 15").first()["text"] == '[secret]" [secret] x'
    assert set(kept.values()) == {0}


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").persist()
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_toxicity(spark, SMALL).collect()}
    one = corpus_pipeline.drop_toxic(spark, docs, SMALL).persist()
    assert {r["doc_id"] for r in one.collect()} == {i for i, p in scores.items() if p == 0}
    two = corpus_pipeline.drop_near_copies(spark, one, SMALL).persist()
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(brute_survivors(edge_rows(one)))
    three = corpus_pipeline.redact_secrets(spark, two, SMALL).persist()
    pair = secret_scan.default_pair()
    want = {i: secret_scan._redacted(t, s, "[secret]") if (s := secret_scan.find_spans(t, pair)) else t for i, t in edge_rows(two)}
    assert dict(edge_rows(three)) == want and all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = corpus_pipeline.mix(spark, three, SMALL).persist()
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(three).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({i: c for i, c in copies.items() if c})
    library = Tokenizer.from_file(PATH)
    five = corpus_pipeline.encode(spark, four, SMALL)
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in five.collect()) == sorted((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in edge_rows(four))


def test_stored_tables_need_a_shared_folder(spark):
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master, None))
        assert common.shared_dir(session(master, "hdfs://a/b/")) == "hdfs://a/b"
    assert os.path.isabs(common.shared_dir(session("local[4]", None)))
    table = common.stored(spark.range(3))
    assert os.path.isdir(table._stored_at) and table.count() == 3
    common.discard(table)
    assert not os.path.exists(table._stored_at)


def test_no_operator_kind_besides_the_ten():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 10
