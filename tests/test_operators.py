import glob
import hashlib
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import audit, embed, extract, ids, latent, lookup, popular, postings, prepare, quantiles, skipgram, vectors, vocabulary
from corpusloom.sources import tables

PAIRS = "pair_id string, ESP string, SHIWILU string"


def col(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


odd = st.text(alphabet="ab é'’\"“ ,.;\t\n ​　İZ(1)", max_size=30)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(odd, min_size=20, max_size=40))
def test_text_functions_agree_with_python(spark, values):
    assert col(spark, values, tx.strip) == [v.strip() for v in values]
    assert col(spark, values, tx.collapse) == [re.sub(r"\s{2,}", " ", v) for v in values]
    assert [list(x) for x in col(spark, values, tx.tokens)] == [v.split() for v in values]
    assert col(spark, values, tx.nfc) == [unicodedata.normalize("NFC", v) for v in values]
    assert [list(x) for x in col(spark, values, tx.lines)] == [[x.strip() for x in v.splitlines()] for v in values]
    found = [sorted(set(re.findall(r"[^\w\s'\-.,;:¡!¿?]", v)))[:5] for v in values]
    assert [list(x) for x in col(spark, values, tx.suspicious)] == found


def test_scores_and_rounding(spark):
    assert col(spark, ["el hombre y la mujer", "nanapishku", "asu' ¿qué?"], tx.spanish_score) == [3, 0, 0]
    assert col(spark, ["nanapishku", "wek'"], tx.other_score) == [5, 2]
    values = [25 / 8, 107 / 40, 0.125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(tx.fixed(F.col("v"), 2).alias("o")).collect()
    assert [r["o"] for r in got] == [f"{v:.2f}" for v in values]


def test_routing_takes_the_first_reason(spark):
    rows = [(0, None, "x"), (1, "x", None), (2, None, None), (3, "  ", "x"), (4, "x", ""), (5, "x", " -- "), (6, "--", "x"), (7, "a", "b")]
    valid, removed = prepare.route(spark.createDataFrame(rows, "row_index long, ESP string, SHIWILU string"))
    assert sorted(map(tuple, valid.collect())) == [("P00000", "--", "x"), ("P00001", "a", "b")]
    assert [r["removal_reason"] for r in sorted(removed.collect())] == ["ESP es NaN", "SHIWILU es NaN", "ESP es NaN", "ESP vacío tras strip", "SHIWILU vacío tras strip", "SHIWILU es placeholder '--'"]


def test_numbers_are_gapless_and_wide(spark):
    got = ids.numbered(spark.range(100_001).withColumn("k", -F.col("id")), "k", "n").select("k", "n", ids.prefixed("n", "U").alias("u"))
    assert got.filter(F.col("n") != F.col("k") + 100_000).count() == 0
    assert got.filter("n = 100000").first()["u"] == "U100000"
    assert ids.numbered(spark.range(0), "id", "n").count() == 0


def test_normalization_logs_each_step(spark):
    df = spark.createDataFrame([("a", '" Hola "', "x , y"), ("b", "é", None), ("c", "ok", "ok")], PAIRS)
    out, log = prepare.normalize(df)
    assert {r["pair_id"]: (r["ESP_normalizado"], r["SHIWILU_normalizado"]) for r in out.collect()} == {"a": (" hola ", "x, y"), "b": ("é", None), "c": ("ok", "ok")}
    steps = sorted((r["pair_id"], r["column"], r["rule_name"]) for r in log.collect())
    assert steps == [("a", "ESP", "lowercase"), ("a", "ESP", "remove_double_quotes"), ("a", "SHIWILU", "normalize_comma_space"), ("b", "ESP", "unicode_nfc")]
    assert prepare.normalize(df, [])[1].count() == 0


def normalized(spark, rows):
    df = spark.createDataFrame([(f"D{i}", e, s) for i, (e, s) in enumerate(rows)], PAIRS)
    return df.select("pair_id", F.col("ESP").alias("ESP_original"), F.col("SHIWILU").alias("SHIWILU_original"), F.col("ESP").alias("ESP_normalizado"), F.col("SHIWILU").alias("SHIWILU_normalizado"))


def kinds(df):
    return sorted((r["pair_id"], r["problem_type"], r["details"]) for r in df.collect())


def test_conflicts_count_null_variants(spark):
    got = kinds(audit.conflicts(normalized(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("a", None)])))
    assert got == [
        ("D0", "bidirectional_conflict", "ESP tiene 3 traducciones SHIWILU diferentes; SHIWILU tiene 2 traducciones ESP"),
        ("D1", "one_to_many_esp", "ESP tiene 3 traducciones SHIWILU diferentes"),
        ("D2", "many_to_one_shiwilu", "SHIWILU tiene 2 traducciones ESP diferentes"),
        ("D3", "one_to_many_esp", "ESP tiene 3 traducciones SHIWILU diferentes"),
    ]


def test_duplicates_name_the_first(spark):
    n = normalized(spark, [("a", "x")] * 3 + [("b", None)] * 2)
    assert kinds(audit.exact_duplicates(n)) == [("D1", "exact_duplicate", "Duplicado de D0 (grupo de 3)"), ("D2", "exact_duplicate", "Duplicado de D0 (grupo de 3)")]
    assert tuple(audit.duplicate_stats(n).first()) == (1, 3, 2)


def test_suspicious_and_length(spark):
    n = normalized(spark, [("(x)", "(x"), ("[x]", "1 2 3"), ("a b c", "d"), ("a b c d", "e"), ("", "x")])
    got = {(i, d) for i, _, d in kinds(audit.suspicious_content(n))}
    assert ("D0", "ESP contiene paréntesis (posible glosa); ESP contiene caracteres sospechosos: ['(', ')']; SHIWILU contiene caracteres sospechosos: ['(']") in got
    assert any(i == "D1" and "SHIWILU es solo números" in d for i, d in got)
    assert kinds(audit.length_issues(n)) == [("D3", "length_issue", "ESP mucho más largo que SHIWILU (ratio: 4.00)"), ("D4", "length_issue", "ESP sin palabras")]


def test_empty_tables_keep_their_schema(spark):
    n = normalized(spark, [("a", "b")]).limit(0)
    problems = audit.all_problems(n)
    assert problems.count() == 0 and audit.consolidated(problems).count() == 0 and audit.flagged(n).count() == 0
    assert prepare.unify(tables.concatenated(spark, [])).columns == ["pair_id", "ESP", "SHIWILU", "source", "source_pair_id"]


LINES = """Prologue dropped
TEXTO 1
between header and item: dropped
1. nanek asu' wek
continuation of the first side
el hombre y la mujer
2. single line only
-- 3 of 10 --
TEXTO 2: heading
TEXTO 2
Lima, 1998
1 U'chimu para otros hablantes.
3. pi'la
2 Foo para otros hablantes.
nana""".split("\n")


def test_extraction(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(LINES)], "doc_id string, line_no int, line string")
    got = {r["pair_id"]: (r["SHIWILU"], r["ESP"], r["quality_flag"]) for r in extract.parallel_table(extract.numbered_items(lines)).collect()}
    assert got == {
        "T001_N001": ("nanek asu' wek continuation of the first side", "el hombre y la mujer", "ok"),
        "T001_N002": ("single line only", "", "missing_spanish"),
        "T002_N003": ("pi'la", "nana", "fallback_last_line_as_spanish"),
    }


def test_samples_and_neighbours(spark):
    assert [r["id"] for r in sorted(vectors.even_sample(spark.range(3), "id").collect(), key=lambda r: r["k"])] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2]
    v = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(20)], "word string, v array<double>")
    unknown = spark.createDataFrame([("q", [1.0, 0.0])], "word string, v array<double>")
    assert vectors.nearest(v, unknown, "word", "v", 10).count() == 10
    assert vectors.nearest(v, unknown, "word", "v", 10, out_of_vocabulary_quirk=True).count() == 11
    by_blocks = vectors.nearest(v, v, "word", "v", 4, most_queries=3, rows_a_block=7)
    assert sorted(by_blocks.collect()) == sorted(vectors.nearest(v, v, "word", "v", 4).collect()) and by_blocks.count() == 80


def test_places_are_exact(spark):
    r = random.Random(1)
    values = [r.choice([0.5, 3.0, r.uniform(-9, 9)]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    got = {r["point"]: r["value"] for r in ids.at_places(df, "v", points).collect()}
    ordered = sorted(values)
    for p in points:
        x = p * (len(ordered) - 1)
        low, high = ordered[int(x)], ordered[min(int(x) + 1, len(ordered) - 1)]
        assert got[p] == pytest.approx(low + (high - low) * (x - int(x)), abs=1e-12)
    assert ids.at_places(df.limit(0), "v", points).count() == 0
    assert [x["value"] for x in ids.at_places(df.limit(1), "v", [0.3]).collect()] == [df.limit(1).first()[0]]


def test_quantiles_by_narrowed_brackets(spark):
    """Coarse sketches, brackets of few rows, ties, NaN and a bracket that misses."""
    r = random.Random(2)
    values = [r.choice([1.0, 1.0, r.gauss(0, 1), r.gauss(0, 1e6), -5.0]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(6)
    points = [0.0, 0.2, 0.5, 0.777, 0.999, 1.0]
    for most, sketch, spread in ((1_000_000, 2048, 0.006), (50, 200, 0.03), (10, 2048, 0.006), (1_000_000, 8, 1e-6)):
        got, also = quantiles.exact(df, "v", points, {"rows": F.count("*")}, most, sketch, spread)
        assert got == pytest.approx(np.quantile(values, points).tolist(), abs=1e-9) and also == {"rows": 20_002}
    assert quantiles.exact(df.filter("v is null"), "v", points)[0] == [None] * 6


def test_neighbours_by_blocks(spark):
    """Equal to all pairs on clustered vectors, with equal ones among them; most blocks are left out."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((24, 16))
    rows = [(f"w{i:05d}", (centres[i % 24] + 0.05 * r.standard_normal(16)).tolist()) for i in range(6000)]
    rows += [(f"same{i}", rows[0][1]) for i in range(15)] + [("zero", [0.0] * 16), ("none", None), (None, rows[1][1])]
    v = spark.createDataFrame(rows, "word string, v array<double>").repartition(4)
    asked = spark.createDataFrame([*rows[:40:4], ("strange", centres[0].tolist()), ("SAME3", rows[0][1])], "word string, v array<double>")
    known = [(w, np.array(x)) for w, x in rows if w and x and any(x)]
    m = np.array([x / np.linalg.norm(x) for _, x in known])
    met = [spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)]
    got = {(x["query"], x["rank"]): (x["word"], x["similarity_score"]) for x in vectors.nearest(v, asked, "word", "v", 5, rows_a_block=64, counts=met).collect()}
    for w, x in ((a["word"], np.array(a["v"])) for a in asked.collect()):
        score = np.round(m @ (x / np.linalg.norm(x)), 12)
        want = sorted((-s, k) for s, (k, _) in zip(score.tolist(), known) if k.lower() != w.lower())[:5]
        assert [got[w, i + 1][0] for i in range(5)] == [k for _, k in want]
        assert [got[w, i + 1][1] for i in range(5)] == pytest.approx([-s for s, _ in want], abs=1e-9)
    assert len(got) == 60 and met[1].value > 4 * met[0].value
    assert vectors.nearest(v.limit(0), asked, "word", "v").count() == 0 and vectors.nearest(v, asked.limit(0), "word", "v").count() == 0


def test_numbers_over_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7 % 1000).alias("k"), "id").unionByName(spark.createDataFrame([(None, 5000)], "k long, id long"))
    got = [(x["k"], x["id"]) for x in sorted(ids.numbered(df, "k", "n", ("id",), parts=300).collect(), key=lambda x: x["n"])]
    assert got == sorted(got, key=lambda x: (x[0] is None, x[0] or 0, x[1])) and len(got) == 3001


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "b"', "x\ny"), ("NA", "none")], "ESP string, SHIWILU string")
    tables.write_csv(df, str(tmp_path / "t"), single=True)
    assert sorted(map(str, tables.read_csv(spark, str(tmp_path / "t"), df.schema).collect())) == sorted(map(str, [df.collect()[0], spark.createDataFrame([(None, "none")], df.schema).first()]))
    assert not tables.write_if_any(df.limit(0), str(tmp_path / "none"))
    source = tables.Source("s", esp_column="ESP", shiwilu_column="missing", enabled=True)
    assert tables.standardise(df.withColumn("ord", F.lit(0)), source, "ord") is None


def test_subwords_give_unknown_words_a_vector(spark):
    s = spark.createDataFrame([(["thing", "other", "thing"],), (["other", "brother"],)], "tokens array<string>")
    model = embed.train(s, vector_size=8, epochs=1)
    assert embed.contains(model, "thing") and not embed.contains(model, "#<th")
    assert len(embed.subword_vectors(model, spark.createDataFrame([("mother",)], "word string")).first()["vector"]) == 8


def test_words_of_equal_contexts_come_near(spark):
    r = random.Random(3)
    frames = [("the", "{}", "sleeps", "on", "a", "warm", "sofa"), ("my", "{}", "eats", "fish", "every", "day")], [("we", "drive", "{}", "along", "some", "road"), ("new", "{}", "costs", "much", "money")]
    kinds = [["pussycat", "doggerel", "bunnykin"], ["carriage", "truckload", "wagonette"]]
    rows = []
    for _ in range(2000):
        g = r.randrange(2)
        rows.append(([w.format(r.choice(kinds[g])) for w in r.choice(frames[g])],))
    model = embed.train(spark.createDataFrame(rows, "tokens array<string>"), vector_size=16, epochs=8, words_a_block=12)
    asked = (*(w for k in kinds for w in k), "pussycats", "truckloads")  # the last two are unknown
    score = {(x["query"], x["word"]): x["similarity_score"] for x in lookup.similar_words(model, asked, 100).collect()}
    kind = {w: i for i, k in enumerate(kinds) for w in k} | {"pussycats": 0, "truckloads": 1}
    mean = lambda words, same: np.mean([x for (w, v), x in score.items() if w in words and v in kind and v not in asked[6:] and (kind[v] == kind[w]) == same])
    assert mean(asked[:6], True) > mean(asked[:6], False) + 0.2
    assert all(mean([w], True) > mean([w], False) for w in asked[6:])


def test_buckets_are_those_of_the_column(spark):
    words = ["extraordinary", "é🙂", "a", "ma'pu'sin", "ĸĸĸ"]
    column = F.array_sort(F.array_distinct(F.transform(skipgram.ngrams(F.col("w")), lambda g: F.pmod(F.xxhash64(g), F.lit(1000)).cast("int"))))
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", column.alias("b")).collect()
    assert {r["w"]: r["b"] for r in got} == {w: skipgram._buckets(w, 3, 5, 1000) for w in words}
    assert len(spark.range(1).select(skipgram.ngrams(F.lit("extraordinary")).alias("g")).first()["g"]) == 36


def test_alias_table_follows_weights():
    r = np.random.default_rng(1)
    w = r.random(50) ** 3
    stay, other = skipgram.alias_table(w)
    share = stay / 50
    np.add.at(share, other, (1 - stay) / 50)
    assert np.allclose(share, w / w.sum())


def test_skip_gram_over_blocks(spark, tmp_path):
    """Planted synonyms, which share no n-gram, and held-out inflected forms come near; loss falls; no block has all words."""
    r = random.Random(1)
    stem = lambda k: "".join("kalomirutesonavidupe"[2 * int(c) : 2 * int(c) + 2] for c in f"{k * 37 % 1000:03d}")
    rows = []
    for _ in range(5000):
        k = r.randrange(20)
        around = [f"c{k}x{r.randrange(6)}" for _ in range(6)]
        rows.append(([*around[:3], r.choice([f"{stem(k)}q", f"zyx{k}dwv", f"{stem(k)}qes", f"{stem(k)}qan"]), *around[3:]],))
    df = spark.createDataFrame([*rows, (None,), ([],), (["alone"],), ([None, "with", "null"],)], "tokens array<string>")
    model = skipgram.train(df, vector_size=24, epochs=4, words_a_block=80, pairs_a_task=15_000)
    assert len(model.losses) == 4 and list(model.losses) == sorted(model.losses, reverse=True) and model.losses[-1] < 0.5 * model.losses[0]
    v = {x["word"]: np.array(x["vector"]) for x in model.words.collect()}
    assert len(v) == len({w for x in rows for w in x[0]} | {"alone", "with", "null"}) and len(v) > 2 * 80
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    held_out = {x["word"]: np.array(x["vector"]) for x in model.subwords(spark.createDataFrame([(f"{stem(k)}qim",) for k in range(20)], "word string")).collect()}
    for k in range(20):
        others = [cos(v[f"{stem(k)}q"], v[f"zyx{j}dwv"]) for j in range(20) if j != k]
        assert cos(v[f"{stem(k)}q"], v[f"zyx{k}dwv"]) > max(others)
        assert cos(held_out[f"{stem(k)}qim"], v[f"{stem(k)}qan"]) > max(cos(held_out[f"{stem(k)}qim"], v[f"{stem(j)}qan"]) for j in range(20) if j != k)
    model.save(str(tmp_path / "m"))
    again = skipgram.SkipGram.load(spark, str(tmp_path / "m"))
    assert {x["word"]: np.array(x["vector"]).tolist() for x in again.words.collect()} == {w: x.tolist() for w, x in v.items()} and again.getVectorSize() == 24


def test_pairs_of_words_are_packed(spark):
    """Many pairs a row, each in the step and block of its words."""
    df = spark.createDataFrame([([f"w{i % 40}" for i in range(k, k + 50)],) for k in range(100)], "tokens array<string>").coalesce(1)
    of = {r["h"]: r["w"] for r in spark.range(40).select(F.concat(F.lit("w"), "id").alias("w")).select("w", F.xxhash64("w").alias("h")).collect()}
    rows, got = skipgram.neighbouring(df, 1, 4, 1).collect(), {}
    for r in rows:
        w, c = np.frombuffer(r["w"], np.int64), np.frombuffer(r["c"], np.int64)
        assert (w % 4 == r["block"]).all() and ((c - w) % 4 == r["step"]).all()
        for x in zip(w.tolist(), c.tolist()):
            got[of[x[0]], of[x[1]]] = got.get((of[x[0]], of[x[1]]), 0) + 1
    assert len(rows) <= 16 and sum(got.values()) == 100 * 49 * 2 and len(got) == 80 and all(n == got[c, w] for (w, c), n in got.items())


def test_skip_gram_stores_no_pairs_and_leaves_two_tables(spark, monkeypatch):
    """What is stored while it trains grows with texts and vectors, not with pairs; then only words and buckets are left."""
    kept, stored, discard = [], skipgram.stored, skipgram.discard
    monkeypatch.setattr(skipgram, "stored", lambda *a, **b: kept.append(stored(*a, **b)) or kept[-1])
    gone = []
    monkeypatch.setattr(skipgram, "discard", lambda *tables: gone.extend(x._stored_at for x in tables) or discard(*tables))
    df = spark.createDataFrame([([f"w{i % 40}" for i in range(k, k + 50)],) for k in range(100)], "tokens array<string>")
    model = skipgram.train(df, vector_size=4, epochs=2, words_a_block=10, buckets=1000)
    assert not any({"w", "c"} <= set(x.columns) for x in kept)
    assert len(kept) - len(gone) == len({x._stored_at for x in kept} - set(gone)) == 2
    assert model.words.count() == 40 and model.grams.filter("size(vector) = 4").count() == model.grams.count() > 0


def test_pairs_of_a_step_are_those_of_all_steps(spark):
    df = spark.createDataFrame([([f"w{(i * i) % 37}" for i in range(k, k + 9 + k % 5)],) for k in range(60)], "tokens array<string>").coalesce(1)

    def pairs(rows):
        return sorted((r["step"], *x) for r in rows for x in zip(np.frombuffer(r["w"], np.int64).tolist(), np.frombuffer(r["c"], np.int64).tolist()))

    for blocks, rounds in ((1, 1), (4, 1), (3, 2)):
        texts = skipgram.hashed(df)
        every = pairs(skipgram.neighbouring(df, 3, blocks, rounds).collect())
        assert len(every) > 2 * 60 * 8 and sorted(x for s in range(blocks * rounds) for x in pairs(skipgram.paired(texts, 3, blocks, rounds, s).collect())) == every


def test_skip_gram_rows_and_row_groups_are_bounded(spark, monkeypatch):
    """A block's vectors are many rows, and readers hold four of them at most, whatever a block has."""
    stored, longest, groups = skipgram.stored, [], []

    def watched(*a, **b):
        out = stored(*a, **b)
        if "vec" in out.columns:
            longest.append(out.filter("kind < 2").agg(F.max(F.length("vec"))).first()[0] or 0)
            files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out._stored_at}/*.parquet")]
            groups.extend(f.row_group(i).num_rows for f in files for i in range(f.num_row_groups))
        return out

    monkeypatch.setattr(skipgram, "stored", watched)
    df = spark.range(2000).select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), (F.col("id") * 10 + i).cast("string"))).alias("tokens"))
    model = skipgram.train(df, vector_size=4, epochs=1, buckets=1000)
    assert 0 < max(longest) <= 16_384 * 4 * 4 and 0 < max(groups) <= 4
    assert model.words.filter("size(vector) = 4").count() == model.words.select("word").distinct().count() == 20_000


def test_audit_shuffles_texts_once(spark):
    rows = [(f"p{i}", f"E{i % 7}", f"S{i % 5}", f"e{i % 7}", f"s{i % 5}" if i % 6 else None) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("pair_id", *audit.TEXTS)))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = audit.audited(df)
        plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert len(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\]]*ESP_original", plan)) == 1
        assert got.columns == [*df.columns, "issues", "has_audit_flags"] and got.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_skip_gram_of_nothing(spark):
    model = skipgram.train(spark.createDataFrame([], "tokens array<string>"), vector_size=4, epochs=1)
    assert model.words.count() == 0 and model.subwords(spark.createDataFrame([("word",)], "word string")).count() == 0


def test_vocabulary_ties_by_first_occurrence(spark):
    df = spark.createDataFrame([(1, "x", "b a b a c"), (0, "x", "z")], "o int, lang string, text string")
    c = vocabulary.counts(df, F.col("text"), "lang", "o")
    assert [r["token"] for r in sorted(vocabulary.most_common(c, "lang").collect(), key=lambda r: r["rank"])] == ["b", "a", "z", "c"]
    assert tuple(vocabulary.stats(c, "lang").first())[1:] == (6, 4, "0.6667", 2)


def test_coordinates_agree_with_numpy(spark, data):
    df = spark.read.parquet(f"{data}/sf0.001/embeddings.parquet")
    got = embed.coordinates(df, "embedding").select("embedding", "x", "y").collect()
    m = np.array([r["embedding"] for r in got], float)
    _, axes = np.linalg.eigh(np.cov(m.T))
    for name, axis in (("x", axes[:, -1]), ("y", axes[:, -2])):
        want, own = m @ axis, np.array([r[name] for r in got])
        assert np.allclose(own, want, atol=1e-6) or np.allclose(own, -want, atol=1e-6)


def dense(rows, n):
    a = np.zeros((len(rows), n))
    for i, at in enumerate(rows):
        np.add.at(a[i], np.array(at, int), 1)
    with_it = (a > 0).sum(0)
    a *= np.where(with_it > 0, np.log((1 + len(rows)) / (1 + with_it)) + 1, 0)
    length = np.linalg.norm(a, axis=1)
    return a / np.where(length > 0, length, 1)[:, None]


def test_singular_values_agree_with_numpy(spark, data):
    docs = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    model = latent.fit(docs, "text", k=16, n=4096, block=32, steps=10)
    a = dense([r[0] for r in docs.select(latent.features(F.col("text"), 4096)).collect()], 4096)
    assert np.abs(np.linalg.svd(a, compute_uv=False)[:16] - model.values).max() < 1e-6
    assert np.allclose(np.linalg.norm(a @ model.vectors, axis=0), model.values, atol=1e-4)


def test_texts_of_one_topic_come_near_without_common_words(spark):
    r = random.Random(4)
    rows = [(" ".join(f"t{k}w{r.randrange(30)}" for _ in range(12)),) for k in (r.randrange(8) for _ in range(1500))] + [(None,), ("",), ("  ",)]
    model = latent.fit(spark.createDataFrame(rows, "text string").repartition(3), "text", k=8, n=1 << 14)
    asked = [(f"query: t{k}w1 t{k}w2 t{k}w3", f"passage: t{j}w11 t{j}w12 t{j}w13", k == j) for k in range(8) for j in range(8)]
    encode = model.column(spark)
    df = spark.createDataFrame([*asked, ("query: nowhere", None, False)], "a string, b string, same boolean")
    scored = [(x["same"], x["c"]) for x in df.select("same", F.coalesce(tx.cosine(encode(F.col("a")), encode(F.col("b"))), F.lit(0.0)).alias("c")).collect()]
    assert min(c for s, c in scored if s) > 0.8 > 0.3 > max(c for s, c in scored if not s)


def test_hashed_encoder_hashes_a_token_once(spark):
    """Equal to plain counting, and in time for long lines: a token was hashed anew for every dimension."""
    texts = [" ".join(f"W{(i * 7919 + k) % 5003}é" for i in range(4000)) for k in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", " \t", "one ONE two"]], "t string").repartition(4).cache()
    df.count()
    began = time.time()
    twice = embed.embed_pairs(df.select(F.col("t").alias("ESP"), F.col("t").alias("SHIWILU")), embed.hashed_encoder(64), "ESP")
    assert twice.filter(tx.cosine(F.col("esp_vector"), F.col("shi_vector")) > 0.9).count() >= 400
    got = {r["t"]: r["v"] for r in df.select("t", embed.hashed_encoder(64)(F.col("t")).alias("v")).collect()}
    assert time.time() - began < 60
    for t in (texts[0], texts[-1], "", " \t", "one ONE two"):
        want = [0.0] * 64
        for w in t.lower().split():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 64] += 1 if h[8] >= "8" else -1
        assert got[t] == want


def test_latent_encoder_of_nothing(spark):
    model = latent.fit(spark.createDataFrame([(None,), ("",)], "text string"), "text", k=4, n=64)
    assert not model.values.any() and not model.encode([np.array([1, 2]), np.array([], int)]).any()


PATTERNS = [
    "the", "THE .*ing", "abc|def", "(abc|xyz)+q?", "a{3}", "a{0,2}b", "(secret|token)s? = [a-z0-9]+", "x*yz", "(?:foo|bar)baz", "foo(bar)?baz", r"\\bword\\b", r"\\d{4}-\\d\\d", "^start", "end$", "ki[sk]k", "straße", "STRASSE",
    "ΑΣ", "éa", "[^abc]def", "[a-c&&[b]]", "[x[yz]]def", r"\\Qa.b\\E", "a++b", "(?i)Ab", "(?<n>abc)def", "a(?=bc)", "(?!x)abc", r"(abc)\\1", r"\\p{L}+ing", r"\\x41bc", r"\\0101bc", "kelvin", "istanbul", "mass", "masſ",
    "日本", "a.c", "", "zzzzzz", "(a|)bcd", "((abc|abd)|xbd)e", "abc.*xyz", "tab\\there", "(abc)?", "(abc){2,}", "abc{2}", "a|b|cde", r"\\.com", "q u",
]


def test_indexed_search_equals_a_scan(spark):
    r = random.Random(8)
    bits = ["the", " ", "King", "ing", "abc", "def", "ABD", "xyz", "secret = ", "token", "foo", "bar", "baz", "word", "2024-05", "\n", "Straße", "STRASSE", "ΑΣ", "ας", "Éa", "éa", "Kelvin", "İstanbul", "ıstanbul", "maſs", "mass", "日本", "a.b", "kisk", "aaa", "b", "c", "Tab\there", ".com", "q u", "e", "start", "end"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))) for i in range(600)] + [(700, None), (701, ""), (702, "ab"), (5, "abc again"), (None, "abc")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = postings.build(df, "text", "id")
    narrowed = 0
    for pattern in (p.replace("\\\\", "\\") for p in PATTERNS):
        want = df.filter(F.col("id").isNotNull() & F.col("text").rlike("(?iu)" + pattern)).select("id", "text")
        assert sorted(map(tuple, index.matches(pattern).select("id", "text").collect())) == sorted(map(tuple, want.collect())), pattern
        narrowed += postings.need(pattern) is not None
    assert len(PATTERNS) >= 50 and narrowed >= 25
    assert [x["id"] for x in index.search("THE", 3).collect()] == [x["id"] for x in vocabulary.search(df.filter("id is not null"), "text", "THE", "id", 3).collect()]


def test_what_patterns_need():
    gram = lambda x: (ord(x[0]) << 14) | (ord(x[1]) << 7) | ord(x[2])
    assert postings.need("abcd") == ("and", (gram("abc"), gram("bcd"))) and postings.need("a.*b") is None
    assert postings.need("(abc|xyz)") == ("or", (gram("abc"), gram("xyz"))) and postings.need("(abc|x)") is None
    assert postings.need("K\u212aK") == postings.need("kkk") == gram("kkk")


def test_items_over_ranges_of_lines(spark):
    """One document of many lines in many ranges is read as by one window."""
    r = random.Random(6)
    kinds = ["TEXTO {}", "{}. nanek asu", "{}.", "el hombre y la mujer", "pi'la wek", "", "-- 3 of 9 --", "{} Foo para otros hablantes", "Lagunas, 1998", "TEXTO nada"]
    rows = [(d, i * 3, r.choice(kinds).format(r.randrange(50))) for d in ("a", "b", None) for i in range(4000)]
    lines = spark.createDataFrame(rows, "doc_id string, line_no int, line string").repartition(4)
    whole, parts = ([tuple(map(str, x)) for x in extract.numbered_items(lines, n).collect()] for n in (10**9, 70))
    assert sorted(whole) == sorted(parts) and len(parts) > 500


def test_quick_check_of_all_characters(spark):
    """Texts that the quick check leaves alone are in NFC: each character alone, behind a letter and behind another mark; Hangul."""
    checked = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", tx.may_change()))
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            for text in (chr(c), "e" + chr(c), "가" + chr(c), chr(0x1100) + chr(c), "\u0323" + chr(c)):
                assert unicodedata.is_normalized("NFC", text) or checked.search(text), hex(c)
    values = ["plain", "é", "e\u0301", "\u1100\u1161\u11a8", "각", "\u212b", "한국어", "q\u0323\u0307", "q\u0307\u0323", "", None, "日本", "\u09c7\u09be"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", tx.nfc(F.col("v")).alias("n")).collect()
    assert {x["i"]: x["n"] for x in got} == {i: v if v is None else unicodedata.normalize("NFC", v) for i, v in enumerate(values)}


def test_popular_keys_crowd_no_task(spark):
    """A third of the rows have one key, a tenth none; without adaptive execution tasks stay alike and results whole."""
    rows = spark.range(60_000).select(F.col("id").alias("pair_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k"))
    figures = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("pair_id").alias("m"))
    (found,) = popular.popular_hashes(rows, ["k"], least=1000)
    assert len(found) == 2 and popular.popular_hashes(rows, ["k"], ["pair_id"]) == [[], []]
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for c, v in zip(kept, ("false", "-1", "16")):
        spark.conf.set(c, v)
    try:
        for how, null_safe in (("inner", False), ("left", False), ("inner", True), ("left_semi", False)):
            same = F.col("k").eqNullSafe(F.col("__k")) if null_safe else F.col("k") == F.col("__k")
            want = rows.join(figures.withColumnRenamed("k", "__k"), same, how).select("pair_id", "k", *(["n", "m"] if how != "left_semi" else []))
            got = popular.with_figures(rows, figures, ["k"], "pair_id", how, null_safe, found)
            assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
        tasks = popular.with_figures(rows, figures, ["k"], "pair_id", "left", popular=found).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()
        sizes = sorted(r["count"] for r in tasks)
        assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    few = rows.limit(0)
    assert popular.with_figures(few, figures, ["k"]).count() == 0
