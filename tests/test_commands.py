import csv
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, lookup, plot, prepare
from corpusloom.plans.commands import run
from corpusloom.sources import tables
from corpusloom.sources.rules import RuleBook, read_rules


def put(path, rows):
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows(rows)
    return str(path)


def got(spark, path):
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(str(path))
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_rule_books(spark, tmp_path):
    config = {
        "global_rules": {"trim": {"enabled": True}, "lowercase": {"enabled": True, "order": 2}, "unicode_nfc": {"order": 1}, "strange": {"enabled": True}},
        "language_specific": {"ESP": {"cut": {"enabled": True, "pattern": "[!]"}, "off": {"pattern": "a"}}, "SHIWILU": {"swap": {"enabled": True, "replacements": {"’": "'", "$": "\\1", "’’": '"'}}, "none": {"enabled": True, "replacements": {}}}},
        "duplicate_handling": {"remove_exact_duplicates": {"enabled": True, "keep": "first"}},
    }
    (tmp_path / "r.json").write_text(json.dumps(config), encoding="utf-8")
    book = read_rules(str(tmp_path / "r.json"))
    assert {s: [n for n, _ in r] for s, r in book.sides.items()} == {"ESP": ["lowercase", "trim", "cut"], "SHIWILU": ["lowercase", "trim", "swap"]}
    assert book.remove_exact_duplicates and not RuleBook.of({}).remove_exact_duplicates
    df = spark.createDataFrame([("P0", " HOLA! ", "a’’b’$")], "pair_id string, ESP string, SHIWILU string")
    out, log = prepare.normalize(df, book.sides)
    assert out.select("ESP_normalizado", "SHIWILU_normalizado").first() == ("hola", "a\"b'\\1")
    assert [r["rule_name"] for r in log.filter("column = 'ESP'").collect()] == ["lowercase", "trim", "cut"]
    with pytest.raises(FileNotFoundError):
        read_rules(str(tmp_path / "absent.json"))


def test_commands_from_raw_rows_to_flags(spark, tmp_path):
    raw = put(tmp_path / "raw.csv", [["ESP", "SHIWILU", "other"], ["Hola, mundo", "U'chimu\nlli", "1"], ["", "x", "2"], ["El agua", "--", "3"], ["El  agua", "Dek", "4"], ["el agua", "dek", "5"]])
    o = lambda n: str(tmp_path / n)
    assert "valid_rows" in run(spark, ["filter", "--input", raw, "--output", o("1")])
    valid = got(spark, tmp_path / "1/valid")
    assert [(r["pair_id"], r["ESP"]) for r in valid] == [("P00000", "Hola, mundo"), ("P00001", "El  agua"), ("P00002", "el agua")]
    assert sorted((r["original_index"], r["removal_reason"]) for r in got(spark, tmp_path / "1/removed")) == [("1", "ESP es NaN"), ("2", "SHIWILU es placeholder '--'")]
    entry = {"esp_column": "ESP", "shiwilu_column": "SHIWILU"}
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"name": "a", "path": o("1/valid"), "enabled": True, **entry}, {"name": "b", "path": o("absent"), "enabled": True, **entry}, {"name": "c", "path": raw, **entry}, {"name": "d", "path": raw, "enabled": True, **entry, "pair_id_column": "no", "filter": {"column": "other", "keep": ["5"]}}]}))
    with pytest.warns(UserWarning, match="source b"):
        run(spark, ["unify", "--input", o("s.json"), "--output", o("2")])
    unified = got(spark, tmp_path / "2/unified")
    assert [(r["pair_id"], r["source"], r["source_pair_id"]) for r in unified] == [("U00000", "a", "P00000"), ("U00001", "a", "P00001"), ("U00002", "a", "P00002"), ("U00003", "d", "d_4")]
    assert {r["pair_id"] for r in got(spark, tmp_path / "2/cross_duplicates")} == {"U00002", "U00003"}
    run(spark, ["normalize", "--input", o("2/unified"), "--output", o("3")])
    assert got(spark, tmp_path / "3/normalized")[1]["ESP_normalizado"] == "el agua" and got(spark, tmp_path / "3/removed") == []
    (tmp_path / "r.json").write_text(json.dumps({"global_rules": {"lowercase": {"enabled": True}, "collapse_spaces": {"enabled": True, "order": 1}}, "duplicate_handling": {"remove_exact_duplicates": {"enabled": True}}}))
    run(spark, ["normalize", "--input", o("2/unified"), "--rules", o("r.json"), "--output", o("3b")])
    assert [r["pair_id"] for r in got(spark, tmp_path / "3b/normalized")] == ["U00000", "U00001"]
    run(spark, ["audit", "--input", o("3/normalized"), "--output", o("4")])
    assert [r["has_audit_flags"] for r in got(spark, tmp_path / "4/final")] == ["false", "false", "true", "true"]
    summary = json.loads("\n".join(r["value"] for r in spark.read.text(o("4/summary")).collect()))
    assert summary["by_type"] == [{"problem_type": "exact_duplicate", "n": 2}] and summary["timestamp"].endswith("+00:00")
    run(spark, ["embed", "--input", o("3/normalized"), "--output", o("5"), "--vector-size", "16"])
    assert len(got(spark, tmp_path / "5/scores")) == 4
    said = run(spark, ["embed", "--input", o("3/normalized"), "--output", o("5b"), "--vector-size", "16", "--npy"])
    assert said.startswith("vectors: hashed words") and "elapsed_seconds" in "".join(r["value"] for r in spark.read.text(o("5b/summary")).collect())
    said = run(spark, ["embed", "--input", o("3/normalized"), "--output", o("5c"), "--vector-size", "4", "--encoder", "latent"])
    assert said.startswith("vectors: latent") and spark.read.parquet(o("5c/vectors")).filter("size(esp_vector) = 4").count() == 4
    matrix = np.load(o("5b/esp_vector.npy"))
    stored = [r["esp_vector"] for r in spark.read.parquet(o("5b/vectors")).orderBy("pair_id").collect()]
    assert matrix.shape == (4, 16) and np.allclose(matrix, stored)
    assert [r["vector"] for r in tables.read_npy(spark, o("5b/esp_vector.npy")).orderBy("row").collect()] == stored
    with open(next((tmp_path / "3/normalized").glob("part-*")), "rb") as f:
        assert f.read(3) == b"\xef\xbb\xbf"
    run(spark, ["compare", "--input", o("5/scores"), "--output", o("6")])
    assert len(got(spark, tmp_path / "6/extremes")) == 8
    assert "U00001" in run(spark, ["search", "--input", o("3/normalized"), "--pattern", "AGUA", "--limit", "1"])
    run(spark, ["train", "--input", o("3/normalized"), "--output", o("7"), "--vector-size", "8", "--epochs", "1"])
    assert len(run(spark, ["similar", "--input", o("7"), "--word", "agua", "--limit", "2"]).splitlines()) == 2
    assert spark.read.text(o("7/vectors")).first()[0].split()[1] == "8"
    said = run(spark, ["picture", "--input", o("3/normalized"), "--model", o("7"), "--output", o("9"), "--highlight", "agua"])
    assert said.splitlines()[1:] == ["agua"] and open(o("9/words.png"), "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    assert {r["label"] for r in got(spark, tmp_path / "9/points")} == {"ESP", "SHIWILU"}
    for stage, more in (("filter", []), ("extract", []), ("audit", []), ("picture", ["--model", o("7")])):
        with pytest.raises(FileNotFoundError, match="no such input"):
            run(spark, [stage, "--input", o("nowhere"), "--output", o("8"), *more])
    with pytest.raises(ValueError, match="lacks"):
        run(spark, ["filter", "--input", o("4/problems"), "--output", o("8")])


def test_extract_command(spark, tmp_path):
    (tmp_path / "t.txt").write_text("TEXTO 1\n1. nanek asu' wek\nel hombre y la mujer\n2. pi'la\n", encoding="utf-8")
    assert "missing_spanish" in run(spark, ["extract", "--input", str(tmp_path / "t.txt"), "--output", str(tmp_path / "x")])
    assert [(r["pair_id"], r["quality_flag"]) for r in got(spark, tmp_path / "x/pairs")] == [("T001_N001", "ok"), ("T001_N002", "missing_spanish")]


def test_lookups(spark):
    sentences = spark.createDataFrame([(["casa", "agua", "bueno"],), (["casas", "agua"],)], "tokens array<string>")
    model = embed.train(sentences, vector_size=8, epochs=1)
    assert (lookup.vocabulary_size(model), lookup.vector_size(model)) == (4, 8)
    assert lookup.vector_of(model, "casa").count() == 1 and lookup.vector_of(model, "casita").count() == 1 and lookup.vector_of(model, "zzz").count() == 0
    near = lookup.similar_words(model, ("casa", "casita", "zzz"), 2).collect()
    assert {r["query"] for r in near} == {"casa", "casita"} and all(r["word"] != r["query"] for r in near) and len(near) == 4
    encoder = embed.hashed_encoder(32)
    pairs = spark.createDataFrame([("a", "casa agua", "agua casa"), ("b", None, "x"), ("c", "qqq", "casa")], "k string, ESP string, SHIWILU string")
    words = lookup.sentence_vocabulary(pairs, encoder, ("ESP", "SHIWILU"))
    assert sorted(r["word"] for r in words.collect()) == ["agua", "casa", "qqq", "x"]
    by_key = {r["k"]: r["avg_word_score"] for r in lookup.word_scores(pairs, embed.vectors(model), "k").collect()}
    assert by_key["b"] == by_key["c"] == 0.0 and by_key["a"] > 0
    assert lookup.text_similarity(spark, " a b ", "a b", encoder, ("query: ", "query: ")).first()[0] == pytest.approx(1.0)
    one = lookup.compare_pair(model, "casa", "casa", encoder).first()
    assert one["avg_word_score"] == pytest.approx(1.0) and one["difference"] == pytest.approx(0.0)
    assert [len(lookup.answer(x, model, words, encoder, 2)) for x in ("", "q", "ft casa", "stw casa", "ambos casa", "st a | b")] == [0, 0, 1, 1, 2, 1]
    assert lookup.answer("stw casa", model, words, encoder, 2)[0].filter(F.col("word") == "casa").count() == 0
    for bad in ("st a", "st a|b|c", "ft", "hola"):
        with pytest.raises(ValueError):
            lookup.parse_command(bad)


def test_pdf_pages_through_a_reader(spark, tmp_path):
    """A stand-in for the PDF reader: pages are parts of a text file."""
    (tmp_path / "pypdf.py").write_text("class _Page:\n    def __init__(self, t):\n        self.t = t\n    def extract_text(self):\n        return self.t\nclass PdfReader:\n    def __init__(self, raw):\n        self.pages = [_Page(t) for t in raw.read().decode().split('\\f')]\n")
    spark.sparkContext.addPyFile(str(tmp_path / "pypdf.py"))
    (tmp_path / "book.pdf").write_text("TEXTO 1\n1. nanek asu' wek\n\fel hombre y la mujer\n2. pi'la\n", encoding="utf-8")
    lines = tables.read_pdf_lines(spark, str(tmp_path / "book.pdf")).orderBy("page_no", "line_no").collect()
    assert [(r["page_no"], r["line_no"], r["line"]) for r in lines] == [(0, 0, "TEXTO 1"), (0, 1, "1. nanek asu' wek"), (1, 0, "el hombre y la mujer"), (1, 1, "2. pi'la")]
    said = run(spark, ["extract", "--input", str(tmp_path / "book.pdf"), "--output", str(tmp_path / "x")])
    assert "first of pairs" in said and "50.0 %" in said
    assert [(r["pair_id"], r["ESP"]) for r in got(spark, tmp_path / "x/pairs")] == [("T001_N001", "el hombre y la mujer"), ("T001_N002", None)]


def test_clusters_stay_apart_in_a_picture(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(40, 10)) + 9 * k for k in range(3)])
    y = plot.tsne(x, perplexity=15, iterations=400)
    kind = np.repeat(np.arange(3), 40)
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert (kind[near] == kind[:, None]).mean() > 0.95
    points = spark.createDataFrame([("ESP", f"w{i}", float(a), float(b)) for i, (a, b) in enumerate(y)], "label string, word string, x double, y double")
    png = plot.scatter_png(points, ("w3",), 200, 100)
    raw = zlib.decompress(png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8])
    assert len(raw) == 100 * (1 + 3 * 200) and bytes(plot.COLOURS["ESP"]) in raw and bytes(plot.RING) in raw
    assert len(plot.shown(points)) == 60 and plot.shown(points, ("w3",)) == ["w3"] and plot.tsne(x[:2]).shape == (2, 2)
