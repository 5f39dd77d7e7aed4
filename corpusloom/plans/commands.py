"""The stages as commands over files: `python -m corpusloom STAGE --input PATH --output FOLDER`.

Each stage writes its frames as CSV folders and its summary as JSON under the output folder, and prints its report.
Paths are Spark's, so any store that Spark reaches will do; configurations are read on the driver.
"""

from __future__ import annotations

import argparse
import time
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import embed, ids, latent, lookup, plot, prepare, vocabulary
from ..operators.skipgram import SkipGram
from ..sources import rules, tables
from . import stages

ORIGINAL, NORMAL = ("ESP", "SHIWILU"), ("ESP_normalizado", "SHIWILU_normalizado")


def text_table(spark: SparkSession, path: str, needed: Sequence[str] = ()) -> DataFrame:
    """A CSV table, all columns text, with `row_index` in file order; lacking columns raise ValueError."""
    df = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8").csv(tables.existing(spark, path))
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    if lacking := [c for c in needed if c not in df.columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    df = df.select(*(tx.blank_to_null(F.col(c)).alias(c) for c in df.columns if c != "row_index"), F.monotonically_increasing_id().alias("__at"))
    return ids.numbered(df, "__at", "row_index").drop("__at")


def kept(result: stages.StageResult, spark: SparkSession, output: str, only_if_any: tuple[str, ...] = (), started: float | None = None) -> str:
    """Writes a stage's frames and summary, with the seconds since `started`; the report."""
    for name, frame in result.frames.items():
        if name in only_if_any:
            tables.write_if_any(frame, f"{output}/{name}", bom=True)
        else:
            tables.write_csv(frame, f"{output}/{name}", bom=True)
    summary = result.summary()
    elapsed = {} if started is None else {"elapsed_seconds": round(time.time() - started, 3)}
    tables.write_summary(spark, elapsed | summary, f"{output}/summary")
    return result.report(summary)


def extract(spark, a):
    tables.existing(spark, a.input)
    lines = tables.read_pdf_lines(spark, a.input) if a.input.lower().endswith(".pdf") else tables.read_lines(spark, a.input)
    if "page_no" in lines.columns:
        lines = lines.select("doc_id", (F.col("page_no").cast("long") * (1 << 32) + F.col("line_no")).alias("line_no"), "line")
    return kept(stages.extract_stage(lines), spark, a.output)


def filter_(spark, a):
    return kept(stages.filter_stage(text_table(spark, a.input, ORIGINAL).select("row_index", *ORIGINAL)), spark, a.output)


def unify(spark, a):
    """Sources that are off, missing or without their columns are passed over with a warning."""
    frames = []
    for source in tables.read_registry(a.input):
        if not source.enabled:
            continue
        try:
            frame = tables.standardise(text_table(spark, source.path), source, "row_index")
        except FileNotFoundError:
            frame = None
        if frame is None:
            warnings.warn(f"source {source.name} is passed over: no such file or columns", stacklevel=1)
        else:
            frames.append(frame)
    return kept(stages.unify_stage(tables.concatenated(spark, frames)), spark, a.output)


def normalize(spark, a):
    book = rules.read_rules(a.rules) if a.rules else rules.RuleBook(prepare.by_side(None))
    result = stages.normalize_stage(text_table(spark, a.input, ("pair_id", *ORIGINAL)).drop("row_index"), book.sides)
    if book.remove_exact_duplicates:
        result.frames["normalized"] = prepare.first_of_duplicates(result.frames["normalized"], list(NORMAL), "pair_id")
    return kept(result, spark, a.output)


def audit(spark, a):
    return kept(stages.audit_stage(text_table(spark, a.input, ("pair_id", *NORMAL)).drop("row_index")), spark, a.output)


def _sides(spark: SparkSession, path: str) -> DataFrame:
    table = text_table(spark, path, ("pair_id", *NORMAL))
    return table.select("row_index", "pair_id", *(F.col(n).alias(o) for n, o in zip(NORMAL, ORIGINAL)))


def train(spark, a):
    started = time.time()
    sentences = vocabulary.sentences(_sides(spark, a.input), "row_index").select("tokens")
    model = embed.train(sentences, a.vector_size, a.window, a.min_count, a.epochs)
    model.save(f"{a.output}/model")
    embed.save_text(model, f"{a.output}/vectors")
    found = lookup.validate(model)
    sizes = sentences.agg(F.count("*").alias("sentences"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens"))
    return kept(stages.StageResult({"probes": found}, {"corpus": sizes, "probes": found.orderBy("query", "rank")}), spark, a.output, started=started)


def embed_(spark, a):
    """Latent semantic vectors fitted on the input, or vectors by hashing, a stand-in that carries no meaning beyond shared
    words; the report says which."""
    started, pairs = time.time(), _sides(spark, a.input)
    if a.encoder == "latent":
        encoder, about = latent.fit(pairs.select(F.explode(F.array(*ORIGINAL)).alias("text")), "text", a.vector_size, block=max(32, -(-a.vector_size // 5))).column(spark), "vectors: latent semantic, fitted on the input\n"
    else:
        encoder, about = embed.hashed_encoder(a.vector_size), "vectors: hashed words, a stand-in for a pretrained encoder\n"
    made = embed.embed_pairs(pairs, encoder)
    made.write.mode("overwrite").parquet(f"{a.output}/vectors")
    if a.npy:
        for side in ("esp_vector", "shi_vector"):
            tables.write_npy(spark.read.parquet(f"{a.output}/vectors"), "pair_id", side, f"{a.output}/{side}.npy")
    scored = spark.read.parquet(f"{a.output}/vectors").select("pair_id", tx.cosine(F.col("esp_vector"), F.col("shi_vector")).alias("similarity_score"))
    texts = pairs.select("pair_id", *(F.col(o).alias(n) for n, o in zip(NORMAL, ORIGINAL)))
    result = stages.compare_stage(scored, "pair_id")
    return about + kept(stages.StageResult({"scores": texts.join(scored, "pair_id"), "extremes": result.frames["extremes"]}, result.figures), spark, a.output, started=started)


def compare(spark, a):
    scores = text_table(spark, a.input, ("pair_id", "similarity_score")).withColumn("similarity_score", F.col("similarity_score").cast("double")).drop("row_index")
    return kept(stages.compare_stage(scores, "pair_id"), spark, a.output, only_if_any=("low_similarity",))


def search(spark, a):
    found = vocabulary.search(text_table(spark, a.input, (a.column,)), a.column, a.pattern, "row_index", a.limit)
    return "\n".join(str(r.asDict()) for r in found.collect())  # `limit` rows


def similar(spark, a):
    found = lookup.similar_words(SkipGram.load(spark, f"{a.input}/model"), (a.word,), a.limit)
    return "\n".join(f"{r['word']}\t{r['similarity_score']:.4f}" for r in found.orderBy("rank").collect())  # `limit` rows


def picture(spark, a):
    """Coordinates and a scatter plot of the words of both sides, out of a trained model."""
    pairs = text_table(spark, a.input, ("pair_id", *NORMAL))
    model = SkipGram.load(spark, f"{tables.existing(spark, a.model)}/model")
    points = plot.placed(plot.labelled_vectors(plot.words_by_side(pairs, a.max_words), embed.vectors(model))).persist()
    highlight = tuple(a.highlight.split(",")) if a.highlight else ()
    tables.write_bytes(spark, plot.scatter_png(points, highlight), f"{a.output}/words.png")
    tables.write_csv(points, f"{a.output}/points", bom=True)
    return "\n".join([f"points: {points.count()}", *plot.shown(points, highlight)])


STAGES = {"extract": extract, "filter": filter_, "unify": unify, "normalize": normalize, "audit": audit, "train": train, "embed": embed_, "compare": compare, "search": search, "similar": similar, "picture": picture}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    of = out.add_subparsers(dest="stage", required=True)
    for name in STAGES:
        p = of.add_parser(name)
        p.add_argument("--input", required=True)
        if name in ("search", "similar"):
            p.add_argument("--limit", type=int, default=10)
        else:
            p.add_argument("--output", required=True)
        if name == "normalize":
            p.add_argument("--rules")
        if name in ("train", "embed"):
            p.add_argument("--vector-size", type=int, default=50 if name == "train" else 384)
        if name == "embed":
            p.add_argument("--encoder", choices=("hashed", "latent"), default="hashed")
            p.add_argument("--npy", action="store_true")
        if name == "picture":
            p.add_argument("--model", required=True)
            p.add_argument("--max-words", type=int, default=800)
            p.add_argument("--highlight")
        if name == "train":
            p.add_argument("--window", type=int, default=3)
            p.add_argument("--min-count", type=int, default=1)
            p.add_argument("--epochs", type=int, default=50)
        if name == "search":
            p.add_argument("--column", default=NORMAL[0])
            p.add_argument("--pattern", required=True)
        if name == "similar":
            p.add_argument("--word", required=True)
    return out


def run(spark: SparkSession, given: Sequence[str]) -> str:
    a = parser().parse_args(given)
    return STAGES[a.stage](spark, a)
