"""A cleaning pipeline over documents: each stage is one training-data operator whose decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, secret_scan, simhash, toxicity
from corpusloom.llm.common import discard, read, stored
from corpusloom.llm.queries import TOKENIZER


def _aside(docs: DataFrame, *made: str) -> DataFrame:
    """docs with columns that an operator would replace under other names."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in made})


def _back(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of a result over _aside(docs)."""
    return result.select(*(F.col(f"__own_{c}").alias(c) if f"__own_{c}" in result.columns else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    scored = toxicity.with_toxicity(_aside(docs, "score", "predicted", "evidence"), read(spark, sf_dir, "labels"))
    return _back(scored.filter("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles in common): that of the smallest id."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.scan_secrets(_aside(docs, "secret_spans"), redact="[secret]")
    return _back(clean.withColumn("n_chars", F.char_length("text").cast("long")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(_aside(docs, "size", "source_size", "target", "copies", "taken")).filter("copies > 0")
    return _back(mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of each document, and the digest of what they decode to."""
    encoded = bpe.encode_and_decode(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("bpe", encode),
]

#: Neighbour votes, SimHash and Markov models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage kept goes as soon as the next one's rows are stored, except for the last one's input."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
