"""Reading and writing pair tables, source registries and summaries."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

UNIFIED = T.StructType([T.StructField(n, T.StringType()) for n in ("pair_id", "ESP", "SHIWILU", "source", "source_pair_id")])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """RFC 4180 with or without BOM; NA literals become null."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', encoding="UTF-8", enforceSchema=False).csv(path)
    return df.select(*(tx.blank_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str, single: bool = False, bom: bool = False) -> None:
    """Header and quoting as read_csv reads them, for empty tables too; with `bom` each file starts with a byte order mark,
    as spreadsheets want it."""
    out = df.coalesce(1) if single else df
    if bom and df.columns:
        out = out.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    out.write.mode("overwrite").options(header=True, escape='"', quoteAll=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_if_any(df: DataFrame, path: str, **options) -> bool:
    if df.isEmpty():
        return False
    write_csv(df, path, **options)
    return True


def write_bytes(spark: SparkSession, body: bytes, path: str) -> None:
    """One file in a store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def existing(spark: SparkSession, path: str) -> str:
    """The path, or FileNotFoundError if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no such input: {path}")
    return path


def write_npy(vectors: DataFrame, order: str, column: str, path: str, most_rows: int = 1_000_000) -> None:
    """A float32 matrix of the vectors in the order of a column, as one .npy file; more than `most_rows` raise ValueError
    (write Parquet then)."""
    rows = vectors.select(order, column).orderBy(order).limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        raise ValueError(f"more than {most_rows} rows in one matrix")
    out = io.BytesIO()
    np.save(out, np.array(rows.column(column).to_pylist(), np.float32))
    write_bytes(vectors.sparkSession, out.getvalue(), path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, vector) of a .npy matrix."""
    raw = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.load(io.BytesIO(raw)))], "row long, vector array<float>")


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """One JSON text with a UTC timestamp, in a store that Spark reaches."""
    body = json.dumps({"timestamp": datetime.now(timezone.utc).isoformat(), **summary}, ensure_ascii=False, indent=2)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of text files, in file order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value")
    return files.select("doc_id", F.posexplode(tx.lines("value")).alias("line_no", "line"))


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_no, line_no, line) of PDF files; needs pypdf on the executors."""
    import importlib.util

    if importlib.util.find_spec("pypdf") is None:
        raise ImportError("pypdf is needed to read PDF files")

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for pdf in batches:
            rows = [(p, i, page.extract_text() or "") for p, raw in zip(pdf["path"], pdf["content"]) for i, page in enumerate(PdfReader(io.BytesIO(raw)).pages)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, "doc_id string, page_no int, text string").select("doc_id", "page_no", F.posexplode(tx.lines("text")).alias("line_no", "line"))


@dataclass(frozen=True)
class Source:
    """An entry of a source registry."""

    name: str
    path: str = ""
    esp_column: str = "ESP"
    shiwilu_column: str = "SHIWILU"
    pair_id_column: str = "pair_id"
    keep_column: str | None = None
    keep: tuple[str, ...] = ()
    enabled: bool = False

    @staticmethod
    def of(entry: dict) -> "Source":
        rule = entry.get("filter") or {}
        return Source(entry["name"], entry.get("path", ""), entry["esp_column"], entry["shiwilu_column"], entry.get("pair_id_column", "pair_id"), rule.get("column"), tuple(rule.get("keep", ())), entry.get("enabled", False))


def read_registry(path: str) -> list[Source]:
    with open(path, encoding="utf-8") as f:
        return [Source.of(x) for x in json.load(f)["sources"]]


def standardise(df: DataFrame, source: Source, order: str) -> DataFrame | None:
    """Standard columns and `ord`, or None if the source is off or lacks a text column. Fallback ids number the rows
    before the keep-filter, in the order of `order`."""
    if not source.enabled or not {source.esp_column, source.shiwilu_column} <= set(df.columns):
        return None
    from ..operators.ids import numbered

    if source.pair_id_column in df.columns:
        own, df = F.col(source.pair_id_column).cast("string"), df
    else:
        df = numbered(df, order, "__n")
        own = F.concat(F.lit(source.name + "_"), F.col("__n").cast("string"))
    if source.keep_column in df.columns and source.keep:
        df = df.filter(F.col(source.keep_column).cast("string").isin(*source.keep))
    return df.select(F.col(source.esp_column).cast("string").alias("ESP"), F.col(source.shiwilu_column).cast("string").alias("SHIWILU"), F.lit(source.name).alias("source"), own.alias("source_pair_id"), F.col(order).cast("long").alias("ord"))


def concatenated(spark: SparkSession, frames: Iterable[DataFrame]) -> DataFrame:
    """All frames with their place as source_ordinal; none gives a typed empty frame."""
    placed = [f.withColumn("source_ordinal", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, placed) if placed else spark.createDataFrame([], "ESP string, SHIWILU string, source string, source_pair_id string, ord long, source_ordinal int")
