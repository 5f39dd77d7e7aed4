"""Bilingual items out of ordered lines, by windows within ranges of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx

# The forms of lines.
HEADER, ITEM = r"^TEXTO\s+(\d+)$", r"^(\d+)\.\s*(.+)$"
PAGE, PLACE = r"^--\s*\d+\s+of\s+\d+\s*--$", r"^[A-Za-zÁÉÍÓÚáéíóúÑñ].*,\s*\d{4}$"
FOOTNOTE, FOOTNOTE_TEXT = r"^\d+\s+.+$", "para otros hablantes"


def skippable(line: Column) -> Column:
    return (line == "") | line.rlike(PAGE) | line.startswith("TEXTO ") | line.rlike(PLACE)


def numbered_items(lines: DataFrame, lines_a_range: int = 100_000) -> DataFrame:
    """(doc_id, line_no, line) -> (doc_id, block, texto_id, item_number, raw_lines).

    A header or an item opens a block; blocks that a header opens, and what precedes the first, are dropped. A document is
    read in ranges of `lines_a_range` line numbers, each of which changes the state by the blocks it opens and its last
    header; the changes are combined in order, a row a range, and then ranges are read apart. So one long file takes many tasks.
    """
    line = F.col("line")
    rows = lines.withColumns({"header": F.nullif(F.regexp_extract(line, HEADER, 1), F.lit("")).cast("int"), "item": line.rlike(ITEM)})
    rows = rows.filter(F.col("header").isNotNull() | ~skippable(line)).withColumn("item", F.col("item") & F.col("header").isNull())
    rows = rows.withColumn("__range", F.floor(F.col("line_no") / lines_a_range))
    opens = (F.col("header").isNotNull() | F.col("item")).cast("int")
    changes = rows.groupBy("doc_id", "__range").agg(F.sum(opens).alias("__opened"), F.max_by("header", F.when(F.col("header").isNotNull(), F.col("line_no"))).alias("__header"))
    before = W.partitionBy("doc_id").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    states = changes.select(F.col("doc_id").alias("__doc"), F.col("__range").alias("__at"), F.coalesce(F.sum("__opened").over(before), F.lit(0)).alias("__blocks"), F.last("__header", ignorenulls=True).over(before).alias("__texto"))
    so_far = W.partitionBy("doc_id", "__range").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"block": F.sum(opens).over(so_far), "texto_id": F.last("header", ignorenulls=True).over(so_far)})
    rows = rows.join(states, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__range") == F.col("__at")))
    rows = rows.withColumns({"block": F.col("block") + F.col("__blocks"), "texto_id": F.coalesce("texto_id", "__texto")})
    note = ~F.col("item") & F.col("header").isNull() & line.rlike(FOOTNOTE) & F.lower(line).contains(FOOTNOTE_TEXT)
    kept = rows.filter(~note)
    content = F.when(F.col("item"), tx.normalize_spaces(F.regexp_extract(line, ITEM, 2))).otherwise(tx.normalize_spaces(line))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("line_no", content.alias("line")))), lambda x: x["line"])
    blocks = kept.groupBy("doc_id", "block").agg(
        F.max(F.when(F.col("item"), F.regexp_extract(line, ITEM, 1).cast("int"))).alias("item_number"),
        F.max("texto_id").alias("texto_id"), entries.alias("raw_lines"),
    )
    out = blocks.filter("item_number is not null")
    # An item without content of its own starts with its next line.
    return out.withColumn("raw_lines", F.when(F.get("raw_lines", F.lit(0)) == "", F.slice("raw_lines", 2, F.size("raw_lines"))).otherwise(F.col("raw_lines"))).select("doc_id", "block", "texto_id", "item_number", "raw_lines")


def split_bilingual(items: DataFrame) -> DataFrame:
    """Adds SHIWILU, ESP, quality_flag: the first line is of the first side; from the first later line that looks
    Spanish on, lines are of the second; without such a line the last one is."""
    n = F.size("raw_lines")
    turns = F.transform("raw_lines", lambda x, i: (i > 0) & (tx.spanish_score(x) > tx.other_score(x)))
    items = items.withColumn("__turn", F.array_position(turns, F.lit(True)).cast("int"))
    fallback = (F.col("__turn") == 0) & (n > 1)
    cut = F.when(F.col("__turn") > 0, F.col("__turn") - 1).when(fallback, n - 1).otherwise(n)
    side = lambda a: tx.normalize_spaces(F.array_join(a, " "))
    items = items.withColumns({"SHIWILU": side(F.slice("raw_lines", F.lit(1), cut)), "ESP": side(F.slice("raw_lines", cut + 1, n)), "__back": fallback})
    notes = tx.joined(F.when(F.col("__back"), "fallback_last_line_as_spanish"), F.when(F.col("SHIWILU") == "", "missing_shiwilu"), F.when(F.col("ESP") == "", "missing_spanish"), sep="|")
    flag = F.when(n == 0, "empty_block").otherwise(F.coalesce(notes, F.lit("ok")))
    return items.withColumn("quality_flag", flag).drop("__turn", "__back")


def parallel_table(items: DataFrame) -> DataFrame:
    """Split items with ids from text and item number; -1 stands for no text."""
    texto = F.coalesce("texto_id", F.lit(-1))
    return split_bilingual(items).select(F.format_string("T%03d_N%03d", texto, "item_number").alias("pair_id"), "doc_id", texto.alias("texto_id"), "item_number", "SHIWILU", "ESP", "quality_flag")


def flag_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("quality_flag").agg(F.count("*").alias("n"), F.count_if(F.col("quality_flag") == "ok").alias("n_ok"))
