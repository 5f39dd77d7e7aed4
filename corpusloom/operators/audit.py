"""Checks of a normalized pair table: each gives (pair_id, problem_type, details) rows with the four texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .popular import popular_hashes, with_figures
from .store import stored

TEXTS = ["ESP_original", "SHIWILU_original", "ESP_normalizado", "SHIWILU_normalizado"]
SIDES = ["ESP", "SHIWILU"]
KEY = ["ESP_normalizado", "SHIWILU_normalizado"]


def _problems(df: DataFrame, kind: Column | str, details: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select("pair_id", kind.alias("problem_type"), details.alias("details"), *TEXTS).filter("details is not null")


def _empty_details() -> Column:
    return tx.joined(*(F.when(F.col(c).isNull() | (tx.strip(F.col(c)) == ""), f"{c} vacío") for c in TEXTS))


def empty_fields(df: DataFrame) -> DataFrame:
    return _problems(df, "empty_field", _empty_details())


def _groups(df: DataFrame) -> DataFrame:
    return df.filter(" and ".join(f"{k} is not null" for k in KEY)).groupBy(*KEY).agg(F.min("pair_id").alias("first"), F.count("*").alias("n")).filter("n > 1")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Members of equal pairs but the first (by pair_id). Groups are aggregated before they meet their rows."""
    return _problems(with_figures(df, _groups(df), KEY, "pair_id"), "exact_duplicate", _duplicate_details())


def _duplicate_details() -> Column:
    return F.when(F.col("pair_id") != F.col("first"), F.format_string("Duplicado de %s (grupo de %d)", "first", "n"))


def duplicate_members(df: DataFrame) -> DataFrame:
    """All members of equal pairs, nulls equal to nulls."""
    return with_figures(df, df.groupBy(*KEY).agg(F.count("*").alias("members")).filter("members > 1"), KEY, "pair_id", null_safe=True)


def duplicate_stats(df: DataFrame) -> DataFrame:
    return _groups(df).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"))


def _variants(df: DataFrame, key: str, other: str, out: str) -> DataFrame:
    """Texts with several counterparts; the number counts a null counterpart too."""
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(other).alias("d"), F.max(F.col(other).isNull().cast("int")).alias("z"))
    return g.filter("d > 1").select(key, (F.col("d") + F.col("z")).alias(out))


def _with_variants(df: DataFrame, rows: DataFrame, popular: list[list[int]]) -> DataFrame:
    """rows, those of df with more columns, with the variants of both sides in df; popular keys of each side are given."""
    one, two = popular
    rows = with_figures(rows, _variants(df, *KEY, "m"), KEY[:1], "pair_id", "left", popular=one)
    return with_figures(rows, _variants(df, *KEY[::-1], "k"), KEY[1:], "pair_id", "left", popular=two)


def _conflict_kind() -> Column:
    return F.when(F.col("m").isNotNull() & F.col("k").isNotNull(), "bidirectional_conflict").when(F.col("m").isNotNull(), "one_to_many_esp").otherwise("many_to_one_shiwilu")


def _conflict_details() -> Column:
    one = F.when(F.col("m").isNotNull(), F.format_string("ESP tiene %d traducciones SHIWILU diferentes", "m"))
    many = F.when(F.col("m").isNull() & F.col("k").isNotNull(), F.format_string("SHIWILU tiene %d traducciones ESP diferentes", "k")).when(F.col("k").isNotNull(), F.format_string("SHIWILU tiene %d traducciones ESP", "k"))
    return tx.joined(one, many)


def conflicts(df: DataFrame) -> DataFrame:
    return _problems(_with_variants(df, df, popular_hashes(df, KEY[:1], KEY[1:])), _conflict_kind(), _conflict_details())


def measured(df: DataFrame) -> DataFrame:
    out = df.withColumns({"esp_words": tx.n_tokens(F.col(KEY[0])), "shi_words": tx.n_tokens(F.col(KEY[1]))})
    return out.withColumn("length_ratio", F.col("esp_words") / F.when(F.col("shi_words") == 0, 1).otherwise(F.col("shi_words")))


def _limited(df: DataFrame) -> DataFrame:
    rows = measured(df)
    limits = rows.agg(*((F.avg(c) + 3 * F.stddev_samp(c)).alias(f"{c}_most") for c in ("esp_words", "shi_words")))
    return rows.crossJoin(F.broadcast(limits))  # one row


def length_issues(df: DataFrame) -> DataFrame:
    return _problems(_limited(df), "length_issue", _length_details())


def _length_details() -> Column:
    def side(name: str, c: str) -> Column:
        long = F.concat(F.format_string(f"{name} muy largo (%d palabras, umbral: ", c), tx.fixed(F.col(f"{c}_most"), 0), F.lit(")"))
        return F.when(F.col(c) <= 0, f"{name} sin palabras").when(F.col(c) > F.col(f"{c}_most"), long)

    shown = F.concat(F.lit(" (ratio: "), tx.fixed(F.col("length_ratio"), 2), F.lit(")"))
    both = (F.col("esp_words") > 0) & (F.col("shi_words") > 0)
    ratio = F.when(both & (F.col("length_ratio") > 3.0), F.concat(F.lit("ESP mucho más largo que SHIWILU"), shown)).when(both & (F.col("length_ratio") < 0.33), F.concat(F.lit("SHIWILU mucho más largo que ESP"), shown))
    return tx.joined(side("ESP", "esp_words"), side("SHIWILU", "shi_words"), ratio)


def length_stats(df: DataFrame) -> DataFrame:
    rows = measured(df)
    out = []
    for c in ("esp_words", "shi_words"):
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), tx.fixed(F.avg(c), 2).alias(f"{c}_mean"), tx.fixed(F.stddev_samp(c), 2).alias(f"{c}_std"), F.median(c).cast("int").alias(f"{c}_median")]
    return rows.agg(*out, *(tx.fixed(f("length_ratio"), 2).alias(f"length_ratio_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def suspicious_content(df: DataFrame) -> DataFrame:
    return _problems(df, "suspicious_content", _suspicious_details())


def _suspicious_details() -> Column:
    def listed(c: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(tx.suspicious(c), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    tests = [
        lambda s, c: F.when(c.rlike(r"\(.*?\)"), f"{s} contiene paréntesis (posible glosa)"),
        lambda s, c: F.when(c.rlike(r"[\[\]<>{}]"), f"{s} contiene marcadores de glosa []<>{{}}"),
        lambda s, c: F.when(F.size(tx.suspicious(c)) > 0, F.concat(F.lit(f"{s} contiene caracteres sospechosos: "), listed(c))),
        lambda s, c: F.when(tx.without_blanks(c).rlike(r"^\p{Nd}+$"), f"{s} es solo números"),
    ]
    return tx.joined(*(t(s, F.col(f"{s}_original")) for t in tests for s in SIDES))


def audited(df: DataFrame) -> DataFrame:
    """All rows with `issues`, array<struct<check_ordinal, problem_type, details>>, and `has_audit_flags`.

    One pass over the rows: the checks of a row are columns of it, and what duplicates, conflicts and lengths need from
    other rows is aggregated before it meets them. The rows are stored first, so that what made them runs once. Duplicates and
    variants are found on MD5 digests in the place of texts; the texts are shuffled once, by a number of their row.
    """
    columns = df.columns
    df = stored(df.withColumn("__row", F.monotonically_increasing_id()))
    narrow = df.select("__row", "pair_id", *(F.unhex(F.md5(k)).alias(k) for k in KEY))
    pairs, *sides = popular_hashes(narrow, KEY, KEY[:1], KEY[1:])
    rows = with_figures(narrow, _groups(narrow), KEY, "pair_id", "left", popular=pairs)
    figures = _with_variants(narrow, rows, sides).filter(F.coalesce("n", "m", "k").isNotNull()).select("__row", "first", "n", "m", "k")
    rows = _limited(df.join(figures, "__row", "left"))
    found = (
        (F.lit("empty_field"), _empty_details()), (F.lit("exact_duplicate"), _duplicate_details()), (_conflict_kind(), _conflict_details()),
        (F.lit("length_issue"), _length_details()), (F.lit("suspicious_content"), _suspicious_details()),
    )
    issues = F.array(*(F.struct(F.lit(i).alias("check_ordinal"), kind.alias("problem_type"), details.alias("details")) for i, (kind, details) in enumerate(found)))
    out = rows.withColumn("issues", F.filter(issues, lambda x: x["details"].isNotNull()))
    return out.select(*columns, "issues", (F.size("issues") > 0).alias("has_audit_flags"))


def all_problems(df: DataFrame) -> DataFrame:
    return audited(df).select("pair_id", F.explode("issues").alias("x"), *TEXTS).select("pair_id", "x.problem_type", "x.details", *TEXTS, "x.check_ordinal")


def by_type(problems: DataFrame) -> DataFrame:
    return problems.groupBy("problem_type").agg(F.count("*").alias("n"))


def consolidated(problems: DataFrame) -> DataFrame:
    """One row a pair: its types, sorted, and its details in the order of the checks."""
    types = F.array_join(F.array_sort(F.collect_set("problem_type")), "|")
    details = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("check_ordinal", "details"))), lambda x: x["details"]), " || ")
    return problems.groupBy("pair_id").agg(types.alias("problem_types"), details.alias("all_details"), *(F.first(t).alias(t) for t in TEXTS))


def flagged(df: DataFrame) -> DataFrame:
    """All rows with has_audit_flags."""
    return audited(df).drop("issues")


def row_counts(df: DataFrame) -> DataFrame:
    """(rows_with_problems, clean_rows): ids with and rows less those ids."""
    bad = F.countDistinct(F.when(F.col("has_audit_flags"), F.col("pair_id")))
    return audited(df).agg(bad.alias("rows_with_problems"), (F.count("*") - bad).alias("clean_rows"))
