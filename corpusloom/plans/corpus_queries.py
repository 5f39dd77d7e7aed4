"""Registered queries over the corpus operators, and their SQL.

Pairs are all lines of each document, two by two, made untidy by doc_id and their number so that every rule has work to do.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, embed, extract, latent, lookup, postings, prepare, vectors, vocabulary
from ..sources.tables import Source, concatenated, standardise

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- inputs

WS = f"[{tx.WSC}]"
_RAW = """raw AS (
  SELECT doc_id, source, k, doc_id * 1048576 + k AS row_id, ls[2 * k + 1] AS l, coalesce(ls[2 * k + 2], '') AS r
  FROM (SELECT doc_id, source, ls, unnest(range((len(ls) + 1) // 2)) AS k FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)))"""
_P = _RAW + """, p AS (
  SELECT row_id, doc_id, k, source,
    CASE (doc_id + k) % 8 WHEN 0 THEN '  ' || l WHEN 1 THEN l || chr(160) WHEN 2 THEN replace(l, ', ', ' , ') WHEN 3 THEN '"' || l || '"'
      WHEN 4 THEN '[x] ' || l WHEN 7 THEN replace(l, 'e', 'e' || chr(769)) ELSE l END AS "ESP",
    CASE (doc_id + k) % 16 WHEN 5 THEN '--' WHEN 6 THEN NULL WHEN 8 THEN '12 34' WHEN 9 THEN '  ' ELSE r END AS "SHIWILU"
  FROM raw
)"""


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, doc_id, k, source, l, r): lines 2k + 1 and 2k + 2 of each document; a missing last one is empty."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", "\n").alias("ls"))
    two = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 2).cast("int")), lambda k: F.struct(k.cast("long").alias("k"), F.get("ls", 2 * k).alias("l"), F.coalesce(F.get("ls", 2 * k + 1), F.lit("")).alias("r")))
    rows = lines.filter("ls is not null").select("doc_id", "source", F.explode(two).alias("x")).select("doc_id", "source", "x.*")
    return rows.withColumn("row_id", F.col("doc_id") * (1 << 20) + F.col("k"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, left, right = F.col("doc_id") + F.col("k"), F.col("l"), F.col("r")
    m = at % 8
    esp = (
        F.when(m == 0, F.concat(F.lit("  "), left)).when(m == 1, F.concat(left, F.lit("\u00a0"))).when(m == 2, F.replace(left, F.lit(", "), F.lit(" , ")))
        .when(m == 3, F.concat(F.lit('"'), left, F.lit('"'))).when(m == 4, F.concat(F.lit("[x] "), left)).when(m == 7, F.replace(left, F.lit("e"), F.lit("e\u0301"))).otherwise(left)
    )
    n = at % 16
    shi = F.when(n == 5, "--").when(n == 6, None).when(n == 8, "12 34").when(n == 9, "  ").otherwise(right)
    return raw_pairs(spark, sf_dir).select("row_id", "doc_id", "k", "source", esp.alias("ESP"), shi.alias("SHIWILU"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_RULE_SQL = [
    ("unicode_nfc", lambda x: f"nfc_normalize({x})"), ("trim", _strip), ("collapse_spaces", lambda x: f"regexp_replace({x}, '{WS}{{2,}}', ' ', 'g')"),
    ("normalize_comma_space", lambda x: f"replace({x}, ' , ', ', ')"), ("lowercase", lambda x: f"lower({x})"), ("remove_double_quotes", lambda x: f"""regexp_replace({x}, '["“”«»]', '', 'g')"""),
]


def _chain() -> str:
    """CTEs t0 to t6, a rule each; n is the normalized table."""
    out = [_P, """t0 AS (SELECT printf('D%08d_%05d', doc_id, k) AS pair_id, source, "ESP" AS e0, "SHIWILU" AS s0 FROM p)"""]
    for i, (_, f) in enumerate(_RULE_SQL):
        out.append(f"t{i + 1} AS (SELECT *, {f(f'e{i}')} AS e{i + 1}, {f(f's{i}')} AS s{i + 1} FROM t{i})")
    out.append('n AS (SELECT pair_id, e0 AS "ESP_original", s0 AS "SHIWILU_original", e6 AS "ESP_normalizado", s6 AS "SHIWILU_normalizado", source FROM t6)')
    return ", ".join(out)


_LOG = "log AS (" + " UNION ALL ".join(
    f"SELECT pair_id, '{side}' AS \"column\", '{rule}' AS rule_name, {v}{i} AS \"before\", {v}{i + 1} AS \"after\" FROM t6 WHERE {v}{i} <> {v}{i + 1}"
    for v, side in (("e", "ESP"), ("s", "SHIWILU")) for i, (rule, _) in enumerate(_RULE_SQL)
) + ")"


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(F.format_string("D%08d_%05d", "doc_id", "k").alias("pair_id"), "ESP", "SHIWILU", "source")


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.normalize(identified(spark, sf_dir))[0]


# ---------------------------------------------------------------- filter, unify

_REASON = f"""j AS (SELECT *, CASE WHEN "ESP" IS NULL THEN 'ESP es NaN' WHEN "SHIWILU" IS NULL THEN 'SHIWILU es NaN'
  WHEN {_strip('"ESP"')} = '' THEN 'ESP vacío tras strip' WHEN {_strip('"SHIWILU"')} = '' THEN 'SHIWILU vacío tras strip'
  WHEN {_strip('"SHIWILU"')} = '--' THEN 'SHIWILU es placeholder ''--''' END AS removal_reason FROM p)"""


def routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return prepare.route(pairs(spark, sf_dir).select(F.col("row_id").alias("row_index"), "ESP", "SHIWILU"))


@query(f"""WITH {_P}, {_REASON} SELECT printf('P%05d', row_number() OVER (ORDER BY row_id) - 1) AS pair_id, "ESP", "SHIWILU" FROM j WHERE removal_reason IS NULL""")
def filter_valid_pairs(spark, sf_dir):
    return routed(spark, sf_dir)[0]


@query(f"""WITH {_P}, {_REASON} SELECT row_id AS original_index, "ESP", "SHIWILU", removal_reason FROM j WHERE removal_reason IS NOT NULL""")
def removed_rows_with_reason(spark, sf_dir):
    return routed(spark, sf_dir)[1]


@query(f"WITH {_P}, {_REASON} SELECT removal_reason, count(*) AS n FROM j WHERE removal_reason IS NOT NULL GROUP BY 1")
def removal_reason_counts(spark, sf_dir):
    return routed(spark, sf_dir)[1].groupBy("removal_reason").agg(F.count("*").alias("n"))


def sources(spark: SparkSession, sf_dir: str) -> list[tuple[Source, DataFrame]]:
    talk = qa_pairs(spark, sf_dir).withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return [
        (Source("web", esp_column="text", shiwilu_column="lang", pair_id_column="doc_id", keep_column="lang", keep=("es", "en"), enabled=True), read(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))),
        (Source("bench", esp_column="text", shiwilu_column="text2", enabled=True), read(spark, sf_dir, "benchmark").withColumns({"text2": F.concat(F.lit("b "), "text"), "ord": F.col("item_id")})),
        (Source("talk", esp_column="question", shiwilu_column="answer", pair_id_column="conv_id", enabled=True), talk),
        (Source("off", esp_column="text", shiwilu_column="lang"), read(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))),
    ]


_QA = """qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_U = f"""{_QA}, u AS (
  SELECT 0 AS so, doc_id AS o, text AS "ESP", lang AS "SHIWILU", 'web' AS source, CAST(doc_id AS VARCHAR) AS source_pair_id FROM documents WHERE lang IN ('es', 'en')
  UNION ALL SELECT 1, item_id, text, 'b ' || text, 'bench', 'bench_' || (row_number() OVER (ORDER BY item_id) - 1) FROM benchmark
  UNION ALL SELECT 2, conv_id * 1000 + turn, question, answer, 'talk', CAST(conv_id AS VARCHAR) FROM qa)"""


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = (standardise(df, s, "ord") for s, df in sources(spark, sf_dir))
    return concatenated(spark, [f for f in frames if f is not None])


@query(f"""WITH {_U} SELECT printf('U%05d', row_number() OVER (ORDER BY so, o) - 1) AS pair_id, "ESP", "SHIWILU", source, source_pair_id FROM u""")
def unify_sources(spark, sf_dir):
    return prepare.unify(unified(spark, sf_dir))


@query(f"""WITH {_U}, names AS (SELECT unnest(['web', 'bench', 'talk', 'off']) AS source)
  SELECT source, count("ESP") AS n, count("ESP") > 0 AS filled FROM names LEFT JOIN u USING (source) GROUP BY 1""")
def source_counts(spark, sf_dir):
    names = spark.createDataFrame([(s.name,) for s, _ in sources(spark, sf_dir)], "source string")
    n = unified(spark, sf_dir).groupBy("source").agg(F.count("ESP").alias("n"))
    return names.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") > 0, F.lit(False)).alias("filled"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('fr', 'de')")
def keep_list_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.col("lang").isin("fr", "de")).select("doc_id", "lang", "source")


@query(f"""WITH {_RAW}, k AS (SELECT row_id, source, {_strip('lower(l)')} AS e, {_strip('lower(r)')} AS s FROM raw),
  d AS (SELECT e, s FROM k GROUP BY 1, 2 HAVING count(DISTINCT source) > 1)
  SELECT row_id, source, substr(e, 1, 20) || '|' || substr(s, 1, 20) AS duplicate_group FROM k JOIN d USING (e, s)""")
def cross_source_duplicates(spark, sf_dir):
    d = raw_pairs(spark, sf_dir).select("row_id", "source", F.col("l").alias("ESP"), F.col("r").alias("SHIWILU"))
    return prepare.cross_duplicates(d).select("row_id", "source", "duplicate_group")


# ---------------------------------------------------------------- normalize

_N = "WITH " + _chain()


@query(f"{_N} SELECT * FROM n")
def normalize_pairs(spark, sf_dir):
    return normalized(spark, sf_dir)


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.normalize(identified(spark, sf_dir))[1]


@query(f"{_N}, {_LOG} SELECT * FROM log")
def normalization_log(spark, sf_dir):
    return change_log(spark, sf_dir)


@query(f"{_N}, {_LOG} SELECT rule_name, count(*) AS n FROM log GROUP BY 1")
def normalization_stats_by_rule(spark, sf_dir):
    return change_log(spark, sf_dir).groupBy("rule_name").agg(F.count("*").alias("n"))


@query(f"""{_N}, {_LOG} SELECT c AS "column", count(log."column") AS n FROM (SELECT unnest(['ESP', 'SHIWILU']) AS c) LEFT JOIN log ON c = log."column" GROUP BY 1""")
def normalization_stats_by_column(spark, sf_dir):
    sides = spark.createDataFrame([("ESP",), ("SHIWILU",)], "column string")
    n = change_log(spark, sf_dir).groupBy("column").agg(F.count("*").alias("n"))
    return sides.join(n, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_N}, {_LOG} SELECT count(DISTINCT pair_id) AS rows_changed, count(*) AS transformations FROM log")
def rows_with_changes(spark, sf_dir):
    return change_log(spark, sf_dir).agg(F.countDistinct("pair_id").alias("rows_changed"), F.count("*").alias("transformations"))


# ---------------------------------------------------------------- audit

_T = '"ESP_original", "SHIWILU_original", "ESP_normalizado", "SHIWILU_normalizado"'
_E, _S = '"ESP_normalizado"', '"SHIWILU_normalizado"'


def _problem(ctes: str, kind: str, details: str, rows: str) -> str:
    return f"{ctes} SELECT pair_id, {kind} AS problem_type, {details} AS details, {_T} FROM {rows} WHERE {details} IS NOT NULL"


def _joined(*issues: str) -> str:
    return f"nullif(concat_ws('; ', {', '.join(issues)}), '')"


_EMPTY = _joined(*(f"CASE WHEN {c} IS NULL OR {_strip(c)} = '' THEN {c[1:-1]!r} || ' vacío' END" for c in _T.split(", ")))
_DUP = f"g AS (SELECT {_E} AS e, {_S} AS s, min(pair_id) AS f, count(*) AS c FROM n WHERE {_E} IS NOT NULL AND {_S} IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"
_DUPS = f"dups AS (SELECT n.*, printf('Duplicado de %s (grupo de %d)', f, c) AS d FROM n JOIN g ON {_E} = e AND {_S} = s WHERE pair_id <> f)"
_CONF = f"""a AS (SELECT {_E} AS e, count(DISTINCT {_S}) + max(({_S} IS NULL)::INT) AS m FROM n WHERE {_E} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_S}) > 1),
  b AS (SELECT {_S} AS s, count(DISTINCT {_E}) + max(({_E} IS NULL)::INT) AS k FROM n WHERE {_S} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {_E}) > 1),
  conf AS (SELECT n.*, m, k, CASE WHEN m IS NOT NULL AND k IS NOT NULL THEN 'bidirectional_conflict' WHEN m IS NOT NULL THEN 'one_to_many_esp' ELSE 'many_to_one_shiwilu' END AS kind,
  nullif(concat_ws('; ', CASE WHEN m IS NOT NULL THEN 'ESP tiene ' || m || ' traducciones SHIWILU diferentes' END,
    CASE WHEN k IS NOT NULL THEN 'SHIWILU tiene ' || k || ' traducciones ESP' || CASE WHEN m IS NULL THEN ' diferentes' ELSE '' END END), '') AS d
  FROM n LEFT JOIN a ON {_E} = e LEFT JOIN b ON {_S} = s)"""
_tok = lambda x: f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
_LEN = f"""l0 AS (SELECT *, len({_tok(_E)}) AS ew, len({_tok(_S)}) AS sw FROM n),
  l1 AS (SELECT *, ew / CAST(CASE WHEN sw = 0 THEN 1 ELSE sw END AS DOUBLE) AS lr FROM l0),
  l2 AS (SELECT avg(ew) + 3 * stddev_samp(ew) AS et, avg(sw) + 3 * stddev_samp(sw) AS st FROM l1),
  len_ AS (SELECT *, nullif(concat_ws('; ',
    CASE WHEN ew <= 0 THEN 'ESP sin palabras' WHEN ew > et THEN printf('ESP muy largo (%d palabras, umbral: %.0f)', ew, et) END,
    CASE WHEN sw <= 0 THEN 'SHIWILU sin palabras' WHEN sw > st THEN printf('SHIWILU muy largo (%d palabras, umbral: %.0f)', sw, st) END,
    CASE WHEN ew > 0 AND sw > 0 AND lr > 3.0 THEN printf('ESP mucho más largo que SHIWILU (ratio: %.2f)', lr)
         WHEN ew > 0 AND sw > 0 AND lr < 0.33 THEN printf('SHIWILU mucho más largo que ESP (ratio: %.2f)', lr) END), '') AS d FROM l1, l2)"""
_odd = lambda c: f"list_sort(list_distinct(regexp_extract_all({c}, '[^{tx.WORD}{tx.WSC}''\\-.,;:¡!¿?]')))[1:5]"
_SUSP = "susp AS (SELECT *, " + _joined(*(
    f.format(s=s, c=f'"{s}_original"', odd=_odd(f'"{s}_original"'), bare=f"""regexp_replace("{s}_original", '{WS}+', '', 'g')""")
    for f in (
        "CASE WHEN regexp_matches({c}, '\\(.*?\\)') THEN '{s} contiene paréntesis (posible glosa)' END",
        "CASE WHEN regexp_matches({c}, '[\\[\\]<>{{}}]') THEN '{s} contiene marcadores de glosa []<>{{}}' END",
        "CASE WHEN len({odd}) > 0 THEN '{s} contiene caracteres sospechosos: [''' || array_to_string({odd}, ''', ''') || ''']' END",
        "CASE WHEN regexp_matches({bare}, '^\\p{{Nd}}+$') THEN '{s} es solo números' END",
    )
    for s in ("ESP", "SHIWILU")
)) + " AS d FROM n)"
_ALL = f"""{_N}, {_DUP}, {_DUPS}, {_CONF}, {_LEN}, {_SUSP}, pr AS (
  SELECT pair_id, 'empty_field' AS problem_type, {_EMPTY} AS details, 0 AS o, {_T} FROM n WHERE {_EMPTY} IS NOT NULL
  UNION ALL SELECT pair_id, 'exact_duplicate', d, 1, {_T} FROM dups
  UNION ALL SELECT pair_id, kind, d, 2, {_T} FROM conf WHERE d IS NOT NULL
  UNION ALL SELECT pair_id, 'length_issue', d, 3, {_T} FROM len_ WHERE d IS NOT NULL
  UNION ALL SELECT pair_id, 'suspicious_content', d, 4, {_T} FROM susp WHERE d IS NOT NULL)"""


@query(_problem(_N, "'empty_field'", _EMPTY, "n"))
def audit_empty_fields(spark, sf_dir):
    return audit.empty_fields(normalized(spark, sf_dir))


@query(_problem(f"{_N}, {_DUP}, {_DUPS}", "'exact_duplicate'", "d", "dups"))
def audit_exact_duplicates(spark, sf_dir):
    return audit.exact_duplicates(normalized(spark, sf_dir))


@query(f"{_N} SELECT * FROM (SELECT pair_id, count(*) OVER (PARTITION BY {_E}, {_S}) AS members FROM n) WHERE members > 1")
def duplicate_members(spark, sf_dir):
    return audit.duplicate_members(normalized(spark, sf_dir)).select("pair_id", "members")


@query(f"{_N}, {_DUP} SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS surplus_rows FROM g")
def duplicate_stats(spark, sf_dir):
    return audit.duplicate_stats(normalized(spark, sf_dir))


@query(_problem(f"{_N}, {_CONF}", "kind", "d", "conf"))
def audit_translation_conflicts(spark, sf_dir):
    return audit.conflicts(normalized(spark, sf_dir))


@query(_problem(f"{_N}, {_LEN}", "'length_issue'", "d", "len_"))
def audit_length_issues(spark, sf_dir):
    return audit.length_issues(normalized(spark, sf_dir))


@query(f"{_N}, {_LEN} SELECT " + ", ".join(
    f"CAST(min({a}) AS INT) AS {b}_min, CAST(max({a}) AS INT) AS {b}_max, printf('%.2f', avg({a})) AS {b}_mean, printf('%.2f', stddev_samp({a})) AS {b}_std, CAST(floor(median({a})) AS INT) AS {b}_median"
    for a, b in (("ew", "esp_words"), ("sw", "shi_words"))
) + ", printf('%.2f', min(lr)) AS length_ratio_min, printf('%.2f', max(lr)) AS length_ratio_max, printf('%.2f', avg(lr)) AS length_ratio_mean FROM l1")
def length_stats(spark, sf_dir):
    return audit.length_stats(normalized(spark, sf_dir))


@query(_problem(f"{_N}, {_SUSP}", "'suspicious_content'", "d", "susp"))
def audit_suspicious_content(spark, sf_dir):
    return audit.suspicious_content(normalized(spark, sf_dir))


@query(f"{_ALL} SELECT problem_type, count(*) AS n FROM pr GROUP BY 1")
def problems_by_type(spark, sf_dir):
    return audit.by_type(audit.all_problems(normalized(spark, sf_dir)))


@query(f"""{_ALL} SELECT pair_id, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT unnest(list_distinct(list(problem_type))) AS x)) AS problem_types,
  string_agg(details, ' || ' ORDER BY o, details) AS all_details, {', '.join(f'any_value({c}) AS {c}' for c in _T.split(', '))} FROM pr GROUP BY pair_id""")
def consolidated_problems(spark, sf_dir):
    return audit.consolidated(audit.all_problems(normalized(spark, sf_dir)))


@query(f"{_ALL} SELECT n.*, pair_id IN (SELECT pair_id FROM pr) AS has_audit_flags FROM n")
def final_flagged_dataset(spark, sf_dir):
    return audit.flagged(normalized(spark, sf_dir))


@query(f"{_ALL} SELECT count(DISTINCT pair_id) AS rows_with_problems, (SELECT count(*) FROM n) - count(DISTINCT pair_id) AS clean_rows FROM pr")
def problem_row_counts(spark, sf_dir):
    return audit.row_counts(normalized(spark, sf_dir))


# ---------------------------------------------------------------- vocabulary

_TOKENS = f"tk AS (SELECT doc_id, lang, unnest({_tok('text')}) AS token, generate_subscripts({_tok('text')}, 1) AS pos FROM documents)"
_COUNTS = f"WITH {_TOKENS}, c AS (SELECT lang, token, count(*) AS n, min((doc_id, pos)) AS first FROM tk GROUP BY 1, 2)"


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.counts(read(spark, sf_dir, "documents"), F.col("text"), "lang", "doc_id")


@query(f"{_COUNTS} SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, printf('%.4f', count(*) / CAST(greatest(sum(n), 1) AS DOUBLE)) AS ttr, count(*) FILTER (n = 1) AS hapax FROM c GROUP BY 1")
def vocabulary_stats(spark, sf_dir):
    return vocabulary.stats(token_counts(spark, sf_dir), "lang")


@query(f"{_COUNTS} SELECT * FROM (SELECT lang, token, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) AS INT) AS rank FROM c) WHERE rank <= 20")
def top20_words(spark, sf_dir):
    return vocabulary.most_common(token_counts(spark, sf_dir), "lang")


@query(f"{_COUNTS} SELECT lang, token FROM c WHERE n = 1")
def hapax_words(spark, sf_dir):
    return token_counts(spark, sf_dir).filter("n = 1").select("lang", "token")


_clean = lambda c: _strip(f"""regexp_replace(regexp_replace(coalesce({c}, ''), '[!?.,;:¡¿"()“”]', ' ', 'g'), '{WS}{{2,}}', ' ', 'g')""")
_SENT = f"""sent AS (SELECT * FROM (SELECT row_id, 0 AS lang_ord, {_tok(_clean('"ESP"'))} AS t FROM p UNION ALL SELECT row_id, 1, {_tok(_clean('"SHIWILU"'))} FROM p) WHERE len(t) > 0)"""


@query(f"WITH {_P}, {_SENT} SELECT row_id, lang_ord, array_to_string(t, ' ') AS sentence, len(t) AS n FROM sent")
def token_sentences(spark, sf_dir):
    s = vocabulary.sentences(pairs(spark, sf_dir), "row_id")
    return s.select("row_id", "lang_ord", F.array_join("tokens", " ").alias("sentence"), F.size("tokens").cast("long").alias("n"))


@query(f"WITH {_P}, {_SENT} SELECT count(*) AS sentences, CAST(sum(len(t)) AS BIGINT) AS tokens FROM sent")
def token_totals(spark, sf_dir):
    return vocabulary.sentences(pairs(spark, sf_dir), "row_id").agg(F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens"))


def _vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    words = vocabulary.occurrences(read(spark, sf_dir, "documents"), F.col("text"), "lang")
    return tuple(words.filter(F.col("lang") == x).select("token").distinct() for x in ("es", "en"))


_V = f"WITH {_TOKENS}, es AS (SELECT DISTINCT token FROM tk WHERE lang = 'es'), en AS (SELECT DISTINCT token FROM tk WHERE lang = 'en')"


@query(f"{_V} SELECT token FROM es INTERSECT SELECT token FROM en")
def vocab_overlap(spark, sf_dir):
    return vocabulary.exclusive(*_vocabularies(spark, sf_dir))[2]


@query(f"{_V} SELECT 'es' AS side, token FROM (SELECT token FROM es EXCEPT SELECT token FROM en) UNION ALL SELECT 'en', token FROM (SELECT token FROM en EXCEPT SELECT token FROM es)")
def vocab_exclusive(spark, sf_dir):
    es, en, _ = vocabulary.exclusive(*_vocabularies(spark, sf_dir))
    return es.select(F.lit("es").alias("side"), "token").unionByName(en.select(F.lit("en").alias("side"), "token"))


@query(f"{_V} SELECT token FROM es UNION SELECT token FROM en")
def vocab_union(spark, sf_dir):
    es, en = _vocabularies(spark, sf_dir)
    return es.union(en).distinct()


@query(f"{_V} SELECT token FROM es ORDER BY token LIMIT 800")
def sorted_vocabulary(spark, sf_dir):
    return _vocabularies(spark, sf_dir)[0].orderBy("token").limit(800)


@query("SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)THE .*ING') ORDER BY doc_id LIMIT 10")
def corpus_search(spark, sf_dir):
    return vocabulary.search(read(spark, sf_dir, "documents"), "text", "THE .*ING", "doc_id", 10).select("doc_id", "lang")


#: Patterns of the indexed search: words, alternatives, classes, repeats, one that no text holds and one that needs no trigram.
_PATTERNS = ("the .*ing", "(secret|token)[ =:]+", "licen[cs]e", "[0-9]{4}-[0-9]{2}", "(abc|and the)+ [a-z]+", "qzxqzx", "a.b")


@query(" UNION ALL ".join(f"SELECT '{x}' AS pattern, doc_id FROM documents WHERE regexp_matches(text, '(?i){x}')" for x in _PATTERNS))
def indexed_search(spark, sf_dir):
    index = postings.build(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    found = [index.matches(x).select(F.lit(x).alias("pattern"), "doc_id") for x in _PATTERNS]
    return functools.reduce(DataFrame.unionByName, found)


@query(f"WITH {_TOKENS} SELECT contains(token, '''') AS apostrophe, count(DISTINCT token) AS n FROM tk GROUP BY 1")
def apostrophe_vocab(spark, sf_dir):
    words = vocabulary.occurrences(read(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return words.groupBy(F.contains("token", F.lit("'")).alias("apostrophe")).agg(F.countDistinct("token").alias("n"))


@query(f"WITH {_QA} SELECT * FROM qa")
def qa_pairs(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])


# ---------------------------------------------------------------- extraction

_LINES = rf"""ln AS (
  SELECT doc_id, i - 1 AS line_no, CASE WHEN i = 1 AND doc_id % 10 = 0 THEN 'TEXTO ' || (doc_id % 7 + 1) WHEN i % 3 = 2 THEN ((i - 1) // 3 + 1) || '. ' || x ELSE x END AS line
  FROM (SELECT doc_id, i, {_strip('ls[i]')} AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
    FROM (SELECT doc_id, string_split(rtrim_one, chr(10)) AS ls FROM (SELECT doc_id, regexp_replace(text, '\n$', '') AS rtrim_one FROM documents))))
)"""


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "x"))
    i, x = F.col("line_no"), F.col("x")
    line = F.when((i == 0) & (F.col("doc_id") % 10 == 0), F.concat(F.lit("TEXTO "), (F.col("doc_id") % 7 + 1).cast("string"))).when(i % 3 == 1, F.concat((F.floor(i / 3) + 1).cast("string"), F.lit(". "), x)).otherwise(x)
    return rows.select("doc_id", "line_no", line.alias("line"))


_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_apos = lambda x: f"(length({x}) - length(translate({x}, '''’', '')))"
_sp = lambda x: f"""(len(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^{tx.WORD}]+', ' ', 'g'), ' '), lambda w: w IN ({_STOPS}))) + regexp_matches({x}, '[áéíóúÁÉÍÓÚ¿¡]')::INT - {_apos(x)})"""
_sh = lambda x: f"({_apos(x)} + len(regexp_extract_all(lower({x}), '{tx.CLUSTERS}')))"
_space = lambda x: _strip(f"regexp_replace({x}, '{WS}{{2,}}', ' ', 'g')")
_ITEMS = rf"""{_LINES}, k AS (
  SELECT *, CAST(nullif(regexp_extract(line, '^TEXTO\s+(\d+)$', 1), '') AS INT) AS header, regexp_matches(line, '^\d+\.\s*.+$') AS item FROM ln
), f AS (SELECT * FROM k WHERE header IS NOT NULL OR NOT (line = '' OR regexp_matches(line, '^--\s*\d+\s+of\s+\d+\s*--$') OR starts_with(line, 'TEXTO ') OR regexp_matches(line, '^[A-Za-zÁÉÍÓÚáéíóúÑñ].*,\s*\d{{4}}$'))
), b AS (SELECT *, sum((header IS NOT NULL OR item)::INT) OVER w AS block, last_value(header IGNORE NULLS) OVER w AS texto_id FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)
), it AS (
  SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(max(CASE WHEN item THEN regexp_extract(line, '^(\d+)\.', 1)::INT END) AS INT) AS item_number, max(texto_id) AS texto_id,
    list({_space(r"CASE WHEN item THEN regexp_extract(line, '^(\d+)\.\s*(.+)$', 2) ELSE line END")} ORDER BY line_no) AS raw
  FROM b WHERE item OR header IS NOT NULL OR NOT (regexp_matches(line, '^\d+\s+.+$') AND contains(lower(line), 'para otros hablantes')) GROUP BY 1, 2
), items AS (SELECT doc_id, block, texto_id, item_number, CASE WHEN raw[1] = '' THEN raw[2:] ELSE raw END AS raw_lines FROM it WHERE item_number IS NOT NULL)"""
_SPLIT = f"""{_ITEMS}, tn AS (SELECT *, coalesce(list_position(list_transform(raw_lines, lambda x, i: i > 1 AND {_sp('x')} > {_sh('x')}), true), 0) AS t, len(raw_lines) AS n FROM items
), ct AS (SELECT *, CASE WHEN t > 0 THEN t - 1 WHEN n > 1 THEN n - 1 ELSE n END AS cut FROM tn
), sd AS (SELECT *, {_space("array_to_string(raw_lines[1:cut], ' ')")} AS s, {_space("array_to_string(raw_lines[cut + 1:n], ' ')")} AS e FROM ct
), sp AS (SELECT printf('T%03d_N%03d', coalesce(texto_id, -1), item_number) AS pair_id, doc_id, coalesce(texto_id, -1) AS texto_id, item_number, s AS "SHIWILU", e AS "ESP",
  CASE WHEN n = 0 THEN 'empty_block' ELSE coalesce(nullif(concat_ws('|', CASE WHEN t = 0 AND n > 1 THEN 'fallback_last_line_as_spanish' END, CASE WHEN s = '' THEN 'missing_shiwilu' END, CASE WHEN e = '' THEN 'missing_spanish' END), ''), 'ok') END AS quality_flag FROM sd)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST({_sp('line')} AS INT) AS spanish, CAST({_sh('line')} AS INT) AS other FROM ln")
def line_language_scores(spark, sf_dir):
    line = F.col("line")
    return labelled_lines(spark, sf_dir).select("doc_id", "line_no", tx.spanish_score(line).cast("int").alias("spanish"), tx.other_score(line).cast("int").alias("other"))


@query(f"WITH {_ITEMS} SELECT doc_id, block, texto_id, item_number, array_to_string(raw_lines, chr(10)) AS raw FROM items")
def numbered_items(spark, sf_dir):
    return extract.numbered_items(labelled_lines(spark, sf_dir)).select("doc_id", "block", "texto_id", "item_number", F.array_join("raw_lines", "\n").alias("raw"))


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def bilingual_split(spark, sf_dir):
    return extract.parallel_table(extract.numbered_items(labelled_lines(spark, sf_dir)))


@query(f"WITH {_SPLIT} SELECT quality_flag, count(*) AS n, count(*) FILTER (quality_flag = 'ok') AS n_ok FROM sp GROUP BY 1")
def quality_flag_counts(spark, sf_dir):
    return extract.flag_counts(bilingual_split(spark, sf_dir))


# ---------------------------------------------------------------- vectors

_COS = """sc AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return vectors.paired(e, e.select((F.col("vec_id") - 1).alias("vec_id"), "embedding"), "vec_id", "embedding")


def _r(c: str) -> Column:
    return F.round(c, 6)


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS similarity_score FROM sc")
def pair_cosine(spark, sf_dir):
    return scores(spark, sf_dir).select("vec_id", _r("similarity_score").alias("similarity_score"))


@query(f"WITH {_COS} SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median FROM sc")
def similarity_stats(spark, sf_dir):
    return vectors.distribution(scores(spark, sf_dir)).select(*(_r(c).alias(c) for c in ("mean", "std", "min", "max", "median")))


@query("WITH " + _COS + " " + " UNION ALL ".join(f"SELECT {p} AS percentile, round(quantile_cont(score, {p / 100}), 6) AS value FROM sc" for p in (10, 25, 50, 75, 90)))
def similarity_percentiles(spark, sf_dir):
    return vectors.percentiles(scores(spark, sf_dir)).select("percentile", _r("value").alias("value"))


@query("""WITH v AS (SELECT [10, 25, 50, 75, 90] AS ps) SELECT p AS percentile, round(list_extract((SELECT quantile_cont(l_extendedprice, [0.1, 0.25, 0.5, 0.75, 0.9]) FROM lineitem), i), 6) AS value
  FROM (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM v)""")
def price_percentiles(spark, sf_dir):
    return vectors.percentiles(read(spark, sf_dir, "lineitem"), "l_extendedprice").select("percentile", _r("value").alias("value"))


@query(f"WITH {_COS} SELECT vec_id, round(score, 6) AS similarity_score FROM sc WHERE score < 0.3")
def low_similarity_pairs(spark, sf_dir):
    return vectors.below(scores(spark, sf_dir)).select("vec_id", _r("similarity_score").alias("similarity_score"))


@query(f"""WITH {_COS} SELECT * FROM (SELECT vec_id, round(score, 6) AS similarity_score, 'bottom' AS side FROM sc ORDER BY score, vec_id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT vec_id, round(score, 6), 'top' FROM sc ORDER BY score DESC, vec_id LIMIT 5)""")
def extreme_pairs(spark, sf_dir):
    return vectors.extremes(scores(spark, sf_dir), "vec_id").select("vec_id", _r("similarity_score").alias("similarity_score"), "side")


@query("""SELECT query, vec_id, round(s, 6) AS similarity_score, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 10""")
def knn_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    near = vectors.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    return near.select("query", "vec_id", _r("similarity_score").alias("similarity_score"), "rank")


@query("""SELECT CAST(k AS INT) AS k, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
  JOIN (SELECT unnest(range(10)) AS k) ON i = (k * (n - 1)) // 9""")
def linspace_sample(spark, sf_dir):
    return vectors.even_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("k", "doc_id")


@query("SELECT doc_id, i AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i % greatest(1, n // 60) = 0")
def step_sample(spark, sf_dir):
    return vectors.step_sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")



_grams = lambda w: f"list_distinct(list_transform(range(1, greatest(length({w}), 1) + 1), lambda i: substr('<' || {w} || '>', i, 3)))"
_CROSS = f"""{_P}, w AS (SELECT row_id, {_tok(_clean('"ESP"'))}[1:3] AS a, {_tok(_clean('"SHIWILU"'))}[1:3] AS b FROM p
), wx AS (SELECT row_id, unnest(a) AS x, b FROM w), wy AS (SELECT row_id, x, unnest(b) AS y FROM wx
), wg AS (SELECT row_id, {_grams('x')} AS g, {_grams('y')} AS h FROM wy
), cross_ AS (SELECT w.row_id, coalesce(avg(len(list_intersect(g, h)) / sqrt(len(g) * len(h))), 0.0) AS s FROM w LEFT JOIN wg USING (row_id) GROUP BY 1)"""


@query(f"WITH {_CROSS} SELECT row_id, round(s, 6) AS avg_word_score FROM cross_")
def word_cross_similarity(spark, sf_dir):
    return vectors.cross_similarity(pairs(spark, sf_dir), "row_id").select("row_id", _r("avg_word_score").alias("avg_word_score"))


@query(f"""WITH {_CROSS}, v AS (SELECT a.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
  m AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n, c, s, substr("ESP", 1, 50) AS esp, substr("SHIWILU", 1, 50) AS shiwilu FROM v JOIN p USING (doc_id) JOIN cross_ USING (row_id))
  SELECT CAST(k AS INT) AS k, row_id, esp, shiwilu, round(c, 6) AS sentence_score, round(s, 6) AS avg_word_score, round(c - s, 6) AS difference
  FROM m JOIN (SELECT unnest(range(10)) AS k) ON i = (k * (n - 1)) // 9""")
def sample_pair_comparison(spark, sf_dir):
    p = pairs(spark, sf_dir).drop("k")
    both = scores(spark, sf_dir).withColumnRenamed("vec_id", "doc_id").join(p, "doc_id").join(vectors.cross_similarity(p, "row_id"), "row_id")
    out = vectors.even_sample(both, "row_id").withColumn("difference", F.col("similarity_score") - F.col("avg_word_score"))
    return out.select("k", "row_id", F.substring("ESP", 1, 50).alias("esp"), F.substring("SHIWILU", 1, 50).alias("shiwilu"), _r("similarity_score").alias("sentence_score"), _r("avg_word_score").alias("avg_word_score"), _r("difference").alias("difference"))


# ---------------------------------------------------------------- models (all but the last without a SQL form)


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.sentences(pairs(spark, sf_dir), "row_id").select("tokens")


#: Vectors of the size that the command trains by default, in fewer epochs.
_MODEL = {"vector_size": 50, "epochs": 3}


@query()
def word2vec_vectors(spark, sf_dir):
    return embed.vectors(embed.train(_training(spark, sf_dir), **_MODEL))


@query()
def word2vec_synonyms(spark, sf_dir):
    found = lookup.similar_words(embed.train(_training(spark, sf_dir), **_MODEL), ("the",), 10)
    return found.select("word", F.col("similarity_score").alias("similarity"))


@query()
def subword_oov_vector(spark, sf_dir):
    model = embed.train(_training(spark, sf_dir), **_MODEL)
    return embed.subword_vectors(model, spark.createDataFrame([("unthinging",)], "word string"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(F.explode(F.array("ESP", "SHIWILU")).alias("text"))


@query()
def latent_singular_values(spark, sf_dir):
    model = latent.fit(read(spark, sf_dir, "documents"), "text", k=16, steps=8)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(model.values)], "rank int, singular_value double")


@query()
def latent_pair_comparison(spark, sf_dir):
    """Sentences and their first words under an encoder that is fitted on both sides of all pairs."""
    p = pairs(spark, sf_dir).withColumnRenamed("row_id", "pair_id")
    encoder = latent.fit(_sides(spark, sf_dir), "text").column(spark)
    v = embed.embed_pairs(p, encoder).select("pair_id", F.coalesce(tx.cosine(F.col("esp_vector"), F.col("shi_vector")), F.lit(0.0)).alias("sentence_score"))
    by_word = lookup.word_scores(p, lookup.sentence_vocabulary(p, encoder, ("ESP", "SHIWILU")), "pair_id")
    return v.join(by_word, "pair_id").withColumn("difference", F.col("sentence_score") - F.col("avg_word_score"))


@query()
def pca_2d(spark, sf_dir):
    return embed.coordinates(read(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", "x", "y")


_side = lambda i, c, role: f"""SELECT row_id, {i} AS side, unnest({_tok(f"lower('{role}: ' || trim(coalesce({c}, '')))")}) AS w FROM p"""
_HASHED = f"""{_P}, t AS ({_side(0, '"ESP"', 'query')} UNION ALL {_side(1, '"SHIWILU"', 'passage')}),
  v AS (SELECT row_id, side, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS i, CAST(sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM t GROUP BY 1, 2, 3),
  n AS (SELECT row_id, sum(x * x) FILTER (side = 0) AS a, sum(x * x) FILTER (side = 1) AS b FROM v GROUP BY 1),
  d AS (SELECT v.row_id, sum(v.x * o.x) AS d FROM v JOIN v o ON v.row_id = o.row_id AND v.i = o.i AND v.side = 0 AND o.side = 1 GROUP BY 1)"""


@query(f"WITH {_HASHED} SELECT row_id AS pair_id, round(coalesce(d, 0) / nullif(sqrt(a) * sqrt(b), 0), 6) AS similarity_score FROM n LEFT JOIN d USING (row_id)")
def encoded_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumnRenamed("row_id", "pair_id")
    v = embed.embed_pairs(p, embed.hashed_encoder(64))
    return v.select("pair_id", F.round(tx.cosine(F.col("esp_vector"), F.col("shi_vector")), 6).alias("similarity_score"))
