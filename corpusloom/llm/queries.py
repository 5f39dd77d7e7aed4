"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, fingerprints, infill, mixing, neighbours, packing, secret_scan, sharding, simhash, substrings, token_counts, toxicity
from .common import read

TOKENIZER = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.drop_repeats(read(spark, sf_dir, "documents"), span=20))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"), keep_columns=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), shards=40)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(fingerprints.fingerprints(read(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(read(spark, sf_dir, "documents")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_source_mixing": op5_source_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_best_fit_packing": op13_best_fit_packing,
}

#: Windows of 20 words numbered by first appearance; a word goes if a later appearance covers it.
_OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(words[s : s + 19], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM again
), per_word AS (
  SELECT w.doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) w
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM per_word p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""

#: The three parts by their lengths; SQL puts them together from the text, so that what is rebuilt is the text.
_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS applied, ('0x' || h[25:32])::BIGINT % 100 AS turned FROM d
), f AS (
  SELECT *, least(x, y) AS i, greatest(x, y) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR applied >= 90 THEN 'plain' WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form FROM r
), o AS (
  SELECT *, substring(t, 1, i) AS p, substring(t, i + 1, j - i) AS m, substring(t, j + 1, n - j) AS s FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(i AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(j - i AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM o
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1_SQL, "op12_fill_in_middle": _OP12_SQL}
