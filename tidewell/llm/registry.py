"""The queries of this subpackage, each over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import disclosure, dominance_packing, guess_cost, huffman_ids, line_frequency, prefix_forest, quality_qda, simhash_variants, soft_mixing, substring_dedup
from .common import table


def op1_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))


def op2_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_variants.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, code = huffman_ids.write_ids(table(spark, sf_dir, "documents"))
    return huffman_ids.read_ids(blocks, code, with_ids=False)


def op6_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guess_cost.find_secrets(table(spark, sf_dir, "documents"))


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return prefix_forest.nearest(rows, rows.where("vec_id % 20 = 0"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_rules(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_fm_substring_dedup, op2_qda_quality, op3_disclosure_pii, op4_simhash_variants, op5_huffman_ids, op6_dominance_packing,
    op7_guess_cost_secrets, op8_prefix_forest, op9_soft_mixing, op10_line_frequency,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, ws FROM d),
g AS (SELECT doc_id, n, word, i, CASE WHEN i + 34 <= n THEN array_to_string(ws[i:i + 34], ' ') END AS seq FROM w),
c AS (SELECT doc_id, n, word, i, CASE WHEN seq IS NOT NULL AND count(*) OVER (PARTITION BY seq) > 1 THEN 1 ELSE 0 END AS again FROM g),
f AS (SELECT doc_id, n, word, i, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
        trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS clean
      FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
q AS (SELECT host, clean FROM l GROUP BY host, clean HAVING count(DISTINCT text) > {line_frequency.MOST_DOCS}),
z AS (SELECT doc_id, CAST(sum(words) AS BIGINT) AS gone FROM l JOIN q USING (host, clean) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS n_frequent_words
      FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_frequent_words >= {line_frequency.KEEP_SHARE} * n_words AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    """The others need XXH64, a tokenizer, a fitted model, spans by code point or a search that is not exact: the tests hold them against plain versions."""
    return {"op1_fm_substring_dedup": OP1_SQL, "op10_line_frequency": OP10_SQL}
