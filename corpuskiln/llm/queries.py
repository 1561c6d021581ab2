"""Queries of the operators for language-model text: p1, p3, p5, p7, p8 and p9."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.llm import leakage, near_duplicates, packing, pairs, residue, scans
from corpuskiln.session import table

#: The vocabulary file of the public tokenizer that p7's queries measure with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, folder, "test_tax_form_instructions_qa_pairs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, folder, "chunks"), version_col="ingested_at", size=3, tenths=7)


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, folder, "chunks"), version_col="ingested_at")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(table(spark, folder, "chunks"))


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The running text of each PDF chunk and what was wrong in it."""
    rows = scans.repaired(table(spark, folder, "chunks"))
    return rows.withColumn("noise", F.array_join("noise", ","))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), table(spark, folder, "token_budgets"), TOKENIZER)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.waste(p7_packed(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_cases"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The merged word spans to be removed from each document."""
    return leakage.leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_cases"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_groups, p5_found, p5_repaired, p7_packed, p7_fill, p8_found, p8_spans, p9_found)}


_WORDS = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _windows(length: int, source: str, keys: str, text: str) -> str:
    """keys, phrase: the distinct runs of words of each text."""
    return f"SELECT DISTINCT {keys}, phrase FROM ({_places(length, source, keys, text)})"


def _places(length: int, source: str, keys: str, text: str) -> str:
    """keys, place, phrase: the runs of words of each text."""
    words = _WORDS.format(text)
    return f"SELECT {keys}, i - 1 AS place, array_to_string(w[i:i + {length - 1}], ' ') AS phrase FROM (SELECT {keys}, {words} AS w FROM {source} WHERE {text} IS NOT NULL), LATERAL (SELECT unnest(range(1, len(w) - {length - 2})) AS i)"


_NEWEST = "newest AS (SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
_HELD = f"items AS ({_windows(13, 'eval_cases', 'item_id', 'question')} UNION {_windows(13, 'eval_cases', 'item_id', 'context')})"


def _similar(size: int, tenths: int, source: str, key: str, text: str) -> str:
    """a < b of the keys whose texts' shingle sets have at least the similarity."""
    return f"""sh AS ({_windows(size, source, key, text)}), n AS (SELECT {key} AS k, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT x.{key} AS a, y.{key} AS b, count(*) AS c FROM sh x JOIN sh y ON x.phrase = y.phrase AND x.{key} < y.{key} GROUP BY 1, 2),
near AS (SELECT a, b FROM met JOIN n AS na ON a = na.k JOIN n AS nb ON b = nb.k WHERE c * 10 >= (na.n + nb.n - c) * {tenths})"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"WITH {_NEWEST}, {_similar(3, 7, 'newest', 'id', 'text')} SELECT a AS id_a, b AS id_b FROM near",
        "p3_groups": f"""WITH RECURSIVE {_NEWEST}, said AS (SELECT id, array_to_string(w, ' ') AS t FROM (SELECT id, {_WORDS.format('text')} AS w FROM newest WHERE text IS NOT NULL) WHERE len(w) >= 5),
texts AS (SELECT t, min(id) AS k, count(*) AS n_copies FROM said GROUP BY t), {_similar(5, 8, 'texts', 'k', 't')},
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), degree AS (SELECT a AS k, count(*) AS n_links FROM links GROUP BY a),
reach AS (SELECT k AS node, k AS other FROM texts UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
groups AS (SELECT node AS k, min(other) AS group_id FROM reach GROUP BY node)
SELECT id, group_id, coalesce(n_links, 0) AS n_links, n_copies FROM said JOIN texts USING (t) JOIN groups USING (k) LEFT JOIN degree USING (k) WHERE n_copies > 1 OR n_links > 0""",
        "p8_found": f"WITH docs AS ({_windows(13, 'documents', 'doc_id', 'text')}), {_HELD} SELECT DISTINCT item_id, doc_id FROM items JOIN docs USING (phrase)",
        "p8_spans": f"""WITH docs AS ({_places(13, 'documents', 'doc_id', 'text')}), {_HELD},
hits AS (SELECT DISTINCT doc_id, item_id, place FROM items JOIN docs USING (phrase)),
begun AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY doc_id, item_id ORDER BY place) <= 13 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY place) AS span FROM begun)
SELECT doc_id, item_id, CAST(min(place) AS INTEGER) AS first_word, CAST(max(place) + 13 AS INTEGER) AS end_word FROM spans GROUP BY doc_id, item_id, span""",
    }
