"""Driver queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import copies, language, leaks, lookalike, neardup, packing, split


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.found(_table(spark, sf, "hchunks"), _table(spark, sf, "chunker_configs"))


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_oversized(_table(spark, sf, "hchunks"), _table(spark, sf, "chunker_configs"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies.found(_table(spark, sf, "hchunks"))


def p3_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return copies.collapsed(_table(spark, sf, "hchunks"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.found(_table(spark, sf, "para_blocks"), _table(spark, sf, "cell_data"))


def p4_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(_table(spark, sf, "para_blocks"), _table(spark, sf, "cell_data"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.classes(_table(spark, sf, "para_blocks"), _table(spark, sf, "cell_data"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.found(_table(spark, sf, "hchunks"))


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(_table(spark, sf, "hchunks"))


def _tokenizer(spark: SparkSession) -> str:
    """The tokenizer's file: a parameter of the session, by default a public one."""
    return spark.conf.get("spark.sheafline.tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(_table(spark, sf, "documents"), _table(spark, sf, "pack_capacities"), _tokenizer(spark))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_table(spark, sf, "documents"), _table(spark, sf, "pack_capacities"), _tokenizer(spark))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.found(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.found(_table(spark, sf, "documents"), _table(spark, sf, "lang_samples"))


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.segments(_table(spark, sf, "documents"), _table(spark, sf, "lang_samples"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_collapsed, p4_found, p4_normalized, p4_classes, p6_found, p6_groups, p7_packed, p7_fill, p8_found, p8_leaks, p9_found, p9_segments)}

# DuckDB: words of a text as one blank-separated string
_WORDS = "array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')"
_FIELDS = "array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(text, '[;|\\n\\r]'), lambda x: array_to_string(regexp_extract_all(lower(x), '[\\p{L}\\p{N}]+'), ' ')), lambda x: x <> '')), '|')"

_COPIES = f"""
WITH canon AS (
  SELECT chunk_no, text, coalesce(kind = 'table', false) AS t,
         CASE WHEN coalesce(kind = 'table', false) THEN {_FIELDS} ELSE {_WORDS} END AS c
  FROM hchunks WHERE text IS NOT NULL),
sets AS (SELECT t, c, min(chunk_no) AS first_no, count(*) AS n FROM canon GROUP BY t, c HAVING count(*) > 1)
"""

_NEAR = """
WITH doc AS MATERIALIZED (SELECT chunk_no, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM hchunks WHERE text IS NOT NULL),
run AS MATERIALIZED (SELECT DISTINCT chunk_no, hash(w[i], w[i + 1], w[i + 2]) AS g FROM doc, unnest(range(1, len(w) - 1)) AS x(i) WHERE len(w) >= 3),
size AS (SELECT chunk_no, count(*) AS n FROM run GROUP BY chunk_no),
both_ AS (SELECT x.chunk_no AS a, y.chunk_no AS b, count(*) AS n FROM run x JOIN run y ON x.g = y.g AND x.chunk_no < y.chunk_no GROUP BY ALL),
near AS (SELECT a, b FROM both_ JOIN size p ON p.chunk_no = a JOIN size q ON q.chunk_no = b WHERE both_.n >= 0.6 * (p.n + q.n - both_.n) - 1e-9)
"""

SQL = {
    "p2_found": """
SELECT chunk_no FROM hchunks JOIN chunker_configs USING (config_id)
WHERE text IS NOT NULL AND greatest(1, (length(text) + 3) // 4) > max_tokens""",
    "p3_found": _COPIES + "SELECT first_no, chunk_no AS copy_no FROM canon JOIN sets USING (t, c) WHERE chunk_no <> first_no",
    "p3_collapsed": _COPIES
    + ", per AS (SELECT first_no, n AS copies, count(DISTINCT text) AS variants FROM canon JOIN sets USING (t, c) GROUP BY first_no, n, t, c) SELECT first_no, copies, variants FROM per",
    "p6_found": _NEAR + "SELECT DISTINCT a AS chunk_a, b AS chunk_b FROM (SELECT a, b FROM near UNION ALL SELECT x.chunk_no, y.chunk_no FROM doc x JOIN doc y ON x.text = y.text AND x.chunk_no < y.chunk_no)",
    "p6_groups": _NEAR
    + """, class AS (SELECT chunk_no AS row_no, min(chunk_no) OVER w AS rep, count(*) OVER w AS copies FROM doc WINDOW w AS (PARTITION BY CASE WHEN len(w) >= 3 THEN array_to_string(w, ' ') END, CASE WHEN len(w) < 3 THEN text END)),
link AS (SELECT DISTINCT least(x.rep, y.rep) AS p, greatest(x.rep, y.rep) AS q FROM near JOIN class x ON x.row_no = a JOIN class y ON y.row_no = b WHERE x.rep <> y.rep),
each AS (SELECT r, count(*) AS n FROM (SELECT p AS r FROM link UNION ALL SELECT q FROM link) GROUP BY r)
SELECT row_no, rep, copies, coalesce(n, 0) AS links FROM class LEFT JOIN each ON r = rep""",
    "p8_found": """
WITH item AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
run AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(12, len(w)) - 1], ' ') AS g, least(12, len(w)) AS m
  FROM item, unnest(range(1, len(w) - least(12, len(w)) + 2)) AS x(i) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT DISTINCT m FROM run),
gram AS (
  SELECT doc_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM doc, lengths, unnest(range(1, len(w) - m + 2)) AS x(i) WHERE len(w) >= m)
SELECT DISTINCT doc_id, item_id FROM gram JOIN run USING (m, g)""",
}
