"""Problem 9: held-out passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.leakage import leaked_spans, without_leaks
from threadloom.session import table


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "passage")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_spans(spark, d).select("doc_id", "item_id").distinct()


def p9_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """The leaking documents with the leaked spans cut out."""
    return without_leaks(table(spark, d, "documents"), "doc_id", "text", p9_spans(spark, d))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_cleaned": p9_cleaned}
ORACLES = {
    "p9_spans": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS a FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(a[i:i + 11], ' ') AS gram FROM (SELECT item_id, a, unnest(range(1, len(a) - 10)) AS i FROM w)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(a[i:i + 11], ' ') AS gram FROM (SELECT doc_id, a, unnest(range(1, len(a) - 10)) AS i FROM dw)),
h AS (SELECT DISTINCT doc_id, item_id, pos FROM dg JOIN g USING (gram)),
b AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id, item_id ORDER BY pos) + 12 THEN 0 ELSE 1 END AS opens FROM h),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, item_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT doc_id, item_id, min(pos) AS first_word, max(pos) + 12 AS end_word FROM n GROUP BY doc_id, item_id, island""",
    "p9_found": r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS a FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(a[i:i + 11], ' ') AS gram FROM (SELECT item_id, a, unnest(range(1, len(a) - 10)) AS i FROM w)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(a[i:i + 11], ' ') AS gram FROM (SELECT doc_id, a, unnest(range(1, len(a) - 10)) AS i FROM dw))
SELECT DISTINCT dg.doc_id, g.item_id FROM dg JOIN g ON g.gram = dg.gram""",
}
