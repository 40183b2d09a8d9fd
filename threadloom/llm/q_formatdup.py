"""Problem 3: questions and notes stored again in another dress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.formatdup import encode, format_duplicates
from threadloom.session import table


def _classes(spark: SparkSession, d: str) -> DataFrame:
    questions = encode(table(spark, d, "exchanges"), "id", "human_text").withColumn("src", F.lit("exchanges"))
    notes = encode(table(spark, d, "memories"), "id", "content").withColumn("src", F.lit("memories"))
    return format_duplicates(questions.unionByName(notes), "src")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _classes(spark, d).filter("id <> class_id").select("src", F.col("class_id").alias("first_id"), F.col("id").alias("copy_id"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """One row for each set of equal records with its number of copies."""
    return _classes(spark, d).filter("id = class_id").select("src", F.col("id").alias("first_id"), "copies")


QUERIES = {"p3_found": p3_found, "p3_kept": p3_kept}
# Canonical letters, named fields of JSON objects and of lines, and classes by passing the smallest id on between equal letters and equal fields.
_CLASSES = r"""
WITH r AS (SELECT 'exchanges' AS src, id, human_text AS t FROM exchanges UNION ALL SELECT 'memories', id, content FROM memories),
w AS (SELECT * FROM (SELECT src, id, t, regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g') AS l FROM r WHERE id IS NOT NULL AND t IS NOT NULL) WHERE length(l) >= 20),
o AS (SELECT src, id, CASE WHEN json_valid(t) AND regexp_matches(t, '^\s*\{') THEN t ELSE '{}' END AS t FROM w),
jf AS (SELECT o.src, o.id, list_sort(list(regexp_replace(lower(e.key), '[^\p{L}\p{N}]', '', 'g') || '=' || regexp_replace(lower(coalesce(e.atom, CAST(e.value AS VARCHAR))), '[^\p{L}\p{N}]', '', 'g'))) AS f FROM o, json_each(o.t) e GROUP BY 1, 2),
ln AS (SELECT src, id, unnest(regexp_split_to_array(t, '\r\n|\n|\r')) AS line FROM w WHERE NOT regexp_matches(t, '^\s*\{')),
lf AS (SELECT src, id, list_sort(list(regexp_replace(lower(split_part(line, ':', 1)), '[^\p{L}\p{N}]', '', 'g') || '=' || regexp_replace(lower(substr(line, strpos(line, ':') + 1)), '[^\p{L}\p{N}]', '', 'g'))) AS f
  FROM ln WHERE regexp_matches(line, '[^\s\p{Z}]') GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_and(regexp_full_match(line, '[\s\p{Z}]*[^\s\p{Z}:][^:\n]*?[\s\p{Z}]*:([\s\p{Z}].*)?'))),
k AS (SELECT w.src, w.id, w.l, coalesce('f' || CAST(coalesce(jf.f, lf.f) AS VARCHAR), 'l' || w.l) AS f FROM w LEFT JOIN jf USING (src, id) LEFT JOIN lf USING (src, id)),
a AS (SELECT *, min(id) OVER (PARTITION BY src, l) AS c FROM k), b AS (SELECT src, id, l, f, min(c) OVER (PARTITION BY src, f) AS c FROM a),
d AS (SELECT src, id, l, f, min(c) OVER (PARTITION BY src, l) AS c FROM b), e AS (SELECT src, id, l, f, min(c) OVER (PARTITION BY src, f) AS c FROM d), g AS (SELECT src, id, min(c) OVER (PARTITION BY src, l) AS c FROM e)"""
ORACLES = {
    "p3_found": f"{_CLASSES} SELECT src, c AS first_id, id AS copy_id FROM g WHERE id <> c",
    "p3_kept": f"{_CLASSES} SELECT src, c AS first_id, count(*) AS copies FROM g GROUP BY 1, 2 HAVING count(*) > 1",
}
