"""Problem 5: parent-child links of messages and notes as full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import descendant_pairs, hierarchy
from threadloom.session import table


def message_links(spark: SparkSession, d: str) -> DataFrame:
    """Messages with trimmed parents; blank parents are none."""
    parent = F.trim("parent_message_uuid")
    return table(spark, d, "chat_messages").select("conversation_uuid", "uuid", F.when(parent != "", parent).alias("parent"))


def _trees(spark: SparkSession, d: str, with_paths: bool, alone: bool = False) -> DataFrame:
    chat = hierarchy(message_links(spark, d), "uuid", "parent", scope="conversation_uuid", with_paths=with_paths)
    notes = hierarchy(table(spark, d, "memories").select("id", "supersedes"), "id", "supersedes", with_paths=with_paths, alone=alone)
    return chat.withColumn("src", F.lit("chat_messages")).unionByName(notes.withColumn("src", F.lit("memories")))


def _with_paths(trees: DataFrame) -> DataFrame:
    return trees.select("src", "scope", "node", "root", F.array_join("path", "/").alias("path"), "depth", "descendants", "in_cycle", "back_edge")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    linked = _trees(spark, d, False).filter("has_parent")
    return linked.select("src", F.col("node").alias("node_key"), F.when(F.col("in_cycle"), "cycle").otherwise(F.col("root")).alias("root_key"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every linked node with its path from the root and its number of descendants."""
    return _with_paths(_trees(spark, d, True))


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """``p5_paths`` for every node: notes that no link touches are roots without descendants."""
    return _with_paths(_trees(spark, d, True, alone=True))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every replaced note, one row for each pair of ancestor and descendant."""
    notes = hierarchy(table(spark, d, "memories").select("id", "supersedes"), "id", "supersedes", with_paths=True)
    return descendant_pairs(notes).drop("scope")


def p5_chat_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every message, one row for each pair of ancestor and descendant in a conversation."""
    chat = hierarchy(message_links(spark, d), "uuid", "parent", scope="conversation_uuid", with_paths=True)
    return descendant_pairs(chat)


QUERIES = {"p5_found": p5_found, "p5_paths": p5_paths, "p5_nodes": p5_nodes, "p5_descendants": p5_descendants, "p5_chat_descendants": p5_chat_descendants}

ORACLES = {
    "p5_paths": """
WITH RECURSIVE node AS (
  SELECT 'chat_messages' AS src, coalesce(conversation_uuid, '') AS scope, uuid AS k, min(nullif(trim(parent_message_uuid), '')) AS p FROM chat_messages WHERE uuid IS NOT NULL GROUP BY 2, 3
  UNION ALL SELECT 'memories', '', CAST(id AS VARCHAR), CAST(supersedes AS VARCHAR) FROM memories WHERE id IS NOT NULL),
link AS (SELECT n.src, n.scope, n.k, u.k AS p FROM node n LEFT JOIN node u ON u.src = n.src AND u.scope = n.scope AND u.k = n.p),
kept AS (SELECT * FROM link l WHERE src = 'chat_messages' OR p IS NOT NULL OR EXISTS (SELECT 1 FROM link c WHERE c.src = l.src AND c.p = l.k)),
walk AS (
  SELECT src, scope, k, [k] AS path FROM kept WHERE p IS NULL
  UNION ALL SELECT l.src, l.scope, l.k, list_append(w.path, l.k) FROM kept l JOIN walk w ON l.src = w.src AND l.scope = w.scope AND l.p = w.k),
below AS (SELECT src, scope, a AS k, count(*) AS n FROM (SELECT src, scope, k, unnest(path) AS a FROM walk) WHERE a <> k GROUP BY 1, 2, 3),
stray AS (SELECT l.* FROM kept l LEFT JOIN walk w ON w.src = l.src AND w.scope = l.scope AND w.k = l.k WHERE w.k IS NULL),
up AS (SELECT src, scope, k, p AS a FROM stray UNION SELECT u.src, u.scope, u.k, s.p FROM up u JOIN stray s ON s.src = u.src AND s.scope = u.scope AND s.k = u.a),
closes AS (SELECT src, scope, k FROM up GROUP BY 1, 2, 3 HAVING bool_or(a = k) AND min(a) = k)
SELECT l.src, l.scope, l.k AS node, w.path[1] AS root, array_to_string(w.path, '/') AS path, CAST(coalesce(len(w.path) - 1, -1) AS BIGINT) AS depth,
  CASE WHEN w.k IS NULL THEN -1 ELSE coalesce(b.n, 0) END AS descendants, w.k IS NULL AS in_cycle, c.k IS NOT NULL AS back_edge
FROM kept l LEFT JOIN walk w ON w.src = l.src AND w.scope = l.scope AND w.k = l.k LEFT JOIN below b ON b.src = l.src AND b.scope = l.scope AND b.k = l.k
  LEFT JOIN closes c ON c.src = l.src AND c.scope = l.scope AND c.k = l.k""",
    "p5_found": """
WITH RECURSIVE node AS (
  SELECT 'chat_messages' AS src, conversation_uuid AS scope, uuid AS k, min(nullif(trim(parent_message_uuid), '')) AS p FROM chat_messages GROUP BY 2, 3
  UNION ALL SELECT 'memories', '', CAST(id AS VARCHAR), CAST(supersedes AS VARCHAR) FROM memories),
link AS (SELECT n.src, n.scope, n.k, u.k AS p FROM node n LEFT JOIN node u ON u.src = n.src AND u.scope = n.scope AND u.k = n.p),
walk AS (
  SELECT src, scope, k, k AS root, 0 AS depth FROM link WHERE p IS NULL
  UNION ALL SELECT l.src, l.scope, l.k, w.root, w.depth + 1 FROM link l JOIN walk w ON l.src = w.src AND l.scope = w.scope AND l.p = w.k)
SELECT l.src, l.k AS node_key, coalesce(w.root, 'cycle') AS root_key, CAST(coalesce(w.depth, -1) AS BIGINT) AS depth
FROM link l LEFT JOIN walk w ON w.src = l.src AND w.scope = l.scope AND w.k = l.k WHERE l.p IS NOT NULL""",
    "p5_descendants": """
WITH RECURSIVE link AS (SELECT CAST(m.id AS VARCHAR) AS k, CAST(u.id AS VARCHAR) AS p FROM memories m LEFT JOIN memories u ON u.id = m.supersedes),
rooted AS (SELECT k FROM link WHERE p IS NULL UNION ALL SELECT l.k FROM link l JOIN rooted r ON l.p = r.k),
walk AS (
  SELECT p AS ancestor, k AS descendant, 1 AS distance FROM link WHERE p IS NOT NULL AND k IN (SELECT k FROM rooted)
  UNION ALL SELECT l.p, w.descendant, w.distance + 1 FROM walk w JOIN link l ON l.k = w.ancestor WHERE l.p IS NOT NULL)
SELECT ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM walk""",
    "p5_chat_descendants": """
WITH RECURSIVE node AS (SELECT conversation_uuid AS scope, uuid AS k, min(nullif(trim(parent_message_uuid), '')) AS p FROM chat_messages WHERE uuid IS NOT NULL GROUP BY 1, 2),
link AS (SELECT coalesce(n.scope, '') AS scope, n.k, u.k AS p FROM node n LEFT JOIN node u ON u.scope IS NOT DISTINCT FROM n.scope AND u.k = n.p),
rooted AS (SELECT scope, k FROM link WHERE p IS NULL UNION ALL SELECT l.scope, l.k FROM link l JOIN rooted r ON l.scope = r.scope AND l.p = r.k),
walk AS (
  SELECT l.scope, l.p AS ancestor, l.k AS descendant, 1 AS distance FROM link l JOIN rooted r ON r.scope = l.scope AND r.k = l.k WHERE l.p IS NOT NULL
  UNION ALL SELECT l.scope, l.p, w.descendant, w.distance + 1 FROM walk w JOIN link l ON l.scope = w.scope AND l.k = w.ancestor WHERE l.p IS NOT NULL)
SELECT scope, ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM walk""",
}
# the same over all nodes
ORACLES["p5_nodes"] = ORACLES["p5_paths"].replace("kept AS (SELECT * FROM link l WHERE src = 'chat_messages' OR p IS NOT NULL OR EXISTS (SELECT 1 FROM link c WHERE c.src = l.src AND c.p = l.k))", "kept AS (SELECT * FROM link)")
