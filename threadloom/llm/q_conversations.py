"""Problem 1: conversations rebuilt from message rows and from numbered turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.conversations import broken_chats, broken_sessions, chat_turns, session_turns
from threadloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    chats = broken_chats(table(spark, d, "chat_messages"), table(spark, d, "conversations"))
    sessions = broken_sessions(table(spark, d, "exchanges"), table(spark, d, "sessions"))
    return chats.withColumn("src", F.lit("chat_messages")).unionByName(sessions.withColumn("src", F.lit("exchanges"))).select("src", "conv_key", "reason")


def p1_chat_turns(spark: SparkSession, d: str) -> DataFrame:
    return chat_turns(table(spark, d, "chat_messages"))


def p1_session_turns(spark: SparkSession, d: str) -> DataFrame:
    return session_turns(table(spark, d, "exchanges"), table(spark, d, "sessions"))


QUERIES = {"p1_found": p1_found, "p1_chat_turns": p1_chat_turns, "p1_session_turns": p1_session_turns}

_BLANK = r"(NOT coalesce(regexp_matches({0}, '[\p{{L}}\p{{Nd}}]') AND NOT regexp_matches({0}, '^\s*\[[^\[\]]*\]\s*$'), false))"

ORACLES = {
    "p1_found": f"""
WITH RECURSIVE raw AS (SELECT DISTINCT trim(conversation_uuid) AS c, trim(uuid) AS u, text, lower(trim(sender)) AS s,
    CASE WHEN translate(trim(parent_message_uuid), '0-', '') = '' OR trim(parent_message_uuid) = '00000000-0000-4000-8000-000000000000' THEN NULL ELSE trim(parent_message_uuid) END AS p FROM chat_messages),
msg AS (SELECT *, CASE WHEN s IN ('human', 'user') THEN 'h' WHEN s IN ('assistant', 'ai') THEN 'a' ELSE 'o' END AS r,
    NOT {_BLANK.format("text")} AND s IN ('human', 'user', 'assistant', 'ai') AS vis FROM raw),
msgs AS (SELECT c, u, p, r, coalesce(vis, false) AS vis, coalesce(s, '') = '' AS nosender FROM msg),
link AS (SELECT m.*, q.u IS NOT NULL AS ok, coalesce(q.vis, false) AS pvis FROM msgs m LEFT JOIN msgs q ON q.c = m.c AND q.u = m.p),
walk AS (SELECT c, u, vis, CAST(NULL AS VARCHAR) AS near FROM link WHERE NOT ok
  UNION ALL SELECT l.c, l.u, l.vis, CASE WHEN w.vis THEN w.u ELSE w.near END FROM link l JOIN walk w ON w.c = l.c AND w.u = l.p WHERE l.ok),
answered AS (SELECT DISTINCT w.c, w.near FROM walk w JOIN msgs m ON m.c = w.c AND m.u = w.u WHERE m.vis AND m.r = 'a' AND w.near IS NOT NULL),
conv AS (SELECT uuid AS c FROM conversations UNION SELECT c FROM msgs),
cs AS (SELECT conv.c, coalesce(bool_or(l.vis), false) AS vis,
    coalesce(bool_or(l.nosender OR (l.p IS NOT NULL AND NOT l.ok) OR w.u IS NULL), false) AS broken,
    coalesce(bool_or(l.vis AND l.r = 'h' AND a.near IS NULL), false) AS open
  FROM conv LEFT JOIN link l ON l.c = conv.c LEFT JOIN walk w ON w.c = l.c AND w.u = l.u LEFT JOIN answered a ON a.c = l.c AND a.near = l.u GROUP BY 1),
ex AS (SELECT session_id AS c, exchange_number AS n, human_text AS h, agent_text AS a, {_BLANK.format("human_text")} AS hb, {_BLANK.format("agent_text")} AS ab FROM exchanges WHERE session_id IS NOT NULL),
nums AS (SELECT c, n, count(DISTINCT (h, a)) AS texts, bool_and(ab) AS ab, bool_and(ab AND hb) AS silent FROM ex GROUP BY 1, 2),
ss AS (SELECT c, bool_and(silent) AS silent, bool_or(n IS NULL) OR bool_or(texts > 1) OR min(n) <> 1 OR max(n) <> count(n) AS broken, arg_max(ab, n) FILTER (WHERE n IS NOT NULL) AS ab FROM nums GROUP BY 1),
sess AS (SELECT session_id AS c FROM sessions WHERE session_id IS NOT NULL UNION SELECT c FROM ss),
res AS (SELECT 'chat_messages' AS src, c AS conv_key, CASE WHEN NOT vis THEN 'empty' WHEN broken THEN 'broken' WHEN open THEN 'no_reply' END AS reason FROM cs
  UNION ALL SELECT 'exchanges', sess.c, CASE WHEN coalesce(silent, true) THEN 'empty' WHEN broken THEN 'broken' WHEN ab THEN 'no_reply' END FROM sess LEFT JOIN ss ON ss.c = sess.c)
SELECT * FROM res WHERE reason IS NOT NULL""",
    "p1_chat_turns": f"""
WITH RECURSIVE raw AS (SELECT trim(conversation_uuid) AS c, trim(uuid) AS u, arg_max(text, (ingested_at, created_at)) AS text, arg_max(created_at, (ingested_at, created_at)) AS made, arg_max(lower(trim(sender)), (ingested_at, created_at)) AS s,
    arg_max(CASE WHEN translate(trim(parent_message_uuid), '0-', '') = '' OR trim(parent_message_uuid) = '00000000-0000-4000-8000-000000000000' THEN '' ELSE trim(parent_message_uuid) END, (ingested_at, created_at)) AS p FROM chat_messages GROUP BY 1, 2),
msg AS (SELECT c, u, text, made, nullif(p, '') AS p, coalesce(s, '') = '' AS nosender, CASE WHEN s IN ('human', 'user') THEN 'human' WHEN s IN ('assistant', 'ai') THEN 'assistant' ELSE 'other' END AS r,
    NOT {_BLANK.format("text")} AND coalesce(s IN ('human', 'user', 'assistant', 'ai'), false) AS vis FROM raw),
link AS (SELECT m.*, q.u IS NOT NULL AS ok FROM msg m LEFT JOIN msg q ON q.c = m.c AND q.u = m.p),
walk AS (SELECT c, u, vis, [u] AS path, 0 AS depth, CAST(NULL AS VARCHAR) AS near FROM link WHERE NOT ok
  UNION ALL SELECT l.c, l.u, l.vis, list_append(w.path, l.u), w.depth + 1, CASE WHEN w.vis THEN w.u ELSE w.near END FROM link l JOIN walk w ON w.c = l.c AND w.u = l.p WHERE l.ok),
answered AS (SELECT DISTINCT w.c, w.near FROM walk w JOIN msg m ON m.c = w.c AND m.u = w.u WHERE m.vis AND m.r = 'assistant' AND w.near IS NOT NULL),
bad AS (SELECT l.c FROM link l LEFT JOIN walk w ON w.c = l.c AND w.u = l.u LEFT JOIN answered a ON a.c = l.c AND a.near = l.u GROUP BY 1
  HAVING NOT bool_or(l.vis) OR bool_or(l.nosender OR (l.p IS NOT NULL AND NOT l.ok) OR w.u IS NULL) OR bool_or(l.vis AND l.r = 'human' AND a.near IS NULL)),
shown AS (SELECT m.c, m.u, m.r, m.made, m.text, w.depth, w.near, row_number() OVER (PARTITION BY m.c ORDER BY w.path) AS n, count(*) OVER g AS versions, row_number() OVER (g ORDER BY m.made DESC NULLS LAST, m.u DESC) = 1 AS final
  FROM msg m JOIN walk w ON w.c = m.c AND w.u = m.u WHERE m.vis AND m.c NOT IN (SELECT c FROM bad) WINDOW g AS (PARTITION BY m.c, m.r, w.near)),
live AS (SELECT c, u, final AS current FROM shown WHERE near IS NULL UNION ALL SELECT s.c, s.u, s.final AND l.current FROM shown s JOIN live l ON l.c = s.c AND l.u = s.near)
SELECT s.c AS conv_key, CAST(n AS BIGINT) AS turn_no, CAST(depth AS BIGINT) AS depth, r AS role, s.u AS uuid, near AS asked_by, versions, CASE WHEN versions = 1 THEN 'create' WHEN r = 'human' THEN 'edit' ELSE 'retry' END AS change, final, current, text
FROM shown s JOIN live l ON l.c = s.c AND l.u = s.u""",
    "p1_session_turns": f"""
WITH ex AS (SELECT session_id AS c, exchange_number AS n, id, human_text AS h, agent_text AS a, {_BLANK.format("human_text")} AS hb, {_BLANK.format("agent_text")} AS ab FROM exchanges WHERE session_id IS NOT NULL),
nums AS (SELECT c, n, count(DISTINCT (h, a)) AS texts, bool_and(ab) AS ab, bool_and(ab AND hb) AS silent FROM ex GROUP BY 1, 2),
bad AS (SELECT c FROM nums GROUP BY 1 HAVING bool_and(silent) OR bool_or(n IS NULL) OR bool_or(texts > 1) OR min(n) <> 1 OR max(n) <> count(n) OR arg_max(ab, n)),
one AS (SELECT * FROM ex WHERE n IS NOT NULL AND c NOT IN (SELECT c FROM bad) QUALIFY row_number() OVER (PARTITION BY c, n ORDER BY id) = 1)
SELECT c AS conv_key, CAST(n AS BIGINT) * 2 - 1 AS turn_no, 'human' AS role, h AS text FROM one WHERE NOT hb
UNION ALL SELECT c, CAST(n AS BIGINT) * 2, 'assistant', a FROM one WHERE NOT ab""",
}
