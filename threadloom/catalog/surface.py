"""The SQL surface: statements in the archive's dialect, run through the gate and the dialect layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import FOLD_FROM, FOLD_TO
from threadloom.model import views
from threadloom.plans.engine import Engine
from threadloom.session import table

#: name: (archive SQL, DuckDB SQL or None where the text is the same in both)
STATEMENTS: dict[str, tuple[str, str | None]] = {
    # joins
    "joins_inner": ("SELECT s.project, count(*) AS n FROM sessions s JOIN exchanges e ON e.session_id = s.session_id GROUP BY s.project", None),
    "joins_left": ("SELECT s.session_id, count(t.id) AS tools FROM sessions s LEFT JOIN tool_uses t ON t.session_id = s.session_id GROUP BY s.session_id", None),
    "joins_right": ("SELECT l.name, count(m.id) AS n FROM memories m RIGHT JOIN layers l ON l.name = m.layer GROUP BY l.name", None),
    "joins_full": ("SELECT c.uuid AS conversation, count(m.uuid) AS n FROM conversations c FULL JOIN chat_messages m ON m.conversation_uuid = c.uuid GROUP BY c.uuid", None),
    "joins_semi": ("SELECT session_id, title FROM sessions s WHERE EXISTS (SELECT 1 FROM tool_uses t WHERE t.session_id = s.session_id AND t.had_error = 1)", None),
    "joins_anti": ("SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM tool_uses WHERE session_id IS NOT NULL)", None),
    "joins_theta": ("SELECT a.name AS one, b.name AS other FROM layers a JOIN layers b ON a.name < b.name AND a.access_mode = b.access_mode", None),
    "joins_cross_constant": ("SELECT l.name, x.top FROM layers l CROSS JOIN (SELECT max(id) AS top FROM memories) x", None),
    "joins_three_way": ("SELECT s.project, t.tool_name, count(*) AS n FROM sessions s JOIN exchanges e ON e.session_id = s.session_id JOIN tool_uses t ON t.session_id = e.session_id AND t.exchange_number = e.exchange_number GROUP BY s.project, t.tool_name", None),
    "joins_self_replaced": ("SELECT m.id, o.id AS old, o.layer FROM memories m JOIN memories o ON o.id = m.supersedes", None),
    "joins_null_safe": ("SELECT count(*) AS n FROM exchanges a JOIN exchanges b ON a.id = b.id AND a.model IS NOT DISTINCT FROM b.model", None),
    "star_join": ("SELECT r.r_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name", None),
    "star_pricing": ("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    # aggregates
    "agg_sessions_per_agent": ("SELECT source_agent, count(*) AS n FROM sessions WHERE started_at LIKE '2025-%' GROUP BY source_agent", None),
    "agg_memories_per_project": ("SELECT project, layer, count(*) AS n FROM memories GROUP BY project, layer", None),
    "agg_total": ("SELECT model, round(total(cost_usd), 6) AS cost, total(tokens_reasoning) AS reasoning FROM exchanges GROUP BY model", "SELECT model, round(coalesce(sum(cost_usd), 0.0), 6) AS cost, CAST(coalesce(sum(tokens_reasoning), 0) AS DOUBLE) AS reasoning FROM exchanges GROUP BY model"),
    "agg_group_concat": ("SELECT had_error, length(group_concat(tool_name, ';')) AS len FROM tool_uses GROUP BY had_error", "SELECT had_error, length(string_agg(tool_name, ';')) AS len FROM tool_uses GROUP BY had_error"),
    "agg_distinct": ("SELECT layer, count(DISTINCT project) AS projects, min(created_at) AS first, max(created_at) AS last, round(avg(length(content)), 4) AS mean FROM memories GROUP BY layer", None),
    "agg_having": ("SELECT session_id, count(*) AS n, sum(had_error) AS errors FROM tool_uses GROUP BY session_id HAVING count(*) > 5 AND sum(had_error) > 0", "SELECT session_id, count(*) AS n, CAST(sum(had_error) AS BIGINT) AS errors FROM tool_uses GROUP BY session_id HAVING count(*) > 5 AND sum(had_error) > 0"),
    "agg_filtered": ("SELECT model, count(*) FILTER (WHERE tokens_in > 10000) AS big, count(*) AS n FROM exchanges GROUP BY model", None),
    "agg_json_group_array": ("SELECT access_mode, json_array_length(json_group_array(name)) AS n FROM layers GROUP BY access_mode", "SELECT access_mode, CAST(count(*) AS INTEGER) AS n FROM layers GROUP BY access_mode"),
    "agg_json_group_object": ("SELECT json_group_object(name, access_mode) AS o FROM layers WHERE name = 'decision'", "SELECT '{\"decision\":\"' || access_mode || '\"}' AS o FROM layers WHERE name = 'decision'"),
    # windows
    "win_row_number": ("SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM exchanges", None),
    "win_rank": ("SELECT id, rank() OVER (PARTITION BY layer ORDER BY project DESC NULLS LAST) AS r, dense_rank() OVER (PARTITION BY layer ORDER BY project DESC NULLS LAST) AS dr FROM memories", None),
    "win_lag_lead": ("SELECT id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS before, lead(id, 2, -1) OVER (PARTITION BY session_id ORDER BY id) AS after FROM exchanges", None),
    "win_first_last_nth": ("SELECT id, first_value(id) OVER w AS f, last_value(id) OVER w AS l, nth_value(id, 2) OVER w AS n FROM tool_uses WINDOW w AS (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "win_ntile": ("SELECT id, ntile(4) OVER (PARTITION BY session_id ORDER BY id) AS q FROM exchanges", None),
    "win_cume_percent": ("SELECT id, round(cume_dist() OVER (PARTITION BY session_id ORDER BY id), 6) AS c, round(percent_rank() OVER (PARTITION BY session_id ORDER BY id), 6) AS p FROM exchanges", None),
    "win_running_sum": ("SELECT id, sum(tokens_in) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM exchanges", "SELECT id, CAST(sum(tokens_in) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM exchanges"),
    "win_canonical": ("SELECT id, min(id) OVER (PARTITION BY layer, content) AS canonical, count(*) OVER (PARTITION BY layer, content) AS copies FROM memories", None),
    "win_range": ("SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY exchange_number NULLS FIRST RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM exchanges WHERE exchange_number IS NOT NULL", None),
    # sets
    "set_union": ("SELECT session_id FROM exchanges UNION SELECT session_id FROM tool_uses", None),
    "set_union_all": ("SELECT project FROM sessions UNION ALL SELECT project FROM memories", None),
    "set_intersect": ("SELECT project FROM sessions INTERSECT SELECT project FROM memories", None),
    "set_except": ("SELECT session_id FROM exchanges EXCEPT SELECT session_id FROM sessions", None),
    "recursive_cte": ("WITH RECURSIVE up AS (SELECT id, supersedes, 0 AS steps FROM memories WHERE supersedes IS NOT NULL UNION ALL SELECT up.id, m.supersedes, up.steps + 1 FROM up JOIN memories m ON m.id = up.supersedes WHERE up.steps < 12 AND m.supersedes IS NOT NULL) SELECT id, max(steps) AS steps FROM up GROUP BY id", None),
    "cte_chain": ("WITH big AS (SELECT session_id, count(*) AS n FROM exchanges GROUP BY session_id), ranked AS (SELECT session_id, n FROM big WHERE n > 20) SELECT r.session_id, r.n, s.project FROM ranked r JOIN sessions s ON s.session_id = r.session_id", None),
    "limit_clamp": ("SELECT id FROM memories ORDER BY id LIMIT 10, 5", "SELECT id FROM memories ORDER BY id LIMIT 5 OFFSET 10"),
    "bounded_rows": ("SELECT id FROM exchanges ORDER BY id DESC LIMIT 100000", "SELECT id FROM exchanges ORDER BY id DESC LIMIT 1000"),
    # scalars
    "fn_text": ("SELECT id, upper(layer) AS u, substr(content, 2, 5) AS s, instr(content, 'e') AS i, replace(layer, 'i', 'I') AS r, length(content) AS l, octet_length(content) AS o, hex(substr(layer, 1, 2)) AS h, trim('  x ') AS t, concat(layer, NULL, '!') AS c, concat_ws('-', layer, status) AS w FROM memories", "SELECT id, upper(layer) AS u, substr(content, 2, 5) AS s, CAST(instr(content, 'e') AS INTEGER) AS i, replace(layer, 'i', 'I') AS r, CAST(length(content) AS INTEGER) AS l, CAST(octet_length(encode(content)) AS INTEGER) AS o, hex(substr(layer, 1, 2)) AS h, 'x' AS t, concat(layer, NULL, '!') AS c, concat_ws('-', layer, status) AS w FROM memories"),
    "fn_choice": ("SELECT id, iif(tokens_in > 5000, 'big', 'small') AS size, ifnull(model, 'none') AS m, nullif(provider, 'north') AS p, coalesce(model, provider, '-') AS c, max(tokens_in, tokens_out) AS hi, min(tokens_in, tokens_out) AS lo, likely(id) AS k, sign(tokens_in - 5000) AS sg, unicode(provider) AS un FROM exchanges", "SELECT id, CASE WHEN tokens_in > 5000 THEN 'big' ELSE 'small' END AS size, ifnull(model, 'none') AS m, nullif(provider, 'north') AS p, coalesce(model, provider, '-') AS c, CASE WHEN tokens_in IS NULL OR tokens_out IS NULL THEN NULL ELSE greatest(tokens_in, tokens_out) END AS hi, CASE WHEN tokens_in IS NULL OR tokens_out IS NULL THEN NULL ELSE least(tokens_in, tokens_out) END AS lo, id AS k, CAST(sign(tokens_in - 5000) AS DOUBLE) AS sg, unicode(provider) AS un FROM exchanges"),
    "fn_like_glob": ("SELECT id FROM memories WHERE layer LIKE 'DEC%' OR glob('han*', layer)", "SELECT id FROM memories WHERE layer ILIKE 'DEC%' OR layer GLOB 'han*'"),
    "fn_format": ("SELECT name, format('%s has mode %s', name, access_mode) AS f, quote(name) AS q FROM layers", "SELECT name, name || ' has mode ' || access_mode AS f, '''' || name || '''' AS q FROM layers"),
    "fn_math": ("SELECT id, round(log(tokens_in), 6) AS lg, round(ln(tokens_in), 6) AS l, round(log2(tokens_in), 6) AS l2, round(sqrt(tokens_in), 6) AS sq, round(pow(tokens_in, 0.5), 6) AS pw, tokens_in % 7 AS m, trunc(tokens_in / 7.0) AS t, round(cos(tokens_in), 6) AS c, round(atan2(tokens_in, 3), 6) AS a, round(degrees(pi()), 4) AS d, ceil(tokens_in / 7.0) AS ce, floor(tokens_in / 7.0) AS fl FROM exchanges WHERE tokens_in > 0", "SELECT id, round(log10(tokens_in), 6) AS lg, round(ln(tokens_in), 6) AS l, round(log2(tokens_in), 6) AS l2, round(sqrt(tokens_in), 6) AS sq, round(pow(tokens_in, 0.5), 6) AS pw, tokens_in % 7 AS m, CAST(trunc(tokens_in / 7.0) AS DOUBLE) AS t, round(cos(tokens_in), 6) AS c, round(atan2(tokens_in, 3), 6) AS a, round(degrees(pi()), 4) AS d, CAST(ceil(tokens_in / 7.0) AS BIGINT) AS ce, CAST(floor(tokens_in / 7.0) AS BIGINT) AS fl FROM exchanges WHERE tokens_in > 0"),
    # dates
    "date_parts": ("SELECT id, strftime('%Y-%m', created_at) AS month, date(created_at) AS day, time(created_at) AS clock, datetime(created_at) AS at, unixepoch(created_at) AS epoch FROM memories WHERE created_at LIKE '%Z'", "SELECT id, strftime(t, '%Y-%m') AS month, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%H:%M:%S') AS clock, strftime(t, '%Y-%m-%d %H:%M:%S') AS at, CAST(floor(epoch(t)) AS BIGINT) AS epoch FROM (SELECT id, CAST(try_cast(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS t FROM memories WHERE created_at LIKE '%Z')"),
    "date_modifiers": ("SELECT id, date(created_at, 'start of month') AS m, date(created_at, '+1 month', '-1 day') AS x, date(created_at, 'start of year') AS y, datetime(created_at, '+90 minutes') AS later FROM memories WHERE created_at LIKE '%Z'", "SELECT id, strftime(date_trunc('month', t), '%Y-%m-%d') AS m, strftime(t + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS x, strftime(date_trunc('year', t), '%Y-%m-%d') AS y, strftime(t + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS later FROM (SELECT id, CAST(try_cast(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP) AS t FROM memories WHERE created_at LIKE '%Z')"),
    "date_julian": ("SELECT id, round(julianday(created_at), 5) AS j FROM memories WHERE created_at LIKE '%Z'", "SELECT id, round(epoch_us(try_cast(created_at AS TIMESTAMPTZ)) / 86400000000.0 + 2440587.5, 5) AS j FROM memories WHERE created_at LIKE '%Z'"),
    # JSON
    "json_read": ("SELECT id, json_extract(metadata, '$.file_path') AS a, metadata ->> 'file_path' AS b, json_valid(content) AS v FROM memories", "SELECT id, metadata ->> '$.file_path' AS a, metadata ->> '$.file_path' AS b, CASE WHEN content IS NULL THEN NULL WHEN json_valid(content) THEN 1 ELSE 0 END AS v FROM memories"),
    "json_build": ("SELECT name, json_object('name', name, 'excluded', search_excluded) AS o, json_array(name, access_mode) AS a FROM layers", "SELECT name, '{\"name\":\"' || name || '\",\"excluded\":' || search_excluded || '}' AS o, '[\"' || name || '\",\"' || access_mode || '\"]' AS a FROM layers"),
    "json_edit": ("SELECT id, json_patch(metadata, '{\"seen\":1}') AS p, json_set(metadata, '$.n', 2) AS s, json_remove(metadata, '$.file_path') AS r FROM memories WHERE metadata IS NOT NULL", None),
    # search
    "match_and": ("SELECT id FROM memories_fts WHERE memories_fts MATCH 'layer AND registry'", None),
    "match_phrase_or": ("SELECT id FROM exchanges_fts WHERE exchanges_fts MATCH '\"token tally\" OR \"cron gate\"'", None),
    "match_column": ("SELECT id FROM exchanges_fts WHERE exchanges_fts MATCH 'human_text : \"term folder\"'", None),
    "match_prefix_not": ("SELECT id FROM memories_fts WHERE memories_fts MATCH 'snap* NOT reader'", None),
    "match_ranked": ("SELECT id, round(bm25(memories_fts), 6) AS rank FROM memories_fts WHERE memories_fts MATCH 'retention job'", None),
    "match_joined": ("SELECT m.layer, count(*) AS n FROM memories m WHERE m.id IN (SELECT id FROM memories_fts WHERE memories_fts MATCH 'cursor') GROUP BY m.layer", None),
    "match_marked": ("SELECT id, highlight(content, 'cursor') AS h, snippet(content, 'cursor') AS s FROM memories_fts WHERE memories_fts MATCH 'cursor'", None),
}


def _run(statement: str, cap: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Engine(spark, {"core": views(spark, d)}).sql(statement, cap=cap)

    return run


#: Statements whose own LIMIT is what they show; all others return every row.
_LIMITED = ("limit_clamp", "bounded_rows")


def cross_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Two databases that disagree about a column, stacked by name."""
    rows = table(spark, d, "memories").select("id", "layer", "status")
    engine = Engine(spark, {"laptop": {"notes": rows.filter("id % 2 = 0").drop("status")}, "server": {"notes": rows.filter("id % 2 = 1")}}, main="server")
    parts = [Engine(spark, {n: engine.databases[n]}, main=n).sql("SELECT * FROM notes", [n], cap=-1).withColumn("origin", F.lit(n)) for n in ("laptop", "server")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def qualified_names(spark: SparkSession, d: str) -> DataFrame:
    """A join over two databases by qualified names."""
    found = views(spark, d)
    engine = Engine(spark, {"core": {"memories": found["memories"]}, "corpus": {"sessions": found["sessions"]}})
    return engine.sql("SELECT s.project, count(*) AS n FROM core.memories m JOIN corpus.sessions s ON s.session_id = m.source_session GROUP BY s.project", cap=-1)


def gate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says of statements that should and should not run."""
    from threadloom.plans.dialect import DialectError
    from threadloom.plans.gate import GateError, admit

    visible = Engine(spark, {"core": views(spark, d)}).visible(["core"])
    out = []
    for statement in (
        "SELECT 1", "SELECT count(*) FROM memories", "WITH a AS (SELECT id FROM memories) SELECT * FROM a", "DELETE FROM memories", "SELECT 1; SELECT 2", "INSERT INTO layers VALUES (1)", "SELECT * FROM ingest_file_state",
        "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM range(10)", "", "SELECT load_extension('x')", "SELECT * FROM nowhere", "SELECT id FROM memories LIMIT 5 -- note", "PRAGMA table_info(memories)",
    ):
        try:
            admit(spark, statement, visible)
            out.append((statement, "admitted"))
        except (GateError, DialectError):
            out.append((statement, "refused"))
    return spark.createDataFrame(out, "statement string, verdict string")


QUERIES = {name: _run(said, 0 if name in _LIMITED else -1) for name, (said, _) in STATEMENTS.items()} | {"cross_union_by_name": cross_union_by_name, "qualified_names": qualified_names, "gate_verdicts": gate_verdicts}

_T = "regexp_extract_all(translate(lower(coalesce({0}, '')), '" + FOLD_FROM + "', '" + FOLD_TO + r"'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def _has(column: str, needle: str) -> str:
    return f"contains(' ' || array_to_string({_T.format(column)}, ' ') || ' ', ' {needle}')"


_OWN = {
    "match_and": f"SELECT id FROM memories WHERE {_has('content', 'layer ')} AND {_has('content', 'registry ')}",
    "match_phrase_or": "SELECT id FROM exchanges WHERE " + " OR ".join(_has(c, w) for c in ("human_text", "agent_text") for w in ("token tally ", "cron gate ")),
    "match_column": f"SELECT id FROM exchanges WHERE {_has('human_text', 'term folder ')}",
    "match_prefix_not": f"SELECT id FROM memories WHERE {_has('content', 'snap')} AND NOT {_has('content', 'reader ')}",
    "match_joined": f"SELECT layer, count(*) AS n FROM memories WHERE {_has('content', 'cursor ')} GROUP BY layer",
    "match_ranked": f"WITH d AS (SELECT id, {_T.format('content')} AS t FROM memories), s AS (SELECT count(*) AS n, avg(len(t)) AS a, count(*) FILTER (WHERE list_contains(t, 'retention')) AS n1, count(*) FILTER (WHERE list_contains(t, 'job')) AS n2 FROM d), f AS (SELECT id, len(t) AS l, len(list_filter(t, lambda x: x = 'retention')) AS f1, len(list_filter(t, lambda x: x = 'job')) AS f2 FROM d) SELECT id, round(-(greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / a)) + greatest(ln((n - n2 + 0.5) / (n2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * l / a))), 6) AS rank FROM f, s WHERE f1 > 0 AND f2 > 0",
}
_NO_ORACLE = ("json_edit", "match_marked")
ORACLES = {name: other or said for name, (said, other) in STATEMENTS.items() if name not in _NO_ORACLE and name not in _OWN} | _OWN | {
    "cross_union_by_name": "SELECT id, layer, CASE WHEN id % 2 = 1 THEN status END AS status, CASE WHEN id % 2 = 0 THEN 'laptop' ELSE 'server' END AS origin FROM memories",
    # what every statement of the query must meet: one reading statement over visible tables with allowed functions
    "gate_verdicts": """SELECT statement, CASE WHEN ok THEN 'admitted' ELSE 'refused' END AS verdict FROM (VALUES ('SELECT 1', true), ('SELECT count(*) FROM memories', true), ('WITH a AS (SELECT id FROM memories) SELECT * FROM a', true), ('SELECT id FROM memories LIMIT 5 -- note', true),
  ('DELETE FROM memories', false), ('SELECT 1; SELECT 2', false), ('INSERT INTO layers VALUES (1)', false), ('SELECT * FROM ingest_file_state', false), ('SELECT * FROM parquet.`/etc`', false), ('SELECT reflect(''java.lang.System'', ''exit'', 1)', false),
  ('SELECT * FROM range(10)', false), ('', false), ('SELECT load_extension(''x'')', false), ('SELECT * FROM nowhere', false), ('PRAGMA table_info(memories)', false)) v(statement, ok)""",
    "qualified_names": "SELECT s.project, count(*) AS n FROM memories m JOIN sessions s ON s.session_id = m.source_session GROUP BY s.project",
}
