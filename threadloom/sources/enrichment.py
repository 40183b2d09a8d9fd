"""What other tables of an agent's store say about its sessions: threads and spawns, routing, channel evidence.

Everything comes as rows, never as lists inside a session, so a thread with millions of children or a session
with millions of routes is no burden to any task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a bot's log names a session, and how its lines and files name a time.
SESSION_MARK = r"\bid=(ses_[A-Za-z0-9_-]+)"
LINE_DATE = r"\d{4}-\d{2}-\d{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
FILE_DATE = r"\d{4}-\d{2}-\d{2}"


def thread_matches(sessions: DataFrame, threads: DataFrame, columns: list[str]) -> DataFrame:
    """``(session_id, thread_id, *columns)``: the thread that a session's id or rollout path names, if both name one only.

    ``sessions(session_id, rollout_path)``, ``threads(id, rollout_path, ...)``. Null and empty ids and paths match nothing.
    """
    named = threads.select(F.col("id").alias("thread_id"), F.col("rollout_path").alias("path"), *columns).distinct()
    by_id = sessions.join(named.filter("thread_id <> ''"), F.col("session_id") == F.col("thread_id")).select("session_id", *named.columns)
    by_path = sessions.filter("rollout_path <> ''").join(named, F.col("rollout_path") == F.col("path")).select("session_id", *named.columns)
    found = by_id.unionByName(by_path).distinct()
    alone = found.groupBy("session_id").agg(F.count("*").alias("n"), F.min(F.struct("thread_id", *columns)).alias("t"))
    return alone.filter("n = 1").select("session_id", "t.*")


def thread_links(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """``(session_id, relation, thread_id)``: distinct parents and children of matched threads; empty ends are none."""
    held = matches.select("session_id", "thread_id")
    sides = []
    for relation, own, other in (("parent", "child_thread_id", "parent_thread_id"), ("child", "parent_thread_id", "child_thread_id")):
        side = edges.filter(F.col(other) != "").select(F.col(own).alias("thread_id"), F.col(other).alias("other")).distinct()
        sides.append(held.join(side, "thread_id").select("session_id", F.lit(relation).alias("relation"), F.col("other").alias("thread_id")))
    return sides[0].unionByName(sides[1]).distinct()


def routing_rows(sessions: DataFrame, routing: DataFrame) -> DataFrame:
    """``(session_id, row)``: routing rows by session key or by the session id inside their entry, each once.

    ``sessions(session_id, session_key)``, ``routing(row, session_key, entry_json)``; an entry that is no JSON names nothing.
    """
    by_key = sessions.filter("session_key <> ''").join(routing.select("row", "session_key"), "session_key").select("session_id", "row")
    entry = routing.select("row", F.get_json_object("entry_json", "$.session_id").alias("session_id")).filter("session_id <> ''")
    return by_key.unionByName(entry.join(sessions.select("session_id").distinct(), "session_id").select("session_id", "row")).distinct()


def routing_counts(sessions: DataFrame, routing: DataFrame) -> DataFrame:
    """``(session_id, routes, first_row)``: how many ``routing_rows`` a session has, and the smallest; null rows are not counted.

    A key of many sessions and many rows would make all their pairs. Rows under the same keys are counted together
    instead, then added up once for all sessions of the same keys; only rows named by an entry are met with their session.
    """
    key = F.when(F.col("session_key") != "", F.col("session_key"))
    held = sessions.groupBy("session_id").agg(F.sort_array(F.collect_set(key)).alias("keys"))
    named = routing.filter(key.isNotNull()).groupBy("row", F.when(F.col("row").isNull(), key).alias("apart")).agg(F.sort_array(F.collect_set(key)).alias("row_keys"))
    alike = named.groupBy("row_keys").agg(F.count("row").alias("n"), F.min("row").alias("first"))
    met = held.select("keys").distinct().withColumn("k", F.explode("keys")).join(alike.withColumn("k", F.explode("row_keys")), "k").select("keys", "row_keys", "n", "first").distinct()
    sums = met.groupBy("keys").agg(F.sum("n").alias("routes"), F.min("first").alias("first_row"))
    by_key = held.join(sums, "keys").select("session_id", "routes", "first_row")
    entry = routing.select("row", F.get_json_object("entry_json", "$.session_id").alias("session_id")).filter("session_id <> ''").distinct()
    once = entry.join(held, "session_id").join(named.filter("row IS NOT NULL").select("row", "row_keys"), "row", "left").filter(~F.coalesce(F.arrays_overlap("keys", "row_keys"), F.lit(False)))
    by_entry = once.groupBy("session_id").agg(F.count("row").alias("routes"), F.min("row").alias("first_row"))
    return by_key.unionByName(by_entry).groupBy("session_id").agg(F.sum("routes").alias("routes"), F.min("first_row").alias("first_row"))


def channel_evidence(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """``(session_id, evidence, log_file, line_date)`` of log lines that name a session of the store.

    ``lines(path, line_no, line)``. Evidence is a digest of file, line, place in the line and session; the date is
    the line's own, else the file name's, else empty. A log never makes a session.
    """
    date = F.regexp_extract("line", LINE_DATE, 0)
    dated = F.when(date != "", date).otherwise(F.regexp_extract(F.element_at(F.split("path", "/"), -1), FILE_DATE, 0))
    found = lines.select("path", "line_no", dated.alias("line_date"), F.posexplode(F.regexp_extract_all("line", F.lit(SESSION_MARK), 1)).alias("place", "session_id"))
    zero = F.lit("\0")
    digest = F.sha2(F.concat("path", zero, F.col("line_no").cast("string"), zero, F.col("place").cast("string"), zero, "session_id"), 256)
    return found.join(sessions.select("session_id").distinct(), "session_id").select("session_id", digest.alias("evidence"), F.col("path").alias("log_file"), "line_date")
