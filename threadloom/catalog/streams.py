"""Event-time windows over the events table, in batch and as a replayed stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import table
from threadloom.streaming.incremental import activity_sessions, event_windows, replay


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def windows_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(_events(spark, d), "ts", ["event_type"], "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def windows_sliding(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(_events(spark, d), "ts", [], "2 days", "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


def windows_session(spark: SparkSession, d: str) -> DataFrame:
    return activity_sessions(_events(spark, d), "ts", ["user_id"], "6 hours").groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def windows_stream(spark: SparkSession, d: str) -> DataFrame:
    """The tumbling windows again, by a stream over the same file: the result must not differ."""
    rows = table(spark, d, "events")
    day = lambda s: event_windows(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "1 day")
    return replay(rows, f"{d}/events.parquet*", "threadloom_windows", day).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (windows_tumbling, windows_sliding, windows_session, windows_stream)}

_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"
ORACLES = {
    "windows_tumbling": _DAILY,
    "windows_stream": _DAILY,
    "windows_sliding": "SELECT strftime(date_trunc('day', ts) - CAST(k AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS day, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1",
    "windows_session": "SELECT user_id, count(*) AS runs, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1",
}
