"""Call logs: redacted JSON-lines segments, imported once each, growing segments from where they ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import redact_log
from threadloom.sources.sinks import VersionedTable

#: Days that calls are kept.
RETENTION_DAYS = 30


def read_segments(spark: SparkSession, root: str, done: DataFrame | None = None) -> DataFrame:
    """``(path, line_no, call_id, at, verb, failed, message)`` of lines beyond those that ``done`` (path, lines) has.

    Only ended lines count: one that is still being written is read when it is complete. Secrets are blanked as the line is read. Lines that hold no JSON object have a null call_id.
    """
    text = spark.read.option("pathGlobFilter", "*.jsonl").text(root, wholetext=True, recursiveFileLookup=True)
    ended = F.substring_index("value", "\n", -1)  # what stands behind the last line end is still being written
    whole = F.expr("substring(value, 1, length(value) - length(rest))")
    lines = text.withColumn("rest", ended).select(F.input_file_name().alias("path"), F.posexplode(F.split(whole, "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    if done is not None:
        lines = lines.join(done.select("path", F.col("lines").alias("had")), "path", "left").filter("had IS NULL OR line_no >= had").drop("had")
    safe = redact_log("line")
    field = lambda name: F.get_json_object(safe, f"$.{name}")
    return lines.select("path", "line_no", field("id").alias("call_id"), field("at").alias("at"), field("verb").alias("verb"), F.coalesce(field("error").isNotNull(), F.lit(False)).alias("failed"), field("error").alias("message"))


def import_calls(spark: SparkSession, root: str, archive: str) -> int:
    """New calls into the archive, each call id once; gives how many lines were new. A second run adds none."""
    calls, state = VersionedTable(spark, f"{archive}/calls"), VersionedTable(spark, f"{archive}/call_segments")
    new = read_segments(spark, root, state.read())
    added = new.count()
    if added:
        calls.upsert(new.filter("call_id IS NOT NULL").drop("path", "line_no"), ["call_id"])
        ends = new.groupBy("path").agg((F.max("line_no") + 1).alias("lines"))
        state.upsert(ends, ["path"])
    return added


def recent(calls: DataFrame, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Calls of the last ``days`` before ``now``; calls without a readable time are kept."""
    old = F.try_to_timestamp(F.col("at")) < F.to_timestamp(F.lit(now)) - F.make_interval(days=F.lit(days))
    return calls.filter(~F.coalesce(old, F.lit(False)))
