"""Incremental ingest: only new and changed files are read, each batch is written once, failures are read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.session import checkpoint
from threadloom.sources.files import parse_files, read_files
from threadloom.sources.sinks import CorpusWriter


def run(spark: SparkSession, root: str, archive: str) -> dict:
    """One pass over ``root``. The state names files by length and time, so unchanged ones are not opened.

    Files that failed or hold open turns are not recorded as done. A second pass over the same files
    reads nothing and changes nothing.
    """
    writer = CorpusWriter(spark, archive)
    state = writer.table("ingest_file_state")
    known = state.read()
    done = known.filter("last_error IS NULL AND NOT pending") if known is not None else None
    files = read_files(spark, root, done)
    parsed = checkpoint(parse_files(files).join(files.select("path", "length", "modificationTime"), "path"))
    counts = parsed.agg(F.count("*"), F.count("error"), F.count(F.when(F.size("deferred") > 0, 1))).first()
    report = {"read": counts[0], "failed": counts[1], "pending": counts[2], "tables": {}}
    if counts[0]:
        report["tables"] = writer.write(parsed.filter("error IS NULL"))
        state.upsert(parsed.select("path", "length", "modificationTime", F.col("kind").alias("source_kind"), "fingerprint", F.col("error").alias("last_error"), (F.size("deferred") > 0).alias("pending")), ["path"])
    return report


def follow(spark: SparkSession, root: str, archive: str, checkpoint_dir: str) -> StreamingQuery:
    """The same as a stream over all files there are now: each micro-batch of new files is parsed and upserted."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    source = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)

    def each(batch: DataFrame, _: int) -> None:
        CorpusWriter(batch.sparkSession, archive).write(checkpoint(parse_files(batch)).filter("error IS NULL"))

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def once_each(frame: DataFrame, keys: list[str], stamp: str, delay: str) -> DataFrame:
    """A stream without repeated deliveries that come within ``delay`` of each other."""
    return frame.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


def event_windows(events: DataFrame, stamp: str, by: list[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts over sliding or tumbling windows of event time; on a stream, late events within ``delay`` still count."""
    frame = events.withWatermark(stamp, delay) if events.isStreaming else events
    at = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return frame.groupBy(at.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def activity_sessions(events: DataFrame, stamp: str, by: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of activity without a pause of ``gap``."""
    frame = events.withWatermark(stamp, delay) if events.isStreaming else events
    return frame.groupBy(F.session_window(stamp, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def replay(frame: DataFrame, path: str, name: str, transform: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run a streaming transformation over stored files of ``frame``'s schema to its end and give the result."""
    spark = frame.sparkSession
    source = spark.readStream.schema(frame.schema).parquet(path)
    query = transform(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
