"""Where records go: versioned tables with numbered manifests, merges of touched buckets, verified backups, the writer facade."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import ingest
from threadloom.operators.quality import typed_digest
from threadloom.session import checkpoint


class VerificationError(RuntimeError):
    """A copy that does not hold what it should."""


class ConflictError(RuntimeError):
    """Another writer moved the table on in the meantime."""


@dataclass
class VersionedTable:
    """Immutable data folders and numbered manifests; the newest manifest is the table.

    A manifest names, for each bucket of keys, the folder that holds it and its rows. A new one is written
    beside the others and renamed to the next number, so there is a table at every moment, readers never see
    half a version, and the second of two writers that began from one version is refused.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _fs(self):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The number of the newest manifest, 0 where there is no table."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        names = (s.getPath().getName() for s in fs.listStatus(path(self.path)))
        return max((int(n.removeprefix("_manifest-")) for n in names if n.startswith("_manifest-") and n[10:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Bucket to folder and rows."""
        at = version or self.version()
        if not at:
            return {}
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/_manifest-{at:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _frame(self, parts: Iterable[dict]) -> DataFrame | None:
        folders = sorted({f"{self.path}/{p['folder']}" for p in parts})
        return self.spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest or a numbered version: a consistent snapshot, whatever is written meanwhile."""
        return self._frame(self.manifest(version).values())

    def rows(self, version: int | None = None) -> int:
        """Rows of a version, from its manifest."""
        return sum(p["rows"] for p in self.manifest(version).values())

    def _commit(self, base: int, manifest: dict[str, dict]) -> int:
        fs, path = self._fs()
        part = path(f"{self.path}/_part-{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        target = path(f"{self.path}/_manifest-{base + 1:010d}")
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise ConflictError(f"{self.path} is beyond version {base}")
        return base + 1

    def write(self, rows: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write the whole table anew."""
        base, name = self.version(), f"v-{uuid.uuid4().hex}"
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{name}")
        return self._commit(base, {"all": {"folder": name, "rows": seen.get["rows"]}})

    def merge(self, rows: DataFrame, keys: list[str], change: Callable[[DataFrame | None, DataFrame], DataFrame]) -> int:
        """``change(stored, rows)`` over the buckets of the first key that ``rows`` touch; all other buckets keep their folders.

        Without rows nothing is written.
        """
        base = self.version()
        held = self.manifest(base)
        bucket = F.pmod(F.xxhash64(F.col(keys[0]).cast("string")), F.lit(self.buckets)).cast("string")
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most ``buckets`` values
        if not touched:
            return base
        if "all" in held:
            touched |= {str(i) for i in range(self.buckets)}
        merged = change(self._frame(p for b, p in held.items() if b == "all" or b in touched), rows).withColumn("__bucket", bucket)
        name = f"v-{uuid.uuid4().hex}"
        # one file a bucket, several where a bucket is large: the optimizer splits and joins them by size
        merged.hint("rebalance", "__bucket").write.mode("errorifexists").partitionBy("__bucket").parquet(f"{self.path}/{name}")
        counts = self.spark.read.parquet(f"{self.path}/{name}").groupBy(F.col("__bucket").cast("string")).count().collect() if merged.columns else []
        fresh = {r[0]: {"folder": f"{name}/__bucket={r[0]}", "rows": r[1]} for r in counts}
        return self._commit(base, {b: p for b, p in held.items() if b != "all" and b not in touched} | fresh)

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows by key: incoming ones replace stored ones, all others stay. Repeats within the batch keep the largest."""
        latest = rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("v")).select(*keys, "v.*").select(rows.columns)
        return self.merge(latest, keys, lambda held, new: new if held is None else held.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the newest ``keep`` and the current one, and folders that no manifest names; gives how many folders went."""
        fs, path = self._fs()
        newest = self.version()
        kept = [v for v in range(max(1, newest - max(keep, 1) + 1), newest + 1)]
        named = {p["folder"].split("/")[0] for v in kept for p in self.manifest(v).values()}
        gone = 0
        for status in fs.listStatus(path(self.path)):
            name = status.getPath().getName()
            if name.startswith("_manifest-") and name[10:].isdigit() and int(name[10:]) not in kept:
                fs.delete(status.getPath(), False)
            elif name.startswith("v-") and name not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone


def content_state(rows: DataFrame) -> tuple[int, str]:
    """Row count and an order-free digest of a table."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(typed_digest(sorted(rows.columns))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, str(total)


def backup(rows: DataFrame, path: str) -> tuple[int, str]:
    """A copy that was read again and compared; VerificationError if it differs."""
    rows.write.mode("errorifexists").parquet(path)
    want, got = content_state(rows), content_state(rows.sparkSession.read.parquet(path))
    if want != got:
        raise VerificationError(f"the backup holds {got}, the table {want}")
    return got


class CorpusWriter:
    """Records of a parsed scan into the tables of an archive directory, by the merge rules of each table."""

    KEYS = {"sessions": ["session_id"], "exchanges": ["session_id"], "tool_uses": ["session_id"], "thinking_blocks": ["session_id"], "memories": ["path", "source_id"]}

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def write(self, parsed: DataFrame) -> dict[str, dict[str, int]]:
        """Merge every table; gives rows before and after. The same records again change nothing.

        Sessions are refreshed, exchanges matched and enriched, tool calls and thinking added where they are
        new, notes updated by freshness and resolved when their file was read without them. A value that a
        delivery does not state never takes away a stored one.
        """
        from threadloom.sources import files

        before = {name: self.table(name).rows() for name in self.KEYS}
        sessions = files.session_rows(parsed).drop("path").filter("session_id IS NOT NULL")
        latest = lambda rows, keys: rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("v")).select(*keys, "v.*").select(rows.columns)
        self.table("sessions").merge(checkpoint(latest(sessions, ["session_id"])), ["session_id"], _merge_sessions)
        made = checkpoint(latest(files.exchange_rows(parsed).filter("session_id IS NOT NULL"), ["session_id", "exchange_number"]))
        outcomes: list[DataFrame] = []

        def exchanges(held: DataFrame | None, new: DataFrame) -> DataFrame:
            if held is None:
                outcomes.append(new.select("session_id", F.col("exchange_number").alias("in_number"), F.col("exchange_number").alias("number"), F.lit("unmatched").alias("outcome")))
                return new
            merged, found = ingest.merge_exchanges(held, new)
            outcomes.append(found)
            return merged

        self.table("exchanges").merge(made, ["session_id"], exchanges)
        for name, rows in (("tool_uses", files.tool_rows(parsed)), ("thinking_blocks", files.thinking_rows(parsed))):
            if outcomes:
                placed = outcomes[0].filter("number IS NOT NULL").select("session_id", F.col("in_number").alias("exchange_number"), "number")
                rows = rows.join(placed, ["session_id", "exchange_number"]).withColumn("exchange_number", F.col("number").cast("int")).drop("number").select(rows.columns)
            same = rows.columns if name == "tool_uses" else [c for c in rows.columns if c != "position_in_session"]
            rows = checkpoint(rows)
            self.table(name).merge(rows, ["session_id"], lambda held, new, same=same: new if held is None else held.unionByName(ingest.missing_rows(held, new, same)))
        notes = files.memory_rows(parsed).withColumn("updated_at", F.coalesce(F.get_json_object("metadata", "$.updated_at"), "created_at")).withColumn("status", F.lit("active"))
        notes, read = checkpoint(latest(notes, self.KEYS["memories"])), checkpoint(parsed.filter("error IS NULL").select("path").distinct())

        def memories(held: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if held is None else ingest.merge_memories(held, new, self.KEYS["memories"], read)

        self.table("memories").merge(notes, self.KEYS["memories"], memories)
        return {name: {"before": before[name], "after": self.table(name).rows()} for name in self.KEYS}


def _merge_sessions(held: DataFrame | None, new: DataFrame) -> DataFrame:
    if held is None:
        return new
    stated = lambda df: df.withColumn("snapshot", F.coalesce(F.get_json_object("metadata", "$.snapshot") == "true", F.lit(False))).withColumn("updated_at", F.coalesce(F.get_json_object("metadata", "$.updated_at"), "ended_at")).withColumn("duration_minutes", F.lit(None).cast("bigint"))
    refreshed = ingest.refresh_sessions(stated(held), stated(new)).drop("duration_minutes")
    metadata = held.select("session_id", F.col("metadata").alias("old")).join(new.select("session_id", F.col("metadata").alias("new")), "session_id", "full_outer").select("session_id", ingest.merge_metadata().alias("metadata"))
    return refreshed.join(metadata, "session_id").select(held.columns)
