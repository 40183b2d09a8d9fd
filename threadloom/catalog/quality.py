"""Curation, ingest and operations queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import instant
from threadloom.operators import archive, ingest, quality
from threadloom.session import checkpoint, shared_folder, table
from threadloom.sources.sinks import CorpusWriter, VersionedTable, backup

PAYLOAD = ["session_id", "exchange_number", "human_text", "agent_text"]
_P = ", ".join(PAYLOAD)


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


def dedup_groups(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_groups(table(spark, d, "exchanges"), "id", PAYLOAD).select("canonical", "copies")


def dedup_mapping(spark: SparkSession, d: str) -> DataFrame:
    return quality.remap(table(spark, d, "exchanges"), "id", PAYLOAD)


def dedup_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return quality.ambiguous_identities(table(spark, d, "exchanges").filter("session_id IS NOT NULL AND exchange_number IS NOT NULL"), ["session_id", "exchange_number"], ["human_text", "agent_text"])


def dedup_after(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exchanges")
    seen = quality.manifest(quality.remap(rows, "id", PAYLOAD))[1]
    return quality.apply_remap(rows, "id", PAYLOAD, seen)["rows"].groupBy("session_id").agg(F.count("*").alias("n"))


def dedup_references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories")
    mapping = quality.remap(rows, "id", ["layer", "content"])
    return quality.follow(rows.select("id", "supersedes"), "supersedes", mapping)


def remap_chain_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.remap_chains(quality.remap(table(spark, d, "memories"), "id", ["layer", "content"]))


def memory_winner_guards(spark: SparkSession, d: str) -> DataFrame:
    return quality.winner_guards(table(spark, d, "memories"), "id", ["layer", "content"], "created_at", "metadata")


def memory_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories")
    return quality.resolve_ids(rows.select("id"), "id", [quality.remap(rows, "id", ["layer", "content"]), quality.remap(rows, "id", ["content"])])


def health_orphans(spark: SparkSession, d: str) -> DataFrame:
    return quality.orphan_replacements(table(spark, d, "memories"))


def health_unregistered_layers(spark: SparkSession, d: str) -> DataFrame:
    return quality.unregistered_layers(table(spark, d, "memories"), table(spark, d, "layers"))


def health_alias_rows(spark: SparkSession, d: str) -> DataFrame:
    return quality.alias_rows(table(spark, d, "memories"), table(spark, d, "layers"))


def health_ghost_sessions(spark: SparkSession, d: str) -> DataFrame:
    return quality.ghost_sessions(table(spark, d, "sessions"), [table(spark, d, "exchanges"), table(spark, d, "tool_uses")])


def sessions_without_row(spark: SparkSession, d: str) -> DataFrame:
    return quality.sessions_without_row(table(spark, d, "sessions"), [table(spark, d, "exchanges"), table(spark, d, "tool_uses")])


def health_checks(spark: SparkSession, d: str) -> DataFrame:
    return quality.health(*(table(spark, d, n) for n in ("memories", "sessions", "layers", "exchanges", "tool_uses")))


def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    return quality.worst(health_checks(spark, d))


def layer_resolve(spark: SparkSession, d: str) -> DataFrame:
    return quality.resolve_layers(table(spark, d, "layers"))


def layer_migrate(spark: SparkSession, d: str) -> DataFrame:
    return quality.migrate_layers(table(spark, d, "memories"), table(spark, d, "layers")).groupBy("layer").agg(F.count("*").alias("n"))


def store_new_memories(spark: SparkSession, d: str) -> DataFrame:
    """Documents offered as notes: those not stored yet, each text once."""
    stored = table(spark, d, "memories").select("layer", "content", "project")
    offered = table(spark, d, "documents").select(F.col("doc_kind").alias("layer"), F.col("text").alias("content"), F.lit(None).cast("string").alias("project"))
    return quality.store_rows(stored, offered, ["layer", "content", "project"])


def expiry_drain(spark: SparkSession, d: str) -> DataFrame:
    return quality.unexpired(table(spark, d, "memories"), "created_at", "2025-07-01 00:00:00").groupBy("status").agg(F.count("*").alias("n"))


def archive_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exchanges")
    return quality.versions({"a": rows.filter("id % 3 <> 0"), "b": rows.filter("id % 3 <> 1")}, PAYLOAD).groupBy("sources", "n").agg(F.count("*").alias("versions"))


def archive_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return quality.occurrence_ordinals(table(spark, d, "exchanges"), "id", ["session_id"], ["human_text", "agent_text"]).select("id", F.col("ordinal").cast("bigint").alias("ordinal"))


def custody_expectation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories")
    return quality.custody_expectation({"a": rows.filter("id % 3 <> 0"), "b": rows.filter("id % 3 <> 1"), "c": rows.filter("id % 2 = 0")}, ["layer", "content"])


def custody_union(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories")
    return quality.custody_union({"a": rows.filter("id % 3 <> 0"), "b": rows.filter("id % 3 <> 1"), "c": rows.filter("id % 2 = 0")}, ["layer", "content"]).groupBy("layer").agg(F.count("*").alias("n"))


def custody_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories")
    now = rows.filter("id % 7 <> 0").withColumn("content", F.when(F.col("id") % 5 == 0, F.upper("content")).otherwise(F.col("content")))
    return quality.drift(rows.filter("id % 11 <> 0"), now, "id", ["layer", "content"]).groupBy("action").agg(F.count("*").alias("n"))


def reconcile_coverage(spark: SparkSession, d: str) -> DataFrame:
    return quality.reconcile(table(spark, d, "tool_uses").filter("session_id IS NOT NULL AND exchange_number IS NOT NULL"), table(spark, d, "exchanges").filter("session_id IS NOT NULL"), "session_id", "exchange_number")


def session_inventory(spark: SparkSession, d: str) -> DataFrame:
    return quality.inventory(table(spark, d, "exchanges"), "session_id", ["human_text", "agent_text"]).select("session_id", "n", "distinct_rows")


def shadow_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_uses").select("tool_name", "had_error")
    return quality.shadow_differences(rows, rows.filter("had_error = 0 OR tool_name <> 'Bash'")).groupBy("tool_name", "had_error", "side").agg(F.count("*").alias("n"))


def handoff_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories").filter("layer = 'handoff' AND project IS NOT NULL")
    return quality.latest_by(rows, ["project"], ["created_at", "id"]).select("project", "id")


def latest_journey(spark: SparkSession, d: str) -> DataFrame:
    return quality.latest_by(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def gate_dependency(spark: SparkSession, d: str) -> DataFrame:
    """Users whose latest run of the dependency (signup) succeeded, that is came with no later error."""
    last = quality.latest_by(table(spark, d, "events").filter("event_type IN ('signup', 'error')"), ["user_id"], ["ts", "event_id"])
    return last.select("user_id", (F.col("event_type") == "signup").alias("may_run"))


def recent_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed tool calls by tool and message: a top-ten report."""
    return table(spark, d, "tool_uses").filter("had_error = 1").groupBy("tool_name", "error_message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_name", "error_message").limit(10)


def retention_cut(spark: SparkSession, d: str) -> DataFrame:
    """Rows by day within seven days of the newest event; the bound is one row."""
    rows = table(spark, d, "events")
    newest = rows.agg(F.max("ts")).first()[0]
    return rows.filter(F.col("ts") > F.lit(newest) - F.expr("INTERVAL 7 DAYS")).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))


# -- ingest -------------------------------------------------------------------------------------------


def turn_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").withColumn("role", F.when(F.lower(F.trim("sender")).isin("human", "user"), "human").when(F.lower(F.trim("sender")).isin("assistant", "ai"), "assistant"))
    return ingest.turn_ids(rows, "conversation_uuid", ["ingested_at", "uuid"], F.col("role") == "human").groupBy("conversation_uuid").agg(F.max("turn").alias("turns"), F.count(F.when(F.col("turn") == 0, 1)).alias("before_first"))


def turn_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_messages").withColumn("role", F.when(F.lower(F.trim("sender")).isin("human", "user"), "human").when(F.lower(F.trim("sender")).isin("assistant", "ai"), "assistant"))
    return ingest.turns(rows, "conversation_uuid", ["ingested_at", "uuid"], "role", "text", "created_at").select("conversation_uuid", "turn", "human_text", F.length("agent_text").alias("answer_length"), "latency_ms")


def session_spans(spark: SparkSession, d: str) -> DataFrame:
    return ingest.session_span(table(spark, d, "exchanges")).select("session_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "minutes")


def usage_tally_nullable(spark: SparkSession, d: str) -> DataFrame:
    return ingest.usage_tally(table(spark, d, "exchanges"), "model")


def thinking_position(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.model import thinking_blocks

    return thinking_blocks(table(spark, d, "exchanges")).select("id", F.round("position_in_session", 6).alias("position"))


def interval_join_nearest_30s(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the nearest equal answer time within thirty seconds, session by session."""
    rows = table(spark, d, "exchanges").filter("session_id IS NOT NULL")
    return ingest.nearest_within(rows, rows, ["session_id"], "human_timestamp", "agent_timestamp", "id", "id").select("left_id", "right_id", F.round("gap_seconds", 3).alias("gap_seconds"))


def span_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Tool calls that were stored within a session's span of questions."""
    tools = table(spark, d, "tool_uses").filter("session_id IS NOT NULL").withColumn("at", F.unix_micros(F.col("ingested_at").cast("timestamp")))
    spans = ingest.session_span(table(spark, d, "exchanges")).withColumn("opened", F.unix_micros("started")).withColumn("closed", F.unix_micros("ended"))
    return ingest.within_spans(tools, spans, "session_id", "at", "opened", "closed").groupBy(F.col("s.session_id")).agg(F.count("*").alias("n"))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """Half of the exchanges delivered again, a part with another text."""
    rows = table(spark, d, "exchanges").filter("id % 2 = 0 AND session_id IS NOT NULL")
    return rows.withColumn("agent_text", F.when(F.col("id") % 6 == 0, F.concat("agent_text", F.lit(" again"))).otherwise(F.col("agent_text"))).withColumn("human_text", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("human_text")))


def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "exchanges").filter("session_id IS NOT NULL")
    stages = [("content", ["human_text", "agent_text"]), ("prompt", ["human_text"]), ("number", ["exchange_number"])]
    return ingest.match_cascade(_incoming(spark, d), stored, "id", "id", "session_id", stages).groupBy("stage", "outcome").agg(F.count("*").alias("n"))


def fresh_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exchanges").filter("session_id IS NOT NULL")
    return ingest.fresh_numbers(rows.filter("exchange_number IS NULL").select("id", "session_id"), rows, "session_id", "exchange_number", "id").select("id", F.col("exchange_number").cast("bigint").alias("number"))


def enrich_richer_signal(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "exchanges").withColumn("tokens_in", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("tokens_in")))
    new = table(spark, d, "exchanges").withColumn("model", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.lit("new")))
    return ingest.enrich(old, new, "id", ["human_text"], ["model", "provider", "tokens_in"]).select("id", "model", "tokens_in")


def session_refresh(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "sessions").withColumn("updated_at", F.lit("2025-06-01T00:00:00Z"))
    new = old.filter("session_id IS NOT NULL").withColumn("snapshot", F.ascii(F.substring("session_id", -1, 1)) % 2 == 0).withColumn("updated_at", F.when(F.ascii(F.substring("session_id", -1, 1)) % 3 == 0, "2025-05-01T00:00:00Z").otherwise("2025-07-01T00:00:00Z")).withColumn("project", F.lit("fresh")).withColumn("title", F.lit("fresh title"))
    return ingest.refresh_sessions(old, new).groupBy("project", F.col("title") == "fresh title").agg(F.count("*").alias("n")).withColumnRenamed("(title = fresh title)", "new_title")


def upsert_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "memories").select("id", "content", "project", F.col("created_at").alias("updated_at"))
    incoming = rows.filter("id % 5 <> 0").withColumn("content", F.when(F.col("id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("updated_at", F.when(F.col("id") % 3 == 0, "2030-01-01T00:00:00Z").when(F.col("id") % 7 == 0, "2001-01-01T00:00:00Z").otherwise(F.col("updated_at")))
    return ingest.memory_actions(rows.filter("id % 9 <> 0"), incoming, ["id"]).groupBy("action").agg(F.count("*").alias("n"))


def metadata_merge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").select("id", F.col("metadata").alias("old"), F.lit('{"file_path": null, "seen": true}').alias("new")).select("id", ingest.merge_metadata().alias("merged"))


def tree_reparent(spark: SparkSession, d: str) -> DataFrame:
    """Messages that say something, under their nearest ancestor that does."""
    parent = F.trim("parent_message_uuid")
    rows = table(spark, d, "chat_messages").select("conversation_uuid", "uuid", F.when(parent != "", parent).alias("parent"), (F.trim(F.coalesce("text", F.lit(""))) != "").alias("shown")).distinct()
    return ingest.surviving_parents(rows, "conversation_uuid", "uuid", "parent", "shown").select("node", "parent")


def _alone(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges that nothing in their session can be taken for: number, question, answer and pair of times each once, none blank."""
    rows = table(spark, d, "exchanges").filter("session_id IS NOT NULL AND exchange_number IS NOT NULL AND trim(human_text) <> '' AND trim(agent_text) <> ''")
    for c in ("exchange_number", "human_text"):
        once = rows.groupBy("session_id", c).agg(F.count("*").alias("n")).filter("n = 1").drop("n")
        rows = rows.join(once, ["session_id", c])
    return rows.select(
        "session_id", "exchange_number", "human_text", "agent_text", F.lit(None).cast("string").alias("human_timestamp"), F.lit(None).cast("string").alias("agent_timestamp"), F.lit(None).cast("string").alias("source_id"), "model", "provider",
        "tokens_in", "tokens_out", "tokens_reasoning", "response_latency_ms", "is_after_compaction",
    )


def exchange_merge(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges after a second delivery with other fields, other numbers and new rows."""
    rows = _alone(spark, d)
    part = F.length("human_text") % 4
    stored = rows.filter(part != 3).withColumn("model", F.when(part == 0, F.lit(None)).otherwise(F.col("model"))).withColumn("provider", F.lit(None).cast("string"))
    incoming = rows.withColumn("tokens_in", F.lit(None).cast("bigint")).withColumn("tokens_out", F.lit(None).cast("bigint")).withColumn("tokens_reasoning", F.lit(None).cast("bigint")).withColumn("model", F.lit("later")).withColumn("provider", F.lit("new")).withColumn("agent_text", F.when(part == 1, F.lit(None)).otherwise(F.col("agent_text")))
    return ingest.merge_exchanges(stored, incoming)[0].select("session_id", "exchange_number", "human_text", F.length("agent_text").alias("answer_length"), "model", "provider", "tokens_in")


def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    """Notes after a second delivery: updated, stamped, attributed, resolved and inserted ones."""
    notes = table(spark, d, "memories").select(F.concat(F.lit("f"), F.col("id") % 97).alias("path"), F.col("id").alias("source_id"), "content", "project", F.lit("2025-06-01T00:00:00Z").alias("updated_at"), F.lit("active").alias("status"), F.lit("{}").alias("metadata"))
    fresh = notes.filter("source_id % 5 <> 0").withColumn("content", F.when(F.col("source_id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).withColumn("updated_at", F.when(F.col("source_id") % 3 == 0, "2030-01-01T00:00:00Z").otherwise("2001-01-01T00:00:00Z"))
    read = notes.select("path").filter("path <> 'f3'").distinct()
    merged = ingest.merge_memories(notes.filter("source_id % 9 <> 0"), fresh, ["path", "source_id"], read)
    return merged.select("source_id", F.length("content").alias("size"), "updated_at", "status", F.col("metadata").contains("superseded").alias("superseded"))


def sink_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table after two upserts into its buckets, and its first version beside it."""
    target = VersionedTable(spark, f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}")
    rows = table(spark, d, "sessions").filter("session_id IS NOT NULL").select("session_id", "title")
    target.upsert(rows.filter("title IS NOT NULL"), ["session_id"])
    target.upsert(rows.withColumn("title", F.upper("title")), ["session_id"])
    count = lambda df, v: df.agg(F.count("*").alias("n"), F.count("title").alias("titles"), F.count(F.when(F.col("title") == F.upper("title"), 1)).alias("upper")).withColumn("version", F.lit(v))
    return count(target.read(1), 1).unionByName(count(target.read(), 2))


def sink_backup(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a verified backup."""
    rows, digest = backup(table(spark, d, "memories"), f"{shared_folder(spark)}/backup-{uuid.uuid4().hex}")
    return spark.createDataFrame([(rows, len(digest) > 0)], "n bigint, verified boolean")


def sink_writer(spark: SparkSession, d: str) -> DataFrame:
    """What the corpus writer reports of one delivery and of the same again: files of one family made of all exchanges."""
    from threadloom.catalog.families import TRANSCRIPTS, transcript_files
    from threadloom.sources.files import parse_files

    pattern, writer, *_ = TRANSCRIPTS["source_claude_session"]
    parsed = checkpoint(parse_files(transcript_files(spark, d, pattern, writer)))
    corpus = CorpusWriter(spark, f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}")
    reports = [corpus.write(parsed), corpus.write(parsed)]
    return spark.createDataFrame([(run, name, r["before"], r["after"]) for run, report in enumerate(reports, 1) for name, r in report.items()], "run int, table string, before bigint, after bigint")


def _custody(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes of two source databases as memberships, evidence and versions by content."""
    notes = table(spark, d, "memories").filter("content IS NOT NULL")
    own = notes.select(F.when(F.col("id") % 3 == 0, "old").otherwise("core").alias("source_database"), F.lit("memories").alias("source_table"), F.col("id").cast("string").alias("source_key"), F.sha2("content", 256).alias("digest"), "id", "content", "layer", "project")
    custody = own.select("source_database", "source_table", "source_key", F.lit("memory_versions").alias("destination_table"), F.col("digest").alias("destination_key"))
    return custody, own.select("source_database", "source_table", "source_key", F.col("id").alias("source_row_id")), own.groupBy(F.col("digest").alias("version_digest")).agg(F.min("layer").alias("layer"), F.length(F.min("content")).alias("size"))


def archive_memberships(spark: SparkSession, d: str) -> DataFrame:
    custody, evidence, versions = _custody(spark, d)
    return archive.memberships(custody, evidence, versions, "memory_versions").select("source_database", "source_row_id", "version_digest", "layer", "size")


def archive_heads(spark: SparkSession, d: str) -> DataFrame:
    """Memberships with the head of their layer: its largest digest; layers whose name begins with d have none."""
    rows = archive_memberships(spark, d)
    heads = rows.filter("layer NOT LIKE 'd%'").groupBy("layer").agg(F.max("version_digest").alias("version_digest"))
    return archive.with_heads(rows, heads, "layer").select("source_row_id", "is_selected")


def archive_hub(spark: SparkSession, d: str) -> DataFrame:
    """The notes of one source again from the archive, under their own ids, with provenance where it is known."""
    notes = table(spark, d, "memories")
    custody = notes.select(F.when(F.col("id") % 3 == 0, "old").otherwise("core").alias("source_database"), F.lit("memories").alias("source_table"), F.col("id").cast("string").alias("source_key"), F.lit("records").alias("destination_table"), (F.col("id") + 7).cast("string").alias("destination_key"))
    records = notes.select((F.col("id") + 7).alias("id"), "layer", "content")
    provenance = custody.filter("source_key LIKE '%5'").select("source_database", "source_key", F.lit("import").alias("provenance"))
    return archive.hub_tables({"memories": (archive.compatible(custody, records, provenance, "records"), {c: c for c in ("id", "layer", "content", "provenance")})})["memories"]


def first_owner(spark: SparkSession, d: str) -> DataFrame:
    """Of the messages given one number in their session the one that was asked first keeps it."""
    given = table(spark, d, "exchanges").filter("session_id IS NOT NULL AND exchange_number IS NOT NULL").select("session_id", "exchange_number", F.concat(F.lit("m"), F.col("id")).alias("source"), "id")
    return archive.first_owners(given, ["session_id"], "exchange_number", "source", "id")


def prune_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "exchanges").filter("session_id IS NOT NULL")
    mapped = rows.filter("exchange_number <= 10")
    return ingest.keep_mapped(rows, mapped, "session_id", "id").groupBy("session_id").agg(F.count("*").alias("n"))


def missing_tool_uses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tool_uses")
    return ingest.missing_rows(rows.filter("id % 3 = 0"), rows, ["session_id", "exchange_number", "tool_name", "tool_params_summary", "had_error"]).select("id")


def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "chat_messages").select(F.col("conversation_uuid").alias("key"), F.substring("conversation_uuid", 1, 1).alias("shard"))
    b = table(spark, d, "conversations").select(F.col("uuid").alias("key"), F.substring("uuid", 1, 1).alias("shard"))
    return ingest.coverage(a, b, "key", "shard")


def support_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Rows and newest arrival of every table family."""
    parts = None
    for name in ("exchanges", "tool_uses", "memories", "documents", "chat_messages"):
        one = table(spark, d, name).agg(F.count("*").alias("n"), F.max("ingested_at").alias("newest")).select(F.lit(name).alias("family"), "n", F.unix_micros(F.col("newest").cast("timestamp")).alias("newest"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges that arrived more than a day after they were asked."""
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(instant("human_timestamp"))
    return table(spark, d, "exchanges").filter(late > 86_400_000_000).select("id")


QUERIES = {
    f.__name__: f
    for f in (
        dedup_groups, dedup_mapping, dedup_ambiguous, dedup_after, dedup_references, remap_chain_check, memory_winner_guards, memory_resolve,
        health_orphans, health_unregistered_layers, health_alias_rows, health_ghost_sessions, sessions_without_row, health_checks, health_verdict, layer_resolve, layer_migrate, store_new_memories, expiry_drain,
        archive_versions, archive_ordinals, custody_expectation, custody_union, custody_drift, reconcile_coverage, session_inventory, shadow_compare,
        handoff_latest, latest_journey, gate_dependency, recent_failures, retention_cut,
        turn_pairing, turn_texts, session_spans, usage_tally_nullable, thinking_position, interval_join_nearest_30s, span_range_join, match_outcomes, fresh_numbering, enrich_richer_signal, session_refresh,
        upsert_actions, exchange_merge, memory_merge, sink_upsert, sink_backup, sink_writer, archive_memberships, archive_heads, archive_hub, first_owner, metadata_merge, tree_reparent, prune_snapshot, missing_tool_uses, source_coverage, support_snapshot, late_arrivals,
    )
}

_TS = "epoch_us(try_cast({0} AS TIMESTAMPTZ))"
_ROLE = "CASE WHEN lower(trim(sender)) IN ('human', 'user') THEN 'human' WHEN lower(trim(sender)) IN ('assistant', 'ai') THEN 'assistant' END"
_REMAP = "SELECT id AS old_id, canonical_id FROM (SELECT id, min(id) OVER (PARTITION BY {0}) AS canonical_id FROM {1}) WHERE id <> canonical_id"

_HEALTH = r"""
WITH c AS (
  SELECT 'orphan_supersedes' AS "check", 'fail' AS bad, count(*) AS n FROM memories m WHERE supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM memories o WHERE o.id = m.supersedes)
  UNION ALL SELECT 'test_metadata_rows', 'fail', count(*) FROM memories WHERE CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$._test') IN ('1', 'true', 'True') END
  UNION ALL SELECT 'test_source_agent_rows', 'fail', count(*) FROM memories WHERE source_agent IN ('test-agent', 'test')
  UNION ALL SELECT 'runtime_layers_not_in_registry', 'fail', count(*) FROM (SELECT m.layer FROM memories m LEFT JOIN layers l ON l.name = m.layer WHERE l.name IS NULL GROUP BY m.layer)
  UNION ALL SELECT 'physical_alias_layer_rows', 'fail', count(*) FROM memories m JOIN layers l ON l.name = m.layer WHERE l.alias_of IS NOT NULL
  UNION ALL SELECT 'ghost_sessions', 'warn', count(*) FROM sessions s WHERE started_at IS NULL AND ended_at IS NULL AND (EXISTS (SELECT 1 FROM exchanges e WHERE e.session_id = s.session_id) OR EXISTS (SELECT 1 FROM tool_uses t WHERE t.session_id = s.session_id))),
f AS (SELECT CASE WHEN regexp_full_match(created_at, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})') THEN 'o' WHEN regexp_full_match(created_at, '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}') THEN 'b' ELSE 'x' END AS f FROM memories WHERE created_at IS NOT NULL)
SELECT "check", n, CASE WHEN n = 0 THEN 'pass' ELSE bad END AS verdict FROM c
UNION ALL SELECT 'memory_created_at_formats', count(*), CASE WHEN count(DISTINCT f) > 1 OR coalesce(bool_or(f = 'x'), false) THEN 'warn' ELSE 'pass' END FROM f"""

def _match_sql() -> str:
    """The cascade of matches, stage by stage, each over what the stages before left."""
    stages = (("content", "human_text, agent_text"), ("prompt", "human_text"), ("number", "exchange_number"))
    parts = [
        "s0 AS (SELECT id, session_id, human_text, agent_text, exchange_number FROM exchanges WHERE session_id IS NOT NULL)",
        "i0 AS (SELECT id, session_id, CASE WHEN id % 10 = 0 THEN NULL ELSE human_text END AS human_text, CASE WHEN id % 6 = 0 THEN agent_text || ' again' ELSE agent_text END AS agent_text, exchange_number FROM s0 WHERE id % 2 = 0)",
    ]
    out, claims = [], []
    for n, (name, keys) in enumerate(stages):
        solid = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
        parts += [
            f"h{n} AS (SELECT * FROM (SELECT session_id, {keys}, min(id) AS iid, count(*) AS ni FROM i{n} WHERE {solid} GROUP BY ALL) JOIN (SELECT session_id, {keys}, min(id) AS sid, count(*) AS ns FROM s{n} WHERE {solid} GROUP BY ALL) USING (session_id, {keys}))",
            f"m{n} AS (SELECT iid, sid FROM h{n} WHERE ni = 1 AND ns = 1)", f"v{n} AS (SELECT id AS iid FROM i{n} JOIN h{n} USING (session_id, {keys}) WHERE ni > 1 OR ns > 1)",
            f"i{n + 1} AS (SELECT * FROM i{n} WHERE id NOT IN (SELECT iid FROM m{n} UNION ALL SELECT iid FROM v{n}))", f"s{n + 1} AS (SELECT * FROM s{n} WHERE id NOT IN (SELECT sid FROM m{n}))",
        ]
        out += [f"SELECT '{name}' AS stage, 'matched' AS outcome FROM m{n}", f"SELECT '{name}', 'ambiguous' FROM v{n}"]
        if name != "number":
            claims.append(f"SELECT r.id, {n} AS place, '{name}' AS stage FROM i3 r JOIN (SELECT DISTINCT session_id, {keys} FROM s0 WHERE id IN (SELECT sid FROM m0 UNION ALL SELECT sid FROM m1 UNION ALL SELECT sid FROM m2)) USING (session_id, {keys})")
    parts.append(f"c AS (SELECT id, arg_min(stage, place) AS stage FROM ({' UNION ALL '.join(claims)}) GROUP BY id)")
    out += ["SELECT stage, 'claimed' FROM c", "SELECT NULL, 'unmatched' FROM i3 WHERE id NOT IN (SELECT id FROM c)"]
    return f"WITH {', '.join(parts)} SELECT stage, outcome, count(*) AS n FROM ({' UNION ALL '.join(out)}) GROUP BY 1, 2"


ORACLES = {
    "dedup_groups": f"SELECT min(id) AS canonical, count(*) AS copies FROM exchanges GROUP BY {_P} HAVING count(*) > 1",
    "dedup_mapping": _REMAP.format(_P, "exchanges"),
    "dedup_ambiguous": "SELECT session_id, exchange_number, count(DISTINCT (human_text, agent_text)) AS payloads, count(*) AS n FROM exchanges WHERE session_id IS NOT NULL AND exchange_number IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT (human_text, agent_text)) > 1",
    "dedup_after": f"SELECT session_id, count(*) AS n FROM (SELECT DISTINCT {_P} FROM exchanges) GROUP BY session_id",
    "dedup_references": f"WITH m AS ({_REMAP.format('layer, content', 'memories')}) SELECT id, coalesce(m.canonical_id, supersedes) AS supersedes FROM memories LEFT JOIN m ON m.old_id = supersedes",
    "remap_chain_check": f"WITH m AS ({_REMAP.format('layer, content', 'memories')}) SELECT a.old_id, a.canonical_id, b.canonical_id AS next_id FROM m a JOIN m b ON a.canonical_id = b.old_id",
    "memory_winner_guards": "SELECT min(id) AS winner, arg_min(id, (coalesce(created_at, ''), id)) AS earliest, coalesce(NOT json_valid(arg_min(metadata, id)), false) AS bad_metadata FROM memories GROUP BY layer, content HAVING count(*) > 1 AND (min(id) <> arg_min(id, (coalesce(created_at, ''), id)) OR coalesce(NOT json_valid(arg_min(metadata, id)), false))",
    "memory_resolve": "SELECT id, CASE WHEN min(id) OVER (PARTITION BY layer, content) <> id THEN min(id) OVER (PARTITION BY layer, content) ELSE min(id) OVER (PARTITION BY content) END AS canonical_id FROM memories",
    "health_orphans": "SELECT m.id, m.supersedes FROM memories m LEFT JOIN memories o ON o.id = m.supersedes WHERE m.supersedes IS NOT NULL AND o.id IS NULL",
    "health_unregistered_layers": "SELECT layer, count(*) AS n FROM memories m LEFT JOIN layers l ON l.name = m.layer WHERE l.name IS NULL GROUP BY layer",
    "health_alias_rows": "SELECT layer, alias_of, count(*) AS n FROM memories JOIN layers ON name = layer WHERE alias_of IS NOT NULL GROUP BY 1, 2",
    "health_ghost_sessions": "SELECT session_id FROM sessions s WHERE started_at IS NULL AND ended_at IS NULL AND (EXISTS (SELECT 1 FROM exchanges e WHERE e.session_id = s.session_id) OR EXISTS (SELECT 1 FROM tool_uses t WHERE t.session_id = s.session_id))",
    "sessions_without_row": "SELECT session_id FROM (SELECT session_id FROM exchanges UNION SELECT session_id FROM tool_uses) WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM sessions)",
    "exchange_merge": """WITH u AS (SELECT * FROM exchanges WHERE session_id IS NOT NULL AND exchange_number IS NOT NULL AND trim(human_text, ' ') <> '' AND trim(agent_text, ' ') <> ''),
v AS (SELECT * FROM u QUALIFY count(*) OVER (PARTITION BY session_id, exchange_number) = 1), a AS (SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY session_id, human_text) = 1),
b AS (SELECT *, length(human_text) % 4 AS p, CASE WHEN length(human_text) % 4 <> 0 THEN model END AS om FROM a),
c AS (SELECT *, CAST(om IS NOT NULL AS INT) + CAST(tokens_in IS NOT NULL AS INT) + CAST(tokens_out IS NOT NULL AS INT) + CAST(tokens_reasoning IS NOT NULL AS INT) AS stated FROM b)
SELECT session_id, exchange_number, human_text, length(agent_text) AS answer_length, CASE WHEN p = 3 OR stated < 2 THEN 'later' ELSE coalesce(om, 'later') END AS model, 'new' AS provider, CASE WHEN p <> 3 THEN tokens_in END AS tokens_in FROM c""",
    "memory_merge": """SELECT id AS source_id, CASE WHEN id % 9 = 0 THEN length(content) + CAST(id % 4 = 0 AS INT) WHEN id % 5 <> 0 AND id % 4 = 0 AND id % 3 = 0 THEN length(content) + 1 ELSE length(content) END AS size,
  CASE WHEN id % 5 = 0 THEN '2025-06-01T00:00:00Z' WHEN id % 3 = 0 THEN '2030-01-01T00:00:00Z' ELSE '2025-06-01T00:00:00Z' END AS updated_at,
  CASE WHEN id % 5 = 0 AND id % 97 <> 3 THEN 'resolved' ELSE 'active' END AS status, id % 5 = 0 AND id % 97 <> 3 AS superseded
FROM memories WHERE id % 9 <> 0 OR id % 5 <> 0""",
    "sink_upsert": """SELECT 1 AS version, count(*) AS n, count(title) AS titles, count(*) FILTER (WHERE title = upper(title)) AS upper FROM sessions WHERE session_id IS NOT NULL AND title IS NOT NULL
UNION ALL SELECT 2, count(*), count(title), count(title) FROM sessions WHERE session_id IS NOT NULL""",
    "sink_backup": "SELECT count(*) AS n, true AS verified FROM memories",
    "sink_writer": r"""WITH t AS (SELECT DISTINCT coalesce(session_id, 'none') || '.' || CAST(CAST(floor(coalesce(exchange_number, 0) / 100) AS BIGINT) AS VARCHAR) AS f, id FROM exchanges WHERE regexp_matches(human_text, '[\p{L}\p{N}]') AND regexp_matches(agent_text, '[\p{L}\p{N}]')),
n AS (SELECT 'sessions' AS "table", count(DISTINCT f) AS n FROM t UNION ALL SELECT 'exchanges', count(*) FROM t UNION ALL SELECT * FROM (VALUES ('tool_uses', 0), ('thinking_blocks', 0), ('memories', 0)))
SELECT r.run, "table", CASE WHEN r.run = 1 THEN 0 ELSE n END AS before, n AS after FROM n, (VALUES (1), (2)) r(run)""",
    "session_refresh": "SELECT CASE WHEN ascii(right(session_id, 1)) % 2 = 0 AND ascii(right(session_id, 1)) % 3 <> 0 THEN 'fresh' ELSE coalesce(project, 'fresh') END AS project, coalesce(CASE WHEN trim(title, ' ') <> '' THEN title END, 'fresh title') = 'fresh title' AS new_title, count(*) AS n FROM sessions GROUP BY 1, 2",
    "match_outcomes": _match_sql(),
    "turn_texts": f"""WITH r AS (SELECT conversation_uuid, ingested_at, uuid, text, {_ROLE} AS role, {_TS.format('created_at')} // 1000 AS made FROM chat_messages),
t AS (SELECT *, sum(CASE WHEN role = 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_uuid ORDER BY ingested_at, uuid ROWS UNBOUNDED PRECEDING) AS turn FROM r)
SELECT conversation_uuid, CAST(turn AS BIGINT) AS turn, max(text) FILTER (WHERE role = 'human') AS human_text, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant' AND trim(text, ' ') <> ''), 0) + greatest(count(*) FILTER (WHERE role = 'assistant' AND trim(text, ' ') <> '') - 1, 0) AS INT) AS answer_length,
  greatest(min(made) FILTER (WHERE role = 'assistant') - max(made) FILTER (WHERE role = 'human'), 0) AS latency_ms FROM t WHERE turn > 0 GROUP BY 1, 2""",
    "archive_memberships": "SELECT CASE WHEN id % 3 = 0 THEN 'old' ELSE 'core' END AS source_database, id AS source_row_id, sha256(content) AS version_digest, min(layer) OVER (PARTITION BY content) AS layer, length(content) AS size FROM memories WHERE content IS NOT NULL",
    "archive_heads": "WITH m AS (SELECT id, sha256(content) AS v, min(layer) OVER (PARTITION BY content) AS layer FROM memories WHERE content IS NOT NULL), h AS (SELECT layer, max(v) AS head FROM m WHERE layer NOT LIKE 'd%' GROUP BY 1) SELECT id AS source_row_id, head = v AS is_selected FROM m LEFT JOIN h USING (layer)",
    "archive_hub": "SELECT id, layer, content, CASE WHEN id % 10 = 5 THEN 'import' END AS provenance FROM memories WHERE id % 3 <> 0",
    "first_owner": "SELECT session_id, exchange_number, 'm' || min(id) AS source FROM exchanges WHERE session_id IS NOT NULL AND exchange_number IS NOT NULL GROUP BY 1, 2",
    "health_checks": _HEALTH,
    "health_verdict": f"SELECT CASE max(CASE verdict WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS verdict FROM ({_HEALTH})",
    "layer_resolve": "SELECT l.name, coalesce(b.name, a.name, l.name) AS resolved FROM layers l LEFT JOIN layers a ON a.name = l.alias_of LEFT JOIN layers b ON b.name = a.alias_of",
    "layer_migrate": "SELECT coalesce(l.alias_of, m.layer) AS layer, count(*) AS n FROM memories m LEFT JOIN layers l ON l.name = m.layer GROUP BY 1",
    "store_new_memories": "SELECT DISTINCT doc_kind AS layer, text AS content, CAST(NULL AS VARCHAR) AS project FROM documents EXCEPT SELECT layer, content, project FROM memories",
    "expiry_drain": "SELECT status, count(*) AS n FROM memories WHERE NOT coalesce(try_cast(created_at AS TIMESTAMPTZ) <= TIMESTAMPTZ '2025-07-01 00:00:00+00', false) GROUP BY status",
    "archive_versions": f"SELECT sources, n, count(*) AS versions FROM (SELECT count(DISTINCT s) AS sources, count(*) AS n FROM (SELECT {_P}, 'a' AS s FROM exchanges WHERE id % 3 <> 0 UNION ALL SELECT {_P}, 'b' FROM exchanges WHERE id % 3 <> 1) GROUP BY {_P}) GROUP BY 1, 2",
    "archive_ordinals": "SELECT id, row_number() OVER (PARTITION BY session_id, human_text, agent_text ORDER BY id) - 1 AS ordinal FROM exchanges",
    "custody_expectation": "SELECT CAST(sum(n) AS BIGINT) AS expected, count(*) AS distinct_rows FROM (SELECT layer, content, max(n) AS n FROM (SELECT layer, content, count(*) AS n FROM memories WHERE id % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT layer, content, count(*) FROM memories WHERE id % 3 <> 1 GROUP BY 1, 2 UNION ALL SELECT layer, content, count(*) FROM memories WHERE id % 2 = 0 GROUP BY 1, 2) GROUP BY 1, 2)",
    "custody_union": "SELECT layer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT layer, content, max(n) AS n FROM (SELECT layer, content, count(*) AS n FROM memories WHERE id % 3 <> 0 GROUP BY 1, 2 UNION ALL SELECT layer, content, count(*) FROM memories WHERE id % 3 <> 1 GROUP BY 1, 2 UNION ALL SELECT layer, content, count(*) FROM memories WHERE id % 2 = 0 GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY layer",
    "custody_drift": "WITH a AS (SELECT id, layer, content FROM memories WHERE id % 11 <> 0), b AS (SELECT id, layer, CASE WHEN id % 5 = 0 THEN upper(content) ELSE content END AS content FROM memories WHERE id % 7 <> 0) SELECT CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'deleted' WHEN a.layer IS NOT DISTINCT FROM b.layer AND a.content IS NOT DISTINCT FROM b.content THEN 'same' ELSE 'changed' END AS action, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1",
    "reconcile_coverage": "WITH s AS (SELECT DISTINCT session_id, exchange_number FROM tool_uses WHERE session_id IS NOT NULL AND exchange_number IS NOT NULL), e AS (SELECT DISTINCT session_id, exchange_number FROM exchanges) SELECT s.session_id, count(*) AS source_rows, count(e.session_id) AS archived, count(*) - count(e.session_id) AS missing, round(100.0 * count(e.session_id) / count(*), 2) AS percent FROM s LEFT JOIN e ON e.session_id = s.session_id AND e.exchange_number = s.exchange_number GROUP BY 1",
    "session_inventory": "SELECT session_id, count(*) AS n, count(DISTINCT (human_text, agent_text)) AS distinct_rows FROM exchanges GROUP BY 1",
    "shadow_compare": "SELECT tool_name, had_error, 'left' AS side, count(*) AS n FROM (SELECT tool_name, had_error FROM tool_uses EXCEPT ALL SELECT tool_name, had_error FROM tool_uses WHERE had_error = 0 OR tool_name <> 'Bash') GROUP BY 1, 2",
    "handoff_latest": "SELECT project, id FROM memories WHERE layer = 'handoff' AND project IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project ORDER BY created_at DESC NULLS LAST, id DESC) = 1",
    "latest_journey": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "gate_dependency": "SELECT user_id, event_type = 'signup' AS may_run FROM events WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "recent_failures": "SELECT tool_name, error_message, count(*) AS n FROM tool_uses WHERE had_error = 1 GROUP BY 1, 2 ORDER BY n DESC, tool_name NULLS FIRST, error_message NULLS FIRST LIMIT 10",
    "retention_cut": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "turn_pairing": f"SELECT conversation_uuid, CAST(max(turn) AS BIGINT) AS turns, count(*) FILTER (WHERE turn = 0) AS before_first FROM (SELECT *, sum(CASE WHEN {_ROLE} = 'human' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_uuid ORDER BY ingested_at, uuid ROWS UNBOUNDED PRECEDING) AS turn FROM chat_messages) GROUP BY 1",
    "session_spans": f"SELECT session_id, min({_TS.format('human_timestamp')}) AS started, max({_TS.format('agent_timestamp')}) AS ended, greatest(CAST(floor((max({_TS.format('agent_timestamp')}) - min({_TS.format('human_timestamp')})) / 60000000) AS BIGINT), 0) AS minutes FROM exchanges WHERE session_id IS NOT NULL GROUP BY 1",
    "usage_tally_nullable": "SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(tokens_reasoning) AS BIGINT) AS tokens_reasoning, round(sum(cost_usd), 6) AS cost_usd FROM exchanges GROUP BY 1",
    "thinking_position": "SELECT id, round(exchange_number / max(exchange_number) OVER (PARTITION BY session_id), 6) AS position FROM exchanges WHERE tokens_reasoning IS NOT NULL AND agent_text IS NOT NULL",
    "interval_join_nearest_30s": f"WITH r AS (SELECT id, session_id, {_TS.format('human_timestamp')} AS a, {_TS.format('agent_timestamp')} AS b FROM exchanges WHERE session_id IS NOT NULL), n AS (SELECT l.id AS left_id, r.id AS right_id, r.b - l.a AS gap, min(r.b - l.a) OVER (PARTITION BY l.id) AS least FROM r l JOIN r ON r.session_id = l.session_id AND r.b - l.a BETWEEN 0 AND 30000000) SELECT left_id, min(right_id) AS right_id, round(min(gap) / 1000000, 3) AS gap_seconds FROM n WHERE gap = least GROUP BY left_id HAVING count(*) = 1",
    "span_range_join": f"WITH p AS (SELECT session_id, min({_TS.format('human_timestamp')}) AS o, max({_TS.format('agent_timestamp')}) AS c FROM exchanges WHERE session_id IS NOT NULL GROUP BY 1) SELECT t.session_id, count(*) AS n FROM tool_uses t JOIN p ON p.session_id = t.session_id AND epoch_us(t.ingested_at) > p.o AND epoch_us(t.ingested_at) <= p.c GROUP BY 1",
    "fresh_numbering": "WITH t AS (SELECT session_id, max(exchange_number) AS top FROM exchanges GROUP BY 1) SELECT id, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY e.session_id ORDER BY id) AS BIGINT) AS number FROM exchanges e JOIN t ON t.session_id = e.session_id WHERE exchange_number IS NULL",
    "enrich_richer_signal": "WITH r AS (SELECT id, model AS om, provider AS op, CASE WHEN id % 3 = 0 THEN NULL ELSE tokens_in END AS ot, CASE WHEN id % 4 = 0 THEN NULL ELSE 'new' END AS nm, provider AS np, tokens_in AS nt FROM exchanges), c AS (SELECT *, (nm IS NOT NULL)::INT + (np IS NOT NULL)::INT + (nt IS NOT NULL)::INT > (om IS NOT NULL)::INT + (op IS NOT NULL)::INT + (ot IS NOT NULL)::INT AS richer FROM r) SELECT id, CASE WHEN richer THEN coalesce(nm, om) ELSE coalesce(om, nm) END AS model, CASE WHEN richer THEN coalesce(nt, ot) ELSE coalesce(ot, nt) END AS tokens_in FROM c",
    "tree_reparent": """
WITH RECURSIVE m AS (SELECT DISTINCT conversation_uuid AS c, uuid AS u, nullif(trim(parent_message_uuid), '') AS p, trim(coalesce(text, '')) <> '' AS shown FROM chat_messages),
l AS (SELECT m.c, m.u, m.shown, q.u AS p FROM m LEFT JOIN m q ON q.c = m.c AND q.u = m.p),
w AS (SELECT c, u, shown, CAST(NULL AS VARCHAR) AS near FROM l WHERE p IS NULL UNION ALL SELECT l.c, l.u, l.shown, CASE WHEN w.shown THEN w.u ELSE w.near END FROM l JOIN w ON l.c = w.c AND l.p = w.u)
SELECT u AS node, near AS parent FROM w WHERE shown""",
    "prune_snapshot": "WITH r AS (SELECT * FROM exchanges WHERE session_id IS NOT NULL), c AS (SELECT DISTINCT session_id FROM r WHERE exchange_number <= 10) SELECT session_id, count(*) AS n FROM r WHERE exchange_number <= 10 OR session_id NOT IN (SELECT session_id FROM c) GROUP BY 1",
    "missing_tool_uses": "SELECT id FROM tool_uses a WHERE NOT EXISTS (SELECT 1 FROM tool_uses b WHERE b.id % 3 = 0 AND a.session_id IS NOT DISTINCT FROM b.session_id AND a.exchange_number IS NOT DISTINCT FROM b.exchange_number AND a.tool_name IS NOT DISTINCT FROM b.tool_name AND a.tool_params_summary IS NOT DISTINCT FROM b.tool_params_summary AND a.had_error IS NOT DISTINCT FROM b.had_error)",
    "source_coverage": "WITH a AS (SELECT DISTINCT conversation_uuid AS k FROM chat_messages), b AS (SELECT DISTINCT uuid AS k FROM conversations) SELECT substr(coalesce(a.k, b.k), 1, 1) AS shard, count(a.k) AS source, count(b.k) AS landed, count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS extra FROM a FULL JOIN b ON a.k = b.k GROUP BY 1",
    "support_snapshot": " UNION ALL ".join(f"SELECT '{n}' AS family, count(*) AS n, epoch_us(max(ingested_at)) AS newest FROM {n}" for n in ("exchanges", "tool_uses", "memories", "documents", "chat_messages")),
    "late_arrivals": f"SELECT id FROM exchanges WHERE epoch_us(ingested_at) - {_TS.format('human_timestamp')} > 86400000000",
    "upsert_actions": "WITH o AS (SELECT id, content, project, created_at AS u FROM memories WHERE id % 9 <> 0), n AS (SELECT id, CASE WHEN id % 4 = 0 THEN content || '!' ELSE content END AS content, project, CASE WHEN id % 3 = 0 THEN '2030-01-01T00:00:00Z' WHEN id % 7 = 0 THEN '2001-01-01T00:00:00Z' ELSE created_at END AS u FROM memories WHERE id % 5 <> 0), b AS (SELECT o.id AS oi, n.id AS ni, o.content IS NOT DISTINCT FROM n.content AS same, coalesce(try_cast(n.u AS TIMESTAMPTZ) > try_cast(o.u AS TIMESTAMPTZ), o.u IS NULL) AS newer, o.project AS op, n.project AS np, n.u AS nu FROM o FULL JOIN n ON o.id = n.id) SELECT CASE WHEN oi IS NULL THEN 'insert' WHEN ni IS NULL THEN 'resolve' WHEN same AND op IS NULL AND np IS NOT NULL THEN 'project' WHEN same AND newer AND nu IS NOT NULL THEN 'stamp' WHEN same THEN 'unchanged' WHEN newer THEN 'update' ELSE 'stale' END AS action, count(*) AS n FROM b GROUP BY 1",
}
