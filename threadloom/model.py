"""The archive's normalized tables over the driver's files, and the views that queries see."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import table

#: Tables of the archive that are read as they are.
STORED = ("sessions", "exchanges", "tool_uses", "memories", "layers", "conversations", "chat_messages", "documents", "embeddings", "events", "raw_records", "eval_items")
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# The layers every archive starts with, their aliases and those kept out of search.
LAYER_ALIASES = {"handover": "handoff", "protocol": "pattern"}
SEARCH_EXCLUDED = ("question", "review", "issue")

EXCHANGE = T.StructType(
    [T.StructField(n, t) for n, t in (("number", T.IntegerType()), ("source_id", T.StringType()), ("is_after_compaction", T.IntegerType()), ("human_text", T.StringType()), ("agent_text", T.StringType()), ("human_timestamp", T.StringType()), ("agent_timestamp", T.StringType()), ("response_latency_ms", T.LongType()), ("model", T.StringType()), ("provider", T.StringType()), ("tokens_in", T.LongType()), ("tokens_out", T.LongType()), ("tokens_reasoning", T.LongType()), ("cost_usd", T.DoubleType()))]
)
SESSION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("session_id", "source_agent", "project", "started_at", "ended_at")]
    + [T.StructField("duration_minutes", T.LongType()), T.StructField("title", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("source_surface", T.StringType())]
)
MEMORY = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "layer", "content", "metadata", "origin", "source_agent", "source_model", "source_surface", "project", "status", "created_at")])
DISCARD = T.StructType([T.StructField("record", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("by_design", T.BooleanType())])


def thinking_blocks(exchanges: DataFrame) -> DataFrame:
    """Reasoning text of answers whose model reported reasoning tokens, with its position in the session."""
    held = exchanges.filter("tokens_reasoning IS NOT NULL AND agent_text IS NOT NULL")
    size = held.groupBy(F.col("session_id").alias("of")).agg(F.max("exchange_number").alias("last"))
    return held.join(size, F.col("session_id").eqNullSafe(F.col("of")), "left").select(
        "id", "session_id", "exchange_number", (F.col("exchange_number") / F.col("last")).alias("position_in_session"), F.lit("normal").alias("depth"),
        F.size(F.split(F.trim("agent_text"), r"\s+")).alias("word_count"), "is_after_compaction", F.col("agent_text").alias("full_text"),
    )


def current(memories: DataFrame) -> DataFrame:
    """Memories that no other memory replaces; the row pointed at is the one that goes."""
    replaced = memories.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct()
    return memories.join(replaced, "id", "left_anti")


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table by the name a query uses, search tables included. Views hold plans, nothing is read here."""
    found = {name: table(spark, sf_dir, name) for name in (*STORED, *STAR) if os.path.exists(f"{sf_dir}/{name}.parquet")}
    if "exchanges" in found:
        found["thinking_blocks"] = thinking_blocks(found["exchanges"])
        found["exchanges_fts"] = found["exchanges"].select("id", "human_text", "agent_text")
        found["thinking_fts"] = found["thinking_blocks"].select("id", "full_text")
    if "memories" in found:
        found["memories_fts"] = found["memories"].select("id", "content")
    if "sessions" in found:
        found["sessions_fts"] = found["sessions"].select("session_id", "title", "project")
    return found
