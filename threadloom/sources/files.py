"""Files of agents as a distributed scan: plan, fingerprints, parsing, and records as tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.parsers import KINDS, kind_of
from threadloom.sources.records import Artefact, Records

#: Counts up when parsers change, so that unchanged files are read again.
PARSER_VERSION = "1"
# Paths that are never read, with the reason.
EXCLUSIONS = ((r"/node_modules/|/\.git/", "dependency or repository internals"), (r"\.(?:lock|tmp|swp|bak)$", "temporary file"), (r"/(?:cache|logs?)/", "cache or log"), (r"\.(?:png|jpe?g|gif|zip|gz|exe|so)$", "binary file"))
# Beginnings of agent names and the surface that they belong to.
SURFACES = (("claude-web", "web"), ("chatgpt", "web"), ("claude", "cli"), ("codex", "cli"), ("cursor-ide", "ide"), ("cursor", "cli"), ("opencode", "cli"), ("qwen", "cli"), ("grok", "cli"), ("hermes", "chat"), ("pi", "cli"), ("glm", "cli"), ("cowork", "desktop"))

_TURN = "number int, human_text string, agent_text string, human_timestamp string, agent_timestamp string, source_id string, model string, provider string, tokens_in bigint, tokens_out bigint, tokens_reasoning bigint, response_latency_ms bigint, is_after_compaction int, signal int"
_RECORDS = (
    "path string, kind string, fingerprint string, error string,"
    f"sessions array<struct<session_id:string,source_agent:string,project:string,title:string,started_at:string,ended_at:string,metadata:string,turns:array<struct<{', '.join(p.replace(' ', ':') for p in _TURN.split(', '))},tools:array<struct<tool_name:string,params:string,had_error:int,error_message:string>>,thinking:array<string>>>>>,"
    "memories array<struct<source_id:string,layer:string,content:string,source_agent:string,project:string,created_at:string,metadata:string>>, discards array<struct<record:string,reason:string,by_design:boolean>>, deferred array<string>"
)


def exclusion_reason(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(EXCLUSIONS):
        out = F.when(path.rlike(pattern), reason).otherwise(out)
    return out


def surface_of(agent: Column | str) -> Column:
    """The surface of an agent by the beginning of its name, null for unknown agents."""
    agent = F.col(agent) if isinstance(agent, str) else agent
    out = F.lit(None).cast("string")
    for prefix, surface in reversed(SURFACES):
        out = F.when(agent.startswith(prefix), surface).otherwise(out)
    return out


def scan_plan(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with size, time and the reason if it is left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime").withColumn("excluded", exclusion_reason("path"))


def fingerprint(length: int, modified: str, content: bytes) -> str:
    return f"{length}:{modified}:{hashlib.sha256(content).hexdigest()}:{PARSER_VERSION}"


def _as_dict(records: Records) -> dict:
    return {
        "sessions": [
            {"session_id": s.session_id, "source_agent": s.source_agent, "project": s.project, "title": s.title, "started_at": s.started_at, "ended_at": s.ended_at, "metadata": json.dumps(s.metadata),
             "turns": [{"number": n, "human_text": t.human_text, "agent_text": t.agent_text, "human_timestamp": t.human_timestamp, "agent_timestamp": t.agent_timestamp, "source_id": t.source_id, "model": t.model, "provider": t.provider, "tokens_in": t.tokens_in, "tokens_out": t.tokens_out, "tokens_reasoning": t.tokens_reasoning, "response_latency_ms": t.latency_ms, "is_after_compaction": int(t.is_after_compaction), "signal": t.signal,
                        "tools": [c | {"had_error": int(c["had_error"])} for c in t.tools], "thinking": t.thinking} for n, t in enumerate(s.turns, 1)]}
            for s in records.sessions
        ],
        "memories": [{"source_id": m.source_id, "layer": m.layer, "content": m.content, "source_agent": m.source_agent, "project": m.project, "created_at": m.created_at, "metadata": json.dumps(m.metadata)} for m in records.memories],
        "discards": [{"record": r, "reason": w, "by_design": b} for r, w, b in records.discards],
        "deferred": records.deferred,
    }


def parse_files(files: DataFrame) -> DataFrame:
    """One nested row of records for each file of a ``binaryFile`` read; a file that fails has ``error`` and no records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "kind", "fingerprint", "error", "sessions", "memories", "discards", "deferred"]
        for batch in batches:
            out = []
            for path, length, modified, content in zip(batch["path"], batch["length"], batch["modified"], batch["content"]):
                content = bytes(content or b"")
                row = {"path": path, "kind": None, "fingerprint": fingerprint(length, modified, content), "error": None} | _as_dict(Records())
                try:
                    kind = kind_of(path, content)
                    if kind is None:
                        row["error"] = "no parser claims this file"
                    else:
                        row |= {"kind": kind.name} | _as_dict(kind.parse(Artefact(path, content)))
                except Exception as error:  # noqa: BLE001 - one broken file must not end the scan
                    row["error"] = f"{type(error).__name__}: {error}"[:500]
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "length", F.col("modificationTime").cast("string").alias("modified"), "content").mapInPandas(run, _RECORDS)


def read_files(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Files below ``root`` that may be read, as bytes; ``known`` (path, length, modificationTime) leaves out unchanged ones before reading."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(exclusion_reason("path").isNull())
    if known is not None:
        files = files.join(known.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")
    return files


def session_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("sessions").alias("s")).select("path", *[f"s.{c}" for c in ("session_id", "source_agent", "project", "title", "started_at", "ended_at", "metadata")]).withColumn("source_surface", surface_of("source_agent"))


def exchange_rows(parsed: DataFrame) -> DataFrame:
    turns = parsed.select(F.explode("sessions").alias("s")).select("s.session_id", F.explode("s.turns").alias("t"))
    return turns.select("session_id", F.col("t.number").alias("exchange_number"), *[f"t.{c.split()[0]}" for c in _TURN.split(", ")[1:]])


def tool_rows(parsed: DataFrame) -> DataFrame:
    turns = parsed.select(F.explode("sessions").alias("s")).select("s.session_id", F.explode("s.turns").alias("t"))
    return turns.select("session_id", F.col("t.number").alias("exchange_number"), F.explode("t.tools").alias("c")).select("session_id", "exchange_number", "c.tool_name", F.col("c.params").alias("tool_params_summary"), "c.had_error", "c.error_message")


def thinking_rows(parsed: DataFrame) -> DataFrame:
    turns = parsed.select(F.explode("sessions").alias("s")).select("s.session_id", F.size("s.turns").alias("n"), F.explode("s.turns").alias("t"))
    return turns.select("session_id", F.col("t.number").alias("exchange_number"), (F.col("t.number") / F.col("n")).alias("position_in_session"), F.explode("t.thinking").alias("full_text")).withColumn("word_count", F.size(F.split(F.trim("full_text"), r"\s+")))


def memory_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("memories").alias("m")).select("path", "m.*")


def discard_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "kind", F.explode("discards").alias("d")).select("path", "kind", "d.*")


def agents_found(parsed: DataFrame) -> DataFrame:
    """Agent families with files, and those without."""
    families = parsed.sparkSession.createDataFrame([(k.name,) for k in KINDS], "kind string")
    counts = parsed.filter("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("files"))
    return families.join(counts, "kind", "left").fillna(0, ["files"])
