"""Problem 7: transcript lines and sidecars whose schema drifts from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.schema_drift import drift_report, unified
from threadloom.session import checkpoint, table


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines with the identity that a record keeps when it is written again: uuid or id."""
    key = F.when(F.col("kind") == "claude_line", F.get_json_object("payload", "$.uuid")).otherwise(F.get_json_object("payload", "$.id"))
    return table(spark, d, "raw_records").withColumn("key", key)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return drift_report(raw_records(spark, d))


def _unified(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        records = raw_records(spark, d)
        return unified(records, checkpoint(drift_report(records.filter(F.col("kind") == kind))), kind)

    return run


QUERIES = {"p7_found": p7_found, "p7_unified_lines": _unified("claude_line"), "p7_unified_sidecars": _unified("cursor_sidecar")}
ORACLES: dict[str, str] = {}
