"""Problem 4: credentials in answers and tool parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.secrets import redact, secret_spans
from threadloom.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    answers = secret_spans(table(spark, d, "exchanges"), "id", "agent_text").withColumn("src", F.lit("exchanges"))
    tools = secret_spans(table(spark, d, "tool_uses"), "id", "tool_params_summary").withColumn("src", F.lit("tool_uses"))
    return answers.unionByName(tools).select("src", "row_id", "secret_text")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every answer and tool parameter with its credentials blanked; the rest of the text is untouched."""
    answers = redact(table(spark, d, "exchanges").select(F.col("id").alias("row_id"), F.col("agent_text").alias("text")), "text", "redacted")
    tools = redact(table(spark, d, "tool_uses").select(F.col("id").alias("row_id"), F.col("tool_params_summary").alias("text")), "text", "redacted")
    return answers.withColumn("src", F.lit("exchanges")).unionByName(tools.withColumn("src", F.lit("tool_uses"))).select("src", "row_id", "redacted")


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted}
ORACLES: dict[str, str] = {}
