"""Problem 6: defective question and answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.pairs import defective_pairs, fit_terminal_model
from threadloom.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "exchanges").select("id", "human_text", "agent_text")
    model = fit_terminal_model(pairs, "agent_text")
    return defective_pairs(pairs, "id", "human_text", "agent_text", model).select(F.col("id").alias("exchange_id"), "defect")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Defects by model of the answer."""
    models = table(spark, d, "exchanges").select(F.col("id").alias("exchange_id"), "model")
    return p6_found(spark, d).join(models, "exchange_id").groupBy("model", "defect").agg(F.count("*").alias("pairs"))


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
ORACLES: dict[str, str] = {}
