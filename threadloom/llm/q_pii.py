"""Problem 2: people in questions, answers and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.pii import collisions, entity_mentions, pii_spans, redact, with_surrogates
from threadloom.session import checkpoint, table

FIELDS = (("exchanges", "human_text"), ("exchanges", "agent_text"), ("memories", "content"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, row_id, field_name, text) of the three fields that mention people."""
    parts = [table(spark, d, t).select(F.lit(t).alias("src"), F.col("id").alias("row_id"), F.lit(c).alias("field_name"), F.col(c).alias("text")) for t, c in FIELDS]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [pii_spans(table(spark, d, t), "id", c).withColumn("src", F.lit(t)).withColumn("field_name", F.lit(c)) for t, c in FIELDS]
    return reduce(DataFrame.unionByName, parts).select("src", "row_id", "field_name", "pii_type", "pii_text").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    return redact(texts(spark, d), "text", "text")


def p2_surrogates(spark: SparkSession, d: str, secret: str = "change this key") -> DataFrame:
    """The texts with mentions, each entity under one keyed stand-in throughout the archive."""
    return with_surrogates(texts(spark, d), ["src", "row_id", "field_name"], "text", secret)


def p2_collisions(spark: SparkSession, d: str, secret: str = "change this key") -> DataFrame:
    """Stand-ins of all entities that two of them would share as written: none."""
    return collisions(checkpoint(entity_mentions(texts(spark, d), ["src", "row_id", "field_name"], "text")), secret)


QUERIES = {"p2_found": p2_found, "p2_collisions": p2_collisions, "p2_redacted": p2_redacted, "p2_surrogates": p2_surrogates}
ORACLES: dict[str, str] = {}
