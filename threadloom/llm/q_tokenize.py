"""Problem 8: ids of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.tokenize import encode_column
from threadloom.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and documents by language and kind, over all documents."""
    ids = p8_ids(spark, d).select("doc_id", F.size("ids").alias("n"))
    return table(spark, d, "documents").select("doc_id", "lang", "doc_kind").join(ids, "doc_id").groupBy("lang", "doc_kind").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_lengths": p8_lengths}
ORACLES: dict[str, str] = {}
