"""Problem 10: junk pages among the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.spam import junk_pages
from threadloom.session import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return junk_pages(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


QUERIES = {"p10_found": p10_found}
ORACLES: dict[str, str] = {}
