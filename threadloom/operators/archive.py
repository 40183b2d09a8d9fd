"""Views over an archive of versions: which source row became which version, which version is selected, and the old tables again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import join_unique

KEYS = ["source_database", "source_table", "source_key"]


def memberships(custody: DataFrame, evidence: DataFrame, versions: DataFrame, destination: str) -> DataFrame:
    """Every source row with its evidence and the version that holds it.

    ``custody(*KEYS, destination_table, destination_key)``, ``evidence(*KEYS, ...)``, ``versions(version_digest, ...)``. A version
    that a third of all rows share is joined without bringing them together. Rows without evidence or version are left out.
    """
    own = custody.filter(F.col("destination_table") == destination).select(*KEYS, F.col("destination_key").alias("version_digest"))
    shown = own.join(evidence, KEYS)
    held = versions.join(own.groupBy("version_digest").agg(F.count("*").alias("__n")), "version_digest")
    return join_unique(shown, held, "version_digest", "__n", own.count())


def with_heads(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``is_selected``: whether their version is the head of ``key``, null where that has no head."""
    head = heads.select(key, F.col("version_digest").alias("__head"))
    return rows.join(head, key, "left").withColumn("is_selected", F.col("__head") == F.col("version_digest")).drop("__head")


def compatible(custody: DataFrame, records: DataFrame, provenance: DataFrame, destination: str) -> DataFrame:
    """Records under the ids of their sources, with provenance where it is known. Keys that are no numbers match nothing."""
    own = custody.filter(F.col("destination_table") == destination).select("source_database", "source_key", F.try_to_number("destination_key", F.lit("99999999999999999999")).cast("bigint").alias("physical_id"))
    rows = own.join(records.withColumnRenamed("id", "physical_id"), "physical_id").join(provenance, ["source_database", "source_key"], "left")
    return rows.withColumn("id", F.expr("try_cast(source_key AS BIGINT)")).drop("source_key")


def hub_tables(views: dict[str, tuple[DataFrame, dict[str, str]]], source: str = "core") -> dict[str, DataFrame]:
    """The old tables of one source database again: each view cut to the source, its columns under their old names."""
    return {name: frame.filter(F.col("source_database") == source).select(*[F.col(c).alias(old) for old, c in columns.items()]) for name, (frame, columns) in views.items()}


def first_owners(assigned: DataFrame, group: list[str], number: str, source: str, order: str) -> DataFrame:
    """Of several sources that were given one number the first in ``order`` keeps it; the others are unknown again. Null and empty sources own nothing."""
    known = assigned.filter(F.coalesce(F.col(source), F.lit("")) != "")
    return known.groupBy(*group, number).agg(F.min_by(source, F.struct(order, source)).alias(source))
