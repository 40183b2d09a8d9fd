"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import HOT_ROWS, join_unique
from threadloom.session import checkpoint


def _star(edges: DataFrame, total: int, large: bool, hot_rows: int) -> DataFrame:
    """One step. The minimum of each neighbourhood is a combinable aggregate; no neighbour list is collected."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    moved = around.filter("b > a") if large else around
    linked = join_unique(moved, least, "a", "n", 2 * total, hot_rows=hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def connected_components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``edges(a bigint, b bigint)`` to ``(node bigint, component bigint)``.

    component is the smallest node id of the component. Null ends and self-loops carry no link and
    are ignored, repeated edges count once, an empty input gives an empty result.
    """
    current = checkpoint(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    mark = None
    while True:
        total, digest = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if total == 0 or (total, digest) == mark:
            break
        mark = (total, digest)
        current = checkpoint(_star(_star(current, total, True, hot_rows), total, False, hot_rows), in_loop=True)
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
