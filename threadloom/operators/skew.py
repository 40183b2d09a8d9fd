"""Joins and groupings that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.session import checkpoint

#: Below this many rows a key cannot overload a task, so no key is treated as hot.
HOT_ROWS = 1_000_000
#: At most this many keys can be hot at once: a hot key holds more than 1/HOT_KEYS of the rows.
HOT_KEYS = 1_000


def hot_threshold(total_rows: int, hot_rows: int = HOT_ROWS) -> int:
    """Rows from which a key is hot. By pigeonhole at most HOT_KEYS keys lie above it."""
    return max(hot_rows, total_rows // HOT_KEYS)


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str, total_rows: int, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` with ``right``, which has one row for each ``key`` and, in ``count``, how often ``left`` holds it.

    Hot keys (at most HOT_KEYS, see ``hot_threshold``) are joined by broadcast, so their left rows
    stay where they are; all other keys take the ordinary shuffle join. ``count`` is dropped.
    Null keys match nothing; with ``how='left'`` their rows are kept.
    """
    limit = hot_threshold(total_rows, hot_rows)
    if total_rows <= limit:
        return left.join(right.drop(count), key, how)
    hot = right.filter(F.col(count) > limit).drop(count)
    hot_keys = hot.select(key)
    in_hot = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot_keys), key, "left_anti")
    return in_hot.unionByName(rest.join(right.filter(F.col(count) <= limit).drop(count), key, how))


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column | int, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the group up to this one, in ``order``.

    A group of any size is spread: rows are range-partitioned by group and order, summed within the partition,
    and the sums of the group's earlier partitions are added. Rows equal in ``order`` take any order among
    themselves. Null groups are one group; an empty table gives an empty result.
    """
    tie = "__tie"
    parted = df.withColumn(tie, F.monotonically_increasing_id()).withColumn("__v", (F.lit(value) if isinstance(value, int) else value).cast("bigint"))
    keys = [*by, *order, tie]
    placed = checkpoint(parted.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))  # the ranges come from a sample: they must hold still
    own = W.partitionBy("__p", *by).orderBy(*order, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = placed.groupBy("__p", *by).agg(F.sum("__v").alias("__s"))
    before = W.partitionBy(*by).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)  # as many rows as a group has partitions
    offsets = sums.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before")).filter("__before <> 0")
    same = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    summed = placed.withColumn("__own", F.sum("__v").over(own)).join(offsets, same, "left")
    return summed.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1; see ``running_sum``."""
    return running_sum(df, by, order, 1, name)
