"""Row identity: dense ids, alignment by key, and set operations on ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.session import cut_lineage

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_ids(df: DataFrame, order: str | Sequence[str], name: str = "dense_id") -> DataFrame:
    """Number the rows 0..n-1 in key order.

    The table is range-partitioned and sorted once, written, and numbered from
    the per-partition counts.  Writing first keeps the partition boundaries (a
    sample of the keys) stable when a task is repeated; no window and no single
    task ever sees the whole table.
    """
    order = [order] if isinstance(order, str) else list(order)
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    part = F.spark_partition_id()
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("part")).count().collect()}
    starts, start = [], 0
    for index in range(max(sizes, default=-1) + 1):
        starts.append(start)
        start += sizes.get(index, 0)
    if not starts:
        return placed.withColumn(name, F.lit(0).cast("bigint"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    base = F.lit(starts)[part]
    return placed.withColumn(name, (base + within).cast("bigint"))


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put the columns of two tables side by side where their keys agree."""
    return left.join(right, key)


def ids_except(ids: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return ids.join(removed.select(key), key, "left_anti")


def ids_in(ids: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return ids.join(members.select(key), key, "left_semi")


def stack_rows(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first
