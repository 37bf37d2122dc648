"""Exact order statistics without a global sort.

"The k rows with the smallest hash" is turned into a row predicate: a few
histogram aggregates (at most 4096 counts each reach the driver) narrow down
the k-th smallest value, after which membership is a map-only comparison with
a literal.  No shuffle of rows, no join, and k may be any share of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions.hashing import RANK_BITS, hash_rank

LEVEL_BITS = 12
SETTLE_ROWS = 10_000


@dataclass(frozen=True)
class Cutoff:
    """The boundary of the ``taken`` smallest of ``total`` rows in (rank, key) order."""

    seed: object
    key: str
    total: int
    taken: int
    rank: int | None = None
    last_key: object = None

    def covers(self) -> Column:
        if self.taken <= 0:
            return F.lit(False)
        if self.taken >= self.total:
            return F.lit(True)
        rank = hash_rank(self.seed, self.key)
        tie = (rank == F.lit(self.rank)) & (F.col(self.key) <= F.lit(self.last_key))
        return (rank < F.lit(self.rank)) | tie


def hash_cutoff(df: DataFrame, key: str, seed, take: Callable[[int], int]) -> Cutoff:
    """Find the boundary of the ``take(n)`` rows that come first in hash order."""
    return hash_cutoffs(df, key, [seed], take)[0]


def hash_cutoffs(df: DataFrame, key: str, seeds: Sequence, take: Callable[[int], int]):
    """Boundaries for several seeds; each level is one grouped count for all of them."""
    ranks = [F.struct(F.lit(i).alias("s"), hash_rank(seed, key).alias("rank"))
             for i, seed in enumerate(seeds)]
    keyed = df.select(F.col(key).alias("key"), F.inline(F.array(*ranks)))
    shift, total = RANK_BITS - LEVEL_BITS, None
    before, chosen, open_seeds = dict.fromkeys(range(len(seeds)), 0), {}, set(range(len(seeds)))
    scope = keyed
    while open_seeds:
        counts = sorted(tuple(r) for r in scope.groupBy(
            "s", F.shiftright("rank", shift).alias("b")).count().collect())
        if total is None:
            total = sum(c for s, _, c in counts if s == 0)
            wanted = min(max(int(take(total)), 0), total)
            if wanted in (0, total):
                return [Cutoff(seed, key, total, wanted) for seed in seeds]
        sizes = {}
        for s, bucket, count in counts:
            if s in sizes or s not in open_seeds:
                continue
            if before[s] + count >= wanted:
                chosen[s], sizes[s] = (shift, bucket), count
            else:
                before[s] += count
        open_seeds = {s for s in open_seeds if sizes[s] > SETTLE_ROWS}
        if open_seeds and shift == 0:
            raise ValueError(f"{key} does not identify rows: too many share one hash")
        shift -= LEVEL_BITS
        scope = keyed.filter(_inside(chosen, open_seeds)) if open_seeds else scope
    # at most SETTLE_ROWS rows per seed are left to sort
    order = Window.partitionBy("s").orderBy("rank", "key")
    ready = keyed.filter(_inside(chosen, range(len(seeds)))).withColumn(
        "nth", F.row_number().over(order))
    hit = reduce(Column.__or__, [(F.col("s") == s) & (F.col("nth") == wanted - before[s])
                                 for s in chosen])
    edges = {r["s"]: r for r in ready.filter(hit).select("s", "rank", "key").collect()}
    return [Cutoff(seed, key, total, wanted, edges[i]["rank"], edges[i]["key"])
            for i, seed in enumerate(seeds)]


def _inside(chosen: dict, members) -> Column:
    """Rows of the chosen hash bucket of each seed."""
    return reduce(Column.__or__, [
        (F.col("s") == s) & (F.shiftright("rank", chosen[s][0]) == F.lit(chosen[s][1]))
        for s in members])


def exact_quantiles(df: DataFrame, column: str, ranks: Callable[[int], list[int]],
                    slots: int = 4096) -> list[float]:
    """Values at 0-based ranks of the values of a numeric column; NULL and NaN are none.

    The value range holding a rank is split into ``slots`` equal parts and
    counted until it holds a single value or few enough rows to sort.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v"))
    head = values.agg(F.count("v"), F.min("v"), F.max("v")).collect()[0]
    found = []
    if not head[0]:
        raise ValueError(f"{column} has no values")
    for rank in ranks(head[0]):
        low, high, before = head[1], head[2], 0
        inside = head[0]
        scope = values
        while low < high and inside > SETTLE_ROWS:
            if math.isinf(low) or math.isinf(high):
                # count the infinities apart and go on with the finite values
                below, finite, least, most = scope.agg(
                    F.count_if(F.col("v") == float("-inf")), F.count_if(F.abs("v") < float("inf")),
                    F.min(F.when(F.col("v") > float("-inf"), F.col("v"))),
                    F.max(F.when(F.col("v") < float("inf"), F.col("v")))).collect()[0]
                if rank < before + below:
                    high = low
                elif rank >= before + below + finite:
                    low = high
                else:
                    before, inside, low, high = before + below, finite, least, most
                    scope = values.filter(F.col("v").between(F.lit(low), F.lit(high)))
                continue
            width = high / slots - low / slots
            if not width > 0 or low + width <= low:
                break
            slot = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(slots - 1))
            rows = sorted(tuple(r) for r in scope.groupBy(slot.alias("s")).agg(
                F.count("v"), F.min("v"), F.max("v")).collect())
            for _, count, first, last in rows:
                if before + count > rank:
                    low, high, inside = first, last, count
                    break
                before += count
            scope = values.filter(F.col("v").between(F.lit(low), F.lit(high)))
        if low < high and inside > SETTLE_ROWS:
            # neighbouring doubles: few distinct values, so count them directly
            for value, count in sorted(tuple(r) for r in scope.groupBy("v").count().collect()):
                if before + count > rank:
                    low = high = value
                    break
                before += count
        if low < high:
            low = scope.orderBy("v").limit(rank - before + 1).agg(F.max("v")).collect()[0][0]
        found.append(low)
    return found


def exact_median(df: DataFrame, column: str) -> float:
    middle = exact_quantiles(
        df, column, lambda n: [n // 2] if n % 2 else [n // 2 - 1, n // 2])
    return sum(middle) / len(middle)


def share_of(fraction: float, rounding=math.floor) -> Callable[[int], int]:
    return lambda n: int(rounding(fraction * n))
