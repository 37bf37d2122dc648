"""Splitting, sampling and corrupting by row key."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.functions.hashing import RANK_BITS, digest, driver_digest, driver_uniform, hash_rank, uniform
from gapwise.operators.rows import dense_ids
from gapwise.operators.select_rank import hash_cutoff, share_of

TOP_ROWS = 10_000


def train_test_flag(df: DataFrame, key: str, seed, test_share: float = 0.2,
                    flag: str = "is_test") -> DataFrame:
    """Add a boolean that marks exactly ceil(share * n) random rows as test rows."""
    cut = hash_cutoff(df, key, seed, share_of(test_share, math.ceil))
    return df.withColumn(flag, cut.covers())


def train_test_split(df: DataFrame, key: str, seed, test_share: float = 0.2):
    cut = hash_cutoff(df, key, seed, share_of(test_share, math.ceil))
    return df.filter(~cut.covers()), df.filter(cut.covers())


def hash_split_flag(df: DataFrame, key: str, seed, test_share: float = 0.2,
                    flag: str = "is_test") -> DataFrame:
    """One-pass variant: each row is a test row with the given probability."""
    return df.withColumn(flag, uniform(seed, key) < F.lit(test_share))


def sample_rows(df: DataFrame, key: str, seed, k: int) -> DataFrame:
    """Exactly min(k, n) rows, uniformly and without replacement."""
    return df.filter(hash_cutoff(df, key, seed, lambda n: k).covers())


def sample_with_replacement(df: DataFrame, key: str, seed, k: int,
                            n: int | None = None, only=None) -> DataFrame:
    """k uniform draws with replacement; column ``n_draws`` is the multiplicity.

    The draws are positions in a random permutation of the rows.  Only how many
    draws fall on the same position matters, because any set of distinct
    positions of a random permutation is a uniform random set of rows: the i-th
    smallest drawn position is served by the i-th row in hash order.  Pass the
    row count ``n`` if it is known.  ``only``, a function of tables, keeps the rows
    that take part; it is applied to no more rows than needed.
    """
    if only is not None and (n is None or k > TOP_ROWS):
        df, only = only(df), None
    n = df.count() if n is None else n
    if n == 0:
        df = df if only is None else only(df)
        return df.withColumn("n_draws", F.lit(0).cast("bigint"))
    if k <= TOP_ROWS:
        times = draw_times(seed, k, n)
        # one top-k job; the batch itself, at most TOP_ROWS rows, is the result
        rows = _first_in_hash_order(df, key, seed, len(times), n, only or (lambda rows: rows))
        schema = T.StructType([*df.schema.fields, T.StructField("n_draws", T.LongType())])
        return df.sparkSession.createDataFrame(
            [(*r, c) for r, c in zip(rows, times)], schema)
    spark = df.sparkSession
    position = F.floor(uniform(seed, F.lit("draw"), F.col("id")) * F.lit(n))
    draws = (spark.range(k).groupBy(position.alias("position"))
             .agg(F.count("*").alias("n_draws")))
    ranks = dense_ids(draws, "position", "slot").drop("position")
    cut = hash_cutoff(df, key, seed, lambda _: ranks.count())
    chosen = df.filter(cut.covers()).withColumn("hash_order", hash_rank(seed, key))
    return dense_ids(chosen, ["hash_order", key], "slot").join(ranks, "slot").drop(
        "slot", "hash_order")


def draw_times(seed, k: int, n: int) -> list[int]:
    """How often each of the drawn rows is drawn, in hash order, when k of n are drawn with replacement."""
    hits = Counter(int(driver_uniform(seed, "draw", j) * n) for j in range(k))
    return [hits[p] for p in sorted(hits)]


def _first_in_hash_order(df: DataFrame, key: str, seed, k: int, n: int, only) -> list:
    """The k rows of about n that come first in hash order.

    Only rows below a bound that some 16 k of them pass are ranked; a rank is
    the head of the digest, so digests compare as ranks do.  Where fewer than k
    pass, all rows are ranked.
    """
    order, share = [hash_rank(seed, key), F.col(key)], 16.0 * k / n
    if share < 0.5:
        bound = f"{int(share * 2 ** RANK_BITS):0{RANK_BITS // 4}x}"
        rows = only(df.filter(digest(seed, key) < F.lit(bound))).orderBy(*order).limit(k).collect()
        if len(rows) == k:
            return rows
    return only(df).orderBy(*order).limit(k).collect()


def pick_column(columns: Sequence[str], seed) -> str:
    """One column name, uniformly at random."""
    return min(columns, key=lambda c: driver_digest(seed, "column", c))


def make_dirty(df: DataFrame, key: str, features: Sequence[str], rate: float, seed) -> DataFrame:
    """Blank exactly int(rate * n) random cells of one randomly chosen feature."""
    hit = hash_cutoff(df, key, seed, share_of(rate)).covers()
    column = pick_column(features, seed)
    return df.withColumn(column, F.when(~hit, F.col(column)))


def blank_at_rate(df: DataFrame, keys: Sequence[str], column: str, rate: float, seed) -> DataFrame:
    """Blank each cell of a column independently with the given probability."""
    return df.withColumn(
        column, F.when(uniform(seed, *keys) >= F.lit(rate), F.col(column)))
