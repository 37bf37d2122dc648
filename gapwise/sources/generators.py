"""Synthetic tables as projections of a key column.

Every cell is a function of the seed, the key and the column, so generation is
map-only and a table of any size needs no driver data: pass ``spark.range(n)`` or
the keys of an existing table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.hashing import driver_uniform, uniform
from gapwise.models.svm import fit_cubic_svm
from gapwise.operators.sample import blank_at_rate, sample_rows

# Fixed values of the generated tables.
INFORMATIVE_SHARE = 5          # one feature in five carries the label
COEFFICIENT_SCALE = 100.0
SVM_LOW, SVM_HIGH = 2500.0, 10000.0

EMPTY_DRAWS = 64  # candidates per key without one outside the margin before giving up


def gaussian(seed, key: str, name: str):
    """Standard normal from two hashed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, key, F.lit(name + "r"))))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, key, F.lit(name + "a")))


def regression_coefficients(n_features: int, seed) -> list[float]:
    """Zero except for the first n_features // 5 features."""
    informative = n_features // INFORMATIVE_SHARE
    return [COEFFICIENT_SCALE * driver_uniform(seed, "coef", i) if i < informative else 0.0
            for i in range(n_features)]


def regression_table(ids: DataFrame, key: str, n_features: int, missing_rate: float,
                     seed) -> DataFrame:
    """x0.., y = coefficients . x without noise; one zero-coefficient column has gaps.

    A certain model exists by construction.
    """
    names = [f"x{i}" for i in range(n_features)]
    coefficients = regression_coefficients(n_features, seed)
    base = ids.select(key, *[gaussian(seed, key, n).alias(n) for n in names])
    y = sum((F.lit(c) * F.col(n) for n, c in zip(names, coefficients) if c), F.lit(0.0))
    return blank_at_rate(base.withColumn("y", y), [key], names[-1], missing_rate,
                         f"{seed}/gap")


def mirrored(half: DataFrame, key: str, features: Sequence[str], kept: Sequence[str],
             label: str = "y") -> DataFrame:
    """Rows labelled +1 and their mirror images labelled -1; ``kept`` columns keep their sign.

    Both rows come from one projection, so the source is read once.
    """
    sides = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    both = half.withColumn(label, sides)
    return both.select(
        (F.col(key) * 2 + F.when(F.col(label) > 0, 0).otherwise(1)).alias("row_id"), key,
        *[F.col(f) if f in kept else (F.col(f) * F.col(label)).alias(f) for f in features], label)


def svm_table(ids: DataFrame, key: str, n_features: int, missing_rate: float, seed,
              low: float = SVM_LOW, high: float = SVM_HIGH, gap: str = "x0") -> DataFrame:
    """Separable two-class table, symmetric in every feature but x0; ``gap`` has missing cells.

    x0 carries no information, so with gap = x0 a certain model exists.
    """
    names = [f"x{i}" for i in range(n_features)]
    half = ids.select(key, *[(F.lit(low) + F.lit(high - low) * uniform(seed, key, F.lit(n)))
                             .alias(n) for n in names])
    return blank_at_rate(mirrored(half, key, names, kept=["x0"]), [key], gap, missing_rate,
                         f"{seed}/gap").drop(key)


def kernel_table(ids: DataFrame, key: str, n_features: int, n_extra: int, seed,
                 low: float = 0.0) -> DataFrame:
    """x0 = 0 everywhere; plus ``n_extra`` rows outside the margin of a cubic-kernel SVM.

    Candidates are further hashed rows per key; exactly ``n_extra`` of those with |f| > 1
    are kept, labelled by the sign of f, and x0 is blanked there.
    """
    names = [f"x{i}" for i in range(n_features)]

    half = ids.select(key, F.lit(0.0).alias("x0"), *[
        (F.lit(low) + F.lit(1.0 - low) * uniform(f"{seed}/base", key, F.lit(n))).alias(n)
        for n in names[1:]])
    base = mirrored(half, key, names, kept=["x0"]).drop(key)
    model, _ = fit_cubic_svm(base, names, "y")
    score = model.score()
    draws = 1
    while True:  # more candidates per key until enough fall outside the margin
        many = ids.select(key, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
        candidates = (many.select(
            (-F.col(key) * draws - F.col("draw")).alias("row_id"), F.lit(0.0).alias("x0"),
            *[(F.lit(low) + F.lit(1.0 - low) * uniform(f"{seed}/extra", key, "draw", F.lit(n)))
              .alias(n) for n in names[1:]])
            .withColumn("f", score).filter(F.abs("f") > 1.0))
        found = candidates.count()
        if found >= n_extra:
            break
        if not found and draws >= EMPTY_DRAWS:
            raise ValueError(f"asked for {n_extra} rows outside the margin, found none")
        draws = max(2 * draws, int(1.1 * draws * n_extra / max(found, 1)) if found else 0)
    extra = sample_rows(candidates, "row_id", f"{seed}/pick", n_extra)
    return base.unionByName(extra.select(
        "row_id", F.lit(None).cast("double").alias("x0"), *names[1:],
        F.signum("f").alias("y")))


