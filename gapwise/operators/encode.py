"""Categorical columns: binarising, cardinality limits and NULL-aware one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.operators.project import column_mode, string_columns

MAX_CATEGORIES = 20  # fixed value of the studied workflow


def mode_binarise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 where the value is the column's mode, 0 elsewhere, NULL stays NULL."""
    modes = column_mode(df, columns)
    flags = {c: F.when(F.col(c).isNotNull(), F.when(F.col(c) == F.lit(modes[c]), 1.0)
                       .otherwise(0.0)) for c in columns if c in modes}
    return df.withColumns(flags)


def category_values(df: DataFrame, columns: Sequence[str],
                    limit: int = MAX_CATEGORIES) -> dict[str, list[str] | None]:
    """Sorted distinct values per column, or None beyond ``limit`` values.

    A sketch in one scan discards the clearly wide columns, so the exact
    distinct step shuffles at most a few values per task.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(F.col(c), 0.02) for c in columns]).collect()[0]
    narrow = [c for c, estimate in zip(columns, sketch) if estimate <= 2 * limit]
    found: dict[str, list[str] | None] = {c: None for c in columns}
    if narrow:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))
                                    for c in narrow]))
        rows = df.select(pairs.alias("p")).select("p.c", "p.v").distinct().collect()
        for c in narrow:
            values = sorted(r["v"] for r in rows if r["c"] == c and r["v"] is not None)
            found[c] = values if len(values) <= limit else None
    return found


def drop_high_cardinality(df: DataFrame, keep: Sequence[str] = (),
                          limit: int = MAX_CATEGORIES) -> DataFrame:
    columns = [c for c in string_columns(df) if c not in keep]
    values = category_values(df, columns, limit)
    return df.drop(*[c for c in columns if values[c] is None])


def onehot_with_nulls(df: DataFrame, columns: Sequence[str],
                      limit: int = MAX_CATEGORIES) -> DataFrame:
    """One indicator per value; a missing cell makes all indicators of its column NULL."""
    values = category_values(df, columns, limit)
    wide = [c for c in columns if values[c] is None]
    if wide:
        raise ValueError(f"more than {limit} categories in {wide}")
    indicators = [
        F.when(F.col(c).isNotNull(), F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0))
        .alias(f"{c}_{v}") for c in columns for v in values[c]]
    return df.select(*[F.col(c) for c in df.columns if c not in set(columns)], *indicators)
