"""Missingness profile: one aggregate over the table, whatever the column count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import any_null, any_null_text, quoted


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """(rows, nulls per column), one scan and one row to the driver."""
    columns = list(columns or df.columns)
    row = df.selectExpr("count(*)", *[f"count({quoted(c)})" for c in columns]).collect()[0]
    return row[0], {c: row[0] - row[i + 1] for i, c in enumerate(columns)}


def incomplete_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [c for c, n in null_counts(df, columns)[1].items() if n]


def missing_table(df: DataFrame) -> DataFrame:
    """column, n_missing, pct_missing, dtype of every column with nulls, worst first.

    The counts are one global aggregate; stacking turns that single row into
    one row per column, so the sort is over columns, not rows.
    """
    dtypes = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("n"), *[
        F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    parts = [F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(f"c{i}")).alias("n_missing"),
                      F.lit(dtypes[c]).alias("dtype"))
             for i, c in enumerate(df.columns)]
    return (counts.select("n", F.explode(F.array(*parts)).alias("p"))
            .filter("p.n_missing > 0")
            .select("p.column", "p.n_missing",
                    (F.lit(100.0) * F.col("p.n_missing") / F.col("n")).alias("pct"), "p.dtype")
            .orderBy(F.desc("pct"), "column")
            .select("column", "n_missing", F.round("pct", 1).alias("pct_missing"), "dtype"))


def missing_factor(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Incomplete rows and their share of all rows, features only."""
    hit = F.when(any_null(features), 1).otherwise(0)
    return df.agg(F.sum(hit).cast("bigint").alias("n_incomplete"), F.avg(hit).alias("factor"))


def incomplete_column_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with nulls."""
    columns = list(columns or df.columns)
    full = df.agg(*[(F.count("*") - F.count(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"))
                      for c in columns])
    return full.select(F.inline(pairs)).filter("n_missing > 0")


def repair_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """{column: (min, max)}: the range a missing cell may be repaired to."""
    row = df.selectExpr(*[f"{fn}(cast({quoted(c)} AS double))" for c in columns
                          for fn in ("min", "max")]).collect()[0] if columns else ()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def bounds_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bounds of those of the given columns that have nulls, as rows."""
    row = df.agg(F.count("*").alias("n"), *[
        F.struct(F.count(F.col(c)).alias("k"), F.min(F.col(c).cast("double")).alias("min_value"),
                 F.max(F.col(c).cast("double")).alias("max_value")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("n") - F.col(c).k).alias("gap"),
                               F.col(c).min_value.alias("min_value"),
                               F.col(c).max_value.alias("max_value")) for c in columns])
    return row.select(F.inline(pairs)).filter("gap > 0").drop("gap")


def label_cardinality(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels without and with NULL as a value of its own."""
    groups = df.groupBy(F.col(label).alias("v")).agg(F.count("*").alias("n"))
    return groups.agg(F.count("v").alias("n_distinct"),
                      F.count("*").alias("n_distinct_with_null"))


def column_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column name and whether every row has a value there."""
    counts = df.agg(*[(F.count(F.col(c)) == F.count("*")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("is_complete"))
                      for c in columns])
    return counts.select(F.inline(pairs))


def single_valued_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with exactly one distinct non-null value: min equals max, no distinct needed."""
    same = df.agg(*[(F.min(F.col(c)) == F.max(F.col(c))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("one"))
                      for c in columns])
    return same.select(F.inline(pairs)).filter("one").drop("one")


def null_cell_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct columns among the null cells (row, column)."""
    cells = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]),
                     lambda c: c.isNotNull())
    return (df.filter(any_null_text(columns))
            .select(F.explode(cells).alias("column")).distinct())
