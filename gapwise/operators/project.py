"""Projections: feature/label selection, renaming, recoding and parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted
from gapwise.operators.profile import null_counts
from gapwise.operators.select_rank import exact_median


def features_and_label(df: DataFrame, label: str, key: str | None = None):
    """(features, label) as two narrow tables; the key stays on both sides."""
    keep = [key] if key else []
    return df.drop(label), df.select(*keep, label)


def rename_positional(df: DataFrame, prefix: str = "feature_", label: str = "label") -> DataFrame:
    """feature_0 .. feature_{n-2}, label."""
    width = len(df.columns) - 1
    return df.toDF(*[f"{prefix}{i}" for i in range(width)], label)


def move_label_last(df: DataFrame, label: str, drop_first: bool = True) -> DataFrame:
    """Drop the leading identifier column and put the label at the end."""
    columns = df.columns[1:] if drop_first else df.columns
    return df.select(*[c for c in columns if c != label], label)


def recode_label(df: DataFrame, label: str, mapping: Mapping, name: str | None = None) -> DataFrame:
    """Map label codes to numbers; codes without an entry become NULL."""
    code: Column = F.lit(None).cast("double")
    for value, number in mapping.items():
        code = F.when(F.col(label) == F.lit(value), F.lit(float(number))).otherwise(code)
    return df.withColumn(name or label, code)


def column_mode(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column as a string, ties to the smallest.

    Counting is a grouped aggregate (combined before the shuffle), so a hot
    value costs one partial count per task and no task holds all values.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = (df.select(pairs.alias("p")).filter("p.v IS NOT NULL")
              .groupBy("p.c", "p.v").count())
    best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))))
    return {r[0]: r[1] for r in best.collect()}


def numeric_mode(df: DataFrame, column: str):
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).count()
    return counts.agg(F.min_by("v", F.struct(-F.col("count"), F.col("v")))).collect()[0][0]


def has_more_than_two_labels(df: DataFrame, label: str) -> bool:
    """More than two distinct labels, NULL counting as one, from two plain aggregates."""
    lo, hi, n, known = df.agg(F.min(label), F.max(label), F.count("*"), F.count(label)).collect()[0]
    values = (lo is not None) + (hi != lo) + (n > known)
    if values > 2 or lo == hi:
        return values > 2
    between = F.max((F.col(label) > F.lit(lo)) & (F.col(label) < F.lit(hi)))
    return values + bool(df.agg(between).collect()[0][0]) > 2


def binarise_label(df: DataFrame, label: str, situation: str = "mean",
                   task: str = "classification", name: str | None = None) -> DataFrame:
    """1 above the midpoint (or equal to the mode), else 0; two-valued labels stay."""
    if label not in df.columns:
        raise ValueError(f"no column {label}")
    if task != "classification" or not has_more_than_two_labels(df, label):
        return df if not name else df.withColumn(name, F.col(label))
    if situation == "mode":
        hit = F.col(label) == F.lit(numeric_mode(df, label))
    elif situation == "median":
        hit = F.col(label) > F.lit(exact_median(df, label))
    elif situation == "mean":
        hit = F.col(label) > F.lit(df.agg(F.avg(label)).collect()[0][0])
    else:
        raise ValueError(f"unknown midpoint {situation}")
    return df.withColumn(name or label, F.when(hit, 1).otherwise(0))


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


# Spark's cast also takes Java's type suffixes ("1d", "2f"); a number has none.
_NUMBER = (r"rlike '(?i)^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?\\s*$"
           r"|^\\s*([+-]?inf(inity)?|nan)\\s*$'")


def to_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast a string column to double if every non-null value parses, else keep it."""
    columns = [c for c in (columns or string_columns(df)) if dict(df.dtypes)[c] == "string"]
    if not columns:
        return df
    tests = [f"bool_and({quoted(c)} IS NULL OR {quoted(c)} {_NUMBER})"
             for c in columns]
    verdict = df.selectExpr(*tests).collect()[0]
    numeric = {c for c, ok in zip(columns, verdict) if ok}
    return df.select(*[F.col(c).cast("double").alias(c) if c in numeric else F.col(c)
                       for c in df.columns])


def try_parse(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Parse cell by cell; text that is no number becomes 0, NULL stays NULL."""
    parsed = F.expr(f"CASE WHEN {quoted(column)} IS NOT NULL "
                    f"THEN coalesce(CASE WHEN {quoted(column)} {_NUMBER} "
                    f"THEN try_cast({quoted(column)} AS double) END, 0D) END")
    return df.withColumn(name or column, parsed)


def drop_categorical(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop what is still text after numeric coercion."""
    parsed = to_numeric(df)
    return parsed.drop(*[c for c in string_columns(parsed) if c not in keep])


def split_complete_columns(df: DataFrame, features: Sequence[str], key: str):
    """(complete-column part, incomplete-column part), both carrying the key."""
    _, nulls = null_counts(df, features)
    complete = [c for c in features if not nulls[c]]
    gaps = [c for c in features if nulls[c]]
    return df.select(key, *complete), df.select(key, *gaps)
