"""Row filters on missing cells; all are map-only and reach the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gapwise.functions.linear import any_null


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def drop_all_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(columns) if columns else None)


def drop_unlabelled(df: DataFrame, label: str) -> DataFrame:
    return df.na.drop("any", subset=[label])


def split_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, incomplete rows): two filters, no anti-join."""
    gap = any_null(columns)
    return df.filter(~gap), df.filter(gap)
