"""Scaling fitted on the training rows and applied to any rows; NULL stays NULL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gapwise.functions.linear import number, quoted


@dataclass(frozen=True)
class Scaler:
    """Per column ``(value - shift) / width``."""

    columns: tuple[str, ...]
    shift: tuple[float, ...]
    width: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        by_name = {c: (s, w) for c, s, w in zip(self.columns, self.shift, self.width)}
        return df.selectExpr(*[
            f"({quoted(c)} - {number(by_name[c][0])}) / {number(by_name[c][1])} AS {quoted(c)}"
            if c in by_name else quoted(c) for c in df.columns])


def _fit(df, columns, low, spread):
    row = df.selectExpr(*[text.format(quoted(c)) for c in columns
                          for text in (low, spread)]).collect()[0]
    # an all-null column or one without spread is only shifted
    shift = tuple(row[2 * i] or 0.0 for i in range(len(columns)))
    width = tuple(row[2 * i + 1] or 1.0 for i in range(len(columns)))
    return Scaler(tuple(columns), shift, width)


def fit_minmax(train: DataFrame, columns: Sequence[str]) -> Scaler:
    return _fit(train, columns, "cast(min({0}) AS double)", "cast(max({0}) - min({0}) AS double)")


def fit_standard(train: DataFrame, columns: Sequence[str]) -> Scaler:
    return _fit(train, columns, "avg({0})", "stddev_pop({0})")
