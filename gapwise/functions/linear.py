"""Linear scores and null tests as expressions and as SQL text.

Iterative learners run one aggregate per step; they use the text forms because
one parsed string is far cheaper to send to the JVM than a tree of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


FLAT_TERMS = 50


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float) -> str:
    return f"({float(value)!r}D)"


def sum_text(terms: Sequence[str]) -> str:
    """A sum; long ones are nested pairwise so that thousands of terms stay shallow."""
    terms = list(terms) or ["0D"]
    if len(terms) <= FLAT_TERMS:
        return "(" + " + ".join(terms) + ")"
    half = len(terms) // 2
    return f"({sum_text(terms[:half])} + {sum_text(terms[half:])})"


def score_text(features: Sequence[str], weights: Sequence[float], intercept: float = 0.0,
               skip_null: bool = False) -> str:
    """``w.x + b``; with ``skip_null`` a missing cell contributes nothing."""
    def cell(name):
        return f"coalesce({quoted(name)}, 0D)" if skip_null else quoted(name)
    terms = [f"{cell(f)} * {number(w)}" for f, w in zip(features, weights, strict=True)]
    if intercept:
        terms.append(number(intercept))
    return sum_text(terms)


def linear_score(features: Sequence[str], weights: Sequence[float], intercept: float = 0.0,
                 skip_null: bool = False) -> Column:
    return F.expr(score_text(features, weights, intercept, skip_null))


def any_null(columns: Sequence[str]) -> Column:
    return F.expr(any_null_text(columns))


def any_null_text(columns: Sequence[str]) -> str:
    if not columns:
        return "false"
    return "(" + " OR ".join(f"{quoted(c)} IS NULL" for c in columns) + ")"


def fill_text(columns: Sequence[str], fills: Mapping[str, float]) -> list[str]:
    """Select list that passes columns through, filling those named in ``fills``."""
    return [
        f"coalesce({quoted(c)}, {number(fills[c])}) AS {quoted(c)}" if c in fills else quoted(c)
        for c in columns
    ]
