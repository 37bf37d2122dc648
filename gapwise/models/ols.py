"""Least squares by a tree of QR steps: one scan, no squared condition number."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from gapwise.models.blocks import triangular
from gapwise.models.descent import slope_sums
from gapwise.models.linear_model import LinearModel


def solve_triangular(r: np.ndarray) -> np.ndarray:
    """Least squares from the triangle of [X, y]; columns are brought to unit length first.

    Rank-deficient systems get the minimum-norm solution in scaled coordinates.
    """
    a, y = r[:, :-1], r[:, -1]
    length = np.linalg.norm(a, axis=0)
    length[length == 0] = 1.0
    return np.linalg.lstsq(a / length, y, rcond=1e-14)[0] / length


def fit_ols(df: DataFrame, features: Sequence[str], label: str, intercept: bool = False,
            refine: bool = False) -> LinearModel:
    """Least squares over complete rows; a missing cell or label is an error.

    ``refine`` spends one more scan to correct the solution by its own residuals.
    """
    n, r = triangular(df, features, label, intercept)
    if np.isnan(r).any():
        raise ValueError("features and label must be complete")
    weights = solve_triangular(r)
    if refine:
        d = len(features)
        _, grad, total = slope_sums(df, features, label, weights[:d], weights[d] if intercept else 0.0, "squared")
        pull = np.array([*grad, total] if intercept else grad)
        weights = weights - np.linalg.lstsq(r[:, :-1], np.linalg.lstsq(r[:, :-1].T, pull, rcond=None)[0], rcond=None)[0]
    left = r[:, -1] - r[:, :-1] @ weights
    bias = float(weights[-1]) if intercept else 0.0
    return LinearModel(tuple(features), tuple(float(w) for w in weights[:len(features)]), bias,
                       {"n": n, "sse": float(left @ left)})
