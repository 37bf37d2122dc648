"""Evaluation aggregates; each is a Column for ``agg`` so several share one scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mean_squared_error(prediction, label) -> Column:
    return F.avg((_col(prediction) - _col(label)) * (_col(prediction) - _col(label)))


def sum_squared_error(prediction, label) -> Column:
    return F.sum((_col(prediction) - _col(label)) * (_col(prediction) - _col(label)))


def r_squared(prediction, label) -> Column:
    """1 - SSE / SST in one pass; NULL when the label is constant."""
    sst = F.var_pop(_col(label)) * F.count(_col(label))
    return F.lit(1.0) - F.try_divide(sum_squared_error(prediction, label), sst)


def accuracy(prediction, label) -> Column:
    return F.avg(F.when(_col(prediction) == _col(label), 1.0).otherwise(0.0))


def mean_absolute_error(prediction, label, n: int | None = None) -> Column:
    """Sum of absolute errors over the row count, or over an explicit n."""
    total = F.sum(F.abs(_col(prediction) - _col(label)))
    return total / (F.lit(float(n)) if n is not None else F.count(_col(label)))


def hinge_loss(score, label, weights=(), penalty: float = 0.0) -> Column:
    """Sum of hinge losses plus penalty * |w|^2."""
    loss = F.sum(F.greatest(F.lit(0.0), F.lit(1.0) - _col(label) * _col(score)))
    return loss + F.lit(float(penalty) * sum(float(w) * float(w) for w in weights))


def sign_prediction(score) -> Column:
    return F.signum(_col(score))
