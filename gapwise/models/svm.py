"""Linear and cubic-kernel support vector machines, logistic and squared-loss learners."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import number, quoted, sum_text
from gapwise.models import conjugate
from gapwise.models.descent import descend
from gapwise.models.linear_model import LinearModel
from gapwise.models.newton import fit_one

MAX_CUBIC_FEATURES = 40


def fit_svm(df: DataFrame, features: Sequence[str], label: str, l2: float = 1e-4,
            steps: int = 100, rate: float = 0.5, solver: str = "newton") -> LinearModel:
    """min mean hinge + l2/2 |w|^2 over complete rows with labels -1 and +1.

    ``newton`` converges in a few tens of scans at every width; ``conjugate``
    needs more scans but no squared number of features; ``mllib`` hands the same
    objective to Spark's quasi-Newton learner; ``steps`` is a fixed number of
    sub-gradient steps that can be reproduced in SQL.
    """
    if solver == "steps":
        return descend(df, features, label, "hinge", steps, rate, l2)
    if solver == "newton":
        return fit_one(df, features, label, l2)
    if solver == "conjugate":
        return conjugate.fit_linear(df, features, label, l2)
    if solver != "mllib":
        raise ValueError(f"unknown solver {solver}")
    ready = VectorAssembler(inputCols=list(features), outputCol="features_").transform(
        df.select(*features, F.when(F.col(label) > 0, 1.0).otherwise(0.0).alias("label_")))
    fitted = LinearSVC(featuresCol="features_", labelCol="label_", regParam=l2, maxIter=steps,
                       standardization=False, tol=1e-6).fit(ready)
    return LinearModel(tuple(features), tuple(float(v) for v in fitted.coefficients.toArray()),
                       float(fitted.intercept))


def fit_c_svm(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0,
              n: int | None = None, **options) -> LinearModel:
    """C-parameterisation: the penalty is 1 / (C n)."""
    n = n if n is not None else df.count()
    return fit_svm(df, features, label, l2=1.0 / (c * n), **options)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, l2: float = 1e-6,
                 steps: int = 100, rate: float = 0.5) -> LinearModel:
    return descend(df, features, label, "log", steps, rate, l2)


def fit_sgd_regression(df: DataFrame, features: Sequence[str], label: str, steps: int = 100,
                       rate: float = 0.1, start: LinearModel | None = None) -> LinearModel:
    """Squared loss without penalty; ``start`` continues from an earlier model."""
    return descend(df, features, label, "squared", steps, rate, start=start)


def kernel_width(df: DataFrame, features: Sequence[str]) -> float:
    """1 / (d * variance of all cells), from per-column means and variances."""
    d = len(features)
    row = df.selectExpr(*[f"{fn}({quoted(f)})" for f in features
                          for fn in ("avg", "var_pop")]).collect()[0]
    means, spreads = row[0::2], row[1::2]
    centre = sum(means) / d
    variance = sum(spreads) / d + sum((m - centre) * (m - centre) for m in means) / d
    return 1.0 / (d * variance) if variance else 1.0


def cubic_terms(features: Sequence[str], gamma: float) -> list[tuple[str, str]]:
    """(name, SQL) of the feature map whose dot product is (gamma x.z)^3."""
    if len(features) > MAX_CUBIC_FEATURES:
        raise ValueError(f"the explicit cubic map is limited to {MAX_CUBIC_FEATURES} features")
    terms = []
    for pick in combinations_with_replacement(range(len(features)), 3):
        orders = math.factorial(3)
        for times in Counter(pick).values():
            orders //= math.factorial(times)
        factor = math.sqrt(orders) * gamma ** 1.5
        product = " * ".join(quoted(features[i]) for i in pick)
        terms.append(("p" + "_".join(str(i) for i in pick), f"{product} * {number(factor)}"))
    return terms


def cubic_features(df: DataFrame, features: Sequence[str], gamma: float,
                   keep: Sequence[str] = ()) -> DataFrame:
    return df.selectExpr(*[quoted(c) for c in keep],
                         *[f"{sql} AS {quoted(name)}" for name, sql in
                           cubic_terms(features, gamma)])


def fit_cubic_svm(complete: DataFrame, features: Sequence[str], label: str, c: float = 1.0,
                  l2: float | None = None, solver: str = "conjugate", **options):
    """(model, gamma) of the kernel (gamma x.z)^3, at any number of features.

    ``conjugate`` never makes the map's columns; any other solver of
    :func:`fit_svm` works on the explicit map and its few features.
    """
    gamma = kernel_width(complete, features)
    l2 = 1.0 / (c * complete.count()) if l2 is None else l2
    if solver == "conjugate":
        return conjugate.fit_cubic(complete, features, label, gamma, l2, **options), gamma
    mapped = cubic_features(complete, features, gamma, keep=[label])
    names = [name for name, _ in cubic_terms(features, gamma)]
    return fit_svm(mapped, names, label, l2=l2, solver=solver, **options), gamma


def cubic_score(model: LinearModel, features: Sequence[str], gamma: float) -> str:
    """Decision value as SQL over the original features; missing cells count as 0."""
    terms = []
    for (name, sql), w in zip(cubic_terms(features, gamma), model.weights, strict=True):
        for f in features:
            sql = sql.replace(quoted(f), f"coalesce({quoted(f)}, 0D)")
        terms.append(f"{sql} * {number(w)}")
    return sum_text([*terms, number(model.intercept)])
