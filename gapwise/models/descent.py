"""First-order learners with a fixed number of steps.

Each step is one aggregate over the rows with the current weights as literals;
the only state is the weight vector, so there is no growing lineage and a lost
executor costs one recomputed partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted, score_text
from gapwise.models.linear_model import LinearModel
from gapwise.models.moments import NARROW, _block


# derivative of the loss with respect to the score f for a row with label y
SLOPES = {
    "hinge": "CASE WHEN {y} * {f} < 1D THEN -{y} ELSE 0D END",
    "log": "-{y} / (1D + exp({y} * {f}))",
    "squared": "{f} - {y}",
}
SLOPE_ARRAYS = {
    "hinge": lambda f, y: np.where(y * f < 1, -y, 0.0),
    "log": lambda f, y: -y / (1 + np.exp(np.clip(y * f, -700, 700))),
    "squared": lambda f, y: f - y,
}


def slope_sums(df: DataFrame, features: Sequence[str], label: str, weights, intercept: float,
               loss: str) -> tuple[int, list[float], float]:
    """(n, sum of slope * x per feature, sum of slopes): one job, one row back."""
    if len(features) > NARROW:
        return _wide_slope_sums(df, features, label, weights, intercept, loss)
    slope = SLOPES[loss].format(y=quoted(label), f=score_text(features, weights, intercept))
    row = (df.selectExpr(*[quoted(f) for f in features], f"{slope} AS slope_")
           .selectExpr("count(*)", "sum(slope_)",
                       *[f"sum(slope_ * {quoted(f)})" for f in features]).collect()[0])
    return row[0], [float(v or 0.0) for v in row[2:]], float(row[1] or 0.0)


def _wide_slope_sums(df, features, label, weights, intercept, loss):
    width, w, slope_of = len(features), np.array(weights, float), SLOPE_ARRAYS[loss]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(width + 1)
        for batch in batches:
            x = _block(batch.column(0), width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            s = slope_of(x @ w + intercept, y)
            total += np.append(s @ x, s.sum())
            rows += len(x)
        yield pa.RecordBatch.from_pydict({
            "j": pa.array(range(width + 1), pa.int32()),
            "n": pa.array([rows] * (width + 1), pa.int64()), "v": pa.array(total)})

    packed = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                       F.col(label).cast("double").alias("y"))
    sums = (packed.mapInArrow(partial, "j int, n bigint, v double")
            .groupBy("j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    by = {r["j"]: r for r in sums}
    return by[width]["n"], [by[j]["v"] for j in range(width)], by[width]["v"]


def held(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The columns a learner reads, kept in memory (disk below) for its passes."""
    return df.selectExpr(*[f"cast({quoted(f)} AS double) AS {quoted(f)}" for f in features],
                         f"cast({quoted(label)} AS double) AS {quoted(label)}"
                         ).persist(StorageLevel.MEMORY_AND_DISK)


def descend(df: DataFrame, features: Sequence[str], label: str, loss: str, steps: int,
            rate: float, l2: float = 0.0, intercept: bool = True,
            start: LinearModel | None = None, tolerance: float | None = None) -> LinearModel:
    """Full-batch (sub)gradient steps on mean loss + l2/2 |w|^2, intercept unpenalised."""
    kept = rows = held(df, features, label)
    w = np.array(start.weights if start else [0.0] * len(features), float)
    b = start.intercept if start else 0.0
    used, n = 0, 0
    try:
        for used in range(1, steps + 1):
            n, grad, total = slope_sums(rows, features, label, w, b, loss)
            if not n:
                break
            g = l2 * w + np.array(grad) / n
            gb = total / n if intercept else 0.0
            w, b = w - rate * g, b - rate * gb
            if tolerance is not None and np.sqrt(g @ g + gb * gb) <= tolerance:
                break
    finally:
        kept.unpersist()
    return LinearModel(tuple(features), tuple(float(v) for v in w), float(b),
                       {"steps": used, "n": n})
