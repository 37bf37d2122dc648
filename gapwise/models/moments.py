"""Gram matrices as aggregates.

Narrow tables use one built-in ``sum`` per feature pair, which combines
before the shuffle; generated code covers it up to about ten features.  Beyond ``NARROW`` features the
columns travel as one array and each task adds up its own blocks with a matrix
product, so a task emits d rows whatever its row count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted

NARROW = 40


@dataclass(frozen=True)
class Moments:
    """Sums over rows: n, X'X, X'y, y'y (and, for gap-aware use, nulls per feature)."""

    features: tuple[str, ...]
    n: int
    gram: np.ndarray
    cross: np.ndarray
    label_square: float
    nulls: tuple[int, ...] = ()

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.features, self.n + other.n, self.gram + other.gram,
                       self.cross + other.cross, self.label_square + other.label_square)

    def restrict(self, features: Sequence[str]) -> "Moments":
        """Drop features: a sub-matrix, no new scan."""
        at = [self.features.index(f) for f in features]
        return Moments(tuple(features), self.n, self.gram[np.ix_(at, at)], self.cross[at],
                       self.label_square)

    def solve(self) -> np.ndarray:
        return solve_normal(self.gram, self.cross)

    def squared_error(self, weights: np.ndarray) -> float:
        return float(weights @ self.gram @ weights - 2 * self.cross @ weights + self.label_square)


def solve_normal(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares from the normal equations, columns brought to unit length first.

    Rank-deficient systems get the minimum-norm solution in scaled coordinates;
    fitted values are the same for every solution.
    """
    length = np.sqrt(np.clip(np.diag(gram), 0, None))
    length[length == 0] = 1.0
    scaled, *_ = np.linalg.lstsq(gram / np.outer(length, length), cross / length, rcond=1e-12)
    return scaled / length


def _terms(features: Sequence[str], label: str, intercept: bool) -> tuple[list[str], list[str]]:
    cells = [quoted(f) for f in features] + (["1D"] if intercept else [])
    names = list(features) + (["intercept"] if intercept else [])
    y = quoted(label)
    sums = [f"sum({cells[i]} * {cells[j]})" for i in range(len(cells))
            for j in range(i, len(cells))]
    sums += [f"sum({c} * {y})" for c in cells]
    return names, ["count(*)", f"count({y})", f"sum({y} * {y})",
                   *[f"count({c})" for c in cells], *sums]


def _unpack(names, row) -> Moments:
    d = len(names)
    n, labelled, label_square = row[0], row[1], row[2]
    if labelled != n:
        raise ValueError("the label must not be missing")
    counts = row[3:3 + d]
    values = [0.0 if v is None else float(v) for v in row[3 + d:]]
    gram = np.zeros((d, d))
    gram[np.triu_indices(d)] = values[:d * (d + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    return Moments(tuple(names), n, gram, np.array(values[d * (d + 1) // 2:]),
                   float(label_square or 0.0), tuple(n - c for c in counts))


def moments(df: DataFrame, features: Sequence[str], label: str,
            intercept: bool = False) -> Moments:
    """All second moments in one scan.  Products with a NULL are skipped."""
    if len(features) > NARROW:
        packed = df.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
                           F.col(label).cast("double").alias("y"))
        found = wide_moments(packed, "x", "y", len(features), intercept)
        names = tuple(features) + (("intercept",) if intercept else ())
        return Moments(names, found.n, found.gram, found.cross, found.label_square, found.nulls)
    names, terms = _terms(features, label, intercept)
    return _unpack(names, tuple(df.selectExpr(*terms).collect()[0]))


def moments_by(df: DataFrame, group: str, features: Sequence[str], label: str,
               intercept: bool = False) -> dict[int, Moments]:
    """Second moments per group; only groups x d^2 numbers are shuffled."""
    names, terms = _terms(features, label, intercept)
    rows = df.groupBy(group).agg(*[F.expr(t) for t in terms]).collect()
    return {r[0]: _unpack(names, tuple(r)[1:]) for r in rows}


def _block(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    if len(values) != len(column) * width:
        raise ValueError(f"feature arrays must all have {width} elements")
    return values.reshape(-1, width)


def gram_rows(df: DataFrame, array: str, label: str, width: int,
              intercept: bool = False) -> DataFrame:
    """(i, values) partial rows of the augmented Gram [x, 1?, y], summed per row i.

    Rows of the matrix are shuffled as arrays.  The number of tasks is held to
    the number of cores, so the shuffle carries cores x d arrays of length d.
    """
    extra = 1 if intercept else 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width + extra + 1
        total, rows, nulls = np.zeros((size, size)), 0, np.zeros(size)
        for batch in batches:
            x = _block(batch.column(0), width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
            block = np.hstack([x] + ([np.ones_like(y)] if extra else []) + [y])
            gaps = np.isnan(block)
            nulls += gaps.sum(axis=0)
            block = np.where(gaps, 0.0, block)
            total += block.T @ block
            rows += len(block)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(size), pa.int32()),
            "n": pa.array([rows] * size, pa.int64()),
            "nulls": pa.array(nulls.astype(int), pa.int64()),
            "values": pa.array(list(total), pa.list_(pa.float64()))})

    parts = (df.select(array, label)
             .mapInArrow(partial, "i int, n bigint, nulls bigint, values array<double>"))
    size = width + extra + 1
    sums = [F.sum(F.col("values")[j]).alias(f"v{j}") for j in range(size)]
    if size <= 256:
        return parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"),
                                      F.array(*sums).alias("values"))
    cells = (parts.select("i", "n", "nulls", F.posexplode("values").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"),
                                    F.sum("v").alias("v")))
    # a matrix row has a fixed number of cells, so this list is bounded by the width
    return cells.groupBy("i").agg(
        F.max("n").alias("n"), F.max("nulls").alias("nulls"),
        F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"])
        .alias("values"))


def wide_moments(df: DataFrame, array: str, label: str, width: int,
                 intercept: bool = False) -> Moments:
    rows = sorted(gram_rows(df, array, label, width, intercept).collect(), key=lambda r: r["i"])
    full = np.array([r["values"] for r in rows])
    names = tuple(f"x{i}" for i in range(width)) + (("intercept",) if intercept else ())
    if rows[-1]["nulls"]:
        raise ValueError("the label must not be missing")
    return Moments(names, rows[0]["n"], full[:-1, :-1], full[:-1, -1], float(full[-1, -1]),
                   tuple(r["nulls"] for r in rows[:-1]))
