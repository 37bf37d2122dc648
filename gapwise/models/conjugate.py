"""Support vector machines by Newton steps that need no curvature matrix.

A step solves its linear system by preconditioned conjugate gradients; each
product of the curvature with a direction is one pass over the packed rows
(:mod:`gapwise.models.blocks`), stopped early while the gradient is still large.
The hinge is smoothed over a zone whose width shrinks in stages, as in
:mod:`gapwise.models.newton`.

The kernel (gamma x.z)^3 is the dot product of all cells x_i x_j x_k.  They are
never made for a table: a task multiplies the pairs x_j x_k of a few rows with a
(pairs x features) matrix of weights, and back.  The learner's state is that
matrix, some d^3 / 2 numbers, whatever the number of rows.

Every fit ends with a certificate: from the smoothed slopes one pass makes a
point of the dual, whose value no weights can beat.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted
from gapwise.models.blocks import Blocks
from gapwise.models.linear_model import LinearModel

WIDTHS = (2.0, 0.4, 0.08, 0.016, 0.003, 6e-4, 1e-4)
STAGE_STEPS = 12
STAGE_GAIN = 1e-2  # part of the width that an unfinished stage may leave to gain
MOST_PRODUCTS = 30    # products with the curvature in one step
PAIR_BYTES = 16 << 20  # pairs of cells that a task holds at a time


class Linear:
    """Rows as they are."""

    def __init__(self, width: int):
        self.size = width

    def slices(self, x: np.ndarray):
        yield slice(0, len(x))

    def forward(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x @ w

    def back(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return x.T @ s

    def squares(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (x * x).T @ s


class Cubic:
    """Products of three cells: the map of the kernel (gamma x.z)^3, with x_j x_k, j <= k, in front of x_i."""

    def __init__(self, width: int, gamma: float):
        self.first, self.second = np.triu_indices(width)
        self.factor = np.where(self.first == self.second, 1.0, np.sqrt(2.0)) * gamma ** 1.5
        self.width, self.size = width, len(self.first) * width

    def slices(self, x: np.ndarray):
        some = max(1, PAIR_BYTES // (8 * max(1, len(self.first))))
        for start in range(0, len(x), some):
            yield slice(start, start + some)

    def pairs(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.first] * x[:, self.second] * self.factor

    def forward(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return ((self.pairs(x) @ w.reshape(-1, self.width)) * x).sum(axis=1)

    def back(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (self.pairs(x).T @ (x * s[:, None])).ravel()

    def squares(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return ((self.pairs(x) ** 2).T @ (x * x * s[:, None])).ravel()


class _Problem:
    """mean smoothed hinge + l2/2 |w|^2; a point is the weights and the intercept."""

    def __init__(self, blocks: Blocks, shape: Linear | Cubic, l2: float, intercept: bool):
        self.blocks, self.shape, self.l2, self.free = blocks, shape, l2, intercept
        self.n = max(1, int(blocks.total(lambda x, y, m: np.array([float(len(y))]), 1)[0]))
        self.scans = 1

    def _total(self, part, size: int) -> np.ndarray:
        shape, self.scans = self.shape, self.scans + 1

        def whole(x, y, member):
            return sum((part(x[at], y[at]) for at in shape.slices(x)), np.zeros(size))
        return self.blocks.total(whole, size)

    def slope(self, at: np.ndarray, width: float) -> tuple[float, np.ndarray, np.ndarray]:
        """(objective, gradient, diagonal of the curvature)."""
        shape, size = self.shape, self.shape.size

        def part(x, y):
            short = 1 - y * (shape.forward(x, at[:-1]) + at[-1])
            loss = np.where(short <= 0, 0, np.where(short < width, short * short / (2 * width), short - width / 2))
            s = -y * np.clip(short / width, 0, 1)
            c = ((short > 0) & (short < width)) / width
            return np.concatenate([[loss.sum()], shape.back(x, s), [s.sum()], shape.squares(x, c), [c.sum()]])
        found = self._total(part, 2 * size + 3) / self.n
        w = np.append(at[:-1], 0.0)
        gradient = found[1:size + 2] + self.l2 * w
        if not self.free:
            gradient[-1] = 0.0
        return found[0] + self.l2 / 2 * (w @ w), gradient, found[size + 2:] + np.append(np.full(size, self.l2), 0.0)

    def product(self, at: np.ndarray, width: float, direction: np.ndarray) -> np.ndarray:
        """The curvature at a point times a direction."""
        shape, size = self.shape, self.shape.size

        def part(x, y):
            short = 1 - y * (shape.forward(x, at[:-1]) + at[-1])
            bent = np.flatnonzero((short > 0) & (short < width))
            x = x[bent]
            s = (shape.forward(x, direction[:-1]) + direction[-1]) / width
            return np.append(shape.back(x, s), s.sum())
        out = self._total(part, size + 1) / self.n + self.l2 * np.append(direction[:-1], 0.0)
        if not self.free:
            out[-1] = 0.0
        return out

    def certificate(self, at: np.ndarray, width: float) -> tuple[float, float]:
        """(hinge objective, bound from below), by a feasible point of the dual.

        The dual point weighs rows by the smoothed slopes; an intercept asks for
        equal weight on both labels, so the heavier side is scaled down.
        """
        shape, size = self.shape, self.shape.size

        def part(x, y):
            short = 1 - y * (shape.forward(x, at[:-1]) + at[-1])
            a = np.clip(short / width, 0, 1)
            up, down = np.where(y > 0, a, 0), np.where(y > 0, 0, a)
            return np.concatenate([[np.maximum(short, 0).sum(), up.sum(), down.sum()],
                                   shape.back(x, up), shape.back(x, down)])
        found = self._total(part, 2 * size + 3) / self.n
        up, down = found[1:3]
        share = (1.0, 1.0)
        if self.free:
            share = min(1.0, down / up) if up else 0.0, min(1.0, up / down) if down else 0.0
        pull = share[0] * found[3:3 + size] - share[1] * found[3 + size:]
        bound = share[0] * up + share[1] * down - (pull @ pull) / (2 * self.l2)
        return found[0] + self.l2 / 2 * (at[:-1] @ at[:-1]), bound

    def step(self, at, width, gradient, diagonal, first: float) -> np.ndarray:
        """The truncated Newton step."""
        scale = np.where(diagonal > 0, diagonal, 1.0)
        rest = -gradient
        aim = min(0.5, np.sqrt(np.linalg.norm(gradient) / first)) * np.linalg.norm(gradient)
        found, ready = np.zeros_like(rest), rest / scale
        way, power = ready, rest @ ready
        for _ in range(min(MOST_PRODUCTS, 2 * len(rest))):
            bent = self.product(at, width, way)
            curve = way @ bent
            if curve <= 1e-14 * (way @ way):
                if not found.any():
                    found = way
                break
            length = power / curve
            found = found + length * way
            rest = rest - length * bent
            if np.linalg.norm(rest) <= aim:
                break
            ready = rest / scale
            after = rest @ ready
            way, power = ready + (after / power) * way, after
        return found

    def solve(self, gap: float) -> tuple[np.ndarray, dict]:
        """Weights whose objective is within ``gap`` of the bound (no weights at all have 1), if the stages get there."""
        at = np.zeros(self.shape.size + 1)
        for width in WIDTHS:
            value, gradient, diagonal = self.slope(at, width)
            first = np.linalg.norm(gradient) or 1.0
            for _ in range(STAGE_STEPS):
                # the bound loses |gradient|^2 / (2 l2), the smoothing up to width / 2
                if gradient @ gradient <= 2 * self.l2 * max(gap / 4, STAGE_GAIN * width):
                    break
                step = self.step(at, width, gradient, diagonal, first)
                shrink, fall = 1.0, gradient @ step
                while shrink > 1e-6:
                    trial = self.slope(at + shrink * step, width)
                    if trial[0] <= value + 1e-4 * shrink * fall:
                        break
                    shrink /= 4
                else:
                    break
                at = at + shrink * step
                value, gradient, diagonal = trial
            objective, bound = self.certificate(at, width)
            if objective - bound <= gap:
                break
        return at, {"objective": objective, "bound": bound, "scans": self.scans, "n": self.n}


def _fit(df, features, label, shape, l2, intercept, gap):
    blocks = Blocks(df, features, label)
    try:
        return _Problem(blocks, shape, l2, intercept).solve(gap)
    finally:
        blocks.close()


def fit_linear(df: DataFrame, features: Sequence[str], label: str, l2: float, intercept: bool = True,
               gap: float = 2e-3) -> LinearModel:
    """Linear SVM; ``info`` holds objective, bound and the number of passes."""
    at, info = _fit(df, features, label, Linear(len(features)), l2, intercept, gap)
    return LinearModel(tuple(features), tuple(float(v) for v in at[:-1]), float(at[-1]), info)


@dataclass(frozen=True)
class CubicModel:
    """Decision function of the kernel (gamma x.z)^3: a (pairs x features) matrix and an intercept."""

    features: tuple[str, ...]
    gamma: float
    weights: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict, compare=False)

    def values(self, x: np.ndarray) -> np.ndarray:
        shape = Cubic(len(self.features), self.gamma)
        return np.concatenate([shape.forward(x[at], self.weights) for at in shape.slices(x)] or [np.zeros(0)]) + self.intercept

    def score(self) -> Column:
        """Decision value as a column; missing cells count as 0."""
        weights, intercept, width, gamma = self.weights, self.intercept, len(self.features), self.gamma
        model = CubicModel(self.features, gamma, weights, intercept)

        @F.pandas_udf("double")
        def decide(cells: pd.Series) -> pd.Series:
            return pd.Series(model.values(np.stack(cells.to_list()).reshape(-1, width) if len(cells) else np.zeros((0, width))))
        return decide(F.array(*[F.expr(f"coalesce(cast({quoted(f)} AS double), 0D)") for f in self.features]))


def fit_cubic(df: DataFrame, features: Sequence[str], label: str, gamma: float, l2: float,
              gap: float = 2e-3) -> CubicModel:
    """Cubic-kernel SVM over complete rows with labels -1 and +1."""
    at, info = _fit(df, features, label, Cubic(len(features), gamma), l2, True, gap)
    return CubicModel(tuple(features), gamma, at[:-1], float(at[-1]), info)
