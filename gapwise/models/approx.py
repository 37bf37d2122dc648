"""Approximately certain models: near-optimal for every repair.

Repair versions differ only in the incomplete rows.  Complete rows are scanned
once and shared by all versions; incomplete rows are multiplied lazily and
reduced to one small aggregate per version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import any_null, number, quoted, score_text
from gapwise.models.blocks import Blocks, beyond_doubt, owned_sums
from gapwise.models.linear_model import LinearModel
from gapwise.models.moments import Moments, moments, moments_by
from gapwise.models.newton import SLICE, fit_packed
from gapwise.operators.impute import adversarial_text, extreme_versions
from gapwise.operators.profile import incomplete_columns
from gapwise.operators.metrics import accuracy, mean_absolute_error

Bounds = Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class Versions:
    """Second moments (with intercept column) and optimal squared error of each repair."""

    features: tuple[str, ...]
    parts: dict[int, Moments]
    best: dict[int, float]

    def losses(self, weights: Sequence[float]) -> dict[int, float]:
        w = np.array(weights, float)
        return {v: m.restrict(self.features).squared_error(w) for v, m in self.parts.items()}


def linear_versions(df: DataFrame, key: str, features: Sequence[str], label: str,
                    bounds: Bounds, versions: int, seed) -> Versions:
    """Moments of every repair version from one pass over complete and one over incomplete rows."""
    open_ = [c for c in incomplete_columns(df, features) if c not in bounds]
    if open_:
        raise ValueError(f"no bounds for the incomplete features {open_}")
    gap = any_null(list(bounds))
    shared = moments(df.filter(~gap), features, label, intercept=True)
    many = extreme_versions(df, key, bounds, versions, seed)
    own = moments_by(many, "version", features, label, intercept=True)
    parts = {v: shared + own[v] if v in own else shared for v in range(versions)}
    best = {v: m.squared_error(m.solve()) for v, m in parts.items()}
    return Versions(tuple(features), parts, best)


def minimax_weights(versions: Versions, tolerance: float = 1e-9, max_steps: int = 5000):
    """(weights, max regret, duality gap) of min over w of max over versions of the regret.

    Works on versions x d^2 numbers, independent of the row count: the dual is
    maximised over mixtures of versions by multiplicative updates, and each
    mixture has a closed-form least-squares solution.
    """
    order = sorted(versions.parts)
    parts = [versions.parts[v].restrict(versions.features) for v in order]
    grams = np.array([m.gram for m in parts])
    crosses = np.array([m.cross for m in parts])
    offsets = np.array([m.label_square - versions.best[v] for v, m in zip(order, parts)])
    length = np.sqrt(np.clip(np.diag(grams.mean(axis=0)), 1e-300, None))
    grams, crosses = grams / np.outer(length, length), crosses / length
    mix = np.full(len(order), 1.0 / len(order))
    best_w, best_primal, best_dual = None, np.inf, -np.inf
    rate = None
    for _ in range(max_steps):
        gram, cross = np.tensordot(mix, grams, 1), mix @ crosses
        w = np.linalg.lstsq(gram, cross, rcond=1e-12)[0]
        regret = np.einsum("vij,i,j->v", grams, w, w) - 2 * crosses @ w + offsets
        primal, dual = regret.max(), mix @ regret
        if primal < best_primal:
            best_primal, best_w = primal, w
        best_dual = max(best_dual, dual)
        scale = max(abs(best_primal), 1e-12)
        if best_primal - best_dual <= tolerance * scale:
            break
        spread = regret.max() - regret.min()
        rate = 1.0 / spread if rate is None else rate
        mix = mix * np.exp(rate * (regret - regret.max()))
        mix /= mix.sum()
        rate *= 1.02 if primal <= best_primal * 1.0001 else 0.98
    return best_w / length, float(best_primal), float(best_primal - best_dual)


def approx_linear(df: DataFrame, key: str, features: Sequence[str], label: str, bounds: Bounds,
                  versions: int = 100, seed=0, threshold: float | None = None) -> DataFrame:
    """One row: max regret, whether it is within ``threshold``, and the weights."""
    table = linear_versions(df, key, features, label, bounds, versions, seed)
    weights, regret, gap = minimax_weights(table)
    ok = None if threshold is None else regret <= threshold
    row = (versions, regret, gap, ok, [float(w) for w in weights])
    return df.sparkSession.createDataFrame(
        [row], "versions int, max_regret double, gap double, is_approximately_certain boolean, "
               "weights array<double>")


def version_losses(df: DataFrame, key: str, features: Sequence[str], label: str, bounds: Bounds,
                   versions: int, seed, weights: Sequence[float]) -> DataFrame:
    """version, squared error at ``weights``, regret against the version's own optimum."""
    table = linear_versions(df, key, features, label, bounds, versions, seed)
    losses = table.losses(weights)
    rows = [(v, float(losses[v]), float(losses[v] - table.best[v])) for v in sorted(losses)]
    return df.sparkSession.createDataFrame(rows, "version int, loss double, regret double")


def hinge_version_table(df: DataFrame, key: str, features: Sequence[str], label: str,
                        bounds: Bounds, versions: int, seed) -> DataFrame:
    """Rows of all versions: complete rows under version NULL, repaired rows under theirs."""
    columns = [*features, label]
    gap = any_null(list(bounds))
    shared = df.filter(~gap).select(F.lit(None).cast("int").alias("version"), *columns)
    return shared.unionByName(extreme_versions(df, key, bounds, versions, seed)
                              .select("version", *columns))


def _hinge_sums(table: DataFrame, features, label, weights):
    margin = f"{quoted(label)} * {score_text(features, weights)}"
    inner = table.selectExpr("version", *[quoted(f) for f in features],
                             f"greatest(0D, 1D - {margin}) AS loss_",
                             f"CASE WHEN {margin} < 1D THEN -{quoted(label)} ELSE 0D END AS slope_")
    return inner.groupBy("version").agg(
        F.expr("sum(loss_)").alias("loss"),
        *[F.expr(f"sum(slope_ * {quoted(f)})").alias(f"g{i}") for i, f in enumerate(features)])


def hinge_version_losses(df: DataFrame, key: str, features: Sequence[str], label: str,
                         bounds: Bounds, versions: int, seed, weights: Sequence[float],
                         penalty: float = 0.5) -> DataFrame:
    """version, sum of hinge losses + penalty |w|^2; one grouped aggregate over all versions."""
    table = hinge_version_table(df, key, features, label, bounds, versions, seed)
    sums = _hinge_sums(table, features, label, weights).select("version", "loss")
    by = {r[0]: r[1] for r in sums.collect()}  # one number per version
    base = by.get(None, 0.0) + penalty * sum(float(w) * float(w) for w in weights)
    rows = [(v, float(base + by.get(v, 0.0))) for v in range(versions)]
    return df.sparkSession.createDataFrame(rows, "version int, loss double")


def lowest_of_cuts(heights: np.ndarray, slopes: np.ndarray, alpha: float, mix: np.ndarray,
                   rounds: int = 4000) -> tuple[float, np.ndarray, np.ndarray]:
    """(bound, w, mix) of min over w of alpha/2 |w|^2 + max over cuts of (height + slope.w).

    Every mix of the cuts bounds the minimum from below; weight moves from the
    worst cut in the mix to the best cut until the two agree.
    """
    w = -(mix @ slopes) / alpha
    for _ in range(rounds):
        reach = heights + slopes @ w
        best, used = int(np.argmax(reach)), np.flatnonzero(mix)
        worst = int(used[np.argmin(reach[used])])
        spread = reach[best] - reach[worst]
        if spread <= 1e-12 * max(1.0, abs(reach[best])):
            break
        way = slopes[best] - slopes[worst]
        bend = way @ way / alpha
        move = mix[worst] if bend == 0 else min(mix[worst], spread / bend)
        mix[best] += move
        mix[worst] -= move
        w = w - move * way / alpha
    w = -(mix @ slopes) / alpha
    return float(mix @ heights - alpha / 2 * (w @ w)), w, mix


def _shared_planes(x: np.ndarray, y: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sum of hinge losses and its slope at every point, of rows that all versions have."""
    left, sure, short, middle = beyond_doubt(x, y, points.T, 0.0)
    pull = (y[sure, None] * x[sure]).sum(0)
    out = np.column_stack([short.sum() - (points - middle) @ pull, np.tile(-pull, (len(points), 1))])
    x, y, some = x[left], y[left], max(1, SLICE // len(points))
    for start in range(0, len(y), some):
        at = slice(start, start + some)
        short = 1 - y[at, None] * (x[at] @ points.T)
        out[:, 0] += np.maximum(short, 0).sum(0)
        out[:, 1:] += np.where(short > 0, -y[at, None], 0.0).T @ x[at]
    return out


def approx_svm(df: DataFrame, key: str, features: Sequence[str], label: str, bounds: Bounds,
               versions: int = 100, seed=0, alpha: float = 1.0, steps: int = 60,
               tolerance: float = 1e-3, threshold: float | None = None) -> DataFrame:
    """min over w of max over versions of (objective_v(w) - best_v), with a bound from below.

    objective_v(w) = sum of hinge losses + alpha/2 |w|^2.  Complete rows are
    packed once and train every version; only incomplete rows are multiplied.
    All per-version optima are fitted together.  A pass over the rows gives a
    plane below each version's loss at w; the next w is the minimum over all
    planes so far, and that minimum is a bound that no w can beat.  Steps end
    when the best regret found is within ``tolerance`` (relative) of it.
    """
    gap = any_null(list(bounds))
    columns = [*features, label]
    n = df.count()
    rows = (df.filter(~gap).select(F.lit(None).cast("int").alias("version"), *columns)
            .unionByName(extreme_versions(df, key, bounds, versions, seed).select("version", *columns)))
    blocks, d = Blocks(rows, features, label, owner=F.col("version")), len(features)

    def planes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of hinge losses, and its slope, of version v at row v of ``points``."""
        def part(x, y, owner):
            shared = owner < 0
            out = _shared_planes(x[shared], y[shared], points)
            x, y, owner = x[~shared], y[~shared], owner[~shared]
            short = 1 - y * np.einsum("ij,ij->i", x, points[owner])
            who, sums = owned_sums(owner, np.column_stack(
                [np.maximum(short, 0), np.where(short > 0, -y, 0.0)[:, None] * x]))
            out[who] += sums
            return out.ravel()
        found = blocks.total(part, versions * (d + 1)).reshape(versions, d + 1)
        return found[:, 0], found[:, 1:]

    try:
        models = fit_packed(blocks, versions, features, alpha / n, intercept=False)
        own = np.array([m.weights for m in models])
        best = planes(own)[0] + alpha / 2 * (own * own).sum(axis=1)
        w, bound, mix = own.mean(axis=0), -np.inf, np.zeros(0)
        best_regret, best_w, heights, slopes = np.inf, w, np.zeros(0), np.zeros((0, d))
        for _ in range(steps):
            losses, slope = planes(np.tile(w, (versions, 1)))
            better = np.minimum(best, losses + alpha / 2 * w @ w)  # fitted optima are upper bounds
            heights, best = heights + np.tile(best - better, len(heights) // versions), better
            regret = float(np.max(losses + alpha / 2 * w @ w - best))
            if regret < best_regret:
                best_regret, best_w = regret, w
            heights = np.append(heights, losses - slope @ w - best)
            slopes = np.vstack([slopes, slope])
            mix = np.append(mix, np.zeros(versions))
            if not mix.any():
                mix[int(np.argmax(heights))] = 1.0
            bound, w, mix = lowest_of_cuts(heights, slopes, alpha, mix)
            if best_regret - bound <= tolerance * max(abs(best_regret), 1e-9 * n):
                break
    finally:
        blocks.close()
    ok = None if threshold is None else best_regret <= threshold
    return df.sparkSession.createDataFrame(
        [(versions, best_regret, bound, ok, [float(v) for v in best_w])],
        "versions int, max_regret double, lower_bound double, is_approximately_certain boolean, "
        "weights array<double>")


def worst_case_descent(df: DataFrame, features: Sequence[str], label: str, bounds: Bounds,
                       steps: int = 1000, rate: float = 0.1, tolerance: float = 1e-5):
    """(model, worst-case mean squared error) by gradient steps on the worst repair.

    The repair is part of the aggregate, so each step is one scan and nothing is
    materialised.
    """
    d = len(features)
    kept = rows = df.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    w, used, loss = np.zeros(d), 0, None
    try:
        for used in range(steps + 1):
            cells, _ = adversarial_text(features, w, label, bounds)
            score = " + ".join(f"x{i} * {number(v)}" for i, v in enumerate(w))
            sums = (rows.selectExpr(*[f"{c} AS x{i}" for i, c in enumerate(cells)],
                                    f"{quoted(label)} AS y_")
                    .selectExpr(*[f"x{i}" for i in range(d)], f"({score}) - y_ AS r_")
                    .selectExpr("count(*)", "sum(r_ * r_)",
                                *[f"sum(r_ * x{i})" for i in range(d)]).collect()[0])
            loss = sums[1] / sums[0]
            grad = 2.0 / sums[0] * np.array(sums[2:], float)
            if used == steps or np.linalg.norm(grad) <= tolerance:
                break
            w = w - rate * grad
    finally:
        kept.unpersist()
    return LinearModel(tuple(features), tuple(float(v) for v in w), 0.0, {"steps": used}), loss


def evaluate(test: DataFrame, model: LinearModel, label: str) -> DataFrame:
    """Sign accuracy and mean absolute error on the complete test rows, in one scan."""
    return (test.na.drop("any", subset=list(model.features))
            .agg(accuracy(F.signum(model.score()), label).alias("accuracy"),
                 mean_absolute_error(model.score(), label).alias("mean_abs_error")))
