"""Linear SVM by Newton steps on a smoothed hinge loss, for one or many models at once.

The hinge is replaced by a quadratic on a zone of width h below margin 1, which
changes the mean loss by at most h / 2, and h shrinks in stages.  Loss, gradient
and curvature come from the same pass, so a model needs a few tens of scans
where sub-gradient steps need hundreds.  Many models (repair versions,
corruption seeds) share the packed rows and every pass; objective, steps and
stopping rule are the same at every width.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame

from gapwise.models.blocks import Blocks, beyond_doubt, owned_sums
from gapwise.models.linear_model import LinearModel

WIDTHS = (2.0, 0.4, 0.08, 0.016, 0.003)
STAGE_STEPS = 12
STAGE_GAIN = 1e-2     # relative gain that ends an intermediate stage
FINAL_GAIN = 1e-6
DAMPING = 1e-9
PAIRED_CELLS = 16     # up to here the curvature is one product of row pairs
SLICE = 1 << 18       # margins (rows x models) a task holds at a time


class _Fit:
    """Driver-side state of one model: accepted point, trial point, stage."""

    def __init__(self, d: int, l2: float, intercept: bool, number: int = 0):
        self.d, self.l2, self.intercept, self.number = d, l2, intercept, number
        self.at = self.trial = np.zeros(d + 1)
        self.value = np.inf
        self.step = np.zeros(d + 1)
        self.shrink, self.damping, self.stage, self.used = 1.0, DAMPING, 0, 0
        self.curve = self.slope = None

    @property
    def width(self) -> float:
        return WIDTHS[min(self.stage, len(WIDTHS) - 1)]

    @property
    def done(self) -> bool:
        return self.stage >= len(WIDTHS)

    def _propose(self):
        size = self.d + 1 if self.intercept else self.d
        curve = self.curve[:size, :size] + self.damping * np.eye(size)
        self.step = np.zeros(self.d + 1)
        self.step[:size] = -np.linalg.lstsq(curve, self.slope[:size], rcond=None)[0]
        self.shrink = 1.0
        self.trial = self.at + self.step

    def _next_stage(self):
        self.stage, self.used, self.value = self.stage + 1, 0, np.inf
        self.trial = self.at

    def receive(self, n: int, loss: float, slope: np.ndarray, curve: np.ndarray):
        """Accept or shorten the trial step given the sums at the trial point."""
        w = np.append(self.trial[:-1], 0.0)
        ridge = self.l2 * np.diag(np.append(np.ones(self.d), 0.0))
        value = loss / n + self.l2 / 2 * (w @ w)
        self.used += 1
        if np.isfinite(self.value) and not (
                value <= self.value - 1e-4 * self.shrink * abs(self.slope @ self.step)):
            if self.used >= STAGE_STEPS or self.shrink < 1e-6:
                self._next_stage()
            else:
                self.shrink /= 5.0
                self.trial = self.at + self.shrink * self.step
            return
        gain = self.value - value
        self.at, self.value = self.trial, value
        self.slope, self.curve = slope / n + self.l2 * w, curve / n + ridge
        last = self.stage == len(WIDTHS) - 1
        if self.used >= STAGE_STEPS or gain <= (FINAL_GAIN if last else STAGE_GAIN) * value:
            self._next_stage()
        else:
            self._propose()


def _add_curves(out: np.ndarray, cells: np.ndarray, bent: np.ndarray) -> None:
    """Add to each model's row its sum of outer products of the rows in its column of ``bent``."""
    size = cells.shape[1]
    if size <= PAIRED_CELLS:
        out += bent.T.astype(float) @ (cells[:, :, None] * cells[:, None, :]).reshape(-1, size * size)
        return
    for m in range(len(out)):
        own = cells[bent[:, m]]
        out[m] += (own.T @ own).ravel()


def _add_shared(out, curves, cells, y, member, points, widths) -> None:
    """Rows that may train every model; ``member`` tells which, if given."""
    many = points.shape[1]
    out[:, 0] += len(y) if member is None else member.sum(0)
    left, sure, short, middle = beyond_doubt(cells, y, points, widths.max())
    pulls = y[sure, None] * cells[sure]
    if member is None:
        n, loss, pull = np.full(many, len(short)), short.sum(), np.tile(pulls.sum(0), (many, 1))
    else:
        own = member[sure].astype(float)
        n, loss, pull = own.sum(0), short @ own, own.T @ pulls
    out[:, 1] += loss - ((points - middle[:, None]).T * pull).sum(1) - n * widths / 2
    out[:, 2:] -= pull
    cells, y = cells[left], y[left]
    inside = None if member is None else member[left]
    some = max(1, SLICE // many)
    for start in range(0, len(y), some):
        at = slice(start, start + some)
        x, short = cells[at], 1 - y[at, None] * (cells[at] @ points)
        zone = short > 0 if inside is None else (short > 0) & inside[at]
        loss = np.where(short < widths, short * short / (2 * widths), short - widths / 2)
        slope = np.where(zone, -y[at, None] * np.minimum(1, short / widths), 0)
        out[:, 1] += np.where(zone, loss, 0).sum(0)
        out[:, 2:] += slope.T @ x
        _add_curves(curves, x, zone & (short < widths))


def _add_owned(out, curves, cells, y, owner, points, widths) -> None:
    """Rows that train one model each, in the order of their owners."""
    size, width = cells.shape[1], widths[owner]
    short = 1 - y * np.einsum("ij,ij->i", cells, points.T[owner])
    zone = short > 0
    loss = np.where(zone, np.where(short < width, short * short / (2 * width), short - width / 2), 0)
    slope = np.where(zone, -y * np.minimum(1, short / width), 0)
    who, sums = owned_sums(owner, np.column_stack([np.ones(len(y)), loss, slope[:, None] * cells]))
    out[who] += sums
    bent = zone & (short < width)
    owner, cells = owner[bent], cells[bent]
    if size <= PAIRED_CELLS:
        who, sums = owned_sums(owner, (cells[:, :, None] * cells[:, None, :]).reshape(-1, size * size))
        curves[who] += sums
        return
    for m in np.unique(owner):
        own = cells[owner == m]
        curves[m] += (own.T @ own).ravel()


def _sums(blocks: Blocks, fits: list[_Fit]) -> list[tuple]:
    """(n, loss, slope vector, curvature matrix) of every fit at its trial point, in one pass."""
    size, many, owned = blocks.width + 1, len(fits), blocks.owned
    points, widths = np.column_stack([f.trial for f in fits]), np.array([f.width for f in fits])
    numbers = [f.number for f in fits]
    place = np.full(max(numbers) + 1, -1)
    place[numbers] = range(many)
    length = 2 + size + size * size

    def part(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
        cells = np.column_stack([x, np.ones(len(y))])
        out, curves = np.zeros((many, 2 + size)), np.zeros((many, size * size))
        if owned:
            shared = member < 0
            _add_shared(out, curves, cells[shared], y[shared], None, points, widths)
            at = np.flatnonzero((member >= 0) & (member < len(place)))
            at = at[place[member[at]] >= 0]
            _add_owned(out, curves, cells[at], y[at], place[member[at]], points, widths)
        else:
            _add_shared(out, curves, cells, y, member[:, numbers] if member.shape[1] else None, points, widths)
        return np.column_stack([out, curves / widths[:, None]]).ravel()
    found = blocks.total(part, many * length).reshape(many, length)
    return [(int(r[0]), r[1], r[2:2 + size], r[2 + size:].reshape(size, size)) for r in found]


def fit_packed(blocks: Blocks, models: int, features: Sequence[str], l2: float,
               intercept: bool = True) -> list[LinearModel]:
    """Fit the learners that the packed rows train; a pass serves all that are not done."""
    fits = [_Fit(len(features), l2, intercept, i) for i in range(models)]
    scans, n = 0, [0] * len(fits)
    while live := [f for f in fits if not f.done]:
        scans += 1
        for fit, sums in zip(live, _sums(blocks, live)):
            n[fit.number] = sums[0]
            if sums[0]:
                fit.receive(*sums)
            else:
                fit.stage = len(WIDTHS)
    return [LinearModel(tuple(features), tuple(float(v) for v in f.at[:-1]), float(f.at[-1]),
                        {"scans": scans, "n": n[f.number]}) for f in fits]


def fit_nearby(x: np.ndarray, y: np.ndarray, member: np.ndarray, n: int, start: np.ndarray, l2: float,
               intercept: bool = True, tries: int = 5) -> list[np.ndarray | None]:
    """Continue the last stage from ``start`` for each column of ``member``, on rows in memory.

    Each learner has ``n`` rows; those not given are rows without loss where the
    fit leads.  None where it did not settle.
    """
    cells = np.column_stack([x, np.ones(len(y))])
    size, many = cells.shape[1], member.shape[1]
    fits = [_Fit(size - 1, l2, intercept, i) for i in range(many)]
    found: list[np.ndarray | None] = [None] * many
    for fit in fits:
        fit.at = fit.trial = start
    for _ in range(tries):
        live = [f for f in fits if found[f.number] is None]
        for fit in live:
            fit.stage, fit.used, fit.value, fit.trial = len(WIDTHS) - 1, 0, np.inf, fit.at
        while moving := [f for f in live if not f.done]:
            points, widths = np.column_stack([f.trial for f in moving]), np.array([f.width for f in moving])
            out, curves = np.zeros((len(moving), 2 + size)), np.zeros((len(moving), size * size))
            _add_shared(out, curves, cells, y, member[:, [f.number for f in moving]], points, widths)
            for fit, sums, curve in zip(moving, out, curves / widths[:, None]):
                fit.receive(n, sums[1], sums[2:], curve.reshape(size, size))
                if fit.done and fit.used < STAGE_STEPS:
                    found[fit.number] = fit.at
    return found


def fit_many(df: DataFrame, members: Sequence[Column], features: Sequence[str], label: str,
             l2: float, intercept: bool = True) -> list[LinearModel]:
    """Fit a learner for each of ``members``, the predicates that say which rows train it.

    Without predicates all rows train one learner.  The table is packed once
    and never copied; a pass serves all learners that are not done.  The
    curvature takes (features + 1) squared numbers for each learner and task.
    """
    blocks = Blocks(df, features, label, members)
    try:
        return fit_packed(blocks, max(1, len(members)), features, l2, intercept)
    finally:
        blocks.close()


def fit_one(df: DataFrame, features: Sequence[str], label: str, l2: float,
            intercept: bool = True) -> LinearModel:
    return fit_many(df, (), features, label, l2, intercept)[0]
