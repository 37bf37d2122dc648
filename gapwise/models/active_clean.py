"""Iterative cleaning: draw batches from a pool, learn where dirty rows are, learn from clean ones.

The pool stays a DataFrame.  Per iteration only the drawn batch (50 rows by
default) is read; leaving the pool is a filter on the drawn keys and on a linear
predicate.  The labelled sample holds at most ``total`` rows by construction of
the loop.  Up to DRIVER_SAMPLE rows the two small learners work on it directly;
beyond that it stays a table and every update is a Spark aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.digests import Keys, pack_rows, to_stream, unpacked
from gapwise.functions.linear import any_null, score_text
from gapwise.models.descent import SLOPE_ARRAYS, slope_sums
from gapwise.operators.impute import impute_tiny_random
from gapwise.operators.profile import incomplete_columns
from gapwise.operators.sample import TOP_ROWS, draw_times, sample_with_replacement
from gapwise.session import cut_lineage, shared_folder

# Fixed values of the studied workflow.
BATCH = 50
TOTAL = 10_000
DIRTY_THRESHOLD = 0.90
DRIVER_SAMPLE = 20_000
CUT_EVERY = 8
RUNS_AT_ONCE = 8


def prepare(df: DataFrame, key: str, features: Sequence[str], label: str, seed,
            scale: float = 0.01, only_missing: bool = False) -> DataFrame:
    """(key, filled features, label, is_dirty): partitions are filters on ``is_dirty``."""
    gaps = incomplete_columns(df, features)
    flagged = df.select(key, *features, label).withColumn("is_dirty", any_null(gaps))
    return impute_tiny_random(flagged, key, features, seed, scale, only_missing, gaps)


def initial_batch(pool: DataFrame, key: str, seed, batch: int = BATCH):
    """(drawn rows with multiplicity, remaining pool)."""
    drawn = sample_with_replacement(pool, key, seed, batch)
    return drawn, pool.join(drawn.select(key), key, "left_anti")


def batch_dirty_count(drawn: DataFrame) -> DataFrame:
    """Originally dirty rows among the draws, counted with multiplicity."""
    return drawn.agg(F.coalesce(F.sum(F.when(F.col("is_dirty"), F.col("n_draws")).otherwise(0)),
                                F.lit(0)).cast("bigint").alias("n_dirty"))


def dirty_probability(features: Sequence[str], weights: Sequence[float], intercept: float):
    """P(dirty) where the classifier scores P(clean) = 1 / (1 + exp(-f))."""
    return F.expr(f"1D / (1D + exp({score_text(features, weights, intercept)}))")


def filter_pool(pool: DataFrame, features: Sequence[str], weights: Sequence[float],
                intercept: float, threshold: float = DIRTY_THRESHOLD,
                mode: str = "reference") -> DataFrame:
    """Keep rows whose dirty probability is below the threshold, or the reverse."""
    below = dirty_probability(features, weights, intercept) < F.lit(threshold)
    if mode == "reference":
        return pool.filter(below)
    if mode == "keep_dirty":
        return pool.filter(~below)
    raise ValueError(f"unknown mode {mode}")


class _Pool:
    """Rows left to draw from: a held table, the keys drawn and the linear filters so far.

    Both travel to the tasks as data, so a step compiles no new code and the
    plan does not grow; draws look at them only for rows that may be drawn.
    """

    def __init__(self, rows: DataFrame, key: str, features: Sequence[str], threshold: float, mode: str):
        if mode not in ("reference", "keep_dirty"):
            raise ValueError(f"unknown mode {mode}")
        self.rows, self.key, self.features, self.mode = rows, key, list(features), mode
        self.level = float(np.log(1.0 / threshold - 1.0))  # 1 / (1 + exp(f)) < threshold above it
        self.keys: list = []
        self.lines: list[np.ndarray] = []

    def drop(self, keys: list) -> None:
        self.keys += keys

    def keep(self, weights: np.ndarray, intercept: float) -> None:
        self.lines.append(np.append(weights, intercept))

    def _left(self):
        """Which rows of an Arrow batch are left.  NULL is no key and has no score, as in a filter."""
        key, features, level, above = self.key, self.features, self.level, self.mode == "reference"
        lines, keys = np.array(self.lines).reshape(-1, len(features) + 1), list(dict.fromkeys(self.keys))

        def left(batch: pa.RecordBatch) -> np.ndarray:
            good = np.full(batch.num_rows, None not in keys)
            if keys and good.any():
                column = batch.column(key)
                drawn = pc.is_in(column, value_set=pa.array(keys, column.type))
                good &= pc.and_(pc.is_valid(column), pc.invert(drawn)).to_numpy(zero_copy_only=False)
            if len(lines):
                cells = np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features])
                for f in features:
                    good &= batch.column(f).is_valid().to_numpy(zero_copy_only=False)
                below = cells @ lines[:, :-1].T + lines[:, -1] > level
                good &= below.all(axis=1) if above else ~below.any(axis=1)
            return good
        return left

    def only(self, rows: DataFrame) -> DataFrame:
        """Those of the rows that are left."""
        left = self._left()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(left(batch)))
        return rows.mapInArrow(run, rows.schema)

    def count(self) -> int:
        left = self._left()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = sum(int(left(batch).sum()) for batch in batches)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})
        counts = self.rows.select(self.key, *self.features).mapInArrow(run, "n long")
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]

    def draw(self, seed, batch: int, left: int) -> DataFrame:
        return sample_with_replacement(self.rows, self.key, seed, batch, left, self.only)

    def ahead(self, packed: DataFrame, seed, most: int) -> tuple[int, list[tuple]]:
        """(rows left, the first ``most`` of them in the hash order of the next draw), in one pass over packed rows."""
        left, key = self._left(), self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, best = 0, []
            for block in unpacked(batches):
                kept = block.filter(pa.array(left(block)))
                n += kept.num_rows
                if kept.num_rows:
                    ranks = Keys(kept.column(kept.num_columns - 1)).ranks(seed).astype(np.int64)
                    best = [_lowest(pa.Table.from_batches([kept]).append_column("rank_", pa.array(ranks)), key, most), *best]
                    best = [_lowest(pa.concat_tables(best), key, most)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([to_stream(best[0]) if best else None], pa.binary())], ["n", "rows"])
        found = packed.mapInArrow(run, "n long, rows binary").toArrow().to_pylist()
        parts = [pa.ipc.open_stream(r["rows"]).read_all() for r in found if r["rows"] is not None]
        rows = _lowest(pa.concat_tables(parts), key, most) if parts else None
        return sum(r["n"] for r in found), ([tuple(r.values())[:-2] for r in rows.to_pylist()] if parts else [])


def _packed(rows: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """What the steps read, held in blocks: (key, features, label, is_dirty, key as text)."""
    return pack_rows(rows.select(key, *features, label, "is_dirty", F.col(key).cast("string").alias("text_"))).persist(
        StorageLevel.MEMORY_AND_DISK)


def _lowest(rows: pa.Table, key: str, most: int) -> pa.Table:
    """The rows that come first by rank, then key, NULL first."""
    if rows.num_rows > most:
        ranks = rows.column("rank_").to_numpy()
        rows = rows.filter(pa.array(ranks <= np.partition(ranks, most - 1)[most - 1]))
    order = pc.sort_indices(rows, [("rank_", "ascending"), (key, "ascending")], null_placement="at_start")
    return rows.take(order[:most])


@dataclass
class _Learner:
    """Weights plus a few gradient steps on whichever form the sample has."""

    loss: str
    l2: float
    weights: np.ndarray
    intercept: float = 0.0

    def update(self, x: np.ndarray, y: np.ndarray, times: np.ndarray, steps: int):
        if not len(y):
            return
        slope = SLOPE_ARRAYS[self.loss]
        # step length from the largest row norm, so unscaled features do not diverge
        rate = 1.0 / (1.0 + float((x * x).sum(axis=1).max()))
        for _ in range(steps):
            s = slope(x @ self.weights + self.intercept, y) * times
            self.intercept -= rate * s.sum() / times.sum()
            self.weights = self.weights - rate * (s @ x / times.sum() + self.l2 * self.weights)

    def update_table(self, rows: DataFrame, features, label, steps: int):
        norm = rows.selectExpr("max(" + " + ".join(f"`{f}` * `{f}`" for f in features)
                               + ")").collect()[0][0]
        rate = 1.0 / (1.0 + float(norm or 0.0))
        for _ in range(steps):
            n, grad, total = slope_sums(rows, features, label, self.weights, self.intercept,
                                        self.loss)
            if not n:
                return
            self.intercept -= rate * total / n
            self.weights = self.weights - rate * (np.array(grad) / n + self.l2 * self.weights)


def fit_error_classifier(labelled: DataFrame, features: Sequence[str], steps: int = 100):
    """Logistic classifier clean (1) / dirty (-1); None while no dirty row was seen.

    ``labelled`` has the features and ``is_dirty``; each step is one aggregate.
    """
    dirty = labelled.selectExpr("count_if(is_dirty)").collect()[0][0]
    if not dirty:
        return None
    rows = labelled.withColumn("clean_", F.when(F.col("is_dirty"), -1.0).otherwise(1.0))
    learner = _Learner("log", 1e-6, np.zeros(len(features)))
    rows = rows.persist()  # every step reads it
    try:
        learner.update_table(rows, features, "clean_", steps)
    finally:
        rows.unpersist()
    return learner.weights, learner.intercept


class _Sample:
    """The labelled rows drawn so far: arrays while few, a table beyond."""

    def __init__(self, key, features, label, total):
        self.key, self.features, self.label = key, list(features), label
        self.small = total <= DRIVER_SAMPLE
        self.x = np.zeros((0, len(self.features)))
        self.y = self.dirty = self.times = np.zeros(0)
        self.table: DataFrame | None = None
        self.parts = 0

    def add(self, drawn: DataFrame) -> tuple[list, int]:
        """Returns (drawn keys, dirty draws)."""
        if self.small:
            return self.add_rows(drawn.select(self.key, *self.features, self.label, "is_dirty",
                                              "n_draws").collect())  # one batch
        self.parts += 1
        part = cut_lineage(drawn.withColumn("copy_", F.explode(F.sequence(
            F.lit(1), F.col("n_draws").cast("int")))).drop("copy_", "n_draws"))
        self.table = part if self.table is None else self.table.unionByName(part)
        if self.parts % CUT_EVERY == 0:
            self.table = cut_lineage(self.table)
        rows = part.select(self.key, "is_dirty").collect()  # one batch
        return sorted({r[0] for r in rows}), sum(r[1] for r in rows)

    def add_rows(self, rows: Sequence[tuple]) -> tuple[list, int]:
        """:meth:`add` of (key, features, label, is_dirty, n_draws) to the arrays."""
        d = len(self.features)
        self.x = np.vstack([self.x, np.array([r[1:1 + d] for r in rows], float).reshape(-1, d)])
        self.y = np.append(self.y, [float(r[1 + d]) for r in rows])
        self.dirty = np.append(self.dirty, [bool(r[2 + d]) for r in rows]).astype(bool)
        self.times = np.append(self.times, [float(r[3 + d]) for r in rows])
        return [r[0] for r in rows], sum(r[3 + d] for r in rows if r[2 + d])

    def fit_classifier(self, learner: _Learner, steps: int) -> bool:
        if self.small:
            if not self.dirty.any():
                return False
            # refitted from zero on every batch, as the table form does
            learner.weights, learner.intercept = np.zeros(len(self.features)), 0.0
            learner.update(self.x, np.where(self.dirty, -1.0, 1.0), self.times, steps)
            return True
        found = fit_error_classifier(self.table, self.features, steps)
        if found is None:
            return False
        learner.weights, learner.intercept = found
        return True

    def fit_model(self, learner: _Learner, steps: int):
        if self.small:
            ok = ~self.dirty
            learner.update(self.x[ok], self.y[ok], self.times[ok], steps)
        else:
            learner.update_table(self.table.filter(~F.col("is_dirty")), self.features,
                                 self.label, steps)

    def score(self, learner: _Learner, task: str) -> float | None:
        """R^2 or accuracy on the clean sampled rows."""
        if not self.small:
            rows = self.table.filter(~F.col("is_dirty"))
            f = F.expr(score_text(self.features, learner.weights, learner.intercept))
            if task == "classification":
                return rows.agg(F.avg(F.when((f > 0) == (F.col(self.label) > 0), 1.0)
                                      .otherwise(0.0))).collect()[0][0]
            error = F.sum((F.col(self.label) - f) * (F.col(self.label) - f))
            return rows.agg(F.lit(1.0) - F.try_divide(
                error, F.var_pop(self.label) * F.count("*"))).collect()[0][0]
        ok = ~self.dirty.astype(bool)
        if not ok.any():
            return None
        x, y, times = self.x[ok], self.y[ok], self.times[ok]
        f = x @ learner.weights + learner.intercept
        if task == "classification":
            return float(np.average((f > 0) == (y > 0), weights=times))
        mean = np.average(y, weights=times)
        spread = float(times @ ((y - mean) * (y - mean)))
        return 1.0 - float(times @ ((y - f) * (y - f))) / spread if spread else None


def active_clean(prepared: DataFrame, key: str, features: Sequence[str], label: str, seed,
                 task: str = "regression", batch: int = BATCH, total: int = TOTAL,
                 threshold: float = DIRTY_THRESHOLD, stop_below: int = BATCH,
                 classifier_steps: int = 100, model_steps: int = 5, first_steps: int = 200,
                 mode: str = "reference") -> tuple[int, float | None]:
    """(dirty rows drawn after the initial batch, score on the clean sampled rows)."""
    rows = cut_lineage(prepared)
    packed = _packed(rows, key, features, label)
    try:
        return _clean(rows, packed, key, list(features), label, seed, task, batch, total, threshold,
                      stop_below, classifier_steps, model_steps, first_steps, mode)
    finally:
        packed.unpersist()


def _clean(rows: DataFrame, packed: DataFrame, key: str, features: list[str], label: str, seed, task: str = "regression",
           batch: int = BATCH, total: int = TOTAL, threshold: float = DIRTY_THRESHOLD, stop_below: int = BATCH,
           classifier_steps: int = 100, model_steps: int = 5, first_steps: int = 200,
           mode: str = "reference") -> tuple[int, float | None]:
    """:func:`active_clean` of rows that are cheap to read again.

    With a small sample, one pass over the packed rows counts those left and
    brings the rows that the next draw may take.
    """
    d = len(features)
    loss, l2 = ("hinge", 1e-6) if task == "classification" else ("squared", 0.0)
    model, detector = _Learner(loss, l2, np.zeros(d)), _Learner("log", 1e-6, np.zeros(d))
    training, labelled = (_Sample(key, features, label, total) for _ in range(2))
    pool = _Pool(rows, key, features, threshold, mode)
    short = training.small and batch <= TOP_ROWS
    steps = len(range(batch, total, batch))

    def look(step: int) -> tuple[int, list[tuple]]:
        return pool.ahead(packed, f"{seed}/{step}", batch) if short else (pool.count(), [])

    def taken(step: int) -> list[tuple]:
        return [(*r, n) for r, n in zip(next_rows, draw_times(f"{seed}/{step}", batch, left))]

    left, next_rows = look(0)
    keys, _ = training.add_rows(taken(0)) if short else training.add(pool.draw(f"{seed}/0", batch, left))
    training.fit_model(model, first_steps)
    pool.drop(keys)

    cleaned = 0
    left, next_rows = look(1)
    for step in range(1, steps + 1):
        drawn = None if short else pool.draw(f"{seed}/{step}", batch, left)
        keys, dirty = labelled.add_rows(taken(step)) if short else labelled.add(drawn)
        if training.small:
            _copy_last(labelled, training, len(keys))
        else:
            training.add(drawn)
        cleaned += int(dirty)
        pool.drop(keys)
        if labelled.fit_classifier(detector, classifier_steps):
            pool.keep(detector.weights, detector.intercept)
        training.fit_model(model, model_steps)
        left, next_rows = look(step + 1)
        if left < stop_below:
            break
    return cleaned, training.score(model, task)


def _copy_last(source: _Sample, target: _Sample, rows: int):
    target.x = np.vstack([target.x, source.x[-rows:]]) if rows else target.x
    for name in ("y", "dirty", "times"):
        setattr(target, name, np.append(getattr(target, name), getattr(source, name)[-rows:])
                if rows else getattr(target, name))


def active_clean_runs(prepared: DataFrame, key: str, features: Sequence[str], label: str,
                      seeds: Sequence[int], **options) -> DataFrame:
    """One row per repetition.

    Repetitions share one held table and run side by side, since each is a
    chain of short jobs.
    """
    shared_folder(prepared.sparkSession)
    kept = prepared.select(key, *features, label, "is_dirty").persist(StorageLevel.MEMORY_AND_DISK)

    packed = _packed(kept, key, features, label)

    def run(seed) -> tuple:
        return (int(seed), *_clean(kept, packed, key, list(features), label, seed, **options))
    try:
        packed.count()  # held once, not by every repetition
        with ThreadPoolExecutor(min(RUNS_AT_ONCE, max(1, len(seeds)))) as side_by_side:
            rows = list(side_by_side.map(run, seeds))
    finally:
        packed.unpersist()
        kept.unpersist()
    return prepared.sparkSession.createDataFrame(
        rows, "seed int, n_cleaned bigint, score double")


def average_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.avg("n_cleaned").alias("avg_cleaned"), F.avg("score").alias("avg_score"))


