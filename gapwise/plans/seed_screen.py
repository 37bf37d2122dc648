"""Corruption seeds that surely leave no certain linear SVM, many of them in one pass.

Seeds take few rows, so their models lie close to the model of all rows.  Rows
that have no loss anywhere in a box around it train none of them; the others,
the open rows, are few.  One pass over the keys finds which open rows each seed
takes; its model is then fitted on the open rows left to it.  If that model lies
inside the box it is the model of all rows the seed leaves, since a convex
function has no other minimum.  A seed is ruled out when this model has weight
on the blanked column or a margin at a taken row, both by a clear amount; all
others are for the full check to decide.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.digests import Keys, pack_rows, unpacked
from gapwise.functions.hashing import RANK_BITS
from gapwise.functions.linear import number, quoted, score_text
from gapwise.models.linear_model import LinearModel
from gapwise.models.newton import fit_nearby, fit_one
from gapwise.operators.sample import pick_column
from gapwise.operators.select_rank import share_of

OPEN_ROWS = 50_000   # beyond, seeds are left to the full check
SPREAD = 4.0         # the box over the distance of the models seen
LEAST_SPREAD = 1e-3
CLEAR = 1e-3         # far more than the solver leaves open
DEVIATIONS = 8.0     # window of ranks in which a seed's boundary is looked for
TOGETHER = 16        # seeds fitted at a time


class SeedScreen:
    """``seen`` are models of a few seeds, which tell how far others may lie."""

    def __init__(self, df: DataFrame, key: str, features: Sequence[str], label: str, rate: float, l2: float,
                 wtol: float, seen: Sequence[LinearModel]):
        self.features, self.l2, self.wtol = list(features), l2, wtol
        names = [key, *features, label]
        sound = " AND ".join([f"{quoted(c)} IS NOT NULL" for c in names]
                             + [f"NOT isnan(cast({quoted(c)} AS double))" for c in names[1:]])
        self.n, good = df.selectExpr("count(*)", f"count_if({sound})").collect()[0]
        self.taken = min(max(int(share_of(rate)(self.n)), 0), self.n)
        self.keys = None
        if good != self.n or not 0 < self.taken < self.n:
            return
        model = fit_one(df, features, label, l2)
        self.at = np.append(model.weights, model.intercept)
        away = [np.abs(np.append(m.weights, m.intercept) - self.at) for m in seen]
        self.box = SPREAD * np.max(away, axis=0) + LEAST_SPREAD * np.abs(self.at).max()
        reach = score_text([f"a{i}" for i in range(len(self.features))], self.box[:-1], self.box[-1])
        open_rows = df.selectExpr(
            f"cast({quoted(key)} AS string) AS t", *[f"cast({quoted(f)} AS double) AS c{i}" for i, f in enumerate(features)],
            f"cast({quoted(label)} AS double) AS y",
            f"1D - {quoted(label)} * {score_text(features, model.weights, model.intercept)} AS short",
            *[f"abs(cast({quoted(f)} AS double)) AS a{i}" for i, f in enumerate(features)])
        rows = open_rows.filter(f"short + {reach} + {number(1e-9)} > 0").select(
            "t", *[f"c{i}" for i in range(len(self.features))], "y").limit(OPEN_ROWS + 1).toArrow()
        if rows.num_rows > OPEN_ROWS:
            return
        self.open_texts = rows.column("t").combine_chunks()
        self.x = np.column_stack([rows.column(f"c{i}").to_numpy() for i in range(len(self.features))])
        self.y = rows.column("y").to_numpy()
        self.keys = pack_rows(df.select(F.col(key).cast("string").alias("t"))).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        if self.keys is not None:
            self.keys.unpersist()

    def ruled_out(self, seeds: Sequence[int]) -> set[int]:
        if self.keys is None:
            return set()
        share, scale = self.taken / self.n, float(1 << RANK_BITS)
        half = DEVIATIONS * (share * (1 - share) / self.n) ** 0.5
        window = int(max(0.0, share - half) * scale), int(min(1.0, share + half) * scale)
        seeds, texts = [int(s) for s in seeds], self.open_texts
        low, high = (np.uint64(w) for w in window)

        def bounds(ranks: np.ndarray) -> np.ndarray:
            """Ranks at which rows are counted: around each open row in the window, and its ends."""
            inside = ranks[(ranks > low) & (ranks <= high)]
            return np.unique(np.concatenate([inside, inside - np.uint64(1), [low, high]]).astype(np.uint64))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Keys(texts)
            marks = [bounds(near.ranks(seed)) for seed in seeds]
            sums = [np.zeros(len(m), np.int64) for m in marks]
            for block in unpacked(batches):
                keys = Keys(block.column(0))
                for i, seed in enumerate(seeds):
                    ranks = keys.ranks(seed)
                    place = np.searchsorted(marks[i], ranks[ranks <= high])
                    sums[i] += np.bincount(place, minlength=len(marks[i])).cumsum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(seeds, [len(m) for m in marks]), pa.int64()),
                 pa.array(np.concatenate(marks).astype(np.int64)), pa.array(np.concatenate(sums))], ["s", "t", "c"])
        judge = self._judge(bounds)
        counted = (self.keys.mapInArrow(count, "s long, t long, c long").groupBy("s", "t").agg(F.sum("c").alias("c"))
                   .groupBy("s").agg(F.expr("array_sort(collect_list(struct(t, c))).c").alias("c")))
        tasks = self.keys.sparkSession.sparkContext.defaultParallelism
        return {r["s"] for r in counted.repartition(tasks).mapInArrow(judge, "s long").collect()}

    def _judge(self, bounds):
        texts, x, y, n, taken, box = self.open_texts, self.x, self.y, self.n, self.taken, self.box
        at, features, l2, wtol = self.at, self.features, self.l2, self.wtol

        def hits(ranks: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
            """Open rows that a seed takes; None where its boundary is not in the window."""
            marks = bounds(ranks)
            if not counts[0] < taken <= counts[-1] or counts[-1] - counts[0] > 40 * taken ** 0.5 + 100:
                return None
            last = marks[np.searchsorted(counts, taken)]  # as many rows as are taken are up to here
            return ranks <= last

        def clear(seed: int, hit: np.ndarray, point: np.ndarray | None) -> bool:
            if point is None or (np.abs(point - at) >= box).any():
                return False
            j = features.index(pick_column(features, seed))
            if abs(point[j]) > wtol + CLEAR:
                return True
            weights = point[:-1].copy()
            weights[j] = 0.0
            return bool((y[hit] * (x[hit] @ weights) < 1.0 - CLEAR).any())

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Keys(texts)
            waiting = ((s, np.array(c)) for b in batches for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            found = []
            while some := list(itertools.islice(waiting, TOGETHER)):
                known = [(s, h) for s, c in some if (h := hits(near.ranks(s), c)) is not None]
                if known:
                    points = fit_nearby(x, y, ~np.column_stack([h for _, h in known]), n - taken, at, l2)
                    found += [s for (s, h), p in zip(known, points) if clear(s, h, p)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["s"])
        return judge
