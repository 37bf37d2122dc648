"""Exact nearest-neighbour imputation with the gap-aware Euclidean distance.

For a row with a gap in column t, the distance to a donor (a row with t present)
uses the coordinates present in both, scaled by d / (number used).  The value is
the mean of t over the k nearest donors, ties to the smaller donor key.

Comparing every gap with every donor does not scale, so the search is exact but
pruned:

* rows that agree on all other coordinates are interchangeable, so donors are
  reduced to the k smallest keys per distinct coordinate vector (limited inside
  each task before the shuffle, so a hot vector costs nothing) and gaps to
  distinct vectors;
* donors are placed in a grid of quantile cells over up to three coordinates;
  a gap searches its home cell first, and the k-th distance found there decides
  which other cells can still hold a nearer donor;
* cells are split into chunks of bounded size on both sides; a task compares one
  chunk pair with numpy and returns only k candidates per gap, never pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted
from gapwise.operators.profile import null_counts
from gapwise.session import cut_lineage

GRID_COLUMNS = 3
CELL_DONORS = 2_000       # aimed-at distinct donor vectors per cell
CHUNK_DONORS = 20_000     # donors one task compares at a time
CHUNK_GAPS = 20_000
MAX_CELLS = 100_000       # bounds the cell table held by every task
EDGE_ERROR = 20_000       # accuracy of the quantile sketch behind the grid


class Grid:
    """Quantile slabs per grid coordinate and counts per cell; bounded by MAX_CELLS."""

    def __init__(self, axes: list[int], edges: list[np.ndarray], width: int):
        self.axes, self.edges, self.width = axes, edges, width
        self.cells: dict[tuple, int] = {}

    def column(self, names: Sequence[str]):
        """Cell of a row as a string of slab numbers; a NULL coordinate is slab -1."""
        slabs = []
        for axis, edges in zip(self.axes, self.edges):
            value = F.col(names[axis])
            slab = F.lit(0)
            if len(edges):
                slab = F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e < value))
            slabs.append(F.when(value.isNull(), F.lit(-1)).otherwise(slab).cast("string"))
        return F.concat_ws(",", *slabs) if slabs else F.lit("")

    def lower_bounds(self, row: np.ndarray) -> list[np.ndarray]:
        """Per axis the squared distance to each slab, slab -1 first; 0 where undefined."""
        found = []
        for axis, edges in zip(self.axes, self.edges):
            slabs = len(edges) + 1
            bound = np.zeros(slabs + 1)
            if not np.isnan(row[axis]):
                low = np.concatenate([[-np.inf], edges])
                high = np.concatenate([edges, [np.inf]])
                away = np.maximum(0.0, np.maximum(low - row[axis], row[axis] - high))
                bound[1:] = away * away
            found.append(bound)
        return found


def _build_grid(donors: DataFrame, names: Sequence[str], total: int) -> Grid:
    aim = min(max(1, total // CELL_DONORS), MAX_CELLS)
    axes = list(range(min(GRID_COLUMNS, len(names)))) if aim > 1 else []
    edges: list[np.ndarray] = []
    if axes:
        per_axis = max(1, int(aim ** (1.0 / len(axes))))
        shares = [i / per_axis for i in range(1, per_axis)]
        if shares:
            row = donors.agg(*[F.percentile_approx(names[a], shares, EDGE_ERROR)
                               for a in axes]).collect()[0]
            edges = [np.unique(np.array(r if r is not None else [], float)) for r in row]
        else:
            edges = [np.array([]) for _ in axes]
    return Grid(axes, edges, len(names))


def _compare(names, k, d):
    """cogroup function: k best donors per gap of one chunk pair."""
    def run(gaps: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(gaps) and len(donors):
            keys = donors["donor"].to_numpy()
            values = donors["value"].to_numpy(float)
            q = gaps[names].to_numpy(float)
            c = donors[names].to_numpy(float)
            step = max(1, 2_000_000 // len(c))
            for at in range(0, len(q), step):
                block = q[at:at + step]
                total = np.zeros((len(block), len(c)))
                used = np.zeros((len(block), len(c)))
                for j in range(len(names)):
                    gap = block[:, j][:, None] - c[:, j][None, :]
                    both = ~np.isnan(gap)
                    total += np.where(both, gap * gap, 0.0)
                    used += both
                with np.errstate(divide="ignore", invalid="ignore"):
                    distance = np.where(used > 0, total * (d / used), np.inf)
                for i in range(len(block)):
                    near = np.flatnonzero(np.isfinite(distance[i]))
                    if len(near) > k:
                        kth = np.partition(distance[i][near], k - 1)[k - 1]
                        near = near[distance[i][near] <= kth]
                    near = near[np.lexsort((keys[near], distance[i][near]))][:k]
                    out.append((gaps["gap"].iat[at + i], distance[i][near], keys[near],
                                values[near]))
        return pd.DataFrame(out, columns=["gap", "distance", "donor", "value"])
    return run


def _search(gaps: DataFrame, donors: DataFrame, names, k, d, key_type) -> DataFrame:
    """k best donors per gap over the (cell, chunk, part) pairs given by both sides."""
    schema = (f"gap bigint, distance array<double>, donor array<{key_type}>, "
              "value array<double>")
    keys = ["cell", "chunk", "part"]
    found = gaps.groupBy(*keys).cogroup(donors.groupBy(*keys)).applyInPandas(
        _compare(list(names), k, float(d)), schema)
    return found.select("gap", F.arrays_zip("distance", "donor", "value").alias("best"))


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Best k over the chunks of a gap; each chunk contributed at most k entries."""
    return found.groupBy("gap").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _fan_out(rows: DataFrame, of_gaps: bool) -> DataFrame:
    """Give every row its own chunk and copies for each chunk of the other side."""
    own, other = ("part", "chunk") if of_gaps else ("chunk", "part")
    mine = F.pmod(F.xxhash64("gap" if of_gaps else "donor"), F.col(f"{own}s")).cast("int")
    return (rows.withColumn(own, mine)
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .drop("chunks", "parts"))


def impute_knn_column(df: DataFrame, key: str, features: Sequence[str], target: str,
                      donors_from: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(key, imputed) for the rows of ``df`` whose ``target`` is missing."""
    spark = df.sparkSession
    source = df if donors_from is None else donors_from
    others = [f for f in features if f != target]
    names = [f"c{i}" for i in range(len(others))]
    d = len(features)
    key_type = dict(source.dtypes)[key]
    if not others:
        mean = source.agg(F.avg(F.col(target).cast("double"))).collect()[0][0]
        return df.filter(F.col(target).isNull()).select(key, F.lit(mean).alias("imputed"))
    cells_of = [f"cast({quoted(f)} AS double) AS {n}" for f, n in zip(others, names)]

    same = Window.partitionBy(*names).orderBy("donor")
    donors = (source.filter(F.col(target).isNotNull())
              .selectExpr(f"{quoted(key)} AS donor", f"cast({quoted(target)} AS double) AS value",
                          *cells_of)
              .withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k).drop("nth"))
    donors = cut_lineage(donors)
    queries = df.filter(F.col(target).isNull()).selectExpr(quoted(key), *cells_of)
    vectors = queries.select(*names).distinct()
    gaps = cut_lineage(vectors.withColumn("gap", F.monotonically_increasing_id()))

    total = donors.count()
    grid = _build_grid(donors, names, total)
    donors = donors.withColumn("cell", grid.column(names))
    gaps = gaps.withColumn("home", grid.column(names))
    donor_cells = {r[0]: r[1] for r in donors.groupBy("cell").count().collect()}
    grid.cells = {tuple(int(s) for s in c.split(",") if s): n for c, n in donor_cells.items()}
    chunk_of = {c: math.ceil(n / CHUNK_DONORS) for c, n in donor_cells.items()}

    def visit(pending: DataFrame) -> DataFrame:
        """Compare (gap, cell) visits; counts per cell size the chunks on both sides."""
        waiting = {r[0]: r[1] for r in pending.groupBy("cell").count().collect()}
        sizes = [(c, chunk_of[c], math.ceil(n / CHUNK_GAPS)) for c, n in waiting.items()
                 if c in chunk_of]

        def plan() -> DataFrame:
            # one small row per grid cell, so MAX_CELLS bounds what is broadcast
            return F.broadcast(spark.createDataFrame(sizes, "cell string, chunks int, parts int"))

        left = _fan_out(pending.join(plan(), "cell"), of_gaps=True)
        right = _fan_out(donors.join(plan(), "cell"), of_gaps=False)
        return _search(left, right, names, k, d, key_type)

    first = visit(gaps.withColumn("cell", F.col("home")))
    if not grid.axes:
        best = _merge(first, k)
    else:
        best = _widen(gaps, first, visit, grid, names, k, d)
    answer = best.select("gap", F.expr(
        "try_divide(aggregate(best, 0D, (s, b) -> s + b.value), size(best))").alias("answer"))
    mean = source.agg(F.avg(F.col(target).cast("double"))).collect()[0][0]
    by_vector = gaps.join(answer, "gap", "left").select(
        *[F.col(n).alias(f"v{n}") for n in names], "answer")
    matched = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"v{n}")) for n in names])
    return (queries.join(by_vector, matched, "left")
            .select(key, F.coalesce("answer", F.lit(mean)).alias("imputed")))


def _widen(gaps: DataFrame, first: DataFrame, visit, grid: Grid, names, k: int, d: int):
    """Second round: visit exactly the cells that can hold a donor nearer than found so far."""
    first = cut_lineage(first)
    reached = _merge(first, k).select("gap", F.when(
        F.size("best") >= k, F.expr(f"element_at(best, {k}).distance")).alias("reach"))
    cells = grid.cells
    columns = list(names)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[columns].to_numpy(float)
            at, found = [], []
            for i, (row, home, reach) in enumerate(zip(rows, batch["home"], batch["reach"])):
                present = int((~np.isnan(row)).sum())
                if not present:
                    continue
                # the scale factor is smallest when all coordinates of the gap are used
                limit = math.inf if reach is None or np.isnan(reach) else reach * present / d
                limit *= 1.0 + 1e-9
                bounds = grid.lower_bounds(row)
                slabs = [[(int(s) - 1, b[s]) for s in np.flatnonzero(b <= limit)]
                         for b in bounds]
                if math.prod(len(s) for s in slabs) <= len(cells):
                    picks = (tuple(s for s, _ in combo) for combo in itertools.product(*slabs)
                             if sum(b for _, b in combo) <= limit)
                    near = [c for c in picks if c in cells]
                else:
                    near = [c for c in cells
                            if sum(b[s + 1] for b, s in zip(bounds, c)) <= limit]
                names_of = [",".join(str(s) for s in c) for c in near]
                for name in names_of:
                    if name != home:
                        at.append(i)
                        found.append(name)
            out = batch.iloc[at][["gap", *columns]].copy()
            out["cell"] = found
            yield out

    schema = "gap bigint, " + ", ".join(f"{n} double" for n in names) + ", cell string"
    pending = (gaps.join(reached, "gap", "left").select("gap", *names, "home", "reach")
               .mapInPandas(expand, schema))
    second = visit(cut_lineage(pending))
    return _merge(first.unionByName(second), k)


def impute_knn(df: DataFrame, key: str, features: Sequence[str],
               fit_on: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Fill every gap of every feature; donors are the original rows of ``fit_on``."""
    source = df if fit_on is None else fit_on
    _, nulls = null_counts(df, features)
    filled = df
    for target in [f for f in features if nulls[f]]:
        answers = impute_knn_column(df, key, features, target, source, k)
        filled = (filled.join(answers, key, "left")
                  .withColumn(target, F.coalesce(F.col(target), "imputed")).drop("imputed"))
    return filled.select(*df.columns)
