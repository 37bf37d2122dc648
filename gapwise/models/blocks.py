"""Rows packed as blocks of doubles, for learners that pass over them many times.

A block is one row of three byte strings (features, labels, memberships or
owners) of at most a few megabytes, kept in memory or on disk.  A pass hands every block to a
numpy function; a task adds up what its blocks give and the tasks' vectors are
added up in Spark, cut into chunks when they are long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import quoted

BLOCK_BYTES = 4 << 20
CHUNK = 1 << 16  #: doubles of a vector that travel together
DIRECT_BYTES = 16 << 20  #: tasks' vectors up to this size in all go to the driver as they are

Part = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _doubles(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, width)


class Blocks:
    """The rows that a learner reads: features, label and which of its models a row trains.

    ``members`` are predicates, one for each model.  Where a row trains either one
    model or all of them, ``owner`` is its model's number, or NULL for all; a block
    then holds one number a row, in rising order, and -1 for NULL.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, members: Sequence[Column] = (),
                 held: bool = True, owner: Column | None = None):
        self.width, self.models, self.owned = len(features), len(members), owner is not None
        width, owned = self.width, self.owned
        cells = F.array(*[F.expr(f"cast({quoted(f)} AS double)") for f in features])
        marks = F.array(*[m.cast("boolean") for m in members]) if members else F.lit(None).cast("array<boolean>")
        if owned:
            marks = F.array(F.coalesce(owner.cast("int"), F.lit(-1)))
        rows = df.select(cells.alias("x"), F.expr(f"cast({quoted(label)} AS double)").alias("y"), marks.alias("m"))
        some = max(1, BLOCK_BYTES // (8 * (width + 1)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, some):
                    batch = whole.slice(start, some)
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                    if owned:
                        marks = batch.column(2).flatten().to_numpy().astype(np.int32)
                        order = np.argsort(marks, kind="stable")
                        x, y, marks = x.reshape(-1, width)[order], y[order], marks[order]
                    else:
                        marks = np.packbits(batch.column(2).flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v.tobytes()], pa.binary()) for v in (x, y, marks)], ["x", "y", "m"])
        packed = rows.mapInArrow(pack, "x binary, y binary, m binary")
        self.rows = packed.persist(StorageLevel.MEMORY_AND_DISK) if held else packed

    def close(self) -> None:
        self.rows.unpersist()

    def total(self, part: Part, size: int) -> np.ndarray:
        """The sum over all blocks of the vectors (``size`` doubles) that ``part`` makes of them."""
        each, chunk = _reader(self.width, self.models, self.owned), CHUNK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value = None
            for x, y, m in each(batches):
                made = part(x, y, m)
                value = made if value is None else value + made
            if value is not None:
                for i in range(-(-len(value) // chunk)):
                    yield _chunk(i, value[i * chunk:(i + 1) * chunk])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    made = np.frombuffer(raw, np.float64)
                    sums[i] = sums[i] + made if i in sums else made
            for i, value in sums.items():
                yield _chunk(i, value)
        parts = self.rows.mapInArrow(run, "i int, v binary")
        if 8 * size * self.rows.rdd.getNumPartitions() > DIRECT_BYTES:
            spark = parts.sparkSession
            reducers = min(-(-size // chunk), max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
            parts = parts.repartition(reducers, "i").mapInArrow(add, "i int, v binary")
        out = np.zeros(size)
        for row in parts.toArrow().to_pylist():
            out[row["i"] * chunk:(row["i"] + 1) * chunk] += np.frombuffer(row["v"], np.float64)
        return out


def beyond_doubt(cells: np.ndarray, y: np.ndarray, points: np.ndarray, width: float):
    """Rows that no point's margin cuts: (open rows, sure rows, 1 - y f of the sure ones at the mean point, that point).

    Points lie in a box about their mean, so a row's 1 - y f moves by at most
    |cells| . (half the box).  Sure rows keep it at ``width`` or more at every
    point, where the smoothed hinge is linear; rows that are neither keep it
    at 0 or less and have no loss.  Where the points are close, few are open.
    """
    middle = points.mean(axis=1)
    reach = np.abs(cells) @ np.abs(points - middle[:, None]).max(axis=1)
    short = 1 - y * (cells @ middle)
    sure = short - reach >= width
    return ~sure & (short + reach > 0), sure, short[sure], middle


def owned_sums(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, sum of each one's values) of rows in the order of their owners."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    return owner[first], np.add.reduceat(values, first, axis=0) if len(owner) else values


def _reader(width: int, models: int, owned: bool = False):
    """How a task reads blocks, without the session that :class:`Blocks` holds."""
    def each(batches):
        for batch in batches:
            for x, y, m in zip(*[c.to_pylist() for c in batch.columns]):
                y = np.frombuffer(y, np.float64)
                yield (_doubles(x, width) if width else np.zeros((len(y), 0)), y,
                       np.frombuffer(m, np.int32) if owned else np.unpackbits(np.frombuffer(m, np.uint8), count=len(y) * models).astype(bool).reshape(len(y), models))
    return each


def _chunk(i: int, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["i", "v"])


def triangular(df: DataFrame, features: Sequence[str], label: str, intercept: bool) -> tuple[int, np.ndarray]:
    """(rows, R) with R'R = [X, 1?, y]'[X, 1?, y], by a tree of QR steps.

    A task folds its blocks one after another into one triangle; triangles are
    folded again in a second layer, and the driver folds the last few.  The
    condition number is that of the columns, not its square.
    """
    blocks = Blocks(df, features, label, held=False)
    each = _reader(blocks.width, 0)
    size = len(features) + int(intercept) + 1

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, r = 0, np.zeros((0, size))
        for x, y, _ in each(batches):
            rows += len(y)
            r = np.linalg.qr(np.vstack([r, np.column_stack([x, *([np.ones(len(y))] if intercept else []), y])]), mode="r")
        if rows:
            yield _triangle(rows, r)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, r = _folded(batches, size)
        if rows:
            yield _triangle(rows, r)
    parts = blocks.rows.mapInArrow(local, "n long, r binary")
    many = blocks.rows.rdd.getNumPartitions()
    if many > 16:
        parts = parts.repartition(int(many ** 0.5)).mapInArrow(fold, "n long, r binary")
    return _folded(parts.toArrow().to_batches(), size)


def _triangle(rows: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["n", "r"])


def _folded(batches, size: int) -> tuple[int, np.ndarray]:
    rows, r = 0, np.zeros((0, size))
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows, r = rows + n, np.linalg.qr(np.vstack([r, _doubles(raw, size)]), mode="r")
    return rows, r
