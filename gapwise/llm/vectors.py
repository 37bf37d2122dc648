"""Vectors as double-precision bytes, checked once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> F.Column:
    """True for a vector that is not null, not zero and wholly finite."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(column, lambda x: x != 0), F.lit(False))


def packed_kind(df: DataFrame, column: str) -> str:
    """The narrowest kind of numbers that holds all of an array column: floats of 4 or 8 bytes."""
    return "<f4" if dict(df.dtypes)[column] == "array<float>" else "<f8"


def pack(df: DataFrame, column: str, kind: str = "<f8") -> DataFrame:
    """Replace an array column of numbers by the bytes of its floats (-0.0 as 0.0)."""
    at = df.columns.index(column)
    schema = ", ".join(f"`{n}` {'binary' if n == column else t}" for n, t in df.dtypes)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0
            ends = np.cumsum([0] + (lists.value_lengths().to_pylist()))
            packed = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            columns = [pa.array(packed, pa.binary()) if i == at else batch.column(i)
                       for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return df.mapInArrow(convert, schema)


def matrix(packed, kind: str = "<f8") -> np.ndarray:
    """A row of doubles for each packed vector, all of one length."""
    packed = list(packed)
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64, copy=False)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one, zero rows as they are.

    Each row is first scaled by a power of two, which rounds nothing, so that
    squares of very small or large components neither vanish nor overflow.
    """
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
