"""Nearest neighbours by inner product along shifted Hilbert curves.

Each curve projects the vectors onto a few random directions, shifts the grid
and sorts by Hilbert key; Spark range-partitions the rows by that key.  Near
vectors tend to be near on some curve, so the windows around a query on all
curves are merged and reranked: that gives 20 good candidates and, with their
worst score, a bar.  The windows on the first curve then widen block by block
over the whole key range; a block whose centre and radius prove that nothing in
it can reach a query's bar is passed over, the others are ranked exactly.  The
answer is therefore complete, also on data without any neighbourhood structure,
where no window of fixed width would do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.store import keep
from gapwise.llm.vectors import matrix, pack, unit_rows, usable
from gapwise.operators.rows import dense_ids

CURVES, AXES, BITS = 3, 6, 8
WINDOW = 512  #: rows of a window step: a query meets its own step and one on either side
BLOCK = 8192  #: rows of a block of the widened windows
SLACK = 1e-9  #: on bars, as a part of the lengths of both vectors: above any rounding of a score


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(x: np.ndarray, curve: int) -> np.ndarray:
    """Keys of vectors on one curve: random directions, shifted grid, Hilbert order."""
    rng = np.random.default_rng(1000 + curve)
    directions = rng.standard_normal((x.shape[1], AXES))
    directions /= np.sqrt((directions ** 2).sum(0))
    flat = np.arctan(unit_rows(x) @ directions * np.sqrt(x.shape[1])) / np.pi + 0.5
    shifted = (flat + rng.random(AXES)) / 2
    return hilbert_keys(np.clip((shifted * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def best(query: np.ndarray, x: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: int, k: int, bar: float,
         slack: float):
    """Ids and scores of the k best candidates: score descending, id ascending, not the query.

    ``scores`` come from a matrix product; those that may be among the best are
    summed again in order of the coordinates, so that equal vectors tie exactly.
    """
    fit = np.flatnonzero((scores >= bar - slack) & (ids != own))
    if len(fit) > k:
        cut = np.partition(scores[fit], len(fit) - k)[len(fit) - k]
        fit = fit[scores[fit] >= cut - slack]
    exact = np.cumsum(x[fit] * query, axis=1)[:, -1] if len(fit) else np.zeros(0)
    order = np.lexsort((ids[fit], -exact))[:k]
    return ids[fit][order], exact[order]


def slack_of(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding may add to or take from a score of each query with rows of ``x``."""
    return SLACK * np.sqrt((queries * queries).sum(1)) * np.sqrt((x * x).sum(1)).max(initial=0.0)


def _ranked(queries: np.ndarray, qids, bars, x: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    out_q, out_v, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    slacks = slack_of(queries, x)
    for start in range(0, len(queries), 256):
        part, own = queries[start:start + 256], slice(start, start + 256)
        for query, row, q, bar, slack in zip(part, part @ x.T, qids[own], bars[own], slacks[own]):
            found, scores = best(query, x, row, ids, q, k, bar, slack)
            out_q.append(np.full(len(found), q, np.int64))
            out_v.append(found)
            out_s.append(scores)
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v),
                         "score": np.concatenate(out_s)})


def window_candidates(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from the windows of all curves; rows: id, v, asks."""
    def spread(frames):
        for frame in frames:
            if len(frame):
                x = matrix(frame["v"])
                for curve in range(CURVES):
                    yield frame.assign(curve=curve, key=curve_keys(x, curve))
    keyed = rows.mapInPandas(spread, "id long, v binary, asks boolean, curve int, key long")
    order = ["curve", "key", "id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def steps():
            held = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                while held.num_rows >= WINDOW:
                    yield held.slice(0, WINDOW)
                    held = held.slice(WINDOW)
            if held is not None and held.num_rows:
                yield held

        def answer(step, around):
            near = pa.concat_tables([s for s in around if s is not None])
            x, ids = matrix(near["v"].to_pylist()), near["id"].to_numpy()
            curve = near["curve"].to_numpy()
            asks = step.filter(step["asks"])
            for c in np.unique(asks["curve"].to_numpy()):
                own = asks.filter(pa.compute.equal(asks["curve"], pa.scalar(int(c), pa.int32())))
                same = curve == c
                q = own["id"].to_numpy()
                found = _ranked(matrix(own["v"].to_pylist()), q, np.full(len(q), -np.inf), x[same], ids[same], k)
                yield pa.RecordBatch.from_pandas(found, preserve_index=False)
        before = now = None
        for after in steps():
            if now is not None:
                yield from answer(now, (before, now, after))
            before, now = now, after
        if now is not None:
            yield from answer(now, (before, now))
    return placed.mapInArrow(slide, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, asks: F.Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other vectors of every row where ``asks`` holds.

    ``asks`` is a condition on the columns of ``df``.  Returns (query_id, rank,
    vec_id, score): score is the inner product in double precision of the
    vectors as they are, rank 1 the largest, ties to the smaller id; a query
    with fewer than k candidates gets them all.  Null, zero and not wholly
    finite vectors and null ids take no part, vectors of different length do not
    meet, and rows that share an id are not candidates of each other.  Other
    columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"),
                     F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).withColumn("dims", F.size("v"))
    packed = keep(pack(rows, "v"), "vectors")
    lengths = [r[0] for r in packed.groupBy("dims").count().collect()]
    found = None
    for dims in sorted(lengths):
        own = _nearest(packed.where(F.col("dims") == dims).select("id", "v", "asks"), k)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    candidates = window_candidates(rows, k).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bars = top.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf")).alias("bar"))

    def first_key(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(key=curve_keys(matrix(frame["v"]), 0))
    keyed = rows.mapInPandas(first_key, "id long, v binary, asks boolean, key long")
    placed = keep(dense_ids(keyed, ["key", "id"]).select(
        "id", "v", "asks", F.floor(F.col("dense_id") / BLOCK).cast("int").alias("block")), "curve")
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    groups = max(1, blocks // 4)
    asked = placed.where("asks").join(bars, placed["id"] == bars["query_id"], "left").select(
        "id", "v", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"), F.pmod("block", F.lit(groups)).alias("part"))
    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = placed.select(*[F.col(c).alias(c) for c in ("id", "v", "block")], F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def rank(_, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return _ranked(np.zeros((0, 1)), [], [], np.zeros((0, 1)), np.zeros(0, np.int64), k)
        x, q = matrix(block["v"]), matrix(queries["v"])
        centre = x.mean(0)
        radius = np.sqrt(((x - centre) ** 2).sum(1)).max()
        most = q @ centre + np.sqrt((q * q).sum(1)) * radius
        open_ = most + slack_of(q, x) >= queries["bar"].to_numpy()
        return _ranked(q[open_], queries["id"].to_numpy()[open_], queries["bar"].to_numpy()[open_],
                       x, block["id"].to_numpy(), k)
    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        rank, "query_id long, vec_id long, score double")
