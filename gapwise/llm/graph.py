"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import forget, keep

#: Edges that one task settles at the end: 16 MB.
SETTLED = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and the least node that each reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def settled(edges: DataFrame) -> DataFrame:
    """(node, into) of at most SETTLED edges, in one task."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        nodes, roots = roots_of(table.column(0).to_numpy(), table.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "into"])
    return edges.coalesce(1).mapInArrow(settle, "node long, into long")


def components(edges: DataFrame, at_once: int = SETTLED) -> DataFrame:
    """(node, component): the least node reachable, for all nodes of ``edges`` (a, b).

    Contraction: every node joins the first of itself and its neighbours in a
    random order, edges inside a group vanish, and the rest repeat on the
    groups.  Each round removes a constant share of the nodes on average,
    whatever the shape of the graph.  Minima combine before the shuffle and hot
    nodes meet plain equi-joins, which Spark can split.  The last ``at_once``
    edges are one task's work, whose size is thereby bounded.
    """
    spark = edges.sparkSession
    flat = keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    steps: list[DataFrame] = []
    while (rest := flat.count()) > 0:
        turn = len(steps)
        if rest <= at_once:
            steps.append(keep(settled(flat), "step"))
            forget(spark, flat)
            break
        ways = flat.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
                           .alias("w")).select("w.a", "w.b")
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c).alias("n"))  # noqa: B023, E731
        near = ways.groupBy("a").agg(F.min(order("b")).alias("best"))
        step = keep(near.select(F.col("a").alias("node"), F.least(order("a"), "best")["n"].alias("into")), "step")
        left = step.select(F.col("node").alias("a"), F.col("into").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("into").alias("y"))
        moved = flat.join(left, "a").join(right, "b").where("x != y")
        after = keep(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        forget(spark, flat)
        flat = after
        steps.append(step)
    if not steps:
        return flat.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = steps[0].select("node", F.col("into").alias("root"))
    if len(steps) == 1 and rest:  # one task has settled all
        return roots.withColumnRenamed("root", "component")
    for step in steps[1:]:
        onward = step.select(F.col("node").alias("root"), "into")
        roots = roots.join(onward, "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
