"""Mixing sources to target weights by a splitting tree, in DataFrame operations alone.

Every row falls into one of 256 permuted blocks of its source by a hash of its
id.  Targets follow from the sources' sizes by water-filling.  A source's quota
of whole blocks is exact: its blocks are taken in permuted order up to its
target; the block where the target falls is opened into 256 parts, and the part
where it falls is shared out in proportion.  So each level of the tree handles
counts of at most 256 blocks per source, never rows, and one source that holds
most of the corpus costs no more than another.

The blocks then split among the output shards: at each node of a binary tree a
random half of its blocks goes left, so the number of blocks of each source in
a child is a multivariate hypergeometric draw with the node's exact quotas.
Blocks are disjoint, and rows are shuffled inside their shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.store import keep

WORD = r"[^\x20\x09-\x0D]+"
LEAVES = 256  #: children of a node of the quota tree
SHARDS = 16  #: a power of two
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digits(seed: int, key: Column, first: int) -> Column:
    """A number below 256 from two hexadecimal digits of md5(seed|key)."""
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(hashed, first, 2), 16, 10).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of
    all sizes; a share above MOST_COPIES times its source stops there and the
    excess goes to the others by weight.  The level where no source is above
    follows from the sources in order of cap / weight.  One row per source
    passes through the two orders here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.lit(MOST_COPIES) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (ranked.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
              .withColumn("weight_left", F.sum("weight").over(everything)
                          - F.coalesce(F.sum("weight").over(before), F.lit(0)))
              .withColumn("total", F.sum("source_size").over(everything)))
    level = (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left")
    open_ = filled.withColumn("level", F.when(F.col("cap").cast("double") / F.col("weight") >= level, level))
    lowest = F.first("level", ignorenulls=True).over(by_fill.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    return open_.withColumn("at", lowest).select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")), F.lit(0.0)).alias("target"))


def _split_level(rows: DataFrame, node: list[str], leaf: str, quota: DataFrame) -> DataFrame:
    """Share each node's quota among its leaves in order: (node, leaf, own, part).

    ``own`` words of the leaf's ``part`` are due to it: all of them while the
    quota lasts, none after it, and some where it ends.  A node has at most
    LEAVES leaves, gathered as sums.
    """
    sums = rows.groupBy(*node, leaf).agg(F.sum("size").alias("part"))
    listed = sums.groupBy(*node).agg(F.sort_array(F.collect_list(F.struct(leaf, "part"))).alias("leaves"))
    joined = listed.join(quota, [listed[c].eqNullSafe(quota[c]) for c in node]).select(
        *[listed[c] for c in node], "leaves", "rest")
    begins = F.expr("transform(leaves, (x, i) -> aggregate(slice(leaves, 1, i), cast(0 as bigint), (a, y) -> a + y.part))")
    opened = joined.select(*node, "rest", F.explode(F.arrays_zip("leaves", begins.alias("begin"))).alias("x"))
    return opened.select(*node, F.col(f"x.leaves.{leaf}").alias(leaf), F.col("x.leaves.part").alias("part"),
                         F.greatest(F.lit(0), F.least(F.col("x.leaves.part"), F.col("rest") - F.col("x.begin"))).alias("own"))


def shards_of(blocks: DataFrame, seed: int, shards: int = SHARDS) -> DataFrame:
    """(source, block, shard): random halves, level by level; at most LEAVES blocks per source."""
    tree = blocks.withColumn("shard", F.lit(0))
    level = 1
    while level < shards:
        draw = F.md5(F.concat_ws("|", F.lit(f"{seed}|{level}"), F.coalesce("source", F.lit("\0")), F.col("block")))
        nodes = tree.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(
            draw.alias("draw"), "source", "block"))).alias("own"))
        tree = nodes.select("shard", F.size("own").alias("n"), F.posexplode("own").alias("i", "b")).select(
            "b.source", "b.block", (2 * F.col("shard") + (2 * F.col("i") >= F.col("n")).cast("int")).alias("shard"))
        level *= 2
    return tree


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 11, shards: int = SHARDS) -> DataFrame:
    """(id, source, size, source_size, target, taken, shard, place) of every row.

    ``taken`` words are due to the row: whole copies and, for the few rows where
    a source's target falls, a part of one; never more than MOST_COPIES times
    its size.  Write with ``repartitionByRange("shard", "place")`` to lay out
    the shuffled shards.  Null texts and texts without words have size 0 and are
    never taken; a null source is a source, last in order; rows that share an id
    share its draws; a null id has a draw of its own.
    """
    key = F.col("id")
    rows = keep(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                          word_count(F.col(f"`{text_col}`")).alias("size"))
                .withColumn("block", _digits(seed, key, 1)).withColumn("part", _digits(seed, key, 3)), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = keep(targets(sizes), "targets")
    due = goal.select("source", F.floor(F.col("target")).alias("due"), "source_size").withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("due") / F.col("source_size"))).otherwise(0))
    quota = due.select("source", "copies", (F.col("due") - F.col("copies") * F.col("source_size")).alias("rest"))
    blocks = keep(_split_level(rows, ["source"], "block", quota.select("source", "rest")).select(
        "source", "block", F.col("part").alias("block_size"), "own"), "blocks")
    border = blocks.where("own > 0 and own < block_size").select("source", "block", F.col("own").alias("rest"))
    inside = rows.join(border.select(F.col("source").alias("s"), F.col("block").alias("b")),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left_semi")
    parts = _split_level(inside.withColumnRenamed("part", "leaf"), ["source", "block"], "leaf", border).select(
        "source", "block", "leaf", F.col("part").alias("part_size"), F.col("own").alias("part_own"))
    placed = shards_of(blocks.select("source", "block"), seed, shards)
    per_block = blocks.alias("k").join(placed.alias("p"), F.expr("k.source <=> p.source and k.block = p.block")).join(
        quota.alias("q"), F.expr("k.source <=> q.source")).join(goal.alias("g"), F.expr("k.source <=> g.source")).select(
        F.col("k.source").alias("s"), F.col("k.block").alias("b"), "k.block_size", "k.own", "p.shard", "q.copies",
        "g.source_size", "g.target")
    joined = rows.join(per_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).join(
        parts.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "leaf", "part_size", "part_own"),
        F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")) & (F.col("part") == F.col("leaf")),
        "left")
    once = (F.when(F.col("own") == F.col("block_size"), F.col("size")).when(F.col("own") == 0, F.lit(0))
            .otherwise(F.coalesce(F.floor(F.col("size") * F.col("part_own") / F.col("part_size")), F.lit(0))))
    taken = F.col("copies") * F.col("size") + F.when(F.col("copies") < MOST_COPIES, once).otherwise(F.lit(0))
    place = F.md5(F.concat(F.lit(f"{seed}|place|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return joined.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "shard",
                         place.alias("place"))
