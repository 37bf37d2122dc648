"""Near-duplicate documents: one-permutation MinHash, banded, starred, verified.

Each text becomes the set of its distinct word shingles.  One hash function is
enough for a whole signature: the hash range is cut into bins and a bin's value
is the least hash in it; an empty bin copies the first filled bin in its own
fixed random order (optimal densification), so that two texts agree in a bin
with the probability of their Jaccard similarity, short texts included.  Bands
of bins are bucket keys.  Inside a bucket only the edges to one centre are
candidates, hence never more than its members; every candidate is confirmed on
the full shingle sets.  A few rounds draw other centres for the buckets that
still hold several components.

What is split then is finished exactly, by the prefix filter: two sets as
similar as asked share one of the rarest shingles of either, so only members
that meet in a rare shingle, lie in different components and can still overlap
enough behind it are compared.  Texts that share a template and no more meet
nowhere, however many they are.

Texts with equal sets are one node from the start (grouped by a 128-bit digest
of the set), so a group of copies costs one signature row, and texts under one
id stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.graph import components
from gapwise.llm.store import bound_batches, forget, forget_table, keep, keep_by_key, only, slices, texts_of
from gapwise.llm.words import mix, shingle_sets

#: 32 bands of 5 bins: a pair at 0.8 shares no band with a chance of 3 in a million.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
PARTS = 64  #: tasks that the pairs of one centre are dealt to
ROUNDS = 3  #: star rounds at most; the exact finish takes what they leave

_EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)
_ORDER = np.argsort(np.argsort(mix(
    np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0xA5A5)).reshape(BINS, BINS), axis=1), axis=1)


def bin_values(shingles: np.ndarray) -> np.ndarray:
    """The densified signature of a non-empty ascending set of hashes."""
    at = np.searchsorted(shingles, _EDGES)
    ends = np.append(at[1:], len(shingles))
    filled = np.flatnonzero(at < ends)
    donor = np.arange(BINS)
    if len(filled) < BINS:
        empty = np.flatnonzero(at >= ends)
        donor[empty] = filled[np.argmin(_ORDER[np.ix_(empty, filled)], axis=1)]
    return shingles[at[donor]]


def band_keys(values: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for row in values.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, digest, keys) of (id, text); no digest or keys for empty sets."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sizes, digests, keys = [], [], []
            for shingles in shingle_sets(texts_of(batch.column(1)), words):
                sizes.append(len(shingles))
                if len(shingles):
                    digests.append(digest_of(shingles))
                    keys.append(band_keys(bin_values(shingles)))
                else:
                    digests.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "keys"])
    return docs.mapInArrow(sign, "id long, n_shingles long, digest binary, keys array<long>")


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text, digest): whole sets, ascending as unsigned numbers.

    A row whose text has another digest belongs to another node of its id.
    """
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = list(shingle_sets(texts_of(batch.column(1)), words))
            own = [digest_of(s) == d for s, d in zip(sets, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(own, pa.bool_())),
                 pa.array([s.view(np.int64) for s, good in zip(sets, own) if good], pa.list_(pa.int64()))],
                ["node", "shingles"])
    return docs.mapInArrow(collect, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, in whole numbers.

    ``pairs`` (a, b, hub) name the one of the two that was the bucket's centre.
    A hub may have any number of pairs, its partner only one for each band: the
    partner's set joins on its node, and the hub's is copied to the few PARTS
    where it has partners.  ``sets`` lie in buckets of their nodes and stay there.
    """
    spoke = F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a"))
    ways = pairs.select("a", "b", "hub", spoke.alias("spoke")).withColumn(
        "part", F.pmod(F.xxhash64("spoke"), F.lit(PARTS)))
    left = ways.select("hub", "part").distinct().hint("merge").join(
        sets.select(F.col("node").alias("hub"), F.col("shingles").alias("left")), "hub")
    right = ways.hint("merge").join(sets.select(F.col("node").alias("spoke"), F.col("shingles").alias("right")), "spoke")
    small, large = F.least(F.size("left"), F.size("right")), F.greatest(F.size("left"), F.size("right"))
    both = (right.hint("merge").join(left, ["hub", "part"]).where(100 * small >= percent * large)
            .select("a", "b", "left", "right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(3))]
            (lo, lv), (ro, rv) = lists
            for i in range(batch.num_rows):
                x, y = lv[lo[i]:lo[i + 1]], rv[ro[i]:ro[i + 1]]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            chosen = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])
    return both.mapInArrow(compare, "a long, b long")


def still_split(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, component) of the buckets that hold several components yet."""
    rows = members.select("key", "node", "n").join(labels, "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("component"))
    split = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low < high").select("key")
    return rows.join(split, "key")


def stars(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b, hub) of one round: in each bucket, its centre with each member of another component.

    Sets whose sizes alone rule a link out are no candidates.

    In the first round the centre follows from one order of all nodes, so that
    large groups share few centres; later rounds draw it for each bucket anew.
    """
    rank = F.xxhash64(F.lit(turn), "node") if turn == 0 else F.xxhash64(F.lit(turn), "key", "node")
    centres = members.groupBy("key").agg(F.min(F.struct(
        rank.alias("rank"), F.col("node").alias("centre"), F.col("component").alias("at"), F.col("n").alias("m"))).alias("c")).select(
        "key", "c.centre", "c.at", "c.m")
    possible = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return (members.join(centres, "key").where(F.col("component") != F.col("at")).where(possible)
            .groupBy(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
            .agg(F.min("centre").alias("hub")))


def rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, n, component, at, short): the prefix of each set, rarest shingles first.

    ``at`` counts from 0 and ``short`` marks the prefix that suffices when the
    other set is at least as large.  Shingles that no other member has are left out.
    """
    rows = sets.hint("merge").join(members, "node").select("node", "n", "component", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    ordered = rows.hint("merge").join(shared, "shingle", "left").groupBy("node", "n", "component").agg(F.sort_array(
        F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "shingle"))).alias("ordered"))
    whole = F.expr(f"cast(n - ({percent} * n + 99) div 100 + 1 as int)")
    short = F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1")
    return (ordered.select("node", "n", "component", F.posexplode(F.slice("ordered", F.lit(1), whole)).alias("at", "s"))
            .where("s.often > 1").select("s.shingle", "node", "n", "component", "at", (F.col("at") < short).alias("short")))


def open_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, hub): all pairs of two components that the prefix filter leaves.

    Of two components at a shingle one at most is its most common one, so pairs
    are listed from the others: a large component costs its members times
    theirs, never its square.
    """
    main = (prefixes.groupBy("shingle", "component").agg(F.count("*").alias("m"))
            .groupBy("shingle").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("parts"))
            .where("parts > 1").select("shingle", "main"))
    marked = prefixes.join(main, "shingle").withColumn("minor", F.col("component") != F.col("main"))
    marked = keep(marked, "prefixes")
    x, y = (marked.select("shingle", "short", "minor", *(F.col(c).alias(c + side) for c in ("node", "n", "component", "at")))
            for side in "xy")
    x = x.where("short")
    met = [left.drop("short", "minor").hint("merge").join(right.drop("short", "minor"), "shingle") for left, right in (
        (x.where("minor"), y), (x.where("not minor"), y.where("minor")))]
    possible = ((F.col("componentx") != F.col("componenty"))
                & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("nodex") < F.col("nodey"))))
                & (100 * F.col("nx") >= percent * F.col("ny"))
                & ((100 + percent) * F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty"))
                   >= percent * (F.col("nx") + F.col("ny"))))
    found = met[0].where(possible).select("nodex", "nodey").union(met[1].where(possible).select("nodex", "nodey"))
    return found.groupBy(F.greatest("nodex", "nodey").alias("a"), F.least("nodex", "nodey").alias("b")).agg(
        F.min("nodex").alias("hub"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Links join documents whose shingle sets overlap by at least ``percent`` of
    their union; ``component_id`` is the least id reachable over links, itself
    included.  Null or wordless texts have no shingles and link with nothing.
    Rows that share an id are judged each by its own text.  A null id links with
    nothing: its component is null and it is kept.  Other columns are not read.
    The result does not depend on ``rounds``.
    """
    spark = df.sparkSession
    bound_batches(spark)
    docs = only(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    signed = keep(signatures(docs, words), "signatures")
    # written numbers: they only name a node until the end
    nodes = keep(signed.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select("node", "n", F.explode("keys").alias("key"))
    crowded = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where(
        "low < high").select("key")
    members = keep(entries.join(crowded, "key").withColumn("component", F.col("node")), "members")
    live = members.select("node").distinct().join(nodes, "node").select(F.col("least").alias("id"), "digest", "node")
    # as many candidates as the corpus has: never broadcast, at no size
    texts = docs.join(live.hint("merge"), "id").select("node", "text", "digest")
    in_buckets = keep_by_key(full_sets(texts, words).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets", "node")
    sets = spark.table(in_buckets)

    links: list[DataFrame] = []
    labels = None
    for turn in range(rounds):
        pairs = keep(stars(members, turn, percent), "pairs")
        fresh = keep(confirmed(pairs, sets, percent), "links")
        forget(spark, pairs)
        if fresh.isEmpty():
            break
        links.append(fresh)
        labels, members = _joined(members, links, labels)
    open_members = keep(members.select("node", "n", "component").distinct(), "open")
    pairs = keep(open_pairs(rare_shingles(open_members, sets, percent), percent), "pairs")
    last = keep(confirmed(pairs, sets, percent), "links")
    if not last.isEmpty():
        links.append(last)
        labels, members = _joined(members, links, labels)
    forget(spark, members, open_members, pairs)
    forget_table(spark, in_buckets)
    reach = nodes.select("digest", "node", "least")
    if labels is not None:
        placed = reach.join(labels, "node", "left").select(
            "digest", "least", F.coalesce("component", "node").alias("component"))
        lowest = placed.groupBy("component").agg(F.min("least").alias("lowest"))
        reach = placed.join(lowest, "component").select("digest", F.col("lowest").alias("least"))
    rows = signed.join(reach.select("digest", "least"), "digest", "left")
    linked = F.col("id").isNotNull()
    component = F.when(linked, F.coalesce("least", "id"))
    return rows.select("id", "n_shingles", component.alias("component_id"),
                       F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _joined(members: DataFrame, links: list[DataFrame], before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The labels (node, component) after all ``links`` and the members of buckets that stay split."""
    spark = members.sparkSession
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    labels = keep(components(every), "labels")
    rest = keep(still_split(members, labels), "members")
    forget(spark, members, *([] if before is None else [before]))
    return labels, rest
