"""Near-duplicate vectors: an inverted multi-index, visited as far as a link can reach, then verified.

The two halves of the unit vectors have codebooks of their own; a pair of codes
is a cell of the product grid.  Near vectors lie in one cell or on both sides of
a border, so each vector also visits foreign cells, half by half, as far from
its own as any two linked vectors can need to meet.  What visits is a sketch,
some bytes of the coordinates along the directions that spread the vectors most:
sketches of linked vectors are never far apart, those of most others are.  The
vectors that meet near each other form groups, and every link lies inside one
group.  Whole vectors go to their groups alone, the largest of which are dealt to
the bins of a grid; groups and bins are cut into blocks of bounded size and the
pairs of blocks verified by matrix products.  What leaves a task is a sum of
links and a spanning forest, never the pairs.

Equal vectors are collapsed first and carried as a weight.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gapwise.llm.graph import components, roots_of
from gapwise.llm.store import forget, give_back, keep, only
from gapwise.llm.vectors import matrix, pack, packed_kind, unit_rows, usable

SAMPLE = 8192  #: vectors at most that the codebooks are fitted on
CELL_VECTORS = 1000  #: aimed at for each cell and label when the grid is chosen
MOST_CODES = 256  #: of a half
BLOCK = 4096  #: vectors of a block at most
SKETCH = 20  #: coordinates of a sketch, a byte each
PIECE = 1024  #: sketches that travel in one row at most
CELL_BLOCK = 65536  #: sketches of a cell, or of a part of it, that meet in one task
FEW = 1 << 20  #: members of groups at most that travel to all executors
DENSE = 2048  #: sketches from which a crowd among them is looked for
SLAB = 1 << 20  #: products at once

Book = tuple[np.ndarray, np.ndarray]


def codebook(sample: np.ndarray, codes: int, rounds: int = 8) -> Book:
    """Lloyd's k-means from evenly spaced rows of the sample: centres, and how far they are apart.

    Centres are rounded, so that no two are too near for a border between them.
    """
    centres = sample[np.linspace(0, len(sample) - 1, min(codes, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * sample @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = sample[near == c].mean(0)
    centres = np.unique(centres.round(6), axis=0) if centres.shape[1] else centres[:1]
    return centres, np.array([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])


def border_distances(half: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest code, and its distance to the border of every code's region."""
    centres, apart = book
    far = (centres ** 2).sum(1) - 2 * half @ centres.T
    home = far.argmin(1)
    between = apart[home]
    gap = (far - far[np.arange(len(half)), home][:, None]) / (2 * np.where(between > 0, between, 1))
    gap[np.arange(len(half)), home] = 0
    return home, np.maximum(gap, 0)


def visits(unit: np.ndarray, books: tuple[Book, Book], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, moved) of every cell within reach of a vector; ``moved`` has bit 1 for a foreign
    code of the first half and bit 2 for one of the second, and is 0 at home."""
    half = unit.shape[1] // 2
    (home1, gaps1), (home2, gaps2) = (border_distances(unit[:, :half], books[0]),
                                      border_distances(unit[:, half:], books[1]))
    row, code1 = np.nonzero(gaps1 <= reach)
    row2, code2 = np.nonzero(gaps2 <= reach)
    many = np.bincount(row2, minlength=len(unit))
    times = many[row]
    at = np.repeat((np.cumsum(many) - many)[row] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    row, code1, code2 = np.repeat(row, times), np.repeat(code1, times), code2[at]
    near = gaps1[row, code1] ** 2 + gaps2[row, code2] ** 2 <= reach * reach
    row, code1, code2 = row[near], code1[near], code2[near]
    moved = (code1 != home1[row]) + 2 * (code2 != home2[row])
    return row, code1 * len(books[1][0]) + code2, moved


def reach_of(cosine: float) -> float:
    """How far from a cell a vector must look so that no link is lost, whatever its direction.

    Linked unit vectors differ by at most r = sqrt(2 - 2 cosine).  In each half
    their distances to the border between their two codes add up to no more
    than they differ there, so one of them is within half of that.  The two meet
    in the cell that has, for each half, the code which the other one's distance
    is not less to: none moves farther than r / 2 over both halves, and never
    both in the same half.
    """
    return math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-6


def directions(sample: np.ndarray, many: int) -> np.ndarray:
    """Orthonormal columns along which the sample spreads most, by subspace iteration."""
    basis = np.random.default_rng(7).standard_normal((sample.shape[1], min(many, sample.shape[1])))
    for _ in range(3):
        basis, _ = np.linalg.qr(sample.T @ (sample @ basis))
    return basis


def sketch(unit: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates along the basis in steps of 1 / 127."""
    return np.clip(np.rint(unit @ basis * 127), -127, 127).astype(np.int8)


def width_of(cosine: float, many: int) -> float:
    """Square of the distance beyond which two sketches of ``many`` coordinates can't be of linked vectors.

    A projection brings vectors no farther apart, and rounding moves each
    coordinate's difference by one step at most.
    """
    return (127 * (math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6) + math.sqrt(many)) ** 2


def excess(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Slabs of minus the squared distances of sketches, each with its first row.  All numbers stay
    whole and below 2^24, so single precision rounds nothing."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    a = np.column_stack([2 * x, -(x * x).sum(1), np.full(len(x), -1, np.float32)])
    b = np.column_stack([y, np.ones(len(y), np.float32), (y * y).sum(1)])
    step = max(1, SLAB // max(1, len(y)))
    for start in range(0, len(x), step):
        yield start, a[start:start + step] @ b.T


def crowds(x: np.ndarray, wide: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Edges that join large crowds of sketches, and the sketches that must still be compared.

    All within twice the width of a crowd's member are joined to it.  Those
    within the width itself have all their neighbours among these and are done.
    """
    draw, edges, left = np.random.default_rng(len(x)), [], np.arange(len(x))
    while len(left) > DENSE:
        seeds = draw.integers(0, len(left), 32)
        apart = -np.concatenate([s for _, s in excess(x[left[seeds]], x[left])])
        near = (apart <= wide).sum(1)
        best = near.argmax()
        if near[best] < len(left) // 32:
            break
        ball = left[apart[best] <= 4 * wide]
        edges.append((np.full(len(ball), left[seeds[best]]), ball))
        left = left[apart[best] > wide]
    return edges, left


def meetings(rep: np.ndarray, moved: np.ndarray, x: np.ndarray, low: np.ndarray | None,
             wide: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) that joins all entries of a cell whose sketches are near and that never moved
    in the same half.  With ``low``, of two blocks: those it marks meet those it doesn't."""
    edges, left = crowds(x, wide)
    moved, x = moved[left], x[left]
    sides = [(np.ones(len(left), bool),) * 2] if low is None else [(low[left], ~low[left]), (~low[left], low[left])]
    size = 0

    def folded() -> list[tuple[np.ndarray, np.ndarray]]:
        nodes, roots = roots_of(np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))
        return [(nodes[nodes != roots], roots[nodes != roots])]
    for one, other in sides:
        for few, many in ((one & (moved == 0), other), (one & (moved == 1), other & (moved == 2))):
            few, many = np.flatnonzero(few), np.flatnonzero(many)
            if not len(few) or not len(many):
                continue
            for start, slab in excess(x[few], x[many]):
                hit = np.flatnonzero(slab >= -wide)
                a, b = left[few[start + hit // len(many)]], left[many[hit % len(many)]]
                edges.append((a[a != b], b[a != b]))
                size += len(a)
                if size > 2 * SLAB:
                    edges, size = folded(), 0
    if not edges:
        return rep[:0], rep[:0]
    (a, b), = folded()
    return rep[a], rep[b]


def bundles(kind: np.ndarray, cell: np.ndarray, entries: np.ndarray, large: dict[tuple, int]) -> pa.RecordBatch:
    """Entries of one kind and cell as bytes, up to PIECE of them in a row.

    Rows of the ``large`` cells go to one of so many blocks each, once for each
    block that it meets.
    """
    order = np.lexsort((cell, kind))
    kind, cell, entries = kind[order], cell[order], entries[order]
    new = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (cell[1:] != cell[:-1])]))
    cuts = -(-np.diff(np.append(new, len(kind))) // PIECE)
    start = np.repeat(new, cuts) + PIECE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    ends = np.append(start, len(kind))
    data = pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer((ends * entries.itemsize).astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])
    kind, cell, n = kind[start], cell[start], np.diff(ends)
    blocks = np.array([large.get(x, 1) for x in zip(kind.tolist(), cell.tolist())])
    block = np.array([crc32(d.as_buffer()) % b if b > 1 else 0 for d, b in zip(data, blocks.tolist())])
    at = np.repeat(np.arange(len(start)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    numbers = (cell[at], np.minimum(block[at], other), np.maximum(block[at], other), block[at], n[at])
    return pa.RecordBatch.from_arrays([pa.array(kind[at]), *(pa.array(x.astype(np.int32)) for x in numbers),
                                       data.take(pa.array(at))], ["kind", "cell", "low", "high", "block", "n", "data"])


def joined(linked: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row and each column of a matrix, equal for those that links connect and
    -1 for those without any; ``back`` is the transpose."""
    rows, columns = np.full(len(linked), -1), np.full(len(back), -1)
    open_rows, open_columns = linked.any(1), back.any(1)
    for start in range(len(linked)):
        if not open_rows[start]:
            continue
        front = np.array([start])
        while len(front):
            rows[front], open_rows[front] = start, False
            met = np.flatnonzero(linked[front].any(0) & open_columns)
            columns[met], open_columns[met] = start, False
            front = np.flatnonzero(back[met].any(0) & open_rows) if len(met) else met
    return rows, columns


def counted(linked: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of the columns that each row links with."""
    return np.count_nonzero(linked, axis=1) if (weight == 1).all() else linked @ weight


def link_block(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, one: np.ndarray, other: np.ndarray | None,
               cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links among the rows ``one``, or with ``other`` between the two lists of rows:
    (a, links) sums and (a, b) forest edges."""
    alike = other is None
    other = one if alike else other
    linked, step = np.empty((len(one), len(other)), bool), max(1, SLAB // max(1, len(other)))
    for start in range(0, len(one), step):
        linked[start:start + step] = x[one[start:start + step]] @ x[other].T >= cosine
    if alike:  # the product of the lesser row with the greater decides for both
        linked = np.triu(linked, 1)
        linked |= linked.T
    back = linked if alike else np.ascontiguousarray(linked.T)
    sums, tree = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    for start in range(0, len(one), step):
        sums[one[start:start + step]] = counted(linked[start:start + step], weight[other])
    if alike:
        np.fill_diagonal(linked, linked.any(1))
    else:
        step = max(1, SLAB // max(1, len(one)))
        for start in range(0, len(other), step):
            sums[other[start:start + step]] = counted(back[start:start + step], weight[one])
    rows, columns = joined(linked, back)
    tree[other], tree[one] = columns, rows
    some = np.flatnonzero(tree >= 0)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, tree[some], ids[some])
    child = some[least[tree[some]] != ids[some]]
    return ids[some], sums[some], ids[child], least[tree[child]]


def bins_near(z: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the bins of a regular grid that each row visits, its own first.

    Of two rows within the distance and in different bins, the one whose bin
    comes first visits the other's.
    """
    side = 2 * max(distance, 0.01)
    home = np.floor(z / side).astype(np.int64)
    above = z - home * side
    steps = np.array([s for s in product((-1, 0, 1), repeat=z.shape[1]) if s >= (0,) * z.shape[1]])
    gap = np.where(steps[None] > 0, side - above[:, None], np.where(steps[None] < 0, above[:, None], 0))
    row, step = np.nonzero((gap ** 2).sum(2) <= (distance + 1e-6) ** 2)
    return row, (home[row] + steps[step] + 128) @ (256 ** np.arange(z.shape[1])[::-1])


def verify(key: tuple, table: pa.Table, kind: str, cosine: float) -> pa.Table:
    """Links of all groups in a table, or between the two blocks that the key names; never of two visitors."""
    low, high = key[2].as_py(), key[3].as_py()
    of = {n: table.column(n).to_numpy() for n in ("kind", "kind2", "component", "rep", "weight", "block", "step")}
    order = np.lexsort((of["rep"], of["component"], of["kind2"], of["kind"]))
    of = {n: c[order] for n, c in of.items()}
    x = unit_rows(matrix(table.column("v").to_pylist(), kind))[order]
    new = np.zeros(len(order), bool)
    for n in ("kind", "kind2", "component"):
        new[1:] |= of[n][1:] != of[n][:-1]
    ends = [0, *np.flatnonzero(new).tolist(), len(order)]
    found = []
    for start, end in zip(ends[:-1], ends[1:]):
        run = slice(start, end)
        home, first = of["step"][run] == 0, of["block"][run] == low
        sides = ([(home, None), (home, ~home)] if low == high else
                 [(first & home, ~first), (first & ~home, ~first & home)])
        for one, other in sides:
            one, other = np.flatnonzero(one), None if other is None else np.flatnonzero(other)
            if len(one) > (other is None) and (other is None or len(other)):
                found.append(link_block(x[run], of["rep"][run], of["weight"][run], one, other, cosine))
    del x
    give_back()
    a, links, child, root = ([np.concatenate([f[i] for f in found]) for i in range(4)] if found
                             else [np.zeros(0, np.int64)] * 4)
    return pa.table({
        "a": pa.array(np.concatenate([a, child])),
        "b": pa.array(np.concatenate([np.zeros(len(a), np.int64), root]), mask=np.arange(len(a) + len(child)) < len(a)),
        "links": pa.array(np.concatenate([links, np.zeros(len(child), np.int64)]))})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine in double precision is at least ``cosine``.  Null,
    zero and not wholly finite vectors link with nothing.  ``n_links`` counts
    other rows, copies included; ``component_id`` is the least id reachable.
    Null ids link with nothing, have a null component and are kept.  Other
    columns are not read.
    """
    rows = only(df, id=id_col, v=vector_col, label=label_col).withColumn("id", F.col("id").cast("long"))
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    kind = packed_kind(fit, "v")
    packed = keep(pack(fit.withColumn("dims", F.size("v")), "v", kind)
                  .withColumn("copy", F.md5(F.col("v"))), "vectors")
    group = ["label", "dims", "copy"]
    nodes = keep(packed.groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("weight"),
                                            F.first("v").alias("v")), "nodes")
    keys = keep(packed.select("id", *group), "keys")
    forget(df.sparkSession, packed)
    per_label = nodes.groupBy("dims", "label").agg(
        F.count("*").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most"))
    sizes = per_label.groupBy("dims").agg(
        F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("usual"),
        F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dims").collect()
    found = None
    for size in sizes:
        own = _links(nodes.where(F.col("dims") == size["dims"]), size, cosine, kind)
        found = own if found is None else found.unionByName(own)
    alone = rows.select("id").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is not None:
        found = keep(found, "links")
        sums = found.groupBy("a").agg(F.sum("links").alias("links"))
        forest = components(found.where("b is not null").select("a", "b"))
        per_node = (nodes.join(sums, nodes["rep"] == sums["a"], "left")
                    .join(forest, nodes["rep"] == forest["node"], "left")
                    .select(*group, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                            F.coalesce("component", "rep").alias("component_id")))
        linked = keys.join(per_node, group).select("id", "n_links", "component_id")
        rest = rows.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")))
        alone = linked.unionByName(rest.select(
            "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return alone.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _links(nodes: DataFrame, size: Row, cosine: float, kind: str) -> DataFrame:
    """(a, b, links) of all vectors of one length; see :func:`link_block`."""
    nodes = nodes.select("rep", "weight", "v", F.xxhash64("label").alias("kind"),
                         F.xxhash64(F.lit(1), "label").alias("kind2"))
    groups, basis = _groups(nodes, size, cosine, kind)
    groups = keep(groups, "groups")
    members = keep(nodes.join(F.broadcast(groups) if groups.count() <= FEW else groups,
                              nodes["rep"] == groups["node"]).drop("node"), "members")
    group = ["kind", "kind2", "component"]
    large = members.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 4)
    sized = members.join(F.broadcast(large), group, "left")
    buckets = max(64, math.ceil(size["count"] / 4096))
    small = sized.where("n is null").withColumns({
        "part": F.pmod(F.xxhash64("component"), F.lit(buckets)), "bin": F.lit(-1), "step": F.lit(0),
        "blocks": F.lit(1), "block": F.lit(-1), "low": F.lit(-1), "high": F.lit(-1)})
    middle = sized.where(F.col("n") <= 4 * BLOCK).withColumns({
        "part": F.col("component"), "bin": F.lit(-1), "step": F.lit(0), "blocks": F.greatest(
            F.ceil(F.col("n") / BLOCK), F.least(F.lit(8), F.ceil(F.col("n") / (BLOCK // 4)))).cast("int")})
    cut = middle.drop("n")
    if large.where(F.col("n") > 4 * BLOCK).count():
        cut = cut.unionByName(_binned(sized.where(F.col("n") > 4 * BLOCK).drop("n"), group, basis[:, :3], cosine, kind))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep", "v"), F.col("blocks")).cast("int"))
    paired = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({
        "low": F.least("block", "with"), "high": F.greatest("block", "with")})
    columns = ["part", "bin", "low", "high", *group, "rep", "weight", "block", "step", "v"]
    return small.select(*columns).unionByName(paired.select(*columns)).groupBy("part", "bin", "low", "high").applyInArrow(
        lambda key, table: verify(key, table, kind, cosine), "a long, b long, links long")


def _binned(members: DataFrame, group: list[str], axes: np.ndarray, cosine: float, kind: str) -> DataFrame:
    """Members of the largest groups in the bins of a grid along ``axes``: once at home, which is step 0,
    and in the bins before which they may have links."""
    distance = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bins = bins_near(unit_rows(matrix(batch.column("v").to_pylist(), kind)) @ axes, distance)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows)))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bins.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "bins"])
    schema = ", ".join(f"{n} {t}" for n, t in members.dtypes)
    located = keep(members.mapInArrow(locate, f"{schema}, bins array<int>"), "located")
    homes = located.groupBy(*group, F.col("bins")[0].alias("bin")).agg(F.lit(True).alias("lived"))
    full = located.select(*group, F.explode("bins").alias("bin")).groupBy(*group, "bin").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spots = keep(homes.join(full, [*group, "bin"]).drop("lived"), "spots")
    entries = located.select(*members.columns, F.posexplode("bins").alias("step", "bin"))
    return entries.join(F.broadcast(spots) if spots.count() <= FEW // 8 else spots, [*group, "bin"]).withColumn(
        "part", F.col("component"))


def _groups(nodes: DataFrame, size: Row, cosine: float, kind: str) -> tuple[DataFrame, np.ndarray]:
    """(node, component) such that all links are inside a component, where a vector that surely has none
    may lack; and directions along which the vectors spread."""
    dims, count, least = size["dims"], size["count"], size["least"]
    codes = max(1, min(MOST_CODES, round(math.sqrt(size["usual"] / CELL_VECTORS))))
    part = min(1.0, SAMPLE / count)
    picked = nodes.where(F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(1 << 20)) < math.ceil(part * (1 << 20)))
    drawn = sorted((bytes(r[1]), r[0]) for r in picked.select("kind", "v").limit(2 * SAMPLE).collect())
    sample = unit_rows(matrix((r[0] for r in drawn), kind) if drawn else np.zeros((1, dims)))
    half = dims // 2
    books = codebook(sample[:, :half], codes), codebook(sample[:, half:], codes)
    basis = directions(sample, SKETCH)
    reach, wide = reach_of(cosine), math.floor(width_of(cosine, basis.shape[1]))
    number = "<u4" if size["most"] - least < 1 << 32 else "<u8"
    entry = np.dtype([("rep", number), ("moved", "u1"), ("x", "i1", basis.shape[1:])])
    rows_at_once = max(1, min(8192, (1 << 22) // max(dims, len(books[0][0]) * len(books[1][0]))))
    full: Counter = Counter()  # how many of the sample visit a cell, which tells the large ones
    for start in range(0, len(drawn), rows_at_once):
        row, cell, _ = visits(sample[start:start + rows_at_once], books, reach)
        full.update((drawn[start + r][1], c) for r, c in zip(row.tolist(), cell.tolist()))
    large = {x: math.ceil(n * count / len(drawn) / CELL_BLOCK) for x, n in full.items()
             if n * count > len(drawn) * CELL_BLOCK}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entered = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                piece = batch.slice(start, rows_at_once)
                unit = unit_rows(matrix(piece.column(2).to_pylist(), kind))
                row, cell, moved = visits(unit, books, reach)
                entries = np.empty(len(row), entry)
                entries["rep"], entries["moved"] = (piece.column(1).to_numpy() - least)[row], moved
                entries["x"] = sketch(unit, basis)[row]
                held.append((piece.column(0).to_numpy()[row], cell, entries))
                entered += len(row)
                if entered >= SLAB // 2:
                    yield bundles(*(np.concatenate(c) for c in zip(*held)), large)
                    held, entered = [], 0
        if entered:
            yield bundles(*(np.concatenate(c) for c in zip(*held)), large)
        del held
        give_back()
    placed = nodes.select("kind", "rep", "v").mapInArrow(
        place, "kind long, cell int, low int, high int, block int, n int, data binary")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("data").to_pylist()), entry)
        low, high = key[2].as_py(), key[3].as_py()
        first = None if low == high else np.repeat(table.column("block").to_numpy() == low, table.column("n").to_numpy())
        a, b = meetings(entries["rep"], entries["moved"], entries["x"], first, wide)
        return pa.table({"a": pa.array(a.astype(np.int64) + least), "b": pa.array(b.astype(np.int64) + least)})
    met = keep(placed.groupBy("kind", "cell", "low", "high").applyInArrow(meet, "a long, b long"), "met")
    groups = components(met)
    # different vectors under one id, which may meet nobody else
    twins = met.where("a = b").select(F.col("a").alias("node")).distinct().join(groups, "node", "left_anti")
    return groups.unionByName(twins.withColumn("component", F.col("node"))), basis
