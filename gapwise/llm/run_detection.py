"""Periodic runs of words, found on a grammar of each text.

A run is a stretch of words with smallest period q, at least twice q and at
least ``shortest`` long, that no neighbouring word extends keeping the period.

Re-Pair replaces frequent neighbouring pairs by nonterminals.  Here a round
replaces every pair that outranks the pairs it overlaps, so the most frequent
pair of each text always goes and many others go with it; rounds end when no
pair of a text occurs twice.  What is left is folded as a balanced tree.  Every
nonterminal is two parts with one boundary between them: the runs that cross it
are looked for once, at the nonterminal's first place, and translated to all
places where the derivation has it.  A run of the text crosses the boundary of
the lowest node that holds it, so none is missed; parts of runs cut off by the
ends of a node lie inside the whole one and are merged into it.

A run that crosses boundary b has two equal words at distance q, either at
b - 1 and b - 1 + q or at b - q and b.  The places of those two words are thus
the only periods to try, and prefix hashes tell by bisection how far each
reaches.  Words count as equal when their 64-bit hashes are.

Many texts share each numpy call; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapwise.llm.store import bound_batches, only, slices, texts_of
from gapwise.llm.words import mix, powers, word_hashes

SHORTEST = 12
SLICE = 4 << 20  #: bytes of text worked on at a time
TRIES = 1 << 19  #: periods tried at a time
_EMPTY = np.zeros(0, np.int64)


class Grammar:
    """Nodes of the derivation trees: boundary nodes and where they stand."""

    def __init__(self):
        self.left, self.middle, self.right = [_EMPTY], [_EMPTY], [_EMPTY]
        self.node, self.place = [_EMPTY], [_EMPTY]
        self.size = 0

    def add(self, left, middle, right, node, place) -> None:
        """Nodes with their first place (left, middle, right), and all places (node, place)."""
        self.node.append(node + self.size)
        self.place.append(place)
        for have, new in zip((self.left, self.middle, self.right), (left, middle, right)):
            have.append(new)
        self.size += len(left)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in (self.left, self.middle, self.right, self.node, self.place))


def outranking(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which pairs to replace: frequent ones that outrank both overlapping pairs.

    ``pair`` numbers the pair at each place, ``count`` says how often it occurs
    (0: no pair).  Overlapping equal pairs, as in a a a, alternate.
    """
    rank = np.where(count > 1, (count << 32) | (mix(pair.astype(np.uint64)) >> np.uint64(33)).astype(np.int64), -1)
    before, after = np.append(-1, rank[:-1]), np.append(rank[1:], -1)
    first = np.append(True, rank[1:] != rank[:-1])
    starts = np.flatnonzero(first)
    offset = np.arange(len(rank)) - starts[np.cumsum(first) - 1]
    return (rank >= 0) & (rank >= before) & (rank >= after) & (offset % 2 == 0)


def re_pair(words: np.ndarray, text: np.ndarray) -> Grammar:
    """A grammar of each text; ``words`` are numbers that no two texts share."""
    grammar = Grammar()
    symbol, at, end = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    symbols = int(words.max(initial=-1)) + 1
    while len(symbol) > 1:
        inside = text[at[1:]] == text[at[:-1]]
        key = np.where(inside, symbol[:-1] * symbols + symbol[1:], -1)
        _, pair, counts = np.unique(key, return_inverse=True, return_counts=True)
        chosen = np.flatnonzero(outranking(pair, np.where(inside, counts[pair], 0)))
        if not len(chosen):
            break
        _, first, node = np.unique(pair[chosen], return_index=True, return_inverse=True)
        head = chosen[first]
        grammar.add(at[head], at[head + 1], end[head + 1], node, at[chosen])
        symbol, end = symbol.copy(), end.copy()
        symbol[chosen] = symbols + node
        end[chosen] = end[chosen + 1]
        symbols += len(first)
        rest = np.ones(len(symbol), bool)
        rest[chosen + 1] = False
        symbol, at, end = symbol[rest], at[rest], end[rest]
    while len(at) > 1:  # the rest: neighbours of even and odd rank join, level by level
        first = np.append(True, text[at[1:]] != text[at[:-1]])
        rank = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        second = np.flatnonzero(rank % 2 == 1)
        if not len(second):
            break
        grammar.add(at[second - 1], at[second], end[second], np.arange(len(second)), at[second - 1])
        end = end.copy()
        end[second - 1] = end[second]
        rest = rank % 2 == 0
        at, end = at[rest], end[rest]
    return grammar


class Reach:
    """How far two places of one word sequence agree."""

    def __init__(self, words: np.ndarray):
        self.words = words
        value = mix(words.astype(np.uint64) + np.uint64(1))
        self.power = powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(value * self.power[:len(words)], dtype=np.uint64, out=self.sums[1:])
        step = mix(mix(value[:-2] + (value[1:-1] << np.uint64(1))) + value[2:]) if len(words) > 2 else value[:0]
        #: three words from each place; the last places never count as equal
        self.three = np.concatenate([step, np.arange(len(words) - len(step), dtype=np.uint64)])

    def equal(self, at: np.ndarray, gap: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Are the ``size`` words at ``at`` and at ``at + gap`` equal?"""
        here = self.sums[at + size] - self.sums[at]
        there = self.sums[at + gap + size] - self.sums[at + gap]
        return here * self.power[gap] == there

    def bisect(self, most: np.ndarray, test) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = test(middle)
            low = np.where(good, middle, low)
            high = np.where(good, high, middle - 1)
        return low

    def forward(self, at, gap, most):
        return self.bisect(most, lambda size: self.equal(at, gap, size))

    def backward(self, at, gap, most):
        """Equal words just before ``at`` and ``at + gap``."""
        return self.bisect(most, lambda size: self.equal(at - size, gap, size))


def _spread(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, value) of all values low <= value < high, some ``TRIES`` at a time."""
    count = np.maximum(high - low, 0)
    owner = np.flatnonzero(count)
    ends = np.cumsum(count[owner])
    total, start = int(ends[-1]) if len(ends) else 0, 0
    while start < total:
        stop = min(start + TRIES, total)
        flat = np.arange(start, stop)
        k = np.searchsorted(ends, flat, "right")
        yield owner[k], low[owner[k]] + flat - (ends[k] - count[owner[k]])
        start = stop


def crossing_runs(words: np.ndarray, left, middle, right, shortest: int) -> tuple[np.ndarray, ...]:
    """(node, start, end, period): stretches inside each node that cross its middle."""
    reach = Reach(words)
    span = len(words) + 1
    key = np.sort(words * span + np.arange(len(words)))  # places of each word, in order
    half = (right - left) // 2
    found = []
    for back in (False, True):
        anchor = middle if back else middle - 1
        base = words[anchor] * span
        if back:
            low = np.searchsorted(key, base + np.maximum(left, anchor - half))
            high = np.searchsorted(key, base + anchor)
        else:
            low = np.searchsorted(key, base + anchor + 1)
            high = np.searchsorted(key, base + np.minimum(right, anchor + half + 1))
        for node, k in _spread(low, high):
            other = key[k] % span
            at = other if back else anchor[node]
            gap = np.abs(other - anchor[node])
            if shortest > 8:  # five words or more agree: three to one side
                same = reach.three[at] == reach.three[at + gap]
                same |= (at >= 3) & (reach.three[np.maximum(at - 3, 0)] == reach.three[np.maximum(at + gap - 3, 0)])
                node, at, gap = node[same], at[same], gap[same]
            after = reach.forward(at, gap, right[node] - at - gap)
            before = reach.backward(at, gap, at - left[node])
            long = after + before >= np.maximum(gap, shortest - gap)
            found.append((node[long], (at - before)[long], (at + gap + after)[long], gap[long]))
    return tuple(np.concatenate([f[i] for f in found] + [_EMPTY]) for i in range(4))


def runs_of(words: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """(start, length, period) of all runs, by start and period; places count through all texts."""
    left, middle, right, node, place = re_pair(words, text).arrays()
    wide = np.flatnonzero(right - left >= shortest)
    if not len(wide):
        return _EMPTY, _EMPTY, _EMPTY
    owner, start, end, period = crossing_runs(words, left[wide], middle[wide], right[wide], shortest)
    owner = wide[owner]
    # to every place of the owner
    order = np.argsort(node, kind="stable")
    node, place = node[order], place[order]
    low, high = np.searchsorted(node, owner), np.searchsorted(node, owner, "right")
    runs = [(start[k], end[k], period[k], place[v] - left[owner[k]]) for k, v in _spread(low, high)]
    if not runs:
        return _EMPTY, _EMPTY, _EMPTY
    start, end, period, shift = (np.concatenate(x) for x in zip(*runs))
    start, end = start + shift, end + shift
    # merge: of one period, what lies inside another goes
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(0, period[1:] != period[:-1])) * (len(words) + 1)
    furthest = np.maximum.accumulate(end + group)
    whole = np.append(True, (end + group)[1:] > furthest[:-1])
    start, end, period = start[whole], end[whole], period[whole]
    # of one stretch, its smallest period counts
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def find(texts: list[bytes], shortest: int = SHORTEST):
    """(offsets, start, length, period, dropped) of a list of texts.

    ``offsets`` bound each text's words; ``dropped`` marks words that repeat a run's first period.
    """
    hashes, offsets = word_hashes(texts, fold=False)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, text))
    new = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1]))[:len(order)]
    words = np.empty(len(order), np.int64)
    words[order] = np.cumsum(new) - 1
    start, length, period = runs_of(words, text, shortest)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return offsets, start, length, period, np.cumsum(change)[:-1] > 0


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row, its whole text.

    Words are maximal stretches of bytes other than space and \\t..\\r, compared
    as they are.  ``runs`` holds (start, length, period) by start, then period;
    ``collapsed`` joins by one space the words that are left when each run keeps
    its first period only.  A null, empty or blank text has no words, no runs
    and an empty ``collapsed``.  Rows are judged each by itself, so repeated
    rows and ids stay; other columns are not read.
    """
    bound_batches(df.sparkSession)
    rows = only(df, id=id_col, text=text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            texts = texts_of(batch.column(1))
            offsets, start, length, period, dropped = find(texts, shortest)
            bounds = np.searchsorted(start, offsets)
            runs = pa.ListArray.from_arrays(
                pa.array(bounds, pa.int32()),
                pa.StructArray.from_arrays([pa.array(start - np.repeat(offsets[:-1], np.diff(bounds))), pa.array(length),
                                            pa.array(period)], fields=list(run_type)))
            collapsed = []
            for i, raw in enumerate(texts):
                words = raw.split()
                if bounds[i] < bounds[i + 1]:
                    gone = dropped[offsets[i]:offsets[i + 1]].tolist()
                    words = [w for w, g in zip(words, gone) if not g]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])
    return rows.mapInArrow(search, f"id {dict(rows.dtypes)['id']}, n_words long, "
                                   "runs array<struct<start: long, length: long, period: long>>, collapsed string")
