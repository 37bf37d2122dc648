"""Periodic runs against a search of every period."""

import hashlib
import zlib

import numpy as np
import pytest

from gapwise.llm.queries import QUERIES
from gapwise.llm.run_detection import find, find_runs


def every_period(words, shortest):
    """All runs (start, length, period), by trying each period at each place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def sequences(seed, many):
    rng = np.random.default_rng(seed)
    for k in range(many):
        n, kinds = int(rng.integers(0, 150)), int(rng.choice([1, 2, 3, 5, 50]))
        w = rng.integers(0, kinds, n).tolist()
        if k % 2 and n:
            a = int(rng.integers(n))
            p = 1 + (n - a) // (3 + int(rng.integers(8)))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w * (3 if k % 5 == 0 else 1)


@pytest.mark.parametrize("shortest", [12, 5, 2])
def test_runs_equal_every_period(shortest):
    lists = list(sequences(shortest, 300))
    offsets, start, length, period, _ = find([" ".join(f"w{x}" for x in w).encode() for w in lists], shortest)
    for i, words in enumerate(lists):
        low, high = np.searchsorted(start, offsets[i:i + 2])
        got = list(zip((start[low:high] - offsets[i]).tolist(), length[low:high].tolist(), period[low:high].tolist()))
        assert got == every_period(words, shortest)


def test_long_texts_need_few_tries():
    words = (["a", "b"] * 40_000 + [f"x{i % 997}" for i in range(60_000)] + ["z"] * 50_000)
    _, start, length, period, dropped = find([" ".join(words).encode()])
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [
        (0, 80_000, 2), (80_000, 60_000, 997), (140_000, 50_000, 1)]
    assert dropped.sum() == len(words) - 2 - 997 - 1


def test_edge_rows(spark):
    rows = [(1, None, 1, 1), (1, "", 1, 1), (2, " \n\t ", 1, 1), (None, "a b " * 6, 1, 1), (3, "A a " * 3 + "a", 1, 1),
            (3, "A a " * 3 + "a", 1, 1), (4, "é\x0b" * 12, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, id int")
    got = sorted((r["id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                 for r in find_runs(df).collect())
    assert got == sorted([(1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (0, 12, [(0, 12, 2)], "a b"),
                          (3, 7, [], "A a A a A a a"), (3, 7, [], "A a A a A a a"), (4, 12, [(0, 12, 1)], "é")])
    assert find_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r.asDict() for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(docs) and sum(r["n_runs"] for r in got.values()) > 10
    for r in docs:
        words = (r["text"] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if n > 4000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = every_period(words, 12)
        first = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert got[r["doc_id"]] == {
            "doc_id": r["doc_id"], "n_runs": len(runs), "start": first[0], "length": first[1], "period": first[2],
            "exponent_milli": 1000 * first[1] // first[2] if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()}
