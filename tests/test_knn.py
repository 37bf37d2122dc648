"""The pruned search must equal a plain all-pairs search."""

import numpy as np
import pytest

from gapwise.operators import knn


def brute_force(rows, d, k):
    filled = [list(r) for r in rows]
    for t in range(d):
        known = [r[1 + t] for r in rows if r[1 + t] is not None]
        for at, r in enumerate(rows):
            if r[1 + t] is not None:
                continue
            found = []
            for o in rows:
                if o[1 + t] is None:
                    continue
                gaps = [(r[1 + j] - o[1 + j]) ** 2 for j in range(d)
                        if j != t and r[1 + j] is not None and o[1 + j] is not None]
                if gaps:
                    found.append((sum(gaps) * d / len(gaps), o[0], o[1 + t]))
            best = [v for _, _, v in sorted(found)[:k]]
            filled[at][1 + t] = np.mean(best) if best else np.mean(known)
    return filled


def table(kind, n=240, d=4):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d))
    if kind == "hot":            # a third of all rows share one vector
        x[rng.random(n) < 0.35] = [1.0, 2.0, 3.0, 4.0][:d]
    if kind == "coarse":         # many exact ties
        x = np.round(x)
    gaps = rng.random((n, d)) < (0.5 if kind == "sparse" else 0.12)
    return [(i, *[None if gaps[i, j] else float(x[i, j]) for j in range(d)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "hot", "coarse", "sparse"])
@pytest.mark.parametrize("cell", [20, 100_000])
def test_equals_all_pairs(spark, monkeypatch, kind, cell):
    monkeypatch.setattr(knn, "CELL_DONORS", cell)
    monkeypatch.setattr(knn, "CHUNK_DONORS", 13)
    monkeypatch.setattr(knn, "CHUNK_GAPS", 7)
    rows = table(kind)
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double")
    got = sorted(tuple(r) for r in knn.impute_knn(df, "id", ["a", "b", "c", "d"]).collect())
    want = brute_force(rows, 4, 5)
    assert np.allclose(np.array(got, float), np.array(want, float), atol=1e-9)


def test_few_donors_and_single_feature(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 6.0), (3, 9.0, 8.0)],
                               "id bigint, a double, b double")
    assert knn.impute_knn(df, "id", ["a", "b"]).filter("id = 1").collect()[0]["b"] == 7.0
    assert knn.impute_knn(df, "id", ["b"]).filter("id = 1").collect()[0]["b"] == 7.0


def test_donors_from_another_table(spark):
    train = spark.createDataFrame([(i, float(i), 10.0 * i) for i in range(20)],
                                  "id bigint, a double, b double")
    test = spark.createDataFrame([(100, 3.0, None)], "id bigint, a double, b double")
    got = knn.impute_knn(test, "id", ["a", "b"], fit_on=train, k=3).collect()[0]["b"]
    assert got == pytest.approx(30.0)
