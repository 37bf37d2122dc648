import numpy as np
import pytest

from gapwise.functions.hashing import driver_uniform, hash_rank, uniform
from gapwise.operators import sample, select_rank
from gapwise.operators.rows import dense_ids


@pytest.mark.parametrize("settle", [1, 5, 10_000])
@pytest.mark.parametrize("k", [0, 1, 37, 499, 500, 900])
def test_cutoff_takes_exactly_the_smallest(spark, monkeypatch, settle, k):
    monkeypatch.setattr(select_rank, "SETTLE_ROWS", settle)
    df = spark.range(500)
    cut = select_rank.hash_cutoff(df, "id", 3, lambda n: k)
    got = {r[0] for r in df.filter(cut.covers()).collect()}
    ranked = sorted((r[1], r[0]) for r in df.select("id", hash_rank(3, "id")).collect())
    assert got == {i for _, i in ranked[:k]}


def test_cutoff_rejects_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(select_rank, "SETTLE_ROWS", 10)
    df = spark.range(300).selectExpr("id % 2 AS id")
    with pytest.raises(ValueError, match="does not identify rows"):
        select_rank.hash_cutoff(df, "id", 3, lambda n: 100)


@pytest.mark.parametrize("n", [1, 2, 9, 400, 401])
@pytest.mark.parametrize("kind", ["spread", "hot", "tiny"])
def test_median_is_exact(spark, monkeypatch, n, kind):
    monkeypatch.setattr(select_rank, "SETTLE_ROWS", 3)
    rng = np.random.default_rng(n)
    values = {"spread": rng.lognormal(0, 6, n), "hot": np.where(rng.random(n) < 0.6, 5.0,
                                                                rng.normal(size=n)),
              "tiny": np.nextafter(1.0, 2.0) * (rng.random(n) < 0.5) + 1.0}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert select_rank.exact_median(df, "v") == np.median(values)


def test_driver_and_column_draws_agree(spark):
    got = spark.range(20).select(uniform("s", "id")).collect()
    assert [r[0] for r in got] == [driver_uniform("s", i) for i in range(20)]


def test_dense_ids_are_ranks(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 10007 AS k").repartition(7)
    rows = sorted((r["k"], r["dense_id"]) for r in dense_ids(df, "k").collect())
    assert [d for _, d in rows] == list(range(1000))


def test_large_sample_with_replacement_uses_every_draw(spark, monkeypatch):
    monkeypatch.setattr(sample, "TOP_ROWS", 10)
    df = spark.range(300)
    rows = sample.sample_with_replacement(df, "id", "big", 200).collect()
    assert sum(r["n_draws"] for r in rows) == 200
    assert len({r["id"] for r in rows}) == len(rows)


def test_both_sample_paths_pick_the_same_rows(spark, monkeypatch):
    df = spark.range(300)
    small = sample.sample_with_replacement(df, "id", "same", 40).select("id", "n_draws").collect()
    monkeypatch.setattr(sample, "TOP_ROWS", 10)
    large = sample.sample_with_replacement(df, "id", "same", 40).select("id", "n_draws").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))


def test_make_dirty_blanks_exact_count_in_one_column(spark):
    df = spark.range(230).selectExpr("id", "1D AS a", "2D AS b", "3D AS c")
    dirty = sample.make_dirty(df, "id", ["a", "b", "c"], 0.1, 4)
    counts = dirty.selectExpr("count(a)", "count(b)", "count(c)").collect()[0]
    assert sorted(counts) == [207, 230, 230]


@pytest.mark.parametrize("settle", [3, 10_000])
def test_quantiles_skip_nan_and_count_infinities(spark, monkeypatch, settle):
    monkeypatch.setattr(select_rank, "SETTLE_ROWS", settle)
    inf, nan = float("inf"), float("nan")
    rows = [(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, inf, inf, -inf, nan, None)]
    df = spark.createDataFrame(rows, "v double")
    assert select_rank.exact_quantiles(df, "v", lambda n: list(range(n))) == [
        -inf, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, inf, inf]
