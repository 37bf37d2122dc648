import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.models import active_clean as ac
from gapwise.operators.sample import blank_at_rate, sample_with_replacement


@pytest.fixture(scope="module")
def prepared(spark):
    df = spark.range(400).select(
        "id", (F.pmod(F.col("id") * 37, F.lit(101)) / 101.0).alias("a"),
        (F.pmod(F.col("id") * 53, F.lit(97)) / 97.0).alias("b"))
    df = df.withColumn("y", 2 * F.col("a") - F.col("b"))
    df = blank_at_rate(df, ["id"], "a", 0.15, "a")
    return ac.prepare(df, "id", ["a", "b"], "y", "prep").cache()


def test_prepare_leaves_no_gap_and_flags_rows(prepared):
    row = prepared.selectExpr("count(a)", "count(*)", "count_if(is_dirty)",
                              "max(CASE WHEN is_dirty THEN a END)").collect()[0]
    assert row[0] == row[1] == 400 and 0 < row[2] < 200 and row[3] < 0.01


def test_only_missing_keeps_observed_cells(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, 3.0, None), (3, 1.0, 1.0)],
                               "id bigint, a double, b double").withColumn("y", F.lit(0.0))
    kept = {r["id"]: r for r in ac.prepare(df, "id", ["a", "b"], "y", 1,
                                           only_missing=True).collect()}
    assert kept[1]["b"] == 5.0 and kept[2]["a"] == 3.0 and kept[1]["a"] < 0.01
    both = {r["id"]: r for r in ac.prepare(df, "id", ["a", "b"], "y", 1).collect()}
    assert both[1]["b"] < 0.01 and both[3]["b"] == 1.0


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_sample_on_driver_and_as_table_agree(spark, prepared, monkeypatch, task):
    data = prepared if task == "regression" else prepared.withColumn(
        "y", F.when(F.col("y") > 0.5, 1.0).otherwise(-1.0))
    options = dict(task=task, batch=30, total=120, stop_below=30, classifier_steps=6,
                   model_steps=3, first_steps=6)
    small = ac.active_clean(data, "id", ["a", "b"], "y", 1, **options)
    monkeypatch.setattr(ac, "DRIVER_SAMPLE", 10)
    large = ac.active_clean(data, "id", ["a", "b"], "y", 1, **options)
    assert small[0] == large[0]
    assert np.isclose(small[1], large[1], atol=0.05)


def test_pool_filter_modes_split_the_pool(prepared):
    kept = ac.filter_pool(prepared, ["a", "b"], [3.0, 0.0], -2.0)
    rest = ac.filter_pool(prepared, ["a", "b"], [3.0, 0.0], -2.0, mode="keep_dirty")
    assert kept.count() + rest.count() == 400


def test_stops_when_the_pool_is_used_up(spark, prepared):
    cleaned, _ = ac.active_clean(prepared.filter("id < 90"), "id", ["a", "b"], "y", 3, batch=30,
                                 total=100_00, stop_below=30, classifier_steps=3)
    assert 0 <= cleaned <= 90


@pytest.mark.parametrize("mode", ["reference", "keep_dirty"])
def test_pool_as_data_keeps_what_filters_keep(spark, prepared, mode):
    data = prepared.unionByName(prepared.limit(1).withColumn("id", F.lit(None).cast("bigint")))
    pool, chain = ac._Pool(data, "id", ["a", "b"], 0.9, mode), data
    assert pool.count() == 401
    for keys, weights, bias in (([3, 5], [3.0, 0.5], -4.0), ([7, 5], [-1.0, -2.0], 0.5)):
        pool.drop(keys)
        pool.keep(np.array(weights), bias)
        chain = ac.filter_pool(chain.filter(~F.col("id").isin(keys)), ["a", "b"], weights, bias, 0.9, mode)
        expected = sorted(r["id"] for r in chain.collect())
        assert pool.count() == len(expected)
        assert sorted(r["id"] for r in pool.only(data).collect()) == expected
    n = len(expected)
    drawn = sorted(tuple(r) for r in pool.draw("s", 5, n).collect())
    assert drawn == sorted(tuple(r) for r in sample_with_replacement(chain, "id", "s", 5, n).collect())
    pool.drop([None])
    assert pool.count() == 0


def test_repetitions_side_by_side_equal_single_ones(prepared):
    options = dict(batch=30, total=120, stop_below=30)
    runs = ac.active_clean_runs(prepared, "id", ["a", "b"], "y", [4, 5], **options).collect()
    for row, seed in zip(runs, (4, 5)):
        assert tuple(row) == (seed, *ac.active_clean(prepared, "id", ["a", "b"], "y", seed, **options))


def test_one_pass_brings_the_rows_of_the_next_draw(spark, prepared):
    for key in ("id", "name"):
        data = prepared.withColumn("name", F.concat(F.lit("row "), F.col("id").cast("string"))).repartition(3)
        data = data.select(key, "a", "b", "y", "is_dirty")
        pool = ac._Pool(data, key, ["a", "b"], 0.9, "reference")
        packed = ac._packed(data, key, ["a", "b"], "y")
        pool.drop([data.first()[0]])
        pool.keep(np.array([3.0, 0.5]), -4.0)
        left, rows = pool.ahead(packed, "s/1", 25)
        assert left == pool.count()
        drawn = [(*r, n) for r, n in zip(rows, ac.draw_times("s/1", 25, left))]
        assert sorted(drawn) == sorted(tuple(r) for r in pool.draw("s/1", 25, left).collect())
        pool.keep(np.zeros(2), -100.0)
        assert pool.ahead(packed, "s/2", 25) == (0, [])
        packed.unpersist()
