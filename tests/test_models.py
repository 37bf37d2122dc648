"""Learners against numpy, and what the verdicts promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.functions.linear import any_null, score_text
from gapwise.models import approx, certain, moments
from gapwise.models.descent import descend
from gapwise.models.moments import wide_moments
from gapwise.models.newton import fit_many
from gapwise.models.ols import fit_ols
from gapwise.models.svm import cubic_terms, fit_cubic_svm, fit_svm
from gapwise.operators.profile import repair_bounds
from gapwise.operators.sample import make_dirty
from gapwise.plans import experiments
from gapwise.sources.generators import kernel_table, regression_table, svm_table


def frame(spark, x, y=None, key=False):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    if y is not None:
        rows = [(*r, float(v)) for r, v in zip(rows, y)]
        names = [*names, "y"]
    schema = ", ".join(f"{n} double" for n in names)
    if key:
        rows = [(i, *r) for i, r in enumerate(rows)]
        schema = "id bigint, " + schema
    return spark.createDataFrame(rows, schema)


def test_ols_matches_numpy_also_when_collinear(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 1000, 1e-3]
    y = x @ [2, 0.003, 400] + rng.normal(size=200)
    names = ["x0", "x1", "x2"]
    model = fit_ols(frame(spark, x, y), names, "y", refine=True)
    assert np.allclose(model.weights, np.linalg.lstsq(x, y, rcond=None)[0])
    twice = np.hstack([x, x[:, :1]])
    fitted = twice @ np.array(fit_ols(frame(spark, twice, y), [*names, "x3"], "y").weights)
    assert np.allclose(fitted, x @ np.linalg.lstsq(x, y, rcond=None)[0])


@pytest.mark.parametrize("width", [45, 300])
def test_wide_moments_match_numpy(spark, width):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(120, width)), rng.normal(size=120)
    df = spark.createDataFrame([(list(map(float, r)), float(v)) for r, v in zip(x, y)],
                               "x array<double>, y double").repartition(3)
    found = wide_moments(df, "x", "y", width)
    assert found.n == 120
    assert np.allclose(found.gram, x.T @ x) and np.allclose(found.cross, x.T @ y)


def test_wide_learners_and_check(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 50))
    y = x[:, :3] @ [1, 2, 3]
    x[rng.random(150) < 0.1, 49] = np.nan
    df = frame(spark, x, y)
    names = [f"x{i}" for i in range(50)]
    assert certain.check_linear(df, names, "y").collect()[0]["is_certain"]
    complete = names[:49]
    stepped = descend(df, complete, "y", "squared", 3, 0.1)
    w, b = np.zeros(49), 0.0
    for _ in range(3):
        r = x[:, :49] @ w + b - y
        w, b = w - 0.1 * r @ x[:, :49] / 150, b - 0.1 * r.mean()
    assert np.allclose(stepped.weights, w) and np.isclose(stepped.intercept, b)


def objective(x, y, w, b, l2):
    return np.maximum(0, 1 - y * (x @ np.array(w) + b)).mean() + l2 / 2 * np.dot(w, w)


def test_newton_reaches_the_optimum_of_long_descent(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = np.sign(x @ [1, -2, 0.5] + rng.normal(size=400))
    model = fit_svm(frame(spark, x, y), ["x0", "x1", "x2"], "y", l2=1e-3)
    w, b = np.zeros(3), 0.0
    best = np.inf
    for t in range(20_000):
        s = np.where(y * (x @ w + b) < 1, -y, 0)
        rate = 2.0 / np.sqrt(t + 1)
        w, b = w - rate * (s @ x / 400 + 1e-3 * w), b - rate * s.mean()
        best = min(best, objective(x, y, w, b, 1e-3))
    assert objective(x, y, model.weights, model.intercept, 1e-3) <= best + 2e-3
    assert model.info["scans"] <= 60


def test_many_models_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = np.sign(x[:, 0] + 0.5 * rng.normal(size=300))
    df = frame(spark, x, y, key=True).withColumn("m", (F.col("id") % 3).cast("int"))
    many = fit_many(df, [F.col("m") == i for i in range(3)], ["x0", "x1"], "y", 1e-2)
    for i in range(3):
        one = fit_svm(df.filter(F.col("m") == i), ["x0", "x1"], "y", l2=1e-2)
        assert np.allclose(many[i].weights, one.weights, atol=1e-6)


def test_cubic_map_is_the_kernel(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=4), rng.normal(size=4)
    names = ["x0", "x1", "x2", "x3"]
    terms = ", ".join(f"{sql} AS {name}" for name, sql in cubic_terms(names, 0.7))
    rows = frame(spark, np.array([x, z])).selectExpr(*[
        f"{sql} AS {name}" for name, sql in cubic_terms(names, 0.7)]).collect()
    assert terms and np.isclose(np.dot(rows[0], rows[1]), (0.7 * x @ z) ** 3)
    with pytest.raises(ValueError):
        cubic_terms([f"x{i}" for i in range(41)], 1.0)


def test_certain_regression_survives_every_repair(spark):
    table = regression_table(spark.range(400), "id", 5, 0.1, "t").cache()
    names = [f"x{i}" for i in range(5)]
    assert certain.check_linear(table, names, "y").collect()[0]["is_certain"]
    rows = np.array([[np.nan if v is None else v for v in r]
                     for r in table.select(*names, "y").collect()], float)
    x, y = rows[:, :5], rows[:, 5]
    rng = np.random.default_rng(6)
    reference = None
    for _ in range(20):
        repaired = np.where(np.isnan(x), rng.normal(0, 10, x.shape), x)
        w = np.linalg.lstsq(repaired, y, rcond=None)[0]
        reference = w if reference is None else reference
        assert np.allclose(w, reference, atol=1e-6)
    noisy = table.withColumn("y", F.col("y") + F.col("x0") * F.col("x0"))
    assert not certain.check_linear(noisy, names, "y").collect()[0]["is_certain"]


def test_certain_svm_hinge_is_the_same_for_every_repair(spark):
    table = svm_table(spark.range(300), "id", 3, 0.05, "t", 0.5, 1.0).withColumn(
        "x0", F.when(F.col("x0").isNotNull(), 0.0))
    names = ["x0", "x1", "x2"]
    complete = table.na.drop("any")
    model = fit_svm(complete, names, "y", l2=1e-3)
    verdict = certain.check_svm(table, names, "y", l2=1e-3).collect()[0]
    assert verdict["n_missing_rows"] > 0
    rows = np.array([[np.nan if v is None else v for v in r]
                     for r in table.select(*names, "y").collect()], float)
    gap = np.isnan(rows[:, 0])
    margins = rows[gap, 3] * (np.nan_to_num(rows[gap, :3]) @ np.array(model.weights))
    assert np.isclose(verdict["min_margin"], margins.min())
    assert verdict["is_certain"] == bool(margins.min() > 1 and abs(model.weights[0]) < 1e-3)


def test_row_order_and_partitioning_do_not_matter(spark):
    table = regression_table(spark.range(300), "id", 5, 0.1, "p")
    names = [f"x{i}" for i in range(5)]
    first = certain.check_linear(table, names, "y").collect()[0]
    second = certain.check_linear(table.repartition(5), names, "y").collect()[0]
    assert first["is_certain"] == second["is_certain"]
    assert first["n_missing_rows"] == second["n_missing_rows"]


def test_missing_label_is_refused(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "x0 double, y double")
    with pytest.raises(ValueError, match="label"):
        certain.check_linear(df, ["x0"], "y").collect()


def test_hundreds_of_features_stay_shallow(spark):
    names = [f"f{i}" for i in range(700)]
    df = spark.range(4).select(*[(F.col("id") + i).cast("double").alias(n)
                                 for i, n in enumerate(names)])
    score = F.expr(score_text(names, [1.0] * len(names), 0.5, skip_null=True))
    rows = df.filter(~any_null(names)).select(score.alias("s")).collect()
    assert sorted(r["s"] for r in rows) == [700 * i + 699 * 350 + 0.5 for i in range(4)]


def test_wide_svm_check_and_seed_search(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0.5, 1, (60, 44))
    y = np.where(np.arange(60) % 2 == 0, 1.0, -1.0)
    x[:, 1:] *= y[:, None]
    x[:, 0] = 0.0
    names = [f"x{i}" for i in range(44)]
    df = frame(spark, x, y, key=True)
    found = experiments.check_corruptions(df, "id", names, "y", 0.1, [5], 1e-3)[0]
    dirty = make_dirty(df, "id", names, 0.1, 5)
    row = certain.check_svm(dirty, names, "y", model=found["model"]).collect()[0]
    assert row["n_missing_rows"] == 6
    assert np.isclose(row["min_margin"], found["min_margin"])
    assert row["is_certain"] == found["is_certain"]


def test_labels_must_be_plus_minus_one(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0)], "x0 double, y double")
    with pytest.raises(ValueError, match="-1"):
        certain.check_svm(df, ["x0"], "y")


def test_evaluation_table_must_keep_complete_columns(spark):
    train = spark.createDataFrame([(1.0, None, 2.0), (2.0, 1.0, 4.0)],
                                  "x0 double, x1 double, y double")
    other = spark.createDataFrame([(3.0, None, 6.0), (4.0, 2.0, 8.0)],
                                  "x0 double, x1 double, y double")
    names = ["x0", "x1"]
    assert certain.check_linear(train, names, "y", eval_df=other).collect()[0]["is_certain"]
    broken = other.withColumn("x0", F.lit(None).cast("double"))
    with pytest.raises(ValueError, match="complete in training"):
        certain.check_linear(train, names, "y", eval_df=broken)


def test_no_gaps_means_certain(spark):
    x = np.arange(12.0).reshape(6, 2)
    assert certain.check_linear(frame(spark, x, x[:, 0] ** 2), ["x0", "x1"],
                                "y").collect()[0]["is_certain"]


def test_minimax_beats_other_weights_and_is_zero_when_certain(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = x @ [1.0, 0.8] + 0.3 * rng.normal(size=200)
    x[rng.random(200) < 0.2, 1] = np.nan
    df = frame(spark, x, y, key=True)
    bounds = repair_bounds(df, ["x1"])
    table = approx.linear_versions(df, "id", ["x0", "x1"], "y", bounds, 20, "m")
    w, regret, gap = approx.minimax_weights(table)
    assert regret >= -1e-9 and gap <= 1e-6 * max(regret, 1)
    for _ in range(50):
        other = w + rng.normal(0, 0.05, 2)
        losses = table.losses(other)
        assert max(losses[v] - table.best[v] for v in losses) >= regret - 1e-6
    sure = regression_table(spark.range(300), "id", 5, 0.1, "t")
    names = [f"x{i}" for i in range(5)]
    row = approx.approx_linear(sure, "id", names, "y", repair_bounds(sure, ["x4"]), 10, "v",
                               threshold=1e-3).collect()[0]
    assert abs(row["max_regret"]) < 1e-3 and row["is_approximately_certain"]


def test_worst_case_descent_lowers_the_worst_loss(spark):
    rng = np.random.default_rng(8)
    x = rng.random((150, 2))
    y = x @ [0.7, 0.4]
    x[rng.random(150) < 0.2, 1] = np.nan
    df = frame(spark, x, y)
    bounds = repair_bounds(df, ["x1"])
    _, early = approx.worst_case_descent(df, ["x0", "x1"], "y", bounds, 1, 0.3)
    _, late = approx.worst_case_descent(df, ["x0", "x1"], "y", bounds, 25, 0.3)
    assert late < early


def test_kernel_table_appends_rows_outside_the_margin(spark):
    table = kernel_table(spark.range(150), "id", 3, 12, "k").cache()
    extra = table.filter("x0 IS NULL")
    assert extra.count() == 12 and table.count() == 312
    names = ["x0", "x1", "x2"]
    model, _ = fit_cubic_svm(table.filter("x0 IS NOT NULL"), names, "y")
    worst = extra.agg(F.min(F.col("y") * model.score())).collect()[0][0]
    assert worst > 1


def test_narrow_limit_is_shared():
    assert moments.NARROW == 40
