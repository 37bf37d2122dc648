"""Learners on packed blocks: certificates, width, kernels and triangles, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwise.models import approx, blocks, conjugate
from gapwise.models.certain import check_cubic_svm
from gapwise.models.newton import fit_many, fit_packed
from gapwise.models.ols import fit_ols
from gapwise.models.svm import fit_cubic_svm, fit_svm
from gapwise.operators.impute import extreme_versions
from gapwise.operators.profile import repair_bounds
from gapwise.plans import fixtures as fx
from gapwise.plans.experiments import check_corruptions
from gapwise.operators.sample import make_dirty


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, float(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ", ".join(["id long", "y double", *[f"{n} double" for n in names]])).repartition(3), names


def objective(x, y, model, l2):
    w = np.array(model.weights)
    return np.maximum(0, 1 - y * (x @ w + model.intercept)).mean() + l2 / 2 * w @ w


def classes(rng, n, d):
    x = rng.normal(size=(n, d))
    return x, np.sign(x[:, 0] - 0.5 * x[:, 1] + 0.4 * rng.normal(size=n))


def test_conjugate_steps_are_certified(spark):
    x, y = classes(np.random.default_rng(3), 400, 3)
    df, names = frame(spark, x, y)
    model = fit_svm(df, names, "y", l2=1e-2, solver="conjugate")
    assert np.isclose(model.info["objective"], objective(x, y, model, 1e-2))
    assert model.info["bound"] <= smo(x @ x.T, y, 1e-2)[1] + 1e-6
    assert model.info["objective"] - model.info["bound"] <= 2e-3


@pytest.mark.parametrize("d, n", [(3, 400), (500, 300)])
def test_one_solver_at_every_width(spark, d, n):
    x, y = classes(np.random.default_rng(d), n, d)
    df, names = frame(spark, x, y)
    model = fit_svm(df, names, "y", l2=1e-2)
    assert -1e-6 <= objective(x, y, model, 1e-2) - smo(x @ x.T, y, 1e-2)[1] <= 2e-3
    assert model.info["scans"] <= 60


def smo(kernel, y, l2):
    """A small dual solver with an intercept: pairs of rows until no pair can improve."""
    n = len(y)
    top, a = 1.0 / (n * l2), np.zeros(n)
    for _ in range(20_000):
        pull = y - kernel @ (a * y)
        up = np.where(((y > 0) & (a < top - 1e-12)) | ((y < 0) & (a > 1e-12)), pull, -np.inf)
        low = np.where(((y > 0) & (a > 1e-12)) | ((y < 0) & (a < top - 1e-12)), pull, np.inf)
        i, j = int(np.argmax(up)), int(np.argmin(low))
        if up[i] - low[j] < 1e-7:
            break
        step = (up[i] - low[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, top - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else top - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
    b = (up[i] + low[j]) / 2
    f = kernel @ (a * y)
    return f + b, np.maximum(0, 1 - y * (f + b)).mean() + l2 / 2 * (a * y) @ f


@pytest.mark.parametrize("d, n, gap", [(3, 150, 5e-4), (50, 90, 2e-3)])
def test_cubic_kernel_equals_the_dual(spark, d, n, gap):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=n))
    df, names = frame(spark, x, y)
    l2 = 1e-3
    model, gamma = fit_cubic_svm(df, names, "y", l2=l2, gap=gap)
    scores, least = smo((gamma * x @ x.T) ** 3, y, l2)
    info = model.info
    assert info["bound"] <= least + 1e-6 and least <= info["objective"] + 1e-6
    assert info["objective"] - info["bound"] <= gap
    got = np.array([r[0] for r in df.orderBy("id").select(model.score()).collect()])
    assert np.abs(got - scores).max() < 0.3
    gaps = df.withColumn("x1", F.when(F.col("id") % 10 != 0, F.col("x1")))
    filled = model.values(np.where(np.arange(d) == 1, 0.0, x[:1]))
    assert np.isclose(gaps.where("id = 0").select(model.score()).collect()[0][0], filled[0])


def test_wide_cubic_check(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 42))
    y = np.sign(x[:, 1])
    x[:, 0] = 0.0
    df, names = frame(spark, x, y)
    dirty = df.withColumn("x0", F.when(F.col("id") % 7 != 0, F.col("x0")))
    row = check_cubic_svm(dirty, names, "y", l2=1e-3).collect()[0]
    assert row["n_missing_rows"] == 12 and row["n_support_nonzero"] == 0


def test_long_vectors_are_added_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 7)
    monkeypatch.setattr(blocks, "DIRECT_BYTES", 0)
    x, y = classes(np.random.default_rng(2), 50, 5)
    df, names = frame(spark, x, y)
    packed = blocks.Blocks(df, names, "y")
    total = packed.total(lambda a, b, m: (a.T @ a).ravel(), 25)
    assert np.allclose(total.reshape(5, 5), x.T @ x)
    assert not packed.total(lambda a, b, m: np.zeros(3), 3).any()
    packed.close()
    assert not blocks.Blocks(df.limit(0), names, "y").total(lambda a, b, m: np.ones(3), 3).any()


def test_least_squares_where_the_normal_equations_fail(spark):
    n, d = 400, 9
    x = 1.0 / (np.arange(n)[:, None] + np.arange(1, d + 1)[None, :])  # Hilbert-like
    w = np.arange(1.0, d + 1)
    y = x @ w
    df, names = frame(spark, x, y)
    gram = np.linalg.lstsq(x.T @ x, x.T @ y, rcond=None)[0]
    assert np.abs(gram - w).max() > 1e-2
    model = fit_ols(df.repartition(20), names, "y")
    assert np.abs(np.array(model.weights) - w).max() < 1e-3
    assert model.info["n"] == n and model.info["sse"] < 1e-18
    with pytest.raises(ValueError):
        fit_ols(df.withColumn("x1", F.when(F.col("id") > 3, F.col("x1"))), names, "y")


def test_seeds_share_the_table(spark):
    x, y = classes(np.random.default_rng(5), 200, 3)
    df, names = frame(spark, x, y)
    found = check_corruptions(df, "id", names, "y", 0.1, [3, 4, 5], 1e-2)
    for result in found:
        dirty = make_dirty(df, "id", names, 0.1, result["seed"]).na.drop()
        alone = fit_svm(dirty, names, "y", l2=1e-2)
        assert np.allclose(result["model"].weights, alone.weights, atol=1e-6)
    packed = blocks.Blocks(df, names, "y", [F.col("id") % 2 == 0, F.col("id") > 5])
    plan = packed.rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hash" not in plan
    packed.close()


def test_minimax_of_versions_is_bounded(spark):
    x, y = classes(np.random.default_rng(6), 120, 2)
    df, names = frame(spark, x, y)
    df = df.withColumn("x0", F.when(F.col("id") % 6 != 0, F.col("x0")))
    bounds = repair_bounds(df, ["x0"])
    row = approx.approx_svm(df, "id", names, "y", bounds, versions=6, seed=1).collect()[0]
    assert 0 <= row["lower_bound"] <= row["max_regret"] <= row["lower_bound"] * 1.01 + 1e-3
    shared = np.array([r for r in df.na.drop().select(*names, "y").collect()], float)
    versions = []
    for v in range(6):
        own = extreme_versions(df, "id", bounds, 6, 1).where(f"version = {v}").select(*names, "y")
        rows = np.vstack([shared, np.array(own.collect(), float)])
        versions.append((rows[:, :2], rows[:, 2]))
    grid = np.stack(np.meshgrid(np.linspace(-1, 3, 201), np.linspace(-2, 1, 151)), -1).reshape(-1, 2)
    losses = np.stack([np.maximum(0, 1 - t[:, None] * (a @ grid.T)).sum(0) + (grid ** 2).sum(1) / 2 for a, t in versions])
    least = (losses - losses.min(axis=1, keepdims=True)).max(axis=0).min()
    assert abs(row["max_regret"] - least) < 0.05 * least + 0.05


def test_learners_without_rows(spark):
    x, y = classes(np.random.default_rng(7), 40, 2)
    df, names = frame(spark, x, y)
    empty, full = fit_many(df, [F.lit(False), F.lit(True)], names, "y", 1e-2)
    assert empty.info["n"] == 0 and not any(empty.weights) and full.info["n"] == 40
    assert conjugate.fit_linear(df, names, "y", 1e-2).info["n"] == 40


@pytest.mark.parametrize("width", [3, 20])
def test_owned_rows_train_as_their_predicates_say(spark, width):
    draw = np.random.default_rng(5)
    names = [f"x{i}" for i in range(width)]
    x = draw.normal(size=(600, width))
    y = np.sign(x[:, 0] + 0.3 * draw.normal(size=600))
    rows = [(int(i), None if i % 3 else int(draw.integers(0, 4)), *map(float, a), float(b))
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id bigint, v int, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(3)
    trains = [F.col("v").isNull() | (F.col("v") == v) for v in range(4)]
    packed = blocks.Blocks(df, names, "y", owner=F.col("v"))
    owned = fit_packed(packed, 4, names, 1e-2)
    packed.close()
    for one, other in zip(owned, fit_many(df, trains, names, "y", 1e-2)):
        assert one.info == other.info
        assert np.allclose(one.weights, other.weights, atol=1e-9) and np.isclose(one.intercept, other.intercept, atol=1e-9)


def test_rows_beyond_doubt_have_the_same_side_at_every_point():
    draw = np.random.default_rng(6)
    cells, y = draw.normal(size=(500, 3)), np.sign(draw.normal(size=500))
    points = np.array([[2.0], [1.0], [0.5]]) + 0.1 * draw.normal(size=(3, 8))
    left, sure, short, middle = blocks.beyond_doubt(cells, y, points, 0.4)
    every = 1 - y[:, None] * (cells @ points)
    assert (every[sure] >= 0.4).all() and (every[~sure & ~left] <= 0).all() and 0 < left.sum() < 250
    assert np.allclose(short, 1 - y[sure] * (cells[sure] @ middle))


def test_a_short_file_makes_work_for_all_cores(spark, folder):
    tasks = spark.sparkContext.defaultParallelism
    assert fx.svm_gaps(spark, folder).rdd.getNumPartitions() >= tasks
