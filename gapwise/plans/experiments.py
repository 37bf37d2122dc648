"""Whole experiments as jobs that return a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions.hashing import driver_uniform
from gapwise.functions.linear import any_null, score_text
from gapwise.models.active_clean import active_clean_runs, average_runs, prepare
from gapwise.models.certain import (WEIGHT_TOLERANCE, certain_score_regression,
                                    certain_score_svm, check_linear)
from gapwise.models.newton import fit_many
from gapwise.models.ols import fit_ols
from gapwise.models.svm import fit_svm
from gapwise.operators import impute, knn, metrics
from gapwise.operators.profile import incomplete_columns
from gapwise.operators.sample import pick_column
from gapwise.operators.select_rank import hash_cutoffs, share_of
from gapwise.plans.seed_screen import SeedScreen
from gapwise.sources.generators import regression_table

# Fixed value: candidate seeds are drawn from [1, SEED_LIMIT).
SEED_LIMIT = 10_000
MAX_ATTEMPTS = 10_000
LOOK_AHEAD = 1024  # seeds screened in one pass


def candidate_seed(run, attempt: int) -> int:
    return 1 + int(driver_uniform(run, "seed", attempt) * (SEED_LIMIT - 1))


def check_corruptions(df: DataFrame, key: str, features: Sequence[str], label: str, rate: float,
                      seeds: Sequence[int], l2: float,
                      wtol: float = WEIGHT_TOLERANCE) -> list[dict]:
    """Corrupt the table with each seed and check the linear SVM, all seeds together.

    A corruption is a predicate (which rows) and a column, never a copy of the
    table: a packed row carries one bit for each seed that leaves it whole, and
    every training step and the final check serve all seeds in one pass.
    """
    cuts = hash_cutoffs(df, key, seeds, share_of(rate))
    columns = [pick_column(features, seed) for seed in seeds]
    hit = [c.covers() for c in cuts]
    models = fit_many(df, [~h for h in hit], features, label, l2)
    margins = []
    for i, (model, column) in enumerate(zip(models, columns)):
        weights = [0.0 if f == column else w for f, w in zip(features, model.weights)]
        score = score_text(features, weights)
        margins.append(F.min(F.when(hit[i], F.col(label) * F.expr(score))).alias(f"m{i}"))
    row = df.agg(*margins).collect()[0]
    found = []
    for i, seed in enumerate(seeds):
        weight = abs(models[i].weight(columns[i])) if cuts[i].taken else 0.0
        certain = weight < wtol and (row[i] is None or row[i] > 1.0)
        found.append({"seed": seed, "column": columns[i], "is_certain": certain,
                      "model": models[i], "min_margin": row[i], "weight": weight})
    return found


def search_seed(df: DataFrame, key: str, features: Sequence[str], label: str, rate: float,
                run, want_certain: bool = True, test: DataFrame | None = None,
                max_attempts: int = MAX_ATTEMPTS, chunk: int = 8, l2: float = 1e-4) -> DataFrame:
    """First corruption seed with (or without) a certain model.

    One row: found, seed, n_failures, n_checked, accuracy on the complete test
    rows.  Seeds are checked a chunk at a time, so the search stops early.  A
    seed drawn again has the verdict it had.  Where the first chunk has no
    certain model, seeds that surely have none are found in passes of growing
    size, and only the others are trained on the whole table.
    """
    rows = df.select(key, *features, label).persist(StorageLevel.MEMORY_AND_DISK)
    first: dict[int, int] = {}
    for attempt in range(max_attempts):
        first.setdefault(candidate_seed(run, attempt), attempt)
    order, at, ahead, hit, screen = list(first), 0, chunk, None, None
    try:
        while at < len(order) and hit is None:
            seeds, at, seen = order[at:at + ahead], at + ahead, []
            if screen is not None:
                out = screen.ruled_out(seeds)
                seeds = [s for s in seeds if s not in out]
            for i in range(0, len(seeds), chunk):
                results = check_corruptions(rows, key, features, label, rate, seeds[i:i + chunk], l2)
                hit = next((r for r in results if r["is_certain"] == want_certain), None)
                if hit is not None:
                    break
                seen += [r["model"] for r in results]
            if want_certain and hit is None and at < len(order):
                screen = screen or SeedScreen(rows, key, features, label, rate, l2, WEIGHT_TOLERANCE, seen)
                ahead = min(max(8 * chunk, 4 * ahead), LOOK_AHEAD)
    finally:
        rows.unpersist()
        if screen is not None:
            screen.close()
    attempt = first[hit["seed"]] if hit is not None else max_attempts
    score = None
    if hit is not None and test is not None:
        guess = F.when(hit["model"].score() > 0, 1.0).otherwise(-1.0)
        score = (test.na.drop("any", subset=list(features))
                 .agg(metrics.accuracy(guess, label)).collect()[0][0])
    record = (hit is not None, hit["seed"] if hit else None, attempt,
              attempt + (1 if hit else 0), score)
    return df.sparkSession.createDataFrame(
        [record], "is_found boolean, seed int, n_failures int, n_checked int, accuracy double")


def sweep_linear(ids: DataFrame, key: str, feature_counts: Sequence[int],
                 rates: Sequence[float], seed, sizes: Sequence[float] = (1.0,)) -> DataFrame:
    """Certain least squares over a grid of generated tables: one row per configuration.

    ``sizes`` are numbers of copies of the key set a configuration is generated for.
    """
    results = None
    for copies in sizes:
        for width in feature_counts:
            for rate in rates:
                names = [f"x{i}" for i in range(width)]
                grown = ids if copies == 1 else ids.select(
                    (F.col(key) * int(copies) + F.explode(F.sequence(
                        F.lit(0), F.lit(int(copies) - 1)))).alias(key))
                table = regression_table(grown, key, width, rate, seed)
                row = check_linear(table, names, "y").select(
                    F.lit(int(width)).alias("n_features"), F.lit(float(rate)).alias("rate"),
                    "n_rows", "n_missing_rows", "is_certain")
                results = row if results is None else results.unionByName(row)
    return results


def _table(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "method string, metric string, score double")


def compare_regression(train: DataFrame, test: DataFrame, key: str, features: Sequence[str],
                       label: str, seed=0, runs: int = 5, total: int = 1000,
                       methods: Sequence[str] = ("certain", "knn", "mean", "delete",
                                                 "active_clean"),
                       intercept: bool = False) -> DataFrame:
    """(method, metric, score) on complete test rows: ``mse``, but ``r2`` for active cleaning.

    The baselines have the model class of the certain model, least squares
    without intercept, unless ``intercept`` is set.
    """
    train, test = _held(train, key, features, label), _held(test, key, features, label)
    complete_test = test.na.drop("any", subset=list(features))

    def score_of(fitted_on: DataFrame) -> float:
        model = fit_ols(fitted_on, features, label, intercept=intercept)
        return complete_test.agg(
            metrics.mean_squared_error(model.score(), label)).collect()[0][0]

    return _compare(train, test, key, features, label, seed, runs, total, methods, "regression",
                    score_of, lambda: certain_score_regression(train, test, features, label))


def compare_classification(train: DataFrame, test: DataFrame, key: str, features: Sequence[str],
                           label: str, seed=0, runs: int = 5, total: int = 1000,
                           l2: float = 1e-4,
                           methods: Sequence[str] = ("certain", "knn", "mean", "delete",
                                                     "active_clean")) -> DataFrame:
    """(method, metric, score): ``accuracy`` of a linear SVM on complete test rows."""
    train, test = _held(train, key, features, label), _held(test, key, features, label)
    complete_test = test.na.drop("any", subset=list(features))

    def score_of(fitted_on: DataFrame) -> float:
        model = fit_svm(fitted_on, features, label, l2=l2)
        guess = F.when(model.score() > 0, 1.0).otherwise(-1.0)
        return complete_test.agg(metrics.accuracy(guess, label)).collect()[0][0]

    return _compare(train, test, key, features, label, seed, runs, total, methods,
                    "classification", score_of,
                    lambda: certain_score_svm(train, test, features, label, l2=l2))


def _compare(train, test, key, features, label, seed, runs, total, methods, task,
             score_of: Callable[[DataFrame], float], certain: Callable[[], DataFrame]):
    try:
        return _table(train, _scores(train, key, features, label, seed, runs, total, methods, task,
                                     score_of, certain))
    finally:
        train.unpersist()
        test.unpersist()


def _held(df: DataFrame, key: str, features: Sequence[str], label: str) -> DataFrame:
    """The columns a comparison reads; every method reads them several times."""
    return df.select(key, *features, label).persist(StorageLevel.MEMORY_AND_DISK)


def _scores(train, key, features, label, seed, runs, total, methods, task, score_of, certain) -> list[tuple]:
    gaps = incomplete_columns(train, features)
    rows = []
    for method in methods:
        if method == "certain":
            score = certain().collect()[0]["score"]
        elif method == "knn":
            score = score_of(knn.impute_knn(train, key, features))
        elif method == "mean":
            fills = impute.mean_or_mode_fills(train, gaps)
            score = score_of(impute.apply_fills(train, fills))
        elif method == "delete":
            score = score_of(train.filter(~any_null(gaps)))
        elif method == "active_clean":
            prepared = prepare(train, key, features, label, seed)
            runs_table = active_clean_runs(prepared, key, features, label, range(runs),
                                           task=task, total=total)
            score = average_runs(runs_table).collect()[0]["avg_score"]
        else:
            raise ValueError(f"unknown method {method}")
        metric = "accuracy" if task == "classification" else "r2" if method == "active_clean" else "mse"
        rows.append((method, metric, score))
    return rows


