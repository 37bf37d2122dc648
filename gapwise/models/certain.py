"""Certain models: is one model optimal for every repair of the missing cells?

Every check returns one row with the verdict and the statistics behind it, as a
lazy aggregate; fitting happens first, on complete columns or complete rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.linear import any_null, any_null_text, number, quoted
from gapwise.models.linear_model import LinearModel
from gapwise.models.moments import NARROW, moments
from gapwise.models.ols import fit_ols
from gapwise.models.svm import cubic_score, fit_cubic_svm, fit_svm
from gapwise.operators.impute import apply_fills
from gapwise.operators.metrics import accuracy, mean_squared_error, r_squared
from gapwise.operators.profile import null_counts

RESIDUAL_TOLERANCE = 1e-3
WEIGHT_TOLERANCE = 1e-3


def fit_on_complete_columns(df: DataFrame, features: Sequence[str],
                            label: str) -> tuple[LinearModel, list[str]]:
    """(least-squares model on the complete columns, incomplete columns).

    Narrow tables need one scan: null counts and all pair sums come together,
    and restricting to complete columns is a sub-matrix.
    """
    if len(features) <= NARROW:
        full = moments(df, features, label)
        nulls = dict(zip(full.features, full.nulls))
        complete = [f for f in features if not nulls[f]]
        part = full.restrict(complete)
        weights = part.solve() if complete else []
        model = LinearModel(tuple(complete), tuple(float(w) for w in weights), 0.0,
                            {"n": full.n})
    else:
        n, nulls = null_counts(df, [*features, label])
        if nulls[label]:
            raise ValueError("the label must not be missing")
        complete = [f for f in features if not nulls[f]]
        model = fit_ols(df.select(*complete, label), complete, label)
    return model, [f for f in features if nulls[f]]


def _residual_rows(df, model, gaps, label):
    """Residual and incomplete columns; the residual is computed once per row."""
    return df.selectExpr(f"{model.text()} - {quoted(label)} AS residual_",
                         *[f"cast({quoted(c)} AS double) AS {quoted(c)}" for c in gaps])


def _column_stats(gaps):
    """Per incomplete column: max |r| on its gaps, |sum of observed cells * r|, gaps."""
    peak = [F.coalesce(F.max(F.when(F.col(c).isNull(), F.abs("residual_"))), F.lit(0.0))
            for c in gaps]
    dot = [F.abs(F.coalesce(F.sum(F.col(c) * F.col("residual_")), F.lit(0.0))) for c in gaps]
    return peak, dot


def _largest(columns):
    return F.greatest(*columns) if len(columns) > 1 else (columns[0] if columns else F.lit(0.0))


def check_linear(df: DataFrame, features: Sequence[str], label: str,
                 atol: float = RESIDUAL_TOLERANCE, eval_df: DataFrame | None = None) -> DataFrame:
    """Certain least squares.

    With the model of the complete columns, residuals must vanish on every gap
    and be orthogonal to the observed part of every incomplete column.
    """
    model, gaps = fit_on_complete_columns(df, features, label)
    target = df if eval_df is None else eval_df
    if eval_df is not None:
        gaps = [c for c, n in null_counts(target, features)[1].items() if n]
        broken = [c for c in gaps if c in model.features]
        if broken:
            raise ValueError(f"{broken} are complete in training but not in evaluation")
    peak, dot = _column_stats(gaps)
    missing = F.sum(F.when(any_null(gaps), 1).otherwise(0))
    stats = _residual_rows(target, model, gaps, label).agg(
        F.count("*").alias("n_rows"), missing.cast("bigint").alias("n_missing_rows"),
        _largest(peak).alias("max_abs_residual_missing"), _largest(dot).alias("max_abs_dot"))
    return stats.withColumn("is_certain",
                            (F.col("max_abs_residual_missing") <= F.lit(atol))
                            & (F.col("max_abs_dot") <= F.lit(atol)))


def check_linear_by_column(df: DataFrame, features: Sequence[str], label: str,
                           atol: float = RESIDUAL_TOLERANCE) -> DataFrame:
    """One row per incomplete column."""
    model, gaps = fit_on_complete_columns(df, features, label)
    peak, dot = _column_stats(gaps)
    parts = [F.struct(F.lit(c).alias("column"), p.alias("max_abs_residual_missing"),
                      d.alias("abs_dot")) for c, p, d in zip(gaps, peak, dot)]
    rows = _residual_rows(df, model, gaps, label)
    return (rows.agg(F.array(*parts).alias("parts")).select(F.inline("parts"))
            .withColumn("is_certain", (F.col("max_abs_residual_missing") <= F.lit(atol))
                        & (F.col("abs_dot") <= F.lit(atol))))


def check_linear_rowwise(df: DataFrame, features: Sequence[str], label: str,
                         atol: float = RESIDUAL_TOLERANCE) -> DataFrame:
    """Row-oriented variant: both conditions are tested per row.

    A row with a gap needs a vanishing residual; every row needs
    |r * sum of its observed incomplete-column cells| within the tolerance.
    """
    model, gaps = fit_on_complete_columns(df, features, label)
    observed = " + ".join(f"coalesce({quoted(c)}, 0D)" for c in gaps) or "0D"
    rows = _residual_rows(df, model, gaps, label).selectExpr(
        "abs(residual_) AS r", f"{any_null_text(gaps)} AS gap",
        f"abs(residual_ * ({observed})) AS product")
    bad = "(gap AND r > {0}) OR product > {0}".format(number(atol))
    return rows.selectExpr("count(*) AS n_rows", f"count_if({bad}) AS n_violations",
                           f"coalesce(NOT bool_or({bad}), true) AS is_certain")


def _gaps_of_labelled(df: DataFrame, features: Sequence[str], label: str) -> list[str]:
    """Incomplete features, after making sure that all labels are -1 or +1; one scan."""
    row = df.selectExpr("count(*)", f"count_if({quoted(label)} IN (-1, 1))",
                        *[f"count({quoted(f)})" for f in features]).collect()[0]
    if row[1] != row[0]:
        raise ValueError(f"{row[0] - row[1]} labels are not -1 or +1")
    return [f for f, n in zip(features, row[2:]) if n < row[0]]


def _svm_model(df, features, label, gaps, model, options):
    if model is not None:
        return model
    complete = df.filter(~any_null(gaps))
    return fit_svm(complete, features, label, **options)


def check_svm(df: DataFrame, features: Sequence[str], label: str,
              model: LinearModel | None = None, wtol: float = WEIGHT_TOLERANCE,
              **options) -> DataFrame:
    """Certain linear SVM for labels -1/+1.

    With the model of the complete rows, incomplete columns must have zero
    weight and every incomplete row must lie outside the margin on its observed
    cells (without the intercept).
    """
    gaps = _gaps_of_labelled(df, features, label)
    model = _svm_model(df, features, label, gaps, model, options)
    largest = max((abs(model.weight(c)) for c in gaps), default=0.0)
    margin = f"{quoted(label)} * {model.text(skip_null=True, with_intercept=False)}"
    return (df.filter(any_null(gaps)).selectExpr(f"{margin} AS margin_")
            .agg(F.count("*").alias("n_missing_rows"), F.min("margin_").alias("min_margin"))
            .withColumn("max_abs_w_missing", F.lit(float(largest)))
            .withColumn("is_certain", F.lit(largest < wtol)
                        & F.coalesce(F.col("min_margin") > 1.0, F.lit(True))))


def check_svm_clipped(df: DataFrame, features: Sequence[str], label: str,
                      model: LinearModel | None = None, wtol: float = WEIGHT_TOLERANCE,
                      **options) -> DataFrame:
    """Variant that clips the score to [-1, 1] and rounds it half-even to one decimal."""
    gaps = _gaps_of_labelled(df, features, label)
    model = _svm_model(df, features, label, gaps, model, options)
    largest = max((abs(model.weight(c)) for c in gaps), default=0.0)
    score = model.text(skip_null=True, with_intercept=False)
    margin = f"{quoted(label)} * bround(greatest(least({score}, 1D), -1D), 1)"
    return (df.filter(any_null(gaps)).selectExpr(f"{margin} AS margin_")
            .agg(F.count("*").alias("n_missing_rows"), F.min("margin_").alias("min_margin"))
            .withColumn("max_abs_w_missing", F.lit(float(largest)))
            .withColumn("is_certain", F.lit(largest <= wtol)
                        & F.coalesce(F.col("min_margin") >= 1.0, F.lit(True))))


def check_cubic_given(df: DataFrame, features: Sequence[str], label: str, model: LinearModel,
                      gamma: float, gaps: Sequence[str], support_tol: float = 1e-6) -> DataFrame:
    """The polynomial-kernel conditions for a given decision function, in one scan.

    A complete row is a support vector iff y f <= 1; support vectors must be 0 in
    every incomplete column, and incomplete rows (gaps as 0) correct with |f| > 1.
    """
    margin = F.expr(f"{quoted(label)} * {cubic_score(model, features, gamma)}")
    return _cubic_conditions(df, margin, gaps, support_tol)


def _cubic_conditions(df: DataFrame, margin: Column, gaps: Sequence[str], support_tol: float) -> DataFrame:
    nonzero = " OR ".join(f"{quoted(c)} <> 0D" for c in gaps) or "false"
    rows = df.select(margin.alias("margin_"), F.expr(any_null_text(gaps)).alias("gap_"),
                     F.expr(f"({nonzero})").alias("nonzero_"))
    support = f"NOT gap_ AND margin_ <= {number(1.0 + support_tol)}"
    return rows.selectExpr(
        f"count_if({support}) AS n_support",
        f"count_if({support} AND nonzero_) AS n_support_nonzero",
        "count_if(gap_) AS n_missing_rows", "min(CASE WHEN gap_ THEN margin_ END) AS min_margin",
    ).withColumn("is_certain", (F.col("n_support_nonzero") == 0)
                 & F.coalesce(F.col("min_margin") > 1.0, F.lit(True)))


def check_cubic_svm(df: DataFrame, features: Sequence[str], label: str, support_tol: float = 1e-6,
                    **options) -> DataFrame:
    """Certain cubic-kernel SVM, fitted on the complete rows, at any number of features."""
    gaps = _gaps_of_labelled(df, features, label)
    model, _ = fit_cubic_svm(df.filter(~any_null(gaps)), features, label, **options)
    return _cubic_conditions(df, F.col(label) * model.score(), gaps, support_tol)


def certain_score_regression(train: DataFrame, test: DataFrame, features: Sequence[str],
                             label: str, atol: float = RESIDUAL_TOLERANCE,
                             metric: str = "mse") -> DataFrame:
    """(is_certain, score): the model on zero-filled rows scored on complete test rows."""
    verdict = check_linear(train, features, label, atol).collect()[0]["is_certain"]
    if not verdict:
        return train.sparkSession.createDataFrame([(False, None)],
                                                  "is_certain boolean, score double")
    model = fit_ols(apply_fills(train, {f: 0.0 for f in features}), features, label)
    measure = {"mse": mean_squared_error, "r2": r_squared}[metric]
    return (test.na.drop("any", subset=list(features))
            .agg(F.lit(True).alias("is_certain"), measure(model.score(), label).alias("score")))


def certain_score_svm(train: DataFrame, test: DataFrame, features: Sequence[str], label: str,
                      **options) -> DataFrame:
    """(is_certain, score): accuracy of the complete-row model where it is certain."""
    gaps = _gaps_of_labelled(train, features, label)
    model = _svm_model(train, features, label, gaps, None, options)
    verdict = check_svm(train, features, label, model=model).collect()[0]["is_certain"]
    if not verdict:
        return train.sparkSession.createDataFrame([(False, None)],
                                                  "is_certain boolean, score double")
    guess = F.when(model.score() > 0, 1.0).otherwise(-1.0)
    return (test.na.drop("any", subset=list(features))
            .agg(F.lit(True).alias("is_certain"), accuracy(guess, label).alias("score")))


