"""Queries: certain models, approximately certain models, iterative cleaning, experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gapwise.functions.hashing import driver_uniform
from gapwise.models import active_clean as ac
from gapwise.models import approx, certain
from gapwise.models.linear_model import LinearModel
from gapwise.models.svm import cubic_terms
from gapwise.operators import sample
from gapwise.operators.profile import repair_bounds
from gapwise.plans import experiments
from gapwise.plans import fixtures as fx
from gapwise.plans.learn_queries import HINGE, LOGISTIC, descent_sql
from gapwise.plans.registry import load, query

_LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]

# ------------------------------------------------------- certain least squares


def _line_label(spark, folder, label: str, discount: bool = False):
    return fx.line_gaps(spark, folder, discount).withColumn("y", F.expr(label))


_EXACT = "2 * l_quantity + 3 * l_discount"
_PRICE = "l_extendedprice / 1000.0"
_FIT = """s AS (SELECT avg(l_quantity * l_quantity) AS aa, avg(l_quantity * l_discount) AS ab,
  avg(l_discount * l_discount) AS bb, avg(l_quantity * y) AS ay, avg(l_discount * y) AS by_
  FROM d), w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS w0,
  (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS w1 FROM s),
  r AS (SELECT d.*, w0 * l_quantity + w1 * l_discount - y AS r FROM d CROSS JOIN w)"""
_STATS = """count(*) AS n_rows, count(*) - count(l_tax) AS n_missing_rows,
  max(CASE WHEN l_tax IS NULL THEN abs(r) END) AS peak, abs(sum(l_tax * r)) AS dot FROM r"""


def _linear_sql(label: str) -> str:
    return (f"WITH {fx.LINE}, d AS (SELECT *, {label} AS y FROM lm), {_FIT}, "
            f"z AS (SELECT {_STATS}) SELECT n_rows, n_missing_rows, round(peak, 5) + 0.0 AS "
            "max_abs_residual_missing, round(dot / n_rows, 5) + 0.0 AS mean_abs_dot, "
            "peak <= 0.001 AND dot <= 0.001 AS is_certain FROM z")


def _linear(label: str):
    def run(spark, folder):
        result = certain.check_linear(_line_label(spark, folder, label), _LINE_FEATURES, "y")
        return result.select(
            "n_rows", "n_missing_rows",
            F.round("max_abs_residual_missing", 5).alias("max_abs_residual_missing"),
            F.round(F.col("max_abs_dot") / F.col("n_rows"), 5).alias("mean_abs_dot"),
            "is_certain")
    return run


query("cm_linear", _linear_sql(_EXACT))(_linear(_EXACT))
query("cm_linear_neg", _linear_sql(_PRICE))(_linear(_PRICE))


@query("cm_linear_by_column", f"""WITH {fx.LINE_TWO}, d AS (SELECT *, 2 * l_quantity AS y FROM lm),
  w AS (SELECT avg(l_quantity * y) / avg(l_quantity * l_quantity) AS w0 FROM d),
  r AS (SELECT d.*, w0 * l_quantity - y AS r FROM d CROSS JOIN w),
  z AS (SELECT 'l_discount' AS "column", max(CASE WHEN l_discount IS NULL THEN abs(r) END) AS peak,
    abs(sum(l_discount * r)) AS dot FROM r UNION ALL
    SELECT 'l_tax', max(CASE WHEN l_tax IS NULL THEN abs(r) END), abs(sum(l_tax * r)) FROM r)
  SELECT "column", round(peak, 5) + 0.0 AS max_abs_residual_missing, round(dot, 3) + 0.0 AS abs_dot,
  peak <= 0.001 AND dot <= 0.001 AS is_certain FROM z""")
def cm_linear_by_column(spark, folder):
    df = _line_label(spark, folder, "2 * l_quantity", discount=True)
    return certain.check_linear_by_column(df, _LINE_FEATURES, "y").select(
        "column", F.round("max_abs_residual_missing", 5).alias("max_abs_residual_missing"),
        F.round("abs_dot", 3).alias("abs_dot"), "is_certain")


@query("cm_linear_rowwise", f"""WITH {fx.LINE}, d AS (SELECT *, {_PRICE} AS y FROM lm), {_FIT},
  v AS (SELECT (l_tax IS NULL AND abs(r) > 0.001) OR abs(r * coalesce(l_tax, 0)) > 0.001 AS bad
    FROM r) SELECT count(*) AS n_rows, count(*) FILTER (WHERE bad) AS n_violations,
  NOT bool_or(bad) AS is_certain FROM v""")
def cm_linear_rowwise(spark, folder):
    return certain.check_linear_rowwise(_line_label(spark, folder, _PRICE), _LINE_FEATURES, "y")


def _certain_split(spark, folder):
    df = sample.hash_split_flag(
        _line_label(spark, folder, _EXACT).withColumn(
            "id", F.concat_ws("-", "l_orderkey", "l_linenumber")), "id", 5)
    return df.filter("NOT is_test"), df.filter("is_test")


@query("cm_score", "SELECT true AS is_certain, 0.0::DOUBLE AS score")
def cm_score(spark, folder):
    """The label is an exact function of the complete columns, so the error is zero."""
    train, test = _certain_split(spark, folder)
    return certain.certain_score_regression(train, test, _LINE_FEATURES, "y").select(
        "is_certain", F.round("score", 6).alias("score"))


# ----------------------------------------------------------------- certain SVM

_SVM_STEPS = 100


def _svm_sql(fixture: str, gap: str, clipped: bool = False, steps: int = _SVM_STEPS) -> str:
    inner = descent_sql(fixture, f"SELECT x0, x1, x2, y FROM gs WHERE {gap} IS NOT NULL", HINGE,
                        steps, 0.5, "0.0001::DOUBLE")
    inner = inner[:inner.rindex("SELECT 'x0' AS feature")]
    score = "coalesce(x0, 0) * w0 + coalesce(x1, 0) * w1 + coalesce(x2, 0) * w2"
    if clipped:
        score = f"round_even(greatest(least({score}, 1.0), -1.0), 1)"
    weight = f"w{gap[1]}"
    test = (f"abs(any_value({weight})) <= 0.001 AND min(m) >= 1" if clipped
            else f"abs(any_value({weight})) < 0.001 AND min(m) > 1")
    return (f"{inner} SELECT count(*) AS n_missing_rows, round(min(m), 5) + 0.0 AS min_margin, "
            f"round(abs(any_value({weight})), 5) + 0.0 AS max_abs_w_missing, {test} AS is_certain "
            f"FROM (SELECT it.*, y * {'(' + score + ')'} AS m FROM gs CROSS JOIN it "
            f"WHERE k = {steps} AND {gap} IS NULL)")


def _rounded_svm(result):
    return result.select("n_missing_rows",
                         (F.round("min_margin", 5) + F.lit(0.0)).alias("min_margin"),
                         F.round("max_abs_w_missing", 5).alias("max_abs_w_missing"), "is_certain")


@query("cm_svm", _svm_sql(fx.SVM, "x0"))
def cm_svm(spark, folder):
    return _rounded_svm(certain.check_svm(fx.svm_gaps(spark, folder), fx.SVM_FEATURES, "y",
                                          solver="steps"))


@query("cm_svm_neg", _svm_sql(fx.SVM_X1, "x1"))
def cm_svm_neg(spark, folder):
    return _rounded_svm(certain.check_svm(fx.svm_gaps(spark, folder, "x1"),
                                          fx.SVM_FEATURES, "y", solver="steps"))


@query("cm_svm_clipped", _svm_sql(fx.SVM, "x0", clipped=True, steps=40))
def cm_svm_clipped(spark, folder):
    return _rounded_svm(certain.check_svm_clipped(fx.svm_gaps(spark, folder), fx.SVM_FEATURES,
                                                  "y", steps=40, solver="steps"))


@query("cm_svm_score")
def cm_svm_score(spark, folder):
    df = sample.hash_split_flag(_kernel_rows(spark, folder), "row_id", 9)
    return certain.certain_score_svm(df.filter("NOT is_test"), df.filter("is_test"),
                                     fx.SVM_FEATURES, "y")


def _kernel_rows(spark, folder, low=0.25):
    """The mirrored table with x0 = 0 throughout and gaps in x0."""
    return fx.svm_gaps(spark, folder, low=low).withColumn("x0", F.when(F.col("x0").isNotNull(), 0.0))


_CUBIC = [0.4 * driver_uniform("cubic", i) for i in range(len(cubic_terms(fx.SVM_FEATURES, 1.0)))]
_CUBIC_GAMMA = 0.6


def _cubic_check_sql() -> str:
    terms = []
    for (name, _), w in zip(cubic_terms(fx.SVM_FEATURES, 1.0), _CUBIC):
        at = [int(i) for i in name[1:].split("_")]
        factor = float(np.sqrt({1: 1, 2: 3, 3: 6}[len(set(at))]) * _CUBIC_GAMMA ** 1.5)
        product = " * ".join(f"coalesce({fx.SVM_FEATURES[i]}, 0)" for i in at)
        terms.append(f"{product} * {factor!r}::DOUBLE * {w!r}::DOUBLE")
    rows = (f"WITH {fx.SVM}, k AS (SELECT x0 IS NULL AS gap, CASE WHEN x0 IS NOT NULL THEN "
            "0.0::DOUBLE END AS x0, x1, x2, y FROM gs), "
            f"f AS (SELECT *, y * ({' + '.join(terms)}) AS m FROM k)")
    return (f"{rows} SELECT count(*) FILTER (WHERE NOT gap AND m <= 1.000001) AS n_support, "
            "count(*) FILTER (WHERE NOT gap AND m <= 1.000001 AND x0 <> 0) AS n_support_nonzero, "
            "count(*) FILTER (WHERE gap) AS n_missing_rows, "
            "round(min(CASE WHEN gap THEN m END), 5) AS min_margin, "
            "count(*) FILTER (WHERE NOT gap AND m <= 1.000001 AND x0 <> 0) = 0 AND "
            "min(CASE WHEN gap THEN m END) > 1 AS is_certain FROM f")


@query("cm_poly_check", _cubic_check_sql())
def cm_poly_check(spark, folder):
    names = tuple(n for n, _ in cubic_terms(fx.SVM_FEATURES, 1.0))
    model = LinearModel(names, tuple(_CUBIC))
    return certain.check_cubic_given(
        _kernel_rows(spark, folder), fx.SVM_FEATURES, "y", model, _CUBIC_GAMMA, ["x0"]
    ).withColumn("min_margin", F.round("min_margin", 5))


@query("cm_poly_svm")
def cm_poly_svm(spark, folder):
    return certain.check_cubic_svm(_kernel_rows(spark, folder, 0.5), fx.SVM_FEATURES, "y",
                                   l2=1e-4)


# ---------------------------------------------- approximately certain models

_ACM_FEATURES = ["size", "price"]
_ACM_W = [0.3, 0.6]
_VERSIONS = 8


def _part_label(spark, folder):
    return fx.part_gaps(spark, folder).withColumn(
        "y", F.lit(0.4) * F.col("size") + F.pmod("p_partkey", F.lit(7)) / 10.0)


_PART_LABEL = f"{fx.PART}, pl AS (SELECT *, 0.4::DOUBLE * size + (p_partkey % 7) / 10.0 AS y FROM pm)"
_PART_VERSIONS = f"""v AS (SELECT ver.version, pl.size, coalesce(pl.price, CASE WHEN
    {fx.sql_uniform('acm', 'ver.version', 'p_partkey', "'price'")} < 0.5
    THEN (SELECT max(price) FROM pm) ELSE (SELECT min(price) FROM pm) END) AS price, pl.y
  FROM pl CROSS JOIN range({_VERSIONS}) ver(version))"""


@query("acm_linear_bounds", f"""WITH {_PART_LABEL}, {_PART_VERSIONS},
  c AS (SELECT version, size - avg(size) OVER p AS a, price - avg(price) OVER p AS b,
    y - avg(y) OVER p AS c, 0.3::DOUBLE * size + 0.6::DOUBLE * price - y AS e
    FROM v WINDOW p AS (PARTITION BY version)),
  g AS (SELECT version, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * c) AS ac,
    sum(b * c) AS bc, sum(c * c) AS cc, sum(e * e) AS loss FROM c GROUP BY version)
  SELECT version::BIGINT AS version, round(loss, 4) AS loss,
  round(loss - (cc - (ac * (ac * bb - bc * ab) + bc * (bc * aa - ac * ab)) / (aa * bb - ab * ab)),
    4) AS regret FROM g""")
def acm_linear_bounds(spark, folder):
    df = _part_label(spark, folder)
    bounds = repair_bounds(df, ["price"])
    return approx.version_losses(df, "p_partkey", _ACM_FEATURES, "y", bounds, _VERSIONS, "acm",
                                 _ACM_W).select(
        F.col("version").cast("bigint").alias("version"), F.round("loss", 4).alias("loss"),
        F.round("regret", 4).alias("regret"))


@query("acm_linear")
def acm_linear(spark, folder):
    df = _part_label(spark, folder)
    bounds = repair_bounds(df, ["price"])
    return approx.approx_linear(df, "p_partkey", _ACM_FEATURES, "y", bounds, 100, "acm")


_SVM_W = [0.2, 0.7, 0.5]


@query("acm_svm_losses", f"""WITH {fx.SVM}, b AS (SELECT min(x0) AS lo, max(x0) AS hi FROM gs),
  v AS (SELECT version, coalesce(x0, CASE WHEN
    {fx.sql_uniform('acm', 'version', 'row_id', "'x0'")} < 0.5 THEN hi ELSE lo END) AS x0,
    x1, x2, y FROM gs CROSS JOIN b CROSS JOIN range({_VERSIONS}) r(version))
  SELECT version::BIGINT AS version, round(sum(greatest(0, 1 - y * (x0 * 0.2::DOUBLE
  + x1 * 0.7::DOUBLE + x2 * 0.5::DOUBLE))) + 0.5::DOUBLE * (0.04 + 0.49 + 0.25)::DOUBLE, 4) AS loss
  FROM v GROUP BY version""")
def acm_svm_losses(spark, folder):
    df = fx.svm_gaps(spark, folder)
    bounds = repair_bounds(df, ["x0"])
    return approx.hinge_version_losses(df, "row_id", fx.SVM_FEATURES, "y", bounds, _VERSIONS,
                                       "acm", _SVM_W).select(
        F.col("version").cast("bigint").alias("version"), F.round("loss", 4).alias("loss"))


@query("acm_svm")
def acm_svm(spark, folder):
    """Gaps in the informative x1, so no single model is optimal for all repairs."""
    df = fx.svm_gaps(spark, folder, "x1")
    bounds = repair_bounds(df, ["x1"])
    return approx.approx_svm(df, "row_id", fx.SVM_FEATURES, "y", bounds, seed="acm")


_GD_STEPS = 30


def _worst_case_sql() -> str:
    """Worst repair of x1 under the current weights, then one gradient step."""
    up = "coalesce(x1, CASE WHEN w1 > 0 THEN hi ELSE lo END)"
    down = "coalesce(x1, CASE WHEN w1 > 0 THEN lo ELSE hi END)"
    rows = (f"SELECT it.*, x0, y, CASE WHEN abs(x0 * w0 + {down} * w1 - y) > "
            f"abs(x0 * w0 + {up} * w1 - y) THEN {down} ELSE {up} END AS x1 "
            "FROM it CROSS JOIN t CROSS JOIN b")
    return f"""WITH RECURSIVE {fx.LINE}, t AS MATERIALIZED (SELECT l_quantity / 50.0 AS x0,
      l_tax * 10.0 AS x1, l_extendedprice / 100000.0 AS y FROM lm),
      b AS MATERIALIZED (SELECT min(x1) AS lo, max(x1) AS hi FROM t),
      it(k, w0, w1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
      SELECT any_value(k) + 1,
        any_value(w0) - 0.5::DOUBLE * 2.0 / count(*) * sum((x0 * w0 + x1 * w1 - y) * x0),
        any_value(w1) - 0.5::DOUBLE * 2.0 / count(*) * sum((x0 * w0 + x1 * w1 - y) * x1)
      FROM ({rows} WHERE k < {_GD_STEPS}) HAVING count(*) > 0)
      SELECT round(any_value(w0), 5) AS w0, round(any_value(w1), 5) AS w1,
      round(avg((x0 * w0 + x1 * w1 - y) * (x0 * w0 + x1 * w1 - y)), 5) AS worst_loss
      FROM ({rows} WHERE k = {_GD_STEPS})"""


@query("acm_worst_case_gd", _worst_case_sql())
def acm_worst_case_gd(spark, folder):
    df = fx.line_gaps(spark, folder).selectExpr(
        "l_quantity / 50D AS x0", "l_tax * 10D AS x1", "l_extendedprice / 100000D AS y")
    bounds = repair_bounds(df, ["x1"])
    model, loss = approx.worst_case_descent(df, ["x0", "x1"], "y", bounds, _GD_STEPS, 0.5,
                                            tolerance=0.0)
    return spark.createDataFrame(
        [(model.weights[0], model.weights[1], loss)], "w0 double, w1 double, worst_loss double"
    ).select(*[F.round(c, 5).alias(c) for c in ("w0", "w1", "worst_loss")])


@query("acm_eval", f"""WITH {fx.SVM}, c AS (SELECT *, x0 * 0.2::DOUBLE + x1 * 0.7::DOUBLE +
  x2 * 0.5::DOUBLE AS f FROM gs WHERE x0 IS NOT NULL) SELECT
  round(avg(CASE WHEN sign(f) = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy,
  round(avg(abs(f - y)), 6) AS mean_abs_error FROM c""")
def acm_eval(spark, folder):
    df = fx.svm_gaps(spark, folder)
    model = LinearModel(tuple(fx.SVM_FEATURES), tuple(_SVM_W))
    return approx.evaluate(df, model, "y").select(F.round("accuracy", 6).alias("accuracy"),
                                                  F.round("mean_abs_error", 6)
                                                  .alias("mean_abs_error"))


# ---------------------------------------------------------- iterative cleaning

_AC_FEATURES = ["total", "urgency", "month"]
_AC_SQL = f"""{fx.ORDERS}, f AS (SELECT *, total IS NULL OR urgency IS NULL AS is_dirty FROM og),
  ap AS (SELECT o_orderkey, is_dirty, month, y,
    CASE WHEN is_dirty THEN 0.01::DOUBLE * {fx.sql_uniform('ac', 'o_orderkey', "'total'")}
      ELSE total END AS total,
    CASE WHEN is_dirty THEN 0.01::DOUBLE * {fx.sql_uniform('ac', 'o_orderkey', "'urgency'")}
      ELSE urgency END AS urgency FROM f)"""
_AC_BATCH = f"""d AS (SELECT floor({fx.sql_uniform('batch', "'draw'", 'j')}
    * (SELECT count(*) FROM orders)) AS position FROM range(50) r(j)),
  m AS (SELECT row_number() OVER (ORDER BY position) AS nth, n_draws FROM
    (SELECT position, count(*) AS n_draws FROM d GROUP BY position)),
  o AS (SELECT *, row_number() OVER (ORDER BY {fx.sql_rank('batch', 'o_orderkey')}, o_orderkey)
    AS nth FROM ap),
  b AS (SELECT o.*, n_draws FROM o JOIN m USING (nth))"""


def _prepared(spark, folder):
    return ac.prepare(fx.order_gaps(spark, folder), "o_orderkey", _AC_FEATURES, "y", "ac")


@query("ac_prepare", f"WITH {_AC_SQL} SELECT o_orderkey, total, urgency, month, "
                     "y, is_dirty FROM ap")
def ac_prepare(spark, folder):
    return _prepared(spark, folder)


@query("ac_init_batch", f"WITH {_AC_SQL}, {_AC_BATCH} SELECT is_dirty, count(*) AS n_rows FROM ap "
       "WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b) GROUP BY is_dirty")
def ac_init_batch(spark, folder):
    """Pool left after the initial batch, by kind of row."""
    _, pool = ac.initial_batch(_prepared(spark, folder), "o_orderkey", "batch")
    return pool.groupBy("is_dirty").agg(F.count("*").alias("n_rows"))


@query("ac_batch_dirty_count", f"WITH {_AC_SQL}, {_AC_BATCH} SELECT "
       "coalesce(sum(CASE WHEN is_dirty THEN n_draws ELSE 0 END), 0)::BIGINT AS n_dirty FROM b")
def ac_batch_dirty_count(spark, folder):
    drawn, _ = ac.initial_batch(_prepared(spark, folder), "o_orderkey", "batch")
    return ac.batch_dirty_count(drawn)


@query("ac_pool_filter", f"WITH {_AC_SQL} SELECT o_orderkey FROM ap WHERE 1 / (1 + exp("
       "total * 0.8::DOUBLE + urgency * 0.9::DOUBLE + month * (-0.2)::DOUBLE + (-2.0)::DOUBLE"
       ")) < 0.9")
def ac_pool_filter(spark, folder):
    pool = _prepared(spark, folder)
    return ac.filter_pool(pool, _AC_FEATURES, [0.8, 0.9, -0.2], -2.0).select("o_orderkey")


_AC_RATE = ("(1.0::DOUBLE / (1.0::DOUBLE + (SELECT max(total * total + urgency * urgency "
            "+ month * month) FROM t)))")


@query("ac_error_classifier", descent_sql(
    _AC_SQL, "SELECT total, urgency, month, CASE WHEN is_dirty THEN -1.0::DOUBLE "
    "ELSE 1.0::DOUBLE END AS y FROM ap", LOGISTIC, 20, _AC_RATE, "0.000001::DOUBLE",
    tuple(_AC_FEATURES)))
def ac_error_classifier(spark, folder):
    """Clean/dirty classifier on all rows of the prepared table."""
    weights, intercept = ac.fit_error_classifier(_prepared(spark, folder), _AC_FEATURES, 20)
    model = LinearModel(tuple(_AC_FEATURES), tuple(float(w) for w in weights), float(intercept))
    return model.as_table(spark).select("feature", F.round("weight", 5).alias("weight"))


@query("ac_run")
def ac_run(spark, folder):
    cleaned, score = ac.active_clean(_prepared(spark, folder), "o_orderkey", _AC_FEATURES, "y",
                                     seed=1, total=500)
    return spark.createDataFrame([(cleaned, score)], "n_cleaned bigint, score double")


@query("ac_average")
def ac_average(spark, folder):
    runs = ac.active_clean_runs(_prepared(spark, folder), "o_orderkey", _AC_FEATURES, "y",
                                range(5), total=200)
    return ac.average_runs(runs)


# ----------------------------------------------------------------- experiments

def _svm_split(spark, folder):
    """Complete two-class table whose x0 is constant 0, split 80/20."""
    df = (fx.svm_gaps(spark, folder).drop("x0").withColumn("x0", F.lit(0.0))
          .select("row_id", *fx.SVM_FEATURES, "y"))
    return sample.train_test_split(df, "row_id", 42)


@query("exp_seed_exists")
def exp_seed_exists(spark, folder):
    train, test = _svm_split(spark, folder)
    return experiments.search_seed(train, "row_id", fx.SVM_FEATURES, "y", 0.01, "exists",
                                   True, test)


@query("exp_seed_not_exists")
def exp_seed_not_exists(spark, folder):
    train, test = _svm_split(spark, folder)
    return experiments.search_seed(train, "row_id", fx.SVM_FEATURES, "y", 0.01, "exists",
                                   False, test)


def _sweep_sql() -> str:
    rows = []
    for width in (5, 10):
        for rate in (0.01, 0.1):
            hit = f"{fx.sql_uniform('sweep/gap', 'o_orderkey')} < {rate}"
            rows.append(f"SELECT {width}::BIGINT AS n_features, {rate}::DOUBLE AS rate, "
                        f"count(*) AS n_rows, count(*) FILTER (WHERE {hit}) AS n_missing_rows, "
                        "true AS is_certain FROM orders")
    return " UNION ALL ".join(rows)


@query("exp_sweep", _sweep_sql())
def exp_sweep(spark, folder):
    """Generated noise-free tables over all order keys: always certain by construction."""
    ids = load(spark, folder, "orders").select("o_orderkey")
    return experiments.sweep_linear(ids, "o_orderkey", [5, 10], [0.01, 0.1], "sweep").withColumn(
        "n_features", F.col("n_features").cast("bigint"))


def _order_split(spark, folder):
    return sample.train_test_split(fx.order_gaps(spark, folder), "o_orderkey", 42)


def _compare_sql() -> str:
    rank = f"row_number() OVER (ORDER BY {fx.sql_rank('42', 'o_orderkey')}, o_orderkey)"
    return f"""WITH {fx.ORDERS}, s AS (SELECT total AS x, y, {rank} <= ceil(0.2::DOUBLE *
        count(*) OVER ()) AS is_test FROM og),
      f AS (SELECT 'mean' AS method, coalesce(x, (SELECT avg(x) FROM s WHERE NOT is_test)) AS x, y
        FROM s WHERE NOT is_test UNION ALL
        SELECT 'delete', x, y FROM s WHERE NOT is_test AND x IS NOT NULL),
      m AS (SELECT method, sum(x * y) / sum(x * x) AS a FROM f GROUP BY method)
      SELECT method, 'mse' AS metric, round(avg((a * x - y) * (a * x - y)), 6) AS score
      FROM m CROSS JOIN s WHERE is_test AND x IS NOT NULL GROUP BY method"""


@query("exp_compare_fills", _compare_sql())
def exp_compare_fills(spark, folder):
    """The two baselines with a closed form, on one feature."""
    train, test = _order_split(spark, folder)
    return experiments.compare_regression(
        train, test, "o_orderkey", ["total"], "y", methods=("mean", "delete")).withColumn(
        "score", F.round("score", 6))


@query("exp_compare_regression")
def exp_compare_regression(spark, folder):
    train, test = _order_split(spark, folder)
    return experiments.compare_regression(train, test, "o_orderkey", _AC_FEATURES, "y")


@query("exp_compare_classification")
def exp_compare_classification(spark, folder):
    df = fx.svm_gaps(spark, folder)
    train, test = sample.train_test_split(df, "row_id", 42)
    return experiments.compare_classification(train, test, "row_id", fx.SVM_FEATURES, "y")


