"""Queries: imputation, scaling, learners, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapwise.functions.linear import linear_score
from gapwise.models.moments import gram_rows
from gapwise.models.ols import fit_ols
from gapwise.models.svm import (cubic_features, cubic_terms, fit_c_svm, fit_cubic_svm,
                                fit_logistic, fit_sgd_regression, fit_svm, kernel_width)
from gapwise.operators import filters, impute, knn, metrics, sample, scale
from gapwise.operators.profile import repair_bounds
from gapwise.plans import fixtures as fx
from gapwise.plans.registry import load, query

# ---------------------------------------------------------------- imputation


def _two_valued(spark, folder):
    """price (many values) and a 0/1 column, both with gaps."""
    df = load(spark, folder, "part").select(
        "p_partkey", (F.col("p_retailprice") / 2000.0).alias("price"),
        F.when(F.col("p_size") > 30, 1.0).otherwise(0.0).alias("large"))
    df = sample.blank_at_rate(df, ["p_partkey"], "price", 0.05, "price")
    return sample.blank_at_rate(df, ["p_partkey"], "large", 0.05, "large")


_TWO_VALUED = f"""tv AS (SELECT p_partkey,
  CASE WHEN {fx.sql_uniform('price', 'p_partkey')} >= 0.05 THEN p_retailprice / 2000.0 END AS price,
  CASE WHEN {fx.sql_uniform('large', 'p_partkey')} >= 0.05 THEN
    CASE WHEN p_size > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS large FROM part)"""


@query("imp_mean_mode", f"""WITH {_TWO_VALUED}, mo AS (SELECT large AS v FROM tv
  WHERE large IS NOT NULL GROUP BY large ORDER BY count(*) DESC, large LIMIT 1)
  SELECT p_partkey, round(coalesce(price, (SELECT avg(price) FROM tv)), 6) AS price,
  coalesce(large, (SELECT v FROM mo)) AS large FROM tv""")
def imp_mean_mode(spark, folder):
    df = _two_valued(spark, folder)
    fills = impute.mean_or_mode_fills(df, ["price", "large"])
    return impute.apply_fills(df, fills).withColumn("price", F.round("price", 6))


@query("imp_mean", f"""WITH {fx.PART}, s AS (SELECT *, {fx.sql_uniform('7', 'p_partkey')} < 0.2
  AS is_test FROM pm) SELECT p_partkey, is_test, round(coalesce(price,
  (SELECT avg(price) FROM s WHERE NOT is_test)), 6) AS price FROM s""")
def imp_mean(spark, folder):
    df = sample.hash_split_flag(fx.part_gaps(spark, folder), "p_partkey", 7)
    train, test = impute.impute_mean(df.filter("NOT is_test"), df.filter("is_test"), ["price"])
    return train.unionByName(test).select("p_partkey", "is_test",
                                          F.round("price", 6).alias("price"))


@query("imp_const", f"WITH {fx.TEXT} SELECT p_partkey, coalesce(p_type, 'missing') AS p_type, "
                    "coalesce(size_text::DOUBLE, 0) AS size FROM sm")
def imp_const(spark, folder):
    df = fx.text_gaps(spark, folder).select("p_partkey", "p_type",
                                            F.col("size_text").cast("double").alias("size"))
    return impute.impute_constant(df)


@query("imp_max", f"WITH {fx.PART} SELECT p_partkey, "
                  "coalesce(price, (SELECT max(price) FROM pm)) AS price FROM pm")
def imp_max(spark, folder):
    df = fx.part_gaps(spark, folder).select("p_partkey", "price")
    return impute.apply_fills(df, impute.max_fills(df, ["price"]))


@query("imp_delete", f"WITH {fx.LINE} SELECT l_orderkey, l_linenumber, l_discount, l_tax "
                     "FROM lm WHERE l_tax IS NOT NULL")
def imp_delete(spark, folder):
    df = fx.line_gaps(spark, folder).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return filters.drop_incomplete(df)


@query("imp_knn", f"""WITH {fx.PART}, c AS (SELECT q.p_partkey, n.price, row_number() OVER (
    PARTITION BY q.p_partkey ORDER BY (q.size - n.size) * (q.size - n.size) * 2.0, n.p_partkey)
    AS nth FROM pm q CROSS JOIN pm n WHERE q.price IS NULL AND n.price IS NOT NULL)
  SELECT p_partkey, round(coalesce(p.price, k.price), 6) AS price FROM pm p LEFT JOIN
  (SELECT p_partkey, avg(price) AS price FROM c WHERE nth <= 5 GROUP BY p_partkey) k
  USING (p_partkey)""")
def imp_knn(spark, folder):
    df = fx.part_gaps(spark, folder)
    return knn.impute_knn(df, "p_partkey", ["size", "price"]).select(
        "p_partkey", F.round("price", 6).alias("price"))


@query("imp_tiny_random", f"""WITH {fx.ORDERS} SELECT o_orderkey,
  CASE WHEN hit THEN 0.01::DOUBLE * {fx.sql_uniform('tiny', 'o_orderkey', "'total'")}
    ELSE total END AS total,
  CASE WHEN hit THEN 0.01::DOUBLE * {fx.sql_uniform('tiny', 'o_orderkey', "'urgency'")}
    ELSE urgency END AS urgency
  FROM (SELECT *, total IS NULL OR urgency IS NULL AS hit FROM og)""")
def imp_tiny_random(spark, folder):
    df = fx.order_gaps(spark, folder).select("o_orderkey", "total", "urgency")
    return impute.impute_tiny_random(df, "o_orderkey", ["total", "urgency"], "tiny")


@query("imp_extreme_versions", f"""WITH {fx.PART} SELECT version::BIGINT AS version, p_partkey,
  CASE WHEN {fx.sql_uniform('ver', 'version', 'p_partkey', "'price'")} < 0.5
  THEN (SELECT max(price) FROM pm) ELSE (SELECT min(price) FROM pm) END AS price
  FROM pm CROSS JOIN range(8) v(version) WHERE price IS NULL""")
def imp_extreme_versions(spark, folder):
    df = fx.part_gaps(spark, folder)
    bounds = repair_bounds(df, ["price"])
    return impute.extreme_versions(df, "p_partkey", bounds, 8, "ver").select(
        F.col("version").cast("bigint").alias("version"), "p_partkey", "price")


@query("imp_adversarial", f"""WITH {fx.PART}, b AS (SELECT min(price) AS lo, max(price) AS hi
  FROM pm), r AS (SELECT p_partkey, size, price, coalesce(price, hi) AS up,
  coalesce(price, lo) AS down FROM pm CROSS JOIN b) SELECT p_partkey,
  CASE WHEN abs(0.8::DOUBLE * down - size) > abs(0.8::DOUBLE * up - size) THEN down ELSE up END
  AS price FROM r""")
def imp_adversarial(spark, folder):
    df = fx.part_gaps(spark, folder)
    bounds = repair_bounds(df, ["price"])
    return impute.impute_adversarial(df, ["price"], [0.8], "size", bounds).select(
        "p_partkey", "price")


# ------------------------------------------------------------------- scaling

_SPLIT = f"s AS (SELECT *, {fx.sql_uniform('7', 'p_partkey')} < 0.2 AS is_test FROM pm)"


def _scaled(spark, folder, fit):
    df = sample.hash_split_flag(fx.part_gaps(spark, folder), "p_partkey", 7)
    scaler = fit(df.filter("NOT is_test"), ["size", "price"])
    return scaler.transform(df).select("p_partkey", "is_test", F.round("size", 6).alias("size"),
                                       F.round("price", 6).alias("price"))


@query("scl_minmax", f"""WITH {fx.PART}, {_SPLIT}, f AS (SELECT min(size) AS s0,
  max(size) - min(size) AS s1, min(price) AS p0, max(price) - min(price) AS p1 FROM s
  WHERE NOT is_test) SELECT p_partkey, is_test, round((size - s0) / s1, 6) AS size,
  round((price - p0) / p1, 6) AS price FROM s CROSS JOIN f""")
def scl_minmax(spark, folder):
    return _scaled(spark, folder, scale.fit_minmax)


@query("scl_standard", f"""WITH {fx.PART}, {_SPLIT}, f AS (SELECT avg(size) AS s0,
  stddev_pop(size) AS s1, avg(price) AS p0, stddev_pop(price) AS p1 FROM s
  WHERE NOT is_test) SELECT p_partkey, is_test, round((size - s0) / s1, 6) AS size,
  round((price - p0) / p1, 6) AS price FROM s CROSS JOIN f""")
def scl_standard(spark, folder):
    return _scaled(spark, folder, scale.fit_standard)


# ------------------------------------------------------------------ learners

def _weight_rows(spark, model, intercept=True, digits=5):
    table = model.as_table(spark) if intercept else model.as_table(spark).filter(
        F.col("feature") != "intercept")
    return table.select("feature", (F.round("weight", digits) + F.lit(0.0)).alias("weight"))


_CRAMER = """m AS (SELECT avg(a * a) AS aa, avg(a * b) AS ab, avg(b * b) AS bb, avg(a * y) AS ay,
  avg(b * y) AS by_ FROM d) SELECT 'l_quantity' AS feature,
  round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 5) + 0.0 AS weight FROM m UNION ALL
  SELECT 'l_discount', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 5) + 0.0 FROM m"""


@query("ols_fit", "WITH d AS (SELECT l_quantity AS a, l_discount AS b, "
                  f"l_extendedprice / 1000.0 AS y FROM lineitem), {_CRAMER}")
def ols_fit(spark, folder):
    df = load(spark, folder, "lineitem").select(
        "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000.0).alias("y"))
    return _weight_rows(spark, fit_ols(df, ["l_quantity", "l_discount"], "y"), intercept=False)


@query("ols_fit_intercept", "SELECT 'l_quantity' AS feature, round(regr_slope(y, x), 5) AS weight "
       "FROM (SELECT l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem) UNION ALL "
       "SELECT 'intercept', round(regr_intercept(y, x), 5) FROM (SELECT l_quantity AS x, "
       "l_extendedprice / 1000.0 AS y FROM lineitem)")
def ols_fit_intercept(spark, folder):
    df = load(spark, folder, "lineitem").select(
        "l_quantity", (F.col("l_extendedprice") / 1000.0).alias("y"))
    return _weight_rows(spark, fit_ols(df, ["l_quantity"], "y", intercept=True))


@query("ols_gram_wide", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
  SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(avg(a.v * b.v), 6) + 0.0 AS value
  FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""")
def ols_gram_wide(spark, folder):
    """Second moments of the 64 embedding coordinates through the array path."""
    df = load(spark, folder, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("double").alias("y"))
    rows = gram_rows(df, "x", "y", 64).filter(F.col("i") < 64)
    cells = rows.select("i", "n", F.posexplode("values").alias("j", "total"))
    return cells.filter(F.col("j") < 64).select(
        F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
        (F.round(F.col("total") / F.col("n"), 6) + F.lit(0.0)).alias("value"))


def descent_sql(prefix: str, source: str, slope: str, steps: int, rate: float | str, l2: str,
                features=("x0", "x1", "x2"), intercept: bool = True, digits: int = 5) -> str:
    """A fixed number of full-batch steps as a recursive query over ``source``."""
    rate = rate if isinstance(rate, str) else f"{rate!r}::DOUBLE"
    ws = [f"w{i}" for i in range(len(features))]
    score = " + ".join(f"{f} * {w}" for f, w in zip(features, ws))
    moves = ", ".join(
        f"any_value({w}) - {rate} * ({l2} * any_value({w}) + sum(s * {f}) / count(*))"
        for f, w in zip(features, ws))
    bias = (f"any_value(b) - {rate} * sum(s) / count(*)" if intercept
            else "0.0::DOUBLE")
    zeros = ", ".join("0.0::DOUBLE" for _ in ws)
    finals = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round({w}, {digits}) + 0.0 AS weight FROM it WHERE k = {steps}"
        for f, w in zip([*features, "intercept"][:len(ws) + intercept], [*ws, "b"]))
    return f"""WITH RECURSIVE {prefix}, t AS MATERIALIZED ({source}),
      it(k, {', '.join(ws)}, b) AS (SELECT 0, {zeros}, 0.0::DOUBLE UNION ALL
      SELECT any_value(k) + 1, {moves}, {bias} FROM
      (SELECT it.*, t.*, {slope.format(f=f'({score} + b)')} AS s FROM it CROSS JOIN t
       WHERE k < {steps}) HAVING count(*) > 0) {finals}"""


HINGE = "CASE WHEN y * {f} < 1 THEN -y ELSE 0.0::DOUBLE END"
LOGISTIC = "-y / (1 + exp(y * {f}))"
SQUARED = "{f} - y"
_COMPLETE = "SELECT x0, x1, x2, y FROM gs WHERE x0 IS NOT NULL"


@query("svm_fit", descent_sql(fx.SVM, _COMPLETE, HINGE, 100, 0.5, "0.0001::DOUBLE"))
def svm_fit(spark, folder):
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    return _weight_rows(spark, fit_svm(complete, fx.SVM_FEATURES, "y", solver="steps"))


@query("svm_fit_c", descent_sql(fx.SVM, _COMPLETE, HINGE, 60, 0.5,
                                "(1.0::DOUBLE / (SELECT count(*) FROM t))"))
def svm_fit_c(spark, folder):
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    return _weight_rows(spark, fit_c_svm(complete, fx.SVM_FEATURES, "y", steps=60,
                                          solver="steps"))


@query("svm_fit_mllib")
def svm_fit_mllib(spark, folder):
    """The same objective through Spark's own learner, run to convergence."""
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    return _weight_rows(spark, fit_svm(complete, fx.SVM_FEATURES, "y", steps=30, solver="mllib"),
                        digits=2)


@query("svm_fit_newton")
def svm_fit_newton(spark, folder):
    """The same objective by Newton steps, the default for narrow tables."""
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    return _weight_rows(spark, fit_svm(complete, fx.SVM_FEATURES, "y"), digits=2)


@query("log_fit", descent_sql(fx.SVM, _COMPLETE, LOGISTIC, 40, 0.5, "0.000001::DOUBLE"))
def log_fit(spark, folder):
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    return _weight_rows(spark, fit_logistic(complete, fx.SVM_FEATURES, "y", steps=40))


_REGRESSION_SOURCE = ("SELECT l_quantity / 50.0 AS x0, l_discount * 10.0 AS x1, "
                      "l_extendedprice / 100000.0 AS y FROM lineitem")


def _line_regression(spark, folder):
    return load(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50.0).alias("x0"), (F.col("l_discount") * 10.0).alias("x1"),
        (F.col("l_extendedprice") / 100000.0).alias("y"))


@query("sgd_regress", descent_sql("u AS (SELECT 1)", _REGRESSION_SOURCE, SQUARED, 40, 0.3,
                                  "0.0::DOUBLE", ("x0", "x1")))
def sgd_regress(spark, folder):
    """40 steps, continued once from the model of the first 20."""
    df = _line_regression(spark, folder)
    first = fit_sgd_regression(df, ["x0", "x1"], "y", steps=20, rate=0.3)
    return _weight_rows(spark, fit_sgd_regression(df, ["x0", "x1"], "y", steps=20, rate=0.3,
                                                  start=first))


def _cubic_sql() -> tuple[str, str]:
    gamma = ("(1.0 / (3 * (SELECT (var_pop(x0) + var_pop(x1) + var_pop(x2)) / 3 + "
             "(pow(avg(x0) - (avg(x0) + avg(x1) + avg(x2)) / 3, 2) "
             "+ pow(avg(x1) - (avg(x0) + avg(x1) + avg(x2)) / 3, 2) "
             "+ pow(avg(x2) - (avg(x0) + avg(x1) + avg(x2)) / 3, 2)) / 3 FROM t)))")
    cells = []
    for name, _ in cubic_terms(fx.SVM_FEATURES, 1.0):
        at = [int(i) for i in name[1:].split("_")]
        factor = {1: 1, 2: 3, 3: 6}[len(set(at))]
        product = " * ".join(fx.SVM_FEATURES[i] for i in at)
        cells.append(f"round({product} * sqrt({factor}.0::DOUBLE) * pow(g, 1.5), 6) + 0.0 "
                     f"AS {name}")
    return gamma, ", ".join(cells)


_GAMMA, _CUBIC_CELLS = _cubic_sql()


@query("poly_features", f"WITH {fx.SVM}, t AS ({_COMPLETE.replace('SELECT', 'SELECT row_id,', 1)})"
       f", k AS (SELECT {_GAMMA} AS g) SELECT row_id, {_CUBIC_CELLS} FROM t CROSS JOIN k")
def poly_features(spark, folder):
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    gamma = kernel_width(complete, fx.SVM_FEATURES)
    mapped = cubic_features(complete, fx.SVM_FEATURES, gamma, keep=["row_id"])
    return mapped.select("row_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c)
                                     for c in mapped.columns[1:]])


_CUBIC_NAMES = tuple(name for name, _ in cubic_terms(fx.SVM_FEATURES, 1.0))
_CUBIC_TABLE = (f"{fx.SVM}, c0 AS MATERIALIZED ({_COMPLETE}), k AS (SELECT "
                f"{_GAMMA.replace('FROM t', 'FROM c0')} AS g), cu AS (SELECT y, "
                f"{_CUBIC_CELLS.replace('round(', '(').replace(', 6) + 0.0', ')')} "
                "FROM c0 CROSS JOIN k)")


@query("svm_poly_fit", descent_sql(_CUBIC_TABLE, "SELECT * FROM cu", HINGE, 30, 0.2,
                                   "0.0001::DOUBLE", _CUBIC_NAMES))
def svm_poly_fit(spark, folder):
    complete = filters.drop_incomplete(fx.svm_gaps(spark, folder))
    model, _ = fit_cubic_svm(complete, fx.SVM_FEATURES, "y", l2=1e-4, steps=30, rate=0.2,
                             solver="steps")
    return _weight_rows(spark, model)


# ------------------------------------------------------ prediction and metrics

_W = [0.9, -0.05]
_F = ["x0", "x1"]
_SCORE_SQL = "(x0 * 0.9::DOUBLE + x1 * (-0.05)::DOUBLE)"
_LINE_SQL = f"d AS ({_REGRESSION_SOURCE})"


@query("prd_linear", "SELECT o_orderkey, p + 0.0 AS prediction, sign(p)::DOUBLE AS side FROM "
       "(SELECT o_orderkey, o_totalprice * 0.00001::DOUBLE + (-2.5)::DOUBLE AS p FROM orders)")
def prd_linear(spark, folder):
    score = linear_score(["o_totalprice"], [0.00001], -2.5)
    return load(spark, folder, "orders").select(
        "o_orderkey", score.alias("prediction"), metrics.sign_prediction(score).alias("side"))


def _metric(name: str, column, sql: str):
    @query(name, f"WITH {_LINE_SQL} SELECT {sql} FROM d")
    def run(spark, folder):
        return _line_regression(spark, folder).agg(column())
    return run


def _line_score():
    return linear_score(_F, _W)


_metric("met_mse", lambda: F.round(metrics.mean_squared_error(_line_score(), "y"), 6).alias("mse"),
        f"round(avg(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)), 6) AS mse")
_metric("met_r2", lambda: F.round(metrics.r_squared(_line_score(), "y"), 6).alias("r2"),
        f"round(1 - avg(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)) / var_pop(y), 6) AS r2")
_metric("met_mae", lambda: F.round(metrics.mean_absolute_error(_line_score(), "y"), 6)
        .alias("mae"), f"round(avg(abs({_SCORE_SQL} - y)), 6) AS mae")
_metric("met_sse", lambda: F.round(metrics.sum_squared_error(_line_score(), "y"), 3).alias("sse"),
        f"round(sum(({_SCORE_SQL} - y) * ({_SCORE_SQL} - y)), 3) AS sse")

_SVM_SCORE = "(coalesce(x0, 0) * 0.1::DOUBLE + x1 * 0.7::DOUBLE + x2 * 0.4::DOUBLE)"


@query("met_accuracy", f"WITH {fx.SVM} SELECT round(avg(CASE WHEN sign({_SVM_SCORE} - 0.5) = y "
                       "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM gs")
def met_accuracy(spark, folder):
    score = linear_score(fx.SVM_FEATURES, [0.1, 0.7, 0.4], -0.5, skip_null=True)
    return fx.svm_gaps(spark, folder).agg(
        F.round(metrics.accuracy(metrics.sign_prediction(score), "y"), 6).alias("accuracy"))


@query("met_hinge", f"WITH {fx.SVM} SELECT round(sum(greatest(0, 1 - y * {_SVM_SCORE})) "
                    "+ 10 * (0.01 + 0.49 + 0.16)::DOUBLE, 3) AS hinge FROM gs")
def met_hinge(spark, folder):
    weights = [0.1, 0.7, 0.4]
    score = linear_score(fx.SVM_FEATURES, weights, skip_null=True)
    return fx.svm_gaps(spark, folder).agg(
        F.round(metrics.hinge_loss(score, "y", weights, 10.0), 3).alias("hinge"))


