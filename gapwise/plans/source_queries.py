"""Queries: file round trips and generated tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gapwise.functions.hashing import uniform
from gapwise.operators.profile import missing_table
from gapwise.plans import fixtures as fx
from gapwise.plans.registry import load, query
from gapwise.session import scratch_path
from gapwise.sources import generators, readers, writers

_PART_FILE = (f"WITH {fx.PART} SELECT p.p_partkey, p.p_type, p.p_size::BIGINT AS p_size, pm.price "
              "FROM part p JOIN pm USING (p_partkey)")


def _part_file(spark, folder):
    part = load(spark, folder, "part").select("p_partkey", "p_type", "p_size")
    return part.join(fx.part_gaps(spark, folder).select("p_partkey", "price"), "p_partkey")


@query("src_csv", _PART_FILE)
def src_csv(spark, folder):
    path = scratch_path(spark, "csv")
    writers.write_csv(_part_file(spark, folder), path)
    back = readers.read_csv(spark, path)
    return back.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_type",
                       F.col("p_size").cast("bigint").alias("p_size"), "price")


@query("src_csv_index", f"WITH {fx.PART} SELECT p_partkey AS row_id, size, price FROM pm")
def src_csv_index(spark, folder):
    path = scratch_path(spark, "indexed")
    writers.write_csv(fx.part_gaps(spark, folder), path)
    return readers.read_csv_indexed(spark, path,
                                    "p_partkey bigint, size double, price double")


@query("src_matrix_labels", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no, "
       "o_totalprice AS feature_0, substr(o_orderpriority, 1, 1)::DOUBLE AS feature_1, "
       "CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE (-1.0)::DOUBLE END AS label "
       "FROM orders")
def src_matrix_labels(spark, folder):
    """Numbers and labels in two text files with different file boundaries."""
    orders = load(spark, folder, "orders")
    numbers, labels = scratch_path(spark, "matrix"), scratch_path(spark, "labels")
    (orders.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey")
     .select(F.concat_ws("  ", F.col("o_totalprice").cast("string"),
                         F.concat(F.substring("o_orderpriority", 1, 1), F.lit(" "))))
     .write.text(numbers))
    (orders.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
     .select(F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1")).write.text(labels))
    table = readers.read_matrix_with_labels(spark, numbers, labels)
    return readers.spread_features(table, 2)


_CAPITAL = f"{fx.sql_uniform('names', 'p_partkey')} < 0.5"


@query("src_names", f"""SELECT feature_name, count(*) AS n_lines FROM (
  SELECT upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS feature_name
  FROM part WHERE {_CAPITAL}) GROUP BY feature_name""")
def src_names(spark, folder):
    """Half of the lines start with a capital and name a feature; the others are comments."""
    path = scratch_path(spark, "names")
    name = F.col("p_name")
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substr(p_name, 2)"))
    line = F.concat_ws(" : ", F.when(uniform("names", "p_partkey") < 0.5, capital)
                       .otherwise(F.lower(name)), F.lower("p_type"))
    load(spark, folder, "part").select(line.alias("value")).write.text(path)
    return readers.read_feature_names(spark, path).groupBy("feature_name").agg(
        F.count("*").alias("n_lines"))


_LINE_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


@query("snk_csv", f"WITH {fx.LINE_TWO}, c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, count(*) AS n FROM lm"
    for c in _LINE_COLUMNS) + ") SELECT \"column\", n_missing, "
    "round(100.0::DOUBLE * n_missing / n, 1) AS pct_missing, 'double' AS dtype "
    "FROM c WHERE n_missing > 0")
def snk_csv(spark, folder):
    path = scratch_path(spark, "result")
    table = missing_table(fx.line_gaps(spark, folder, discount=True).select(*_LINE_COLUMNS))
    writers.write_csv(table, path)
    return readers.read_csv(spark, path,
                            "column string, n_missing bigint, pct_missing double, dtype string")


@query("snk_report", """SELECT 'rows ' || o_orderstatus AS metric, count(*)::VARCHAR AS value
  FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'rows', count(*)::VARCHAR FROM orders""")
def snk_report(spark, folder):
    """One report, created by the first method and appended to by the second."""
    path = scratch_path(spark, "report")
    orders = load(spark, folder, "orders")
    count = F.count("*").cast("string").alias("value")
    writers.write_report(orders.groupBy(
        F.concat_ws(" ", F.lit("rows"), "o_orderstatus").alias("metric")).agg(count), path)
    writers.write_report(orders.agg(F.lit("rows").alias("metric"), count), path, append=True)
    return writers.read_report(spark, path)


_WIDTH = 5


def _regression_sql() -> str:
    cells = []
    for i in range(_WIDTH):
        r = fx.sql_uniform("reg", "o_orderkey", f"'x{i}r'")
        a = fx.sql_uniform("reg", "o_orderkey", f"'x{i}a'")
        cells.append(f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {r})) * "
                     f"cos({2 * math.pi!r}::DOUBLE * {a}) AS x{i}")
    weights = generators.regression_coefficients(_WIDTH, "reg")
    y = " + ".join(f"{w!r}::DOUBLE * x{i}" for i, w in enumerate(weights) if w)
    keep = f"{fx.sql_uniform('reg/gap', 'o_orderkey')} >= 0.05"
    shown = ", ".join(f"round(x{i}, 6) + 0.0 AS x{i}" for i in range(_WIDTH - 1))
    return (f"WITH g AS (SELECT o_orderkey, {', '.join(cells)} FROM orders) SELECT o_orderkey, "
            f"{shown}, CASE WHEN {keep} THEN round(x{_WIDTH - 1}, 6) + 0.0 END "
            f"AS x{_WIDTH - 1}, round({y}, 5) + 0.0 AS y FROM g")


@query("gen_regression", _regression_sql())
def gen_regression(spark, folder):
    ids = load(spark, folder, "orders").select("o_orderkey")
    table = generators.regression_table(ids, "o_orderkey", _WIDTH, 0.05, "reg")
    return table.select("o_orderkey", *[(F.round(f"x{i}", 6) + F.lit(0.0)).alias(f"x{i}")
                                        for i in range(_WIDTH)],
                        (F.round("y", 5) + F.lit(0.0)).alias("y"))


def _svm_table_sql() -> str:
    cells = ", ".join(f"2500.0::DOUBLE + 7500.0::DOUBLE * "
                      f"{fx.sql_uniform('msvm', 'o_orderkey', repr(f'x{i}'))} AS x{i}"
                      for i in range(3))
    keep = f"{fx.sql_uniform('msvm/gap', 'o_orderkey')} >= 0.01"
    half = f"WITH h AS (SELECT o_orderkey, {keep} AS keep, {cells} FROM orders)"
    sides = [f"SELECT o_orderkey * 2 + {s} AS row_id, CASE WHEN keep THEN x0 END AS x0, "
             f"x1 * {v} AS x1, x2 * {v} AS x2, {v} AS y FROM h"
             for s, v in ((0, "1.0::DOUBLE"), (1, "(-1.0)::DOUBLE"))]
    return f"{half} {' UNION ALL '.join(sides)}"


@query("gen_svm", _svm_table_sql())
def gen_svm(spark, folder):
    ids = load(spark, folder, "orders").select("o_orderkey")
    return generators.svm_table(ids, "o_orderkey", 3, 0.01, "msvm")


@query("gen_kernel")
def gen_kernel(spark, folder):
    """Base rows plus one appended row per 20 keys, all outside the margin."""
    ids = load(spark, folder, "part").select("p_partkey")
    return generators.kernel_table(ids, "p_partkey", 3, ids.count() // 20, "kernel")
