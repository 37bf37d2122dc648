"""Tables with gaps derived from the supplied tables, in Spark and in SQL.

The supplied tables have no NULLs, so gaps are drawn per cell from the md5 of a
seed and the row key; both engines compute the same gaps over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.operators.sample import blank_at_rate
from gapwise.plans.registry import load
from gapwise.session import spread
from gapwise.sources.generators import svm_table

GAP_RATE = 0.05


def sql_digest(seed, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def sql_uniform(seed, *parts: str) -> str:
    head = f"('0x' || substr({sql_digest(seed, *parts)}, 1, 8))::BIGINT"
    return f"({head} / 4294967296.0::DOUBLE)"


def sql_rank(seed, *parts: str) -> str:
    return f"('0x' || substr({sql_digest(seed, *parts)}, 1, 15))::BIGINT"


def line_gaps(spark: SparkSession, folder: str, discount: bool = False) -> DataFrame:
    """lineitem measures with gaps in l_tax and, on request, in l_discount."""
    keys = ["l_orderkey", "l_linenumber"]
    rows = load(spark, folder, "lineitem").select(
        *keys, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = blank_at_rate(rows, keys, "l_tax", GAP_RATE, "tax")
    return blank_at_rate(rows, keys, "l_discount", 0.1, "discount") if discount else rows


def _line_sql(discount: bool) -> str:
    key = ("l_orderkey", "l_linenumber")
    gap = (f"CASE WHEN {sql_uniform('discount', *key)} >= 0.1 THEN l_discount END AS l_discount"
           if discount else "l_discount")
    return (f"lm AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, {gap}, "
            f"CASE WHEN {sql_uniform('tax', *key)} >= {GAP_RATE} THEN l_tax END AS l_tax "
            "FROM lineitem)")


LINE = _line_sql(False)
LINE_TWO = _line_sql(True)


def part_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """part with size and price scaled to about [0, 1] and gaps in price."""
    rows = load(spark, folder, "part").select(
        "p_partkey", (F.col("p_size").cast("double") / 50.0).alias("size"),
        (F.col("p_retailprice") / 2000.0).alias("price"))
    return blank_at_rate(rows, ["p_partkey"], "price", GAP_RATE, "price")


PART = (f"pm AS (SELECT p_partkey, p_size::DOUBLE / 50.0 AS size, "
        f"CASE WHEN {sql_uniform('price', 'p_partkey')} >= {GAP_RATE} "
        f"THEN p_retailprice / 2000.0 END AS price FROM part)")


def order_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """orders as a learning table: two features with gaps, label y linear in them plus month."""
    rows = spread(load(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 100000.0).alias("total"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("urgency"),
        F.month("o_orderdate").cast("double").alias("month")))
    rows = rows.withColumn("y", F.col("total") - F.lit(0.5) * F.col("urgency")
                           + F.lit(0.01) * F.col("month"))
    rows = blank_at_rate(rows, ["o_orderkey"], "total", GAP_RATE, "total")
    return blank_at_rate(rows, ["o_orderkey"], "urgency", GAP_RATE, "urgency")


ORDERS = f"""og AS (SELECT o_orderkey,
  CASE WHEN {sql_uniform('total', 'o_orderkey')} >= {GAP_RATE} THEN total END AS total,
  CASE WHEN {sql_uniform('urgency', 'o_orderkey')} >= {GAP_RATE} THEN urgency END AS urgency,
  month, total - 0.5::DOUBLE * urgency + 0.01::DOUBLE * month AS y
  FROM (SELECT o_orderkey, o_totalprice / 100000.0 AS total,
        substr(o_orderpriority, 1, 1)::DOUBLE AS urgency,
        month(o_orderdate)::DOUBLE AS month FROM orders))"""


def text_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """String columns of part: a category with gaps, numbers as text, a mixture, a wide one."""
    rows = load(spark, folder, "part").select(
        "p_partkey", "p_type", F.col("p_size").cast("string").alias("size_text"),
        F.when(F.col("p_size") < 25, F.col("p_brand"))
        .otherwise(F.col("p_size").cast("string")).alias("mixed"),
        "p_brand", "p_size")
    rows = blank_at_rate(rows, ["p_partkey"], "p_type", 0.1, "type")
    return blank_at_rate(rows, ["p_partkey"], "size_text", GAP_RATE, "size")


TEXT = f"""sm AS (SELECT p_partkey,
  CASE WHEN {sql_uniform('type', 'p_partkey')} >= 0.1 THEN p_type END AS p_type,
  CASE WHEN {sql_uniform('size', 'p_partkey')} >= {GAP_RATE} THEN p_size::VARCHAR END AS size_text,
  CASE WHEN p_size < 25 THEN p_brand ELSE p_size::VARCHAR END AS mixed, p_brand, p_size
  FROM part)"""


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """documents with the labels that exist; the others are NULL."""
    docs = load(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(load(spark, folder, "labels"), "doc_id", "left")


DOCS = ("dl AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")

SVM_FEATURES = ["x0", "x1", "x2"]


def svm_gaps(spark: SparkSession, folder: str, gap: str = "x0", low: float = 0.25) -> DataFrame:
    """Mirrored two-class table keyed by part; gaps in one feature."""
    keys = spread(load(spark, folder, "part").select("p_partkey"))
    return svm_table(keys, "p_partkey", 3, GAP_RATE, "gs", low, 1.0, gap)


def _svm_sql(gap: str) -> str:
    keep = f"{sql_uniform('gs/gap', 'p_partkey')} >= {GAP_RATE}"
    half = ", ".join(f"0.25::DOUBLE + 0.75::DOUBLE * {sql_uniform('gs', 'p_partkey', repr(f))} "
                     f"AS {f}" for f in SVM_FEATURES)

    def side(sign: str, shift: int) -> str:
        cells = []
        for f in SVM_FEATURES:
            value = f if f == "x0" or sign == "1" else f"-{f}"
            cells.append(f"CASE WHEN keep THEN {value} END AS {f}" if f == gap
                         else f"{value} AS {f}")
        return (f"SELECT p_partkey * 2 + {shift} AS row_id, {', '.join(cells)}, "
                f"{sign}::DOUBLE AS y FROM half")
    return (f"half AS (SELECT p_partkey, {keep} AS keep, {half} FROM part), "
            f"gs AS ({side('1', 0)} UNION ALL {side('(-1)', 1)})")


SVM = _svm_sql("x0")
SVM_X1 = _svm_sql("x1")
