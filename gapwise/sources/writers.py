"""Result tables and metric reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def report_rows(spark: SparkSession, run: str, metrics: Mapping[str, object]) -> DataFrame:
    """Metrics of one run in long form."""
    return spark.createDataFrame([(run, k, str(v)) for k, v in metrics.items()],
                                 "run string, metric string, value string")


def write_report(rows: DataFrame, path: str, append: bool = False) -> None:
    """``metric: value`` lines; later methods append to the same report."""
    lines = rows.select(F.concat_ws(": ", "metric", "value").alias("value"))
    lines.write.mode("append" if append else "overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", ": ", 2)
    return spark.read.text(path).select(parts[0].alias("metric"), parts[1].alias("value"))
