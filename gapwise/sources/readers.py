"""Table readers.  Blank cells and NaN both arrive as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_BITS = 33  # row number within a task, low bits of monotonically_increasing_id


def nan_to_null(df: DataFrame) -> DataFrame:
    """Only float columns can hold NaN; others pass through untouched."""
    return df.select(*[
        F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
             header: bool = True) -> DataFrame:
    """CSV with a header.  Give a schema at scale: inferring it reads the data once more."""
    reader = spark.read.option("header", header).option("nullValue", "")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_csv_indexed(spark: SparkSession, path: str,
                     schema: str | T.StructType | None = None,
                     index: str = "row_id") -> DataFrame:
    """CSV whose first column is a row index, not a feature."""
    df = read_csv(spark, path, schema)
    return df.withColumnRenamed(df.columns[0], index)


def numbered_lines(spark: SparkSession, path: str, name: str = "line_no") -> DataFrame:
    """Text lines with their 0-based number over all files in path order.

    A split knows where it starts, so line numbers follow from the line count of
    each split: one counting pass, then only small numbers (one per split) move.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), "value")
    splits = sorted(
        lines.groupBy("file", "start").agg(F.min("row").alias("low"), F.count("*").alias("n"))
        .collect(), key=lambda r: (r["file"], r["start"]))
    offsets, before = [], 0
    for s in splits:
        offsets.append((s["file"], s["start"], before - s["low"]))
        before += s["n"]
    table = spark.createDataFrame(offsets, "file string, start bigint, shift bigint")
    return (lines.join(table, ["file", "start"])
            .select((F.col("row") + F.col("shift")).alias(name), "value"))


def read_matrix(spark: SparkSession, path: str, line: str = "line_no",
                features: str = "features") -> DataFrame:
    """Whitespace-delimited numbers, one row per line, as one array column."""
    cells = F.split(F.trim(F.col("value")), r"\s+")
    return numbered_lines(spark, path, line).select(
        line, cells.cast("array<double>").alias(features))


def read_matrix_with_labels(spark: SparkSession, matrix: str, labels: str,
                            label: str = "label", line: str = "line_no") -> DataFrame:
    """Matrix rows and labels paired by line number, as (line, features, label)."""
    y = numbered_lines(spark, labels, line).select(
        line, F.trim("value").cast("double").alias(label))
    return read_matrix(spark, matrix, line).join(y, line)


def spread_features(df: DataFrame, width: int, features: str = "features",
                    prefix: str = "feature_") -> DataFrame:
    """Array column -> feature_0 .. feature_{width-1}."""
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.col(features)[i].alias(f"{prefix}{i}") for i in range(width)])


def read_feature_names(spark: SparkSession, path: str) -> DataFrame:
    """First token of every line that starts with a capital letter, with its line number."""
    return (numbered_lines(spark, path).filter(F.col("value").rlike("^[A-Z]"))
            .select("line_no", F.split("value", r"\s+")[0].alias("feature_name")))
