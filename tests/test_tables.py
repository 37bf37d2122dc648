"""Readers, encoders and small semantics that need no large table."""

import pytest
from pyspark.sql import functions as F

from gapwise.operators import encode, impute, project, scale
from gapwise.session import scratch_path
from gapwise.sources import readers, writers


def test_blank_and_nan_become_null(spark):
    path = scratch_path(spark, "blank")
    spark.createDataFrame([("a,b",), ("1,",), ("NaN,2.5",)], "value string").coalesce(1) \
        .write.text(path)
    df = readers.read_csv(spark, path, "a double, b double")
    assert [tuple(r) for r in df.collect()] == [(1.0, None), (None, 2.5)]


def test_inferred_types_and_index(spark):
    path = scratch_path(spark, "index")
    writers.write_csv(spark.range(3).selectExpr("id", "id * 0.5D AS v"), path)
    df = readers.read_csv_indexed(spark, path)
    assert df.columns == ["row_id", "v"] and dict(df.dtypes)["v"] == "double"


def test_line_numbers_over_many_splits(spark):
    path = scratch_path(spark, "lines")
    spark.range(5000).repartitionByRange(4, "id").sortWithinPartitions("id") \
        .select(F.col("id").cast("string")).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = readers.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(r["line_no"] == int(r["value"]) for r in rows)


def test_numeric_only_if_every_value_parses(spark):
    df = spark.createDataFrame([("1", "x", None), (None, "2", "3.5")], "a string, b string, c string")
    assert dict(project.to_numeric(df).dtypes) == {"a": "double", "b": "string", "c": "double"}


def test_two_valued_label_is_untouched_and_null_counts_as_value(spark):
    two = spark.createDataFrame([(3,), (7,), (3,)], "v int")
    assert not project.has_more_than_two_labels(two, "v")
    assert [r[0] for r in project.binarise_label(two, "v").collect()] == [3, 7, 3]
    three = spark.createDataFrame([(3,), (7,), (None,)], "v int")
    assert project.has_more_than_two_labels(three, "v")
    assert [r[0] for r in project.binarise_label(three, "v").collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        project.binarise_label(two, "other")


def test_mode_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert project.column_mode(df, ["v"]) == {"v": "a"}
    numbers = spark.createDataFrame([(5.0,), (2.0,), (None,)], "v double")
    assert impute.mean_or_mode_fills(numbers, ["v"]) == {"v": 2.0}


def test_onehot_is_per_column_even_with_common_prefix(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "p", None)], "id int, a string, a_b string")
    rows = {r["id"]: r for r in encode.onehot_with_nulls(df, ["a", "a_b"]).collect()}
    assert rows[1]["a_p"] is None and rows[1]["a_b_x"] == 1.0
    assert rows[2]["a_p"] == 1.0 and rows[2]["a_b_x"] is None


def test_category_limit_is_exact_around_the_limit(spark):
    df = spark.range(2000).selectExpr("cast(id % 20 AS string) AS a", "cast(id % 21 AS string) AS b",
                                      "cast(id AS string) AS c")
    found = encode.category_values(df, ["a", "b", "c"])
    assert len(found["a"]) == 20 and found["b"] is None and found["c"] is None


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(4.0, 1.0), (4.0, None)], "a double, b double")
    for fit in (scale.fit_minmax, scale.fit_standard):
        rows = fit(df, ["a", "b"]).transform(df).collect()
        assert [r["a"] for r in rows] == [0.0, 0.0] and rows[1]["b"] is None


def test_tiny_and_const_imputers_leave_no_null(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, 2.0, None)], "id bigint, a double, s string")
    assert impute.impute_constant(df).filter("a IS NULL OR s IS NULL").count() == 0


def test_type_suffixes_are_no_numbers(spark):
    from gapwise.operators.project import to_numeric, try_parse

    df = spark.createDataFrame([("1d", "1"), ("2f", " 2e3 "), ("-.5", "3."), (None, None)], "a string, b string")
    assert to_numeric(df).dtypes == [("a", "string"), ("b", "double")]
    assert [r[0] for r in try_parse(df, "a").select("a").collect()] == [0.0, 0.0, -0.5, None]


def test_kernel_table_has_every_row_asked_for(spark):
    from gapwise.sources.generators import kernel_table

    table = kernel_table(spark.range(30).withColumnRenamed("id", "k"), "k", 3, 400, 5)
    assert table.where("x0 is null").count() == 400
