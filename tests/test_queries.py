"""Every registered query against its SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, sql_session

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return sql_session(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, ORACLE[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_is_certain(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["is_certain"] and rows[0]["n_missing_rows"] > 0


@pytest.mark.parametrize("name, expected", [
    ("cm_linear", True), ("cm_linear_neg", False), ("cm_linear_rowwise", False),
    ("cm_svm_neg", False), ("cm_poly_svm", True), ("cm_svm_score", True),
])
def test_both_verdicts_occur(spark, folder, name, expected):
    assert QUERIES[name](spark, folder).collect()[0]["is_certain"] is expected
