import math

import pytest

import __spark_entry__ as entry
from compare import difference, duck
from lonetext.catalog.spark_queries import QUERIES as OWN

QUERIES = {name: fn for name, fn in entry.queries().items() if name in OWN}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if "score" in rows[0]:
        assert all(math.isfinite(r.score) for r in rows)
    if "error" in rows[0]:
        assert [r for r in rows if r.error] == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_pos", "n_neg", "auc", "ap"]
    assert df.count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_inlier_orientation_is_the_negative(spark, sf):
    a = {r.row_id: r.score for r in QUERIES["ocsvm"](spark, sf).collect()}
    b = {r.row_id: r.score for r in QUERIES["oneclass_svm"](spark, sf).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] + b[k]) < 2e-6 for k in a)
