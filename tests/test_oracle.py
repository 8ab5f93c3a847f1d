"""Every registered query with an oracle must agree with DuckDB at sf0.01."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tests.oracle_compare import compare, duck

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF01)
    compare(df, con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0, name


def test_grid_search(spark):
    rows = E.queries()["grid_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 16 and all(r["n_folds"] == 3 for r in rows)
    assert sorted(r["rank"] for r in rows) == list(range(1, 17))


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["loc_id", "name", "lat", "lon", "aqi", "label", "color"]
