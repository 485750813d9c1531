"""Every query with an SQL twin, compared at the smallest scale."""

import decimal

import pytest

import __spark_entry__ as contract
from disarm.plans.catalog import QUERIES
from disarm.plans.derived import GIVEN
from tests.conftest import SF

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, twin, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    done = twin.execute(contract.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in done.fetchall()), key=repr)
    assert got == want
    assert got


def test_entry(spark):
    assert contract.entry(spark).count() > 0
