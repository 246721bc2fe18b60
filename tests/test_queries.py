"""Every query of the engine against its SQL, on the smallest test data."""

import decimal
import os

import duckdb
import pytest

from gleaner.plans import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert rows or name == "shown_hits"
    if name in (sql := oracle.oracle_sql()):
        found = duck.execute(sql[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = [names.index(c) for c in sorted(names)]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
