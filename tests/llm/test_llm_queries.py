"""Every query of a problem against its SQL, on the smallest test data."""

import decimal
import os

import duckdb
import pytest

from gleaner.llm import oracle, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(v):
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    found = duck.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())


def test_queries_without_sql():
    assert set(queries.queries()) - set(oracle.oracle_sql()) == {"p3_pieces", "p5_nearest", "p6_containers", "p6_fill", "p7_mixture", "p7_shares"}
