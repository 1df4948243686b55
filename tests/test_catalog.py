"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from cloakframe.plans.catalog import QUERIES
from cloakframe.plans.oracle import oracles

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SQL = oracles()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in rows)
    want = sorted(
        tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()
    )
    assert got == want


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    counts = {r.type: r.n for r in entry.entry(spark).collect()}
    assert counts == {"EMAIL": 5, "IP_ADDRESS": 6, "CREDIT_CARD": 6, "PHONE": 6}


def test_entry_has_the_catalog():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
