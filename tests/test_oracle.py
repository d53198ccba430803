"""Every registered query against its DuckDB oracle (the correctness gate), at sf0.001."""

import datetime as dt
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from churnkit.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(QUERIES) >= 80


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["province", "total_customers", "churned", "retained", "churn_rate_pct"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = Counter(tuple(_norm(v) for v in r) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    assert df.columns == [d[0] for d in cur.description]
    want = Counter(tuple(_norm(v) for v in r) for r in cur.fetchall())
    assert got == want
