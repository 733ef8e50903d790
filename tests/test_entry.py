"""The driver's queries against their SQL on the smallest tables, as far as these are there."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def tidy(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def library():
    from vectorvote import catalog

    return sorted(catalog.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", library())
def test_query(spark, db, name):
    rows = entry.queries()[name](spark, DATA)
    columns = sorted(rows.columns)
    got = Counter(tuple(tidy(v) for v in r) for r in rows.select(*columns).collect()) if name in entry.oracle_sql() else None
    if got is None:
        assert rows.count() > 0
        return
    sql = entry.oracle_sql()[name]
    found = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert got == Counter(tuple(tidy(v) for v in r) for r in found)
