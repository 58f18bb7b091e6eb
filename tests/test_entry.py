import duckdb
import pytest

import __spark_entry__ as entry
from loomspan.plans.oracles import ORACLES
from loomspan.plans.queries import QUERIES

FILES = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FILES}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FILES)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
