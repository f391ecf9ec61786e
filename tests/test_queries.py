"""Each query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.registry.ORACLES if n in entry.registry.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, con, name):
    df = entry.registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(entry.registry.ORACLES[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == cols
    want = sorted((tuple(r[own.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
