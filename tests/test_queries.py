"""Every query runs on the smallest tables; those with a SQL twin agree with DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*'}')")
    return c


def flat(v):
    return f"{v:.6g}" if isinstance(v, float) else str([flat(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(flat(r[c]) for c in columns) for r in df.collect())
    if sql := registry.oracle_sql().get(name):
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert sorted(tuple(flat(r[k]) for k in at) for r in found.fetchall()) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
