import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gneiss.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, decimal.Decimal):
            v = float(v) if v % 1 else int(v)
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    out = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
