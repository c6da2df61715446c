"""Every registered query of the core against its SQL on the smallest test data."""

import glob
import math
import os

import duckdb
import pytest

from sonoframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, dict):
        return str(sorted((k, norm(x)) for k, x in v.items()))
    return norm(v.item()) if hasattr(v, "item") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted("|".join(norm(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert len(rows) > 0
        return
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == sorted("|".join(norm(r[i]) for i in at) for r in result.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
