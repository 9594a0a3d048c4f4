"""Every query with a SQL counterpart gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from fluvia.plans import quality, river, series

SF = "/root/testdata/sf0.001"
KIND = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
QUERIES = series.QUERIES | river.QUERIES | quality.QUERIES
SQL = series.SQL | river.SQL | quality.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{x + 0.0:.5g}" if abs(x) < 1e-4 else f"{float(x):.9g}"
    return str(x).removesuffix(" 00:00:00")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    types = {r[0]: KIND.get(r[1], r[1]) for r in duck.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert dict(got.dtypes) == types
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
