"""The driver contract, and every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
NAMES = sorted(n for n in entry.oracle_sql() if n not in getattr(entry.llm_queries, "QUERIES", {}) and n != "pipeline")


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 4) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 100


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted([plain(x) for x in r] for r in df.collect()) == sorted([plain(r[i]) for i in at] for r in want.fetchall())
