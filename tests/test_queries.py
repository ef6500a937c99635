"""Every query with SQL against DuckDB on the same tables."""

import importlib
import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from rasterway import earth_queries, oracles, queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries.queries() | earth_queries.queries(), oracles.oracle_sql() | earth_queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "-"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return f"{float(v):.6g}"


def rows(frame):
    names = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_wkt_holds_every_step(spark):
    path = SF.replace("0.01", "0.001")
    events = spark.read.parquet(f"{path}/events.parquet").select("user_id", "ts", "event_id").collect()
    lines = {}
    for user, _, event in sorted(tuple(e) for e in events):
        lines.setdefault(user, []).append(((event * 7 + user) % 32 * 90 + 45.0, 2880 - event % 32 * 90 - 45.0))
    assert max(map(len, lines.values())) > 3
    got = {r.route_id: r.wkt for r in queries.route_wkt(spark, path).collect()}
    assert got == {k: ("LINESTRING (" if len(v) > 1 else "POINT (") + ", ".join(f"{x} {y}" for x, y in v) + ")" for k, v in lines.items()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_works_without_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("rasterway.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "rasterway.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    try:
        assert set(again.queries()) == set(QUERIES)
        assert set(again.oracle_sql()) == set(SQL)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
