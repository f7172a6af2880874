"""Registered queries against their SQL in DuckDB, on the smallest tables; loops over graphs on 25 of their nodes."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from loomgraph.plans import registry
from loomgraph.plans.carriers import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NODES = int(os.environ.get("TEST_GRAPH_NODES", "25"))


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if hasattr(v, "tzinfo") and hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def connected(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """By whether a query is one of graphs: the folder of its tables and a connection to them."""
    small = tmp_path_factory.mktemp("graph")
    for t in TABLES:
        if t != "part":
            os.symlink(f"{DATA}/{t}.parquet", small / f"{t}.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '{DATA}/part.parquet' WHERE p_partkey < {NODES}) TO '{small}/part.parquet' (FORMAT parquet)")
    return {False: (DATA, connected(DATA)), True: (str(small), connected(small))}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    folder, duck = tables[registry.QUERIES[name].__module__.endswith("graph_queries")]
    got = registry.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(r[i]) for i in places) for r in want.fetchall())
