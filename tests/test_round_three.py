"""Whole jobs and work that grows no faster than the input."""

import datetime

import duckdb
import pytest

from loomgraph.operators import budget as B
from loomgraph.operators import files as S
from loomgraph.operators import parsing as P
from loomgraph.plans import registry
from loomgraph.plans.carriers import CARRIERS, carrier


def test_files_that_share_a_path(spark):
    files = spark.createDataFrame([(1, "a/mapping.ts", ""), (2, "a/mapping.ts", ""), (3, "b.ts", "")], "file_id long, path string, content string")
    found = lambda **keys: sorted(r.file_id for r in S.select_candidate_files(files, names=("mapping",), **keys).collect())
    assert (found(), found(keys=("file_id",))) == ([1], [1, 2])


@pytest.mark.parametrize("name", ["a16_concat_token_sources", "e6_batch_by_budget"])
def test_projects_are_the_whole_table_in_three(spark, name):
    assert {r.project for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").select("project").distinct().collect()} == {0, 1, 2}
    assert "file_id % 3 AS project" in registry.ORACLE_SQL[name]


def test_budgets_by_lengths_alone(spark):
    files = spark.createDataFrame([(1, p, "x" * n) for p, n in [("a", 9), ("b", 4), ("c", 13), ("d", 4)]], "project long, path string, content string")
    short = files.selectExpr("project", "path", "length(content) AS length")
    kept = lambda df: {r.path: r.kept for r in B.cap_to_budget(df, 5).collect()}
    assert kept(short) == kept(files) == {"b": True, "d": True, "a": True, "c": False}


def test_a_name_is_scored_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(P, "cut", lambda df, own=P.cut: tables.append(own(df)) or tables[-1])
    names = spark.createDataFrame([(i, ("red pin", "rod")[i % 2]) for i in range(12)], "arrival long, name string")
    got = P.fuzzy_search_all(names, spark.createDataFrame([("rd",)], "query string"), 3).orderBy("rank").collect()
    assert [(r.arrival, r.name) for r in got] == [(0, "red pin"), (2, "red pin"), (4, "red pin")] or [(r.arrival, r.name) for r in got] == [(1, "rod"), (3, "rod"), (5, "rod")]
    assert [t.count() for t in tables if "name" in t.columns] == [2]


def test_imports_meet_files_without_all_their_tries(spark):
    imports = spark.createDataFrame([("/r/a/x.ts", s) for s in ("./y", "./z", "./w.ts", "./none", "lib", "../../out")], "importer string, source string")
    files = spark.createDataFrame([(p,) for p in ("/r/a/y.ts", "/r/a/y.js", "/r/a/z/index.tsx", "/r/a/w.ts", "/out.ts")], "path string")
    got = S.resolve_local_imports(imports, files, "/r")
    assert {r.source: r.path for r in got.collect()} == {"./y": "a/y.js", "./z": "a/z/index.tsx", "./w.ts": "a/w.ts", "./none": "a/none", "lib": None, "../../out": None}
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("turned", [False, True])
def test_lines_of_one_key_in_any_order(spark, tmp_path, turned):
    day = datetime.datetime(2000, 1, 1)
    lines = [(1, 7, s, 2, 10.0, 1.0, 0.0, 0.0, flag, "F", day) for s, flag in ((4, "A"), (3, "N"))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines[::-1] if turned else lines, schema).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r.cdf_type, r.category) for r in carrier(spark, str(tmp_path), "cat_props").collect()] == [("enum", None)]


def test_lines_with_one_range_are_one_region(spark):
    files = spark.createDataFrame([(1, "motion\nnation")], "file_id long, content string")
    assert [tuple(r) for r in S.slice_regions(files, ("tion",), 1).collect()] == [(1, 0, 1, "motion\nnation")]


@pytest.mark.parametrize("turned", [False, True])
def test_tied_lines_in_the_order_of_their_file(spark, tmp_path, turned):
    day = datetime.datetime(2000, 1, 1)
    lines = [(1, 7, s, 2, 10.0, 1.0, 0.0, 0.0, flag, "F", day) for s, flag in ((4, "A"), (3, "N"))]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines[::-1] if turned else lines, schema).coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    got = [(r.cdf_type, r.category) for r in carrier(spark, str(tmp_path), "cat_props").collect()]
    assert got == ([("enum", None)] if turned else [(None, "content")])
    duck = duckdb.connect()
    duck.sql(f"SET threads = 1; CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert duck.sql(f"SELECT cdf_type, category FROM ({CARRIERS['cat_props']})").fetchall() == got


def test_members_of_an_object_parsed_once(spark):
    rows = spark.createDataFrame([(1, """{"it's":1,"b":null,"c":{"d":"x"}}"""), (2, "[1]")], "doc long, node string")
    got = P._members(rows, "node", "key")
    assert {(r.doc, r.key, r.node) for r in got.collect()} == {(1, "it's", "1"), (1, "b", "null"), (1, "c", '{"d":"x"}')}


def test_imports_are_joined_once(spark):
    files = spark.createDataFrame([("/r/a/b.ts",), ("/r/c/index.vue",), ("/r/c.ts",), ("/x/d.ts",)], "path string")
    rows = [("/r/a/b.ts", "../c", 1), ("/r/a/b.ts", "../c", 2), ("/r/a/b.ts", "./gone", 3), ("/r/a/b.ts", "../../x/d", 4), ("/r/a/b.ts", "lib", 5), ("/r/a/b.ts", None, 6), (None, "./b", 7), ("/r/c.ts", "./c/index.vue", 8)]
    got = S.resolve_local_imports(spark.createDataFrame(rows, "importer string, source string, place int"), files, "/r/")
    assert got.columns == ["importer", "source", "place", "path"]
    assert sorted((r.place, r.path) for r in got.collect()) == [(1, "c.ts"), (2, "c.ts"), (3, "a/gone"), (4, None), (5, None), (6, None), (7, None), (8, "c/index.vue")]
    plans = got._jdf.queryExecution()
    assert plans.optimizedPlan().toString().count("Join ") == 1
    assert "SortMergeJoin" in plans.executedPlan().toString() and "BroadcastHashJoin" not in plans.executedPlan().toString()
