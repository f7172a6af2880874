"""Operators on small tables, with cases that the driver's tables don't hold."""

import pytest

from loomgraph.functions import naming as N
from loomgraph.operators import components as C
from loomgraph.operators import dedupe as D
from loomgraph.operators import graph as G


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def edges(spark, *pairs):
    return frame(spark, [(a, "s", b) for a, b in pairs], "src string, slot string, dst string")


def nodes(spark, names):
    return frame(spark, [(n,) for n in names], "node string")


def test_closure_of_a_cycle_and_a_diamond(spark):
    e, n = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "x")), nodes(spark, "abcd")
    got = {(r.root, r.node): r.depth for r in G.closure(e, n, n.filter("node = 'a'")).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "d"): 1, ("a", "c"): 2}
    assert [r.node for r in G.closure(e, n, frame(spark, [("zz",)], "node string")).collect()] == ["zz"]


def test_strong_components_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("d", "e"), ("f", "a"))
    assert {(r.node, r.unit) for r in G.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}
    assert sorted(">".join(r.path) for r in G.elementary_cycles(e).collect()) == ["a>b>c", "d"]
    assert G.strong_components(edges(spark, ("a", "b"))).count() == 0


def test_long_chains_and_cycles_are_whole_or_an_error(spark):
    names = [f"n{i:02}" for i in range(32)]
    line, ring = edges(spark, *zip(names, names[1:])), edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    chains = G.ancestor_chains(line, nodes(spark, names), nodes(spark, names[-1:])).collect()
    assert [list(r.chain) for r in chains] == [names[::-1]]
    with pytest.raises(ValueError):
        G.ancestor_chains(line, nodes(spark, names), nodes(spark, names[-1:]), max_len=2)
    with pytest.raises(ValueError):
        G.elementary_cycles(ring, max_len=2)


def test_cascades_are_idempotent(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("z", "c"))
    units = G.strong_components(e)
    once = G.accept_cascade(e, nodes(spark, "a"), units)
    assert {r.node for r in once.collect()} == {"a", "b", "c"} == {r.node for r in G.accept_cascade(e, once, units).collect()}
    rejected, deselected, partners = G.reject_cascade(e, nodes(spark, "b"), units)
    assert {r.node for r in rejected.collect()} == {"a", "b", "c", "z"}
    assert deselected.count() == 0 and {r.node for r in partners.collect()} == {"c"}


def test_merge_edges_keeps_the_best_rank_and_reports_conflicts(spark):
    rows = [(1, "p", "c", "x", "agent"), (2, "p", "c", "y", "user"), (3, "p", "c", "y", "doc"), (4, "p", "c", None, "user"), (5, "p", "d", None, "doc")]
    merged, conflicts = D.merge_edges(frame(spark, rows, "seq long, parent string, child string, slot string, provenance string"))
    assert {(r.seq, r.child) for r in merged.collect()} == {(2, "c"), (5, "d")}
    assert {(r.seq, r.winner, r.loser) for r in conflicts.collect()} == {(2, "user", "agent"), (4, "user", "user")}


def test_path_score_prefers_index_files(spark):
    rows = frame(spark, [("src/Button/index.tsx",), ("src/Button/Button.tsx",), ("src/components/Button/Button.tsx",)], "p string")
    assert [r[0] for r in rows.select(D.path_score("p")).collect()] == [97, -13, -22]


def test_issues_of_empty_and_clashing_names(spark):
    kind = "session_id int, component_id int, name string, props array<struct<name:string,type:string>>, slots array<struct<name:string>>"
    rows = [(1, 1, " ", [("a", "string"), ("", "string")], [("a",)]), (1, 2, "B", [], []), (1, 3, "B", [("x", "string")], [("",)])]
    got = {r.component_id: [i.code for i in r.issues] for r in C.validate_components(frame(spark, rows, kind)).collect()}
    assert got[1] == ["EMPTY_COMPONENT_NAME", "EMPTY_PROP_NAME", "PROP_SLOT_NAME_COLLISION"]
    assert got[2] == ["DUPLICATE_COMPONENT_NAME", "EMPTY_COMPONENT"] and got[3] == ["EMPTY_SLOT_NAME", "DUPLICATE_COMPONENT_NAME"]


def test_names(spark):
    row = frame(spark, [("call-to-actionButton", "apply push", "Symbol")], "a string, b string, c string").select(N.kebab_to_pascal("a"), N.normalize_command("b"), N.map_server_type("c")).first()
    assert tuple(row) == ("CallToActionButton", "apply_push", "enum")
