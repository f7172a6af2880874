"""Queries over the slot graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import inspection as Z
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query

_E = "+e AS (SELECT DISTINCT src, dst FROM slot_edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)),\nrts AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM e WHERE src <> dst))"


def _closed(starts: str) -> str:
    """The closure of each start: depth, and a path over the least nodes one step nearer."""
    return _E + f""",
cl(root, node, depth, path) USING KEY (root, node) AS (SELECT node, node, 0, CAST(node AS VARCHAR) FROM {starts} UNION (
  SELECT cl.root, e.dst, min(cl.depth) + 1, arg_min(concat(cl.path, '>', e.dst), cl.node) FROM cl JOIN e ON e.src = cl.node LEFT JOIN recurring.cl AS k ON k.root = cl.root AND k.node = e.dst WHERE k.node IS NULL GROUP BY 1, 2))"""


_CLOSE = _closed("rts")
_REACH = _E + ",\nreach AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM reach JOIN e ON b = src),\nun AS (SELECT x.a AS node, min(x.b) AS unit FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1)"
_STATUS = "CASE node % 11 WHEN 3 THEN 'error' WHEN 5 THEN 'warning' WHEN 7 THEN 'warning' END"


def graph_sql(head: str, body: str) -> str:
    return with_carriers(head + "\n" + body, "slot_edges", "nodes", recursive=True)


def _edges(spark, sf):
    return carrier(spark, sf, "slot_edges"), carrier(spark, sf, "nodes")


def _known(spark, sf):
    edges, nodes = _edges(spark, sf)
    ends = lambda c: nodes.withColumnRenamed("node", c)
    return edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi"), nodes


def _issues(nodes):
    return nodes.select("node", F.expr(_STATUS).alias("status")).filter("status IS NOT NULL")


def _state(nodes):
    return nodes.selectExpr("node", "CASE node % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' END AS state").filter("state IS NOT NULL")


@query("h1_build_slot_edges", graph_sql(_E, "SELECT DISTINCT src, slot, dst FROM slot_edges WHERE dst IN (SELECT node FROM nodes) AND src % 7 <> 0"))
def h1(spark, sf):
    edges, nodes = _edges(spark, sf)
    slots = edges.groupBy("src", "slot").agg(F.collect_set("dst").alias("children"))
    return G.build_slot_edges(slots, nodes, nodes.filter("node % 7 = 0"))


@query("h2_roots", graph_sql(_E, "SELECT node FROM rts"))
def h2(spark, sf):
    return G.roots(*_edges(spark, sf))


@query("h3_closure", graph_sql(_closed("nodes"), "SELECT root, node, depth, path FROM cl"))
def h3(spark, sf):
    edges, nodes = _edges(spark, sf)
    paths = G.closure_paths(G.closure(edges, nodes, nodes), edges)
    return paths.selectExpr("root", "node", "depth", "array_join(transform(path, x -> string(x)), '>') AS path")


@query("h3_contains_cycle", graph_sql(_closed("nodes") + ",\n" + _REACH.split(",\n", 2)[2], "SELECT root, bool_or(node IN (SELECT node FROM un)) AS contains_cycle FROM cl GROUP BY 1"))
def h3_cycle(spark, sf):
    edges, nodes = _known(spark, sf)
    return G.reaches_cycle(edges, nodes, G.strong_components(edges))


@query("h4_all_closures", graph_sql(_CLOSE, "SELECT root, node, depth FROM cl"))
def h4(spark, sf):
    return G.all_closures(*_edges(spark, sf)).select("root", "node", "depth")


@query("h4_closure_parents", graph_sql(_CLOSE, "SELECT c.root, d.node, string_agg(DISTINCT e.src, ',' ORDER BY e.src) AS parents FROM cl c JOIN e ON e.src = c.node JOIN cl d ON d.root = c.root AND d.node = e.dst GROUP BY 1, 2"))
def h4_parents(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.closure_parents(G.all_closures(edges, nodes), edges).selectExpr("root", "node", "array_join(transform(parents, x -> string(x)), ',') AS parents")


@query("h5_shared_dependencies", graph_sql(_CLOSE, "SELECT node, string_agg(root, ',' ORDER BY root) AS roots FROM cl WHERE node <> root GROUP BY 1 HAVING count(*) >= 2"))
def h5(spark, sf):
    return G.shared_dependencies(G.all_closures(*_edges(spark, sf))).selectExpr("node", "array_join(transform(roots, x -> string(x)), ',') AS roots")


@query("h6_direct_parents", graph_sql(_E, "SELECT DISTINCT dst AS node, src AS parent, slot FROM slot_edges WHERE src <> dst AND dst IN (SELECT node FROM nodes)"))
def h6(spark, sf):
    return G.direct_parents(*_edges(spark, sf))


@query("h7_ancestors", graph_sql(_REACH, "SELECT DISTINCT b AS node, a AS ancestor FROM reach WHERE a <> b"))
def h7(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.ancestors(edges, nodes, nodes)


@query("h8_ancestor_chains", graph_sql(_E + """,
up AS (SELECT DISTINCT s.dst AS child, s.src AS parent, s.slot FROM slot_edges s JOIN e ON e.src = s.src AND e.dst = s.dst WHERE s.src <> s.dst),
ch AS (SELECT node, [node] AS chain, CAST([] AS VARCHAR[]) AS slots, node AS cur FROM nodes UNION ALL SELECT node, list_append(chain, parent), list_append(slots, slot), parent FROM ch JOIN up ON child = cur WHERE NOT list_contains(chain, parent))""",
"SELECT node, array_to_string(chain, '>') AS chain, array_to_string(slots, '>') AS slots FROM ch WHERE NOT EXISTS (SELECT 1 FROM up WHERE child = cur AND NOT list_contains(chain, parent))"))
def h8(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.ancestor_chains(edges, nodes, nodes).selectExpr("node", "array_join(transform(chain, x -> string(x)), '>') AS chain", "array_join(slots, '>') AS slots")


def _of_status(spark, sf, status):
    """The components of a status as nodes."""
    return carrier(spark, sf, "cat_components").filter(F.col("status") == status).selectExpr("component_id AS node")


def status_sql(status: str, head: str, body: str) -> str:
    """graph_sql with the components of a status as the table picked."""
    return with_carriers(head + f",\npicked AS (SELECT component_id AS node FROM cat_components WHERE status = '{status}')\n" + body, "slot_edges", "nodes", "cat_components", recursive=True)


@query("h10_neighborhood", status_sql("accepted", _E, "SELECT node FROM picked UNION SELECT dst FROM slot_edges WHERE src IN (SELECT node FROM picked) UNION SELECT src FROM slot_edges WHERE dst IN (SELECT node FROM picked)"))
def h10(spark, sf):
    return G.neighborhood(carrier(spark, sf, "slot_edges"), _of_status(spark, sf, "accepted"))


@query("h11_strong_components", graph_sql(_REACH, "SELECT node, unit FROM un"))
def h11(spark, sf):
    return G.strong_components(_known(spark, sf)[0])


_CYC = _REACH + """,
ie AS (SELECT DISTINCT s.src, s.slot, s.dst FROM slot_edges s JOIN un x ON x.node = s.src JOIN un y ON y.node = s.dst AND x.unit = y.unit),
cy AS (SELECT [src] AS path, [slot] AS slots, src AS first, dst AS cur FROM ie WHERE dst >= src UNION ALL SELECT list_append(path, cur), list_append(slots, slot), first, dst FROM cy JOIN ie ON src = cur WHERE cur > first AND NOT list_contains(path, cur) AND dst >= first),
cycles AS (SELECT path, slots FROM cy WHERE cur = first),
ce AS (SELECT path, slots, i - 1 AS place, path[i] AS src, slots[i] AS slot, CASE WHEN i = len(path) THEN path[1] ELSE path[i + 1] END AS dst FROM (SELECT path, slots, unnest(range(1, len(path) + 1)) AS i FROM cycles)),
deg AS (SELECT dst AS node, count(*) AS n FROM ce GROUP BY 1)"""


@query("h12_elementary_cycles", graph_sql(_CYC, "SELECT array_to_string(path, '>') AS path, array_to_string(slots, '>') AS slots FROM cycles"))
def h12(spark, sf):
    return G.elementary_cycles(_known(spark, sf)[0]).selectExpr("array_join(transform(path, x -> string(x)), '>') AS path", "array_join(slots, '>') AS slots")


@query("d8_edge_indegree_over_cycles", graph_sql(_CYC, "SELECT node, n FROM deg"))
def d8(spark, sf):
    return G.edge_indegree_over_cycles(G.elementary_cycles(_known(spark, sf)[0]))


@query("f5_break_edge", graph_sql(_CYC, "SELECT array_to_string(path, '>') AS path, src, slot, dst FROM (SELECT ce.*, row_number() OVER (PARTITION BY path, slots ORDER BY n DESC, place) AS rn FROM ce JOIN deg ON deg.node = ce.dst) WHERE rn = 1"))
def f5(spark, sf):
    return G.break_edge(G.elementary_cycles(_known(spark, sf)[0])).selectExpr("array_join(transform(path, x -> string(x)), '>') AS path", "src", "slot", "dst")


@query("h14_accept_cascade", status_sql("accepted", _REACH, "SELECT node FROM picked UNION SELECT b FROM reach WHERE a IN (SELECT node FROM picked)"))
def h14(spark, sf):
    edges, _ = _known(spark, sf)
    return G.accept_cascade(edges, _of_status(spark, sf, "accepted"), G.strong_components(edges))


@query("h15_reject_cascade", status_sql("rejected", _REACH, "SELECT node, 'rejected' AS kind FROM (SELECT node FROM picked UNION SELECT a FROM reach WHERE b IN (SELECT node FROM picked)) UNION ALL SELECT DISTINCT b, 'deselected' FROM reach WHERE (a IN (SELECT node FROM picked) OR a IN (SELECT r.a FROM reach r WHERE r.b IN (SELECT node FROM picked))) AND b NOT IN (SELECT node FROM picked) AND b NOT IN (SELECT r.a FROM reach r WHERE r.b IN (SELECT node FROM picked))"))
def h15(spark, sf):
    edges, _ = _known(spark, sf)
    rejected, deselected, _ = G.reject_cascade(edges, _of_status(spark, sf, "rejected"), G.strong_components(edges))
    return rejected.withColumn("kind", F.lit("rejected")).unionByName(deselected.withColumn("kind", F.lit("deselected")))


@query("h16_reachable_cycle_units", status_sql("accepted", _REACH, "SELECT node, unit FROM un WHERE unit IN (SELECT unit FROM un WHERE node IN (SELECT node FROM picked UNION SELECT b FROM reach WHERE a IN (SELECT node FROM picked)))"))
def h16(spark, sf):
    edges, _ = _known(spark, sf)
    return G.reachable_cycle_units(edges, _of_status(spark, sf, "accepted"), G.strong_components(edges))


@query("h13_cycle_units", graph_sql(_REACH, "SELECT unit, string_agg(node, ',' ORDER BY node) AS members FROM un GROUP BY 1"))
def h13(spark, sf):
    return G.cycle_units(_known(spark, sf)[0]).selectExpr("unit", "array_join(transform(members, x -> string(x)), ',') AS members")


@query("h17_cycle_auto_reject", graph_sql(_REACH, "SELECT node FROM un UNION SELECT a FROM reach WHERE b IN (SELECT node FROM un)"))
def h17(spark, sf):
    edges, _ = _known(spark, sf)
    return G.cycle_auto_reject(edges, G.strong_components(edges))


@query("h18_cycle_view", status_sql("rejected", _REACH + ",\nreach2 AS (SELECT src AS a, dst AS b FROM e WHERE src NOT IN (SELECT component_id FROM cat_components WHERE status = 'rejected') AND dst NOT IN (SELECT component_id FROM cat_components WHERE status = 'rejected') UNION SELECT r.a, e.dst FROM reach2 r JOIN e ON r.b = e.src WHERE e.dst NOT IN (SELECT component_id FROM cat_components WHERE status = 'rejected'))", "SELECT node, true AS structural, node IN (SELECT a FROM reach2 WHERE a = b) AS blocking FROM un"))
def h18(spark, sf):
    edges, _ = _known(spark, sf)
    return G.cycle_view(edges, _of_status(spark, sf, "rejected"))


_ISSUES = _CLOSE + f",\niss AS (SELECT root, node, depth, CASE s WHEN 'error' THEN 3 ELSE 2 END AS r FROM (SELECT *, {_STATUS} AS s FROM cl) WHERE s IS NOT NULL),\ntop AS (SELECT root, max(r) FILTER (depth = 0) AS own, max(r) AS worst FROM iss GROUP BY 1)"
_NAME = "CASE {} WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'ok' END"


@query("d11_worst_status", graph_sql(_ISSUES, f"SELECT root, {_NAME.format('worst')} AS status FROM (SELECT DISTINCT root FROM cl) LEFT JOIN top USING (root)"))
def d11(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.worst_status(G.all_closures(edges, nodes), _issues(nodes))


@query("h19_inherited_status", graph_sql(_ISSUES, f"SELECT root, {_NAME.format('coalesce(any_value(own), any_value(worst))')} AS status, string_agg(node, ',' ORDER BY node) FILTER (r = coalesce(own, worst) AND (own IS NULL OR depth = 0)) AS sources FROM iss JOIN top USING (root) GROUP BY 1"))
def h19(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.inherited_status(G.all_closures(edges, nodes), _issues(nodes)).selectExpr("root", "status", "array_join(transform(sources, x -> string(x)), ',') AS sources")


@query("f6_drill_target", graph_sql(_ISSUES, "SELECT root, arg_min(node, (-r, depth, node)) AS target FROM iss WHERE root NOT IN (SELECT root FROM iss WHERE depth = 0) GROUP BY 1"))
def f6(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.drill_target(G.all_closures(edges, nodes), _issues(nodes))


@query("h20_group_root", graph_sql(_CLOSE + ",\n" + _REACH.split(",\n", 2)[2], "SELECT node, CASE WHEN node IN (SELECT node FROM un) OR node IN (SELECT root FROM cl) THEN node ELSE coalesce((SELECT min(root) FROM cl WHERE cl.node = nodes.node), node) END AS group_root FROM nodes"))
def h20(spark, sf):
    edges, nodes = _known(spark, sf)
    return G.group_root(nodes, G.all_closures(edges, nodes), G.strong_components(edges))


@query("h22_assert_acyclic", graph_sql(_REACH, "SELECT DISTINCT src, slot, dst FROM slot_edges s WHERE NOT EXISTS (SELECT 1 FROM un x JOIN un y ON x.unit = y.unit WHERE x.node = s.src AND y.node = s.dst)"))
def h22(spark, sf):
    edges = carrier(spark, sf, "slot_edges").distinct()
    return G.assert_acyclic(G.without_cycle_edges(edges, G.strong_components(edges)))


@query("h22_cycle_gate", graph_sql(_REACH, "SELECT count(*) > 0 AS blocked, count(*) AS nodes, count(DISTINCT unit) AS units FROM un"))
def h22_gate(spark, sf):
    return G.cycle_gate(_known(spark, sf)[0])


@query("h23_store_cycles", with_carriers(_CYC + """,
br AS (SELECT path, slots, src, slot, dst FROM (SELECT ce.*, row_number() OVER (PARTITION BY path, slots ORDER BY n DESC, place) AS rn FROM ce JOIN deg ON deg.node = ce.dst) WHERE rn = 1),
fresh AS (SELECT path[1] % 4 AS session_id, array_to_string(path, '>') AS path, array_to_string(slots, '>') AS slots, concat(src, '.', slot, '.', dst) AS suggested_break FROM br),
old AS (SELECT component_id % 4 + 2 AS session_id, CAST(component_id AS VARCHAR) AS path, 'old' AS slots, CAST(NULL AS VARCHAR) AS suggested_break FROM cat_components)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY path, slots) - 1 AS cycle_index, path, slots, suggested_break FROM fresh UNION ALL SELECT session_id, 0, path, slots, suggested_break FROM old WHERE session_id > 3""", "slot_edges", "nodes", "cat_components", recursive=True))
def h23(spark, sf):
    join = lambda c: f"array_join(transform({c}, x -> string(x)), '>') AS {c}"
    found = Z.suggested_cycles(_known(spark, sf)[0]).selectExpr("path[0] % 4 AS session_id", join("path"), join("slots"), "concat(src, '.', slot, '.', dst) AS suggested_break")
    old = carrier(spark, sf, "cat_components").selectExpr("component_id % 4 + 2 AS session_id", "0L AS cycle_index", "string(component_id) AS path", "'old' AS slots", "CAST(NULL AS STRING) AS suggested_break")
    sessions = spark.range(4).withColumnRenamed("id", "session_id")
    return Z.store_cycles(old, found, sessions)


@query("d9_scope_counters", graph_sql(_CLOSE, "SELECT count(*) FILTER (node % 3 = 0) AS accepted, count(*) FILTER (node % 3 = 1) AS rejected, count(*) FILTER (node % 3 = 2) AS undecided, (SELECT count(*) FROM (SELECT root FROM cl WHERE root % 3 = 0 GROUP BY 1 HAVING count(*) > 1)) AS accepted_groups FROM nodes"))
def d9(spark, sf):
    edges, nodes = _edges(spark, sf)
    return G.scope_counters(nodes, G.all_closures(edges, nodes), _state(nodes))


@query("d10_group_dependency_counts", graph_sql(_CLOSE + ",\n" + _REACH.split(",\n", 2)[2], "SELECT 0 AS tier, unit AS group_key, count(*) AS n FROM un GROUP BY 2 UNION ALL SELECT 1, root, count(*) FROM cl WHERE node <> root AND root % 3 = 0 GROUP BY 2"))
def d10(spark, sf):
    edges, nodes = _known(spark, sf)
    return G.group_dependency_counts(G.all_closures(edges, nodes), _state(nodes), G.strong_components(edges))
