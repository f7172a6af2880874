"""Queries that dedupe components, props and edges, and place edges in slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import budget as B
from loomgraph.operators import dedupe as D
from loomgraph.operators import edges as X
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query

# The paths of this carrier all have the form /repo/packages/<p>/src/components/<name>/<file>.
_SCOPED = """
+s AS (SELECT *, string_split(source, '/') AS g FROM components), t AS (SELECT *, concat(g[2], '/', g[3], '/', g[4], CASE WHEN true THEN '' END) AS root, g[8] AS file FROM s),
fam AS (SELECT DISTINCT session_id, root, g[7] AS name FROM t WHERE file IN (concat(g[7], '.tsx'), concat(g[7], '.ts'), 'index.tsx', 'index.ts')),
sc AS (SELECT t.*, CASE WHEN fam.name IS NOT NULL AND t.g[7] = t.name THEN concat(t.root, '::', t.name) ELSE concat(t.root, '/src/components/', t.g[7]) END AS scope,
  CASE WHEN regexp_matches(file, '^index\\.[jt]sx?$') THEN 100 ELSE 0 END - CASE WHEN regexp_replace(file, '\\.[^.]+$', '') = t.g[7] THEN 10 ELSE 0 END - 8 - 7 AS score
  FROM t LEFT JOIN fam ON fam.session_id = t.session_id AND fam.root = t.root AND fam.name = t.name)
"""


@query("e3_family_scope_key", with_carriers(_SCOPED + "SELECT arrival, scope FROM sc", "components"))
def e3(spark, sf):
    return D.family_scope_key(carrier(spark, sf, "components")).select("arrival", "scope")


@query("e2_dedupe_components", with_carriers(_SCOPED + "SELECT session_id, name, scope, source, arrival FROM (SELECT *, row_number() OVER (PARTITION BY session_id, name, scope ORDER BY score DESC, length(source), arrival) AS rn FROM sc) WHERE rn = 1", "components"))
def e2(spark, sf):
    return D.dedupe_components(carrier(spark, sf, "components"))[0].select("session_id", "name", "scope", "source", "arrival")


_RANK = "CASE provenance WHEN 'user' THEN 1 WHEN 'typed-slot' THEN 2 WHEN 'structural' THEN 3 WHEN 'manifest' THEN 4 WHEN 'doc' THEN 5 ELSE CASE WHEN starts_with(provenance, 'adapter:') THEN 6 ELSE 7 END END"
_MERGED = f"""
+k AS (SELECT *, {_RANK} AS rk FROM composition_edges),
w AS (SELECT *, arg_min(struct_pack(rk := rk, slot := slot, provenance := provenance), (rk, seq)) OVER (PARTITION BY parent, child ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS won, row_number() OVER (PARTITION BY parent, child ORDER BY rk, seq) AS rn FROM k),
m AS (SELECT seq, parent, child, slot, provenance FROM w WHERE rn = 1)
"""


@query("e4_merge_edges", with_carriers(_MERGED + "SELECT * FROM m", "composition_edges"))
def e4(spark, sf):
    return D.merge_edges(carrier(spark, sf, "composition_edges"))[0].select("seq", "parent", "child", "slot", "provenance")


@query("e4_merge_conflicts", with_carriers(_MERGED + "SELECT seq, parent, child, CASE WHEN rk < won.rk THEN provenance ELSE won.provenance END AS winner, CASE WHEN rk < won.rk THEN won.provenance ELSE provenance END AS loser FROM w WHERE won IS NOT NULL AND coalesce(won.slot, '') <> coalesce(slot, '')", "composition_edges"))
def e4_conflicts(spark, sf):
    return D.merge_edges(carrier(spark, sf, "composition_edges"))[1]


def _files(spark, sf):
    return carrier(spark, sf, "files").withColumn("project", F.floor(F.col("file_id") / 60))


@query("e5_cap_to_budget", with_carriers("SELECT file_id, sum(ceil(length(content) / 4)) OVER (PARTITION BY file_id // 60 ORDER BY length(content), path ROWS UNBOUNDED PRECEDING) <= 20000 AS kept FROM files", "files"))
def e5(spark, sf):
    files = _files(spark, sf).withColumn("length", F.length("content")).drop("content")
    return B.cap_to_budget(files, 20_000).select("file_id", "kept")


@query("e6_batch_by_budget", with_carriers("""
+f AS (SELECT file_id % 3 AS project, path, CAST(ceil(length(content) / 4) AS BIGINT) AS cost, row_number() OVER (PARTITION BY file_id % 3 ORDER BY path, ceil(length(content) / 4)) AS n FROM files),
b AS (SELECT project, path, n, 0 AS batch, CASE WHEN cost > 6000 THEN 0 ELSE cost END AS spent, cost <= 6000 AS opened FROM f WHERE n = 1
  UNION ALL SELECT f.project, f.path, f.n, batch + CASE WHEN f.cost <= 6000 AND opened AND spent + f.cost <= 6000 THEN 0 ELSE 1 END, CASE WHEN f.cost > 6000 THEN 0 WHEN opened AND spent + f.cost <= 6000 THEN spent + f.cost ELSE f.cost END, f.cost <= 6000
  FROM b JOIN f ON f.project = b.project AND f.n = b.n + 1)
SELECT project, path, CAST(batch AS BIGINT) AS batch FROM b""", "files", recursive=True))
def e6(spark, sf):
    return B.batch_by_budget(_files(spark, sf).withColumn("project", F.col("file_id") % 3))


@query("e7_chunk", with_carriers("SELECT arrival, (rn - 1) // 5 AS chunk, (rn - 1) % 5 AS place FROM (SELECT arrival, row_number() OVER (PARTITION BY session_id ORDER BY arrival) AS rn FROM components)", "components"))
def e7(spark, sf):
    return D.chunk(carrier(spark, sf, "components"), "arrival").selectExpr("arrival", "bigint(chunk) AS chunk", "bigint(place) AS place")


@query("e11_first_component_per_file", with_carriers("SELECT session_id, source, arg_min(name, arrival) AS name FROM components GROUP BY 1, 2", "components"))
def e11(spark, sf):
    return D.first_component_per_file(carrier(spark, sf, "components"))


@query("e14_candidate_dedupe_first_seen", with_carriers("SELECT file_id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY file_id) AS rn FROM files) WHERE rn = 1", "files"))
def e14(spark, sf):
    return D.first_seen(carrier(spark, sf, "files"), "path", "file_id").select("file_id", "path")


_SOURCED = """SELECT component_key, name, type, CASE WHEN origin % 3 = 0 THEN NULL ELSE type END AS category, CASE WHEN origin % 4 = 0 THEN concat('d', CAST(origin AS STRING)) END AS default_value, CASE WHEN origin % 5 = 1 THEN concat('about ', CAST(origin AS STRING)) END AS description, CASE origin % 6 WHEN 0 THEN 'a,b' WHEN 1 THEN CAST(origin AS STRING) WHEN 2 THEN '' END AS listed, required, origin * 10 + position AS source_rank FROM props"""
_LAST = "arg_max({c}, (source_rank, {c})) FILTER ({c} IS NOT NULL{more}) AS {c}"


def _sourced(spark, sf):
    carrier(spark, sf, "props").createOrReplaceTempView("props")
    return spark.sql(_SOURCED).withColumn("values", F.expr("filter(split(listed, ','), x -> x <> '')")).drop("listed")


@query("e15_merge_props", with_carriers(f"+p AS ({_SOURCED.replace('AS STRING', 'AS VARCHAR')}) SELECT component_key, name, {', '.join(_LAST.format(c=c, more='') for c in ('type', 'category', 'default_value', 'description'))}, arg_max(listed, (source_rank, string_split(listed, ','))) FILTER (listed <> '') AS listed, bool_and(required) AS required FROM p GROUP BY 1, 2", "props"))
def e15(spark, sf):
    return D.merge_props(_sourced(spark, sf)).withColumn("listed", F.array_join("values", ",")).drop("values")


@query("e15_replace_props", with_carriers(f"+p AS ({_SOURCED.replace('AS STRING', 'AS VARCHAR')}) SELECT component_key, name, type, category, default_value, description, listed, required FROM (SELECT *, row_number() OVER (PARTITION BY component_key, name ORDER BY source_rank DESC, type DESC NULLS LAST, category DESC NULLS LAST, default_value DESC NULLS LAST, description DESC NULLS LAST) AS rn FROM p) WHERE rn = 1", "props"))
def e15_replace(spark, sf):
    return D.merge_props(_sourced(spark, sf), replace=True).withColumn("listed", F.array_join("values", ",")).drop("values")


@query("a13_edges_to_map", with_carriers("SELECT parent, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM composition_edges GROUP BY 1", "composition_edges"))
def a13(spark, sf):
    maps = X.edges_to_map(carrier(spark, sf, "composition_edges"))
    back = X.map_to_edges(maps.select(F.create_map("parent", "children").alias("groups")))
    return X.edges_to_map(back).selectExpr("parent", "array_join(transform(children, x -> string(x)), ',') AS children")


_NAMED = "+names AS (SELECT CAST(p_partkey AS BIGINT) AS name FROM part WHERE p_partkey % 10 <> 3)"


@query("b32_sanitize_edges", with_carriers(_NAMED + """
SELECT seq, parent, child, CASE WHEN parent = child THEN 'self edge' WHEN parent NOT IN (SELECT name FROM names) THEN 'unknown parent' WHEN child NOT IN (SELECT name FROM names) THEN 'unknown child' ELSE 'ok' END AS verdict,
  CASE WHEN seq % 8 BETWEEN 1 AND 5 THEN seq % 8 END AS confidence FROM composition_edges""", "composition_edges"))
def b32(spark, sf):
    names = carrier(spark, sf, "nodes").filter("node % 10 <> 3").withColumnRenamed("node", "name")
    good, bad = X.sanitize_edges(carrier(spark, sf, "composition_edges").withColumn("confidence", F.col("seq") % 8), names)
    cols = ["seq", "parent", "child", "verdict", "confidence"]
    return good.withColumn("verdict", F.lit("ok")).select(cols).unionByName(bad.withColumnRenamed("reason", "verdict").select(cols))


@query("c21_residue_parents", with_carriers("SELECT node AS name FROM nodes WHERE node NOT IN (SELECT parent FROM composition_edges WHERE slot = 'header')", "composition_edges", "nodes"))
def c21(spark, sf):
    return X.residue_parents(carrier(spark, sf, "nodes").withColumnRenamed("node", "name"), carrier(spark, sf, "composition_edges").filter("slot = 'header'"))


_PLACED = _MERGED.rstrip() + """,
names AS (SELECT node AS name FROM nodes WHERE node % 10 <> 3),
sl AS (SELECT node AS parent, 'body' AS name, node % 2 = 0 AS is_default FROM nodes WHERE node % 5 <> 0),
q AS (SELECT m.*, m.parent IN (SELECT name FROM names) AS kp, m.child IN (SELECT name FROM names) AS kc, EXISTS (SELECT 1 FROM sl WHERE sl.parent = m.parent AND sl.name = m.slot) AS has, (SELECT min(name) FROM sl WHERE sl.parent = m.parent AND is_default) AS def,
  m.provenance IN ('user', 'typed-slot') OR starts_with(m.provenance, 'adapter:') AS trusted FROM m),
pl AS (SELECT parent, child, CASE WHEN slot IS NULL THEN coalesce(def, 'children') WHEN has OR trusted THEN slot END AS placed, CASE WHEN slot IS NULL THEN def IS NULL ELSE NOT has END AS made FROM q WHERE kp AND kc)
"""


def _mapped(spark, sf):
    nodes = carrier(spark, sf, "nodes")
    slots = nodes.filter("node % 5 <> 0").selectExpr("node AS parent", "'body' AS name", "node % 2 = 0 AS is_default", "0 AS position")
    return nodes.filter("node % 10 <> 3").withColumnRenamed("node", "name"), slots, carrier(spark, sf, "composition_edges")


@query("c22_apply_mapping", with_carriers(_PLACED + "SELECT parent, placed AS slot, bool_and(made) AS synthesized, string_agg(DISTINCT child, ',' ORDER BY child) AS children FROM pl WHERE placed IS NOT NULL GROUP BY 1, 2", "composition_edges", "nodes"))
def c22(spark, sf):
    components, slots, edges = _mapped(spark, sf)
    return X.apply_mapping(components, slots, D.merge_edges(edges)[0])[0].selectExpr("parent", "slot", "synthesized", "array_join(transform(children, x -> string(x)), ',') AS children")


@query("j12_resolve_mapping", with_carriers(_PLACED + "SELECT parent, child, 'slot not found' AS reason FROM pl WHERE placed IS NULL UNION ALL SELECT parent, child, CASE WHEN NOT kp THEN 'unknown parent' ELSE 'unknown child' END FROM q WHERE NOT (kp AND kc)", "composition_edges", "nodes"))
def j12(spark, sf):
    return X.resolve_mapping(*_mapped(spark, sf))["warnings"]


@query("g1_collect_edges", with_carriers("SELECT parent, child, slot, 'typed-slot' AS provenance, 0 AS source, seq FROM composition_edges WHERE provenance = 'typed-slot' UNION ALL SELECT parent, child, slot, 'structural', 1, seq FROM composition_edges WHERE provenance = 'structural' UNION ALL SELECT parent, child, slot, 'user', 2, seq FROM composition_edges WHERE provenance = 'user'", "composition_edges"))
def g1(spark, sf):
    edges = carrier(spark, sf, "composition_edges")
    of = lambda p: edges.filter(F.col("provenance") == p)
    return X.collect_edges(typed_slot=of("typed-slot"), structural=of("structural"), user=of("user"))


@query("c20_uncovered_directories", with_carriers("+d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM files) SELECT DISTINCT directory FROM d WHERE directory NOT IN (SELECT directory FROM d WHERE file_id % 3 = 0)", "files"))
def c20(spark, sf):
    files = carrier(spark, sf, "files")
    return X.uncovered_directories(files, files.filter("file_id % 3 = 0"))


@query("c20_expand_by_directories", with_carriers("+d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS directory FROM files), u AS (SELECT DISTINCT directory FROM d WHERE directory NOT IN (SELECT directory FROM d WHERE file_id % 3 = 0) AND length(directory) % 2 = 0) SELECT path FROM d WHERE file_id % 3 = 0 UNION SELECT path FROM d WHERE directory IN (SELECT directory FROM u)", "files"))
def c20_expand(spark, sf):
    files = carrier(spark, sf, "files")
    chosen = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).filter("length(directory) % 2 = 0")
    return X.expand_by_directories(files, files.filter("file_id % 3 = 0"), chosen)
