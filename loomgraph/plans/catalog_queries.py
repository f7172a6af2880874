"""Queries over whole catalogs: calls, restored classifications, stored definitions, cached work, stale runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lineage import new_folder
from loomgraph.operators import catalog as K
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query
from loomgraph.sources.session_tables import read_sessions, store_sessions

_TABLES = ("k_components", "k_props", "k_values", "k_slots", "k_children")


def _catalog(spark, sf) -> K.Catalog:
    return K.Catalog(*(carrier(spark, sf, n) for n in _TABLES))


# ---- calls: arg_max over a struct keeps a null that a call has written

_CALLS = """
+c AS (SELECT *, tool IN ('classify_prop', 'exclude_prop') AS touches, tool = 'classify_prop' AS classify FROM k_calls),
w AS (SELECT session_id, component_id, name,
  arg_max(struct_pack(v := CASE WHEN classify THEN cdf_type ELSE 'excluded' END), seq) AS t, arg_max(struct_pack(v := CASE WHEN classify THEN cdf_category END), seq) AS c, arg_max(struct_pack(v := CASE WHEN classify THEN token_kind END), seq) AS k,
  arg_max(struct_pack(v := CASE WHEN classify THEN reason ELSE nullif(reason, '') END), seq) AS r, arg_max(struct_pack(v := coalesce(required, false)), seq) FILTER (classify) AS q, arg_max(struct_pack(v := description), seq) FILTER (classify) AS d,
  arg_max(default_value, seq) FILTER (classify AND default_value IS NOT NULL) AS dv, arg_max(listed, seq) FILTER (classify AND listed IS NOT NULL) AS vals FROM c WHERE touches GROUP BY 1, 2, 3),
s AS (SELECT session_id, component_id, name, arg_max(struct_pack(v := coalesce(required, true)), seq) AS q, arg_max(struct_pack(v := description), seq) AS d, arg_max(reason, seq) FILTER (reason IS NOT NULL) AS r, arg_max(listed, seq) FILTER (listed IS NOT NULL) AS kids FROM c WHERE tool = 'classify_slot' GROUP BY 1, 2, 3)
"""


def _applied(spark, sf) -> tuple[K.Catalog, DataFrame]:
    calls = carrier(spark, sf, "k_calls").withColumn("list", F.split("listed", ","))
    about = "named_struct('description', CASE WHEN cdf_type = 'A' THEN 'A' END, 'props', reason, 'slots', CAST(NULL AS STRING)) AS about"
    return K.apply_calls(_catalog(spark, sf), calls.selectExpr("*", about))


@query("e8_apply_tool_calls", with_carriers(_CALLS + """
SELECT p.component_id, p.name, CASE WHEN t IS NULL THEN p.cdf_type ELSE t.v END AS cdf_type, CASE WHEN c IS NULL THEN p.category ELSE c.v END AS category, CASE WHEN k IS NULL THEN p.token_kind ELSE k.v END AS token_kind,
  CASE WHEN q IS NULL THEN p.required ELSE q.v END AS required, CASE WHEN d IS NULL THEN p.description ELSE d.v END AS description, coalesce(dv, p.default_value) AS default_value, CASE WHEN r IS NULL THEN p.rationale ELSE r.v END AS rationale
FROM k_props p LEFT JOIN w USING (session_id, component_id, name)""", "k_props", "k_calls"))
def e8(spark, sf):
    return _applied(spark, sf)[0].props.select("component_id", "name", "cdf_type", "category", "token_kind", "required", "description", "default_value", "rationale")


@query("e8_allowed_lists", with_carriers(_CALLS + """,
nv AS (SELECT session_id, component_id, name, vals FROM w JOIN k_props USING (session_id, component_id, name) WHERE vals IS NOT NULL), nc AS (SELECT session_id, component_id, name, kids FROM s JOIN k_slots USING (session_id, component_id, name) WHERE kids IS NOT NULL),
l AS (SELECT session_id, component_id, name, 'value' AS kind, string_split(vals, ',') AS xs FROM nv UNION ALL SELECT session_id, component_id, name, 'child', string_split(kids, ',') FROM nc)
SELECT component_id, name, kind, min(i) - 1 AS position, xs[i] AS item FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM l) GROUP BY component_id, name, kind, xs[i]
UNION ALL SELECT component_id, prop_name, 'value', position, value FROM k_values v WHERE NOT EXISTS (SELECT 1 FROM nv WHERE nv.session_id = v.session_id AND nv.component_id = v.component_id AND nv.name = v.prop_name)
UNION ALL SELECT component_id, slot_name, 'child', position, child FROM k_children v WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.session_id = v.session_id AND nc.component_id = v.component_id AND nc.name = v.slot_name)""", "k_props", "k_slots", "k_values", "k_children", "k_calls"))
def e8_lists(spark, sf):
    out = _applied(spark, sf)[0]
    values = out.allowed_values.selectExpr("component_id", "prop_name AS name", "'value' AS kind", "bigint(position) AS position", "value AS item")
    return values.unionByName(out.children.selectExpr("component_id", "slot_name AS name", "'child' AS kind", "bigint(position) AS position", "child AS item"))


@query("e8_slots", with_carriers(_CALLS + "SELECT p.component_id, p.name, is_default, CASE WHEN q IS NULL THEN p.required ELSE q.v END AS required, CASE WHEN d IS NULL THEN p.description ELSE d.v END AS description, coalesce(r, p.rationale) AS rationale FROM k_slots p LEFT JOIN s USING (session_id, component_id, name)", "k_slots", "k_calls"))
def e8_slots(spark, sf):
    return _applied(spark, sf)[0].slots.select("component_id", "name", "is_default", "required", "description", "rationale")


@query("e8_components", with_carriers("""
+n AS (SELECT session_id, component_id, arg_max(description, seq) FILTER (tool = 'classify_component' AND description IS NOT NULL) AS d, arg_max(cdf_type, seq) FILTER (tool = 'classify_component' AND cdf_type = 'A') AS a, arg_max(reason, seq) FILTER (tool = 'classify_component') AS r FROM k_calls GROUP BY 1, 2)
SELECT c.component_id, CASE WHEN n.component_id IS NULL THEN status ELSE 'generated' END AS status, coalesce(d, description) AS description, coalesce(a, description_rationale) AS description_rationale, coalesce(r, props_rationale) AS props_rationale FROM k_components c LEFT JOIN n ON n.session_id = c.session_id AND n.component_id = c.component_id""", "k_components", "k_calls"))
def e8_components(spark, sf):
    return _applied(spark, sf)[0].components.select("component_id", "status", "description", "description_rationale", "props_rationale")


@query("e8_warnings", with_carriers("""+c AS (SELECT * FROM k_calls)
SELECT component_id, tool, name FROM c WHERE tool = 'classify_prop' AND NOT EXISTS (SELECT 1 FROM k_props p WHERE p.session_id = c.session_id AND p.component_id = c.component_id AND p.name = c.name)
UNION ALL SELECT component_id, tool, name FROM c WHERE tool = 'classify_slot' AND NOT EXISTS (SELECT 1 FROM k_slots p WHERE p.session_id = c.session_id AND p.component_id = c.component_id AND p.name = c.name)""", "k_props", "k_slots", "k_calls"))
def e8_warnings(spark, sf):
    return _applied(spark, sf)[1].select("component_id", "tool", "name")


# ---- a new extraction: some props are renamed, some have changed places

_NEW = """+nw AS (SELECT session_id, component_id, position, CASE WHEN CAST(component_id AS INT) % 3 = 0 AND position = 2 THEN 'fresh' WHEN CAST(component_id AS INT) % 5 = 0 AND position = 3 THEN 'moved' ELSE name END AS name FROM k_props),
had AS (SELECT * FROM k_props WHERE cdf_type IS NOT NULL), lost AS (SELECT * FROM had o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.session_id = o.session_id AND nw.component_id = o.component_id AND nw.name = o.name)),
got AS (SELECT nw.*, h.name IS NOT NULL AS by_name, h.name IS NULL AND l.name IS NOT NULL AS by_place, h.cdf_type AS t, h.category AS c, l.cdf_type AS lt, l.category AS lc FROM nw LEFT JOIN had h ON h.session_id = nw.session_id AND h.component_id = nw.component_id AND h.name = nw.name
  LEFT JOIN lost l ON l.session_id = nw.session_id AND l.component_id = nw.component_id AND l.position = nw.position)
"""


def _restored(spark, sf) -> K.Catalog:
    old = _catalog(spark, sf)
    name = F.expr("CASE WHEN int(component_id) % 3 = 0 AND position = 2 THEN 'fresh' WHEN int(component_id) % 5 = 0 AND position = 3 THEN 'moved' ELSE name END")
    none = lambda table, *columns: table.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in columns})
    new = old._replace(components=none(old.components, "description"), props=none(old.props.withColumn("name", name), "cdf_type", "category"), allowed_values=old.allowed_values.withColumn("value", F.lit("new")).dropDuplicates(["session_id", "component_id", "prop_name"]).withColumn("position", F.lit(0)))
    return K.restore(old, new)


@query("e9_restore_classification", with_carriers(_NEW + "SELECT component_id, position, name, CASE WHEN by_name THEN t WHEN by_place THEN lt END AS cdf_type, CASE WHEN by_name THEN c WHEN by_place THEN lc END AS category FROM got", "k_props"))
def e9(spark, sf):
    return _restored(spark, sf).props.select("component_id", "position", "name", "cdf_type", "category")


@query("e9_restore_values", with_carriers(_NEW + """, back AS (SELECT v.* FROM k_values v JOIN got ON got.session_id = v.session_id AND got.component_id = v.component_id AND got.name = v.prop_name WHERE by_name OR by_place)
SELECT component_id, prop_name, position, value FROM back UNION ALL SELECT DISTINCT component_id, prop_name, 0, 'new' FROM k_values v WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.session_id = v.session_id AND b.component_id = v.component_id AND b.prop_name = v.prop_name)""", "k_props", "k_values"))
def e9_values(spark, sf):
    return _restored(spark, sf).allowed_values.select("component_id", "prop_name", "position", "value")


# ---- definitions: of every third component, and of keys that are no component's

_ENTRIES = """+e AS (SELECT session_id, name AS key, component_id FROM k_components WHERE CAST(component_id AS INT) % 3 = 0 UNION ALL SELECT session_id, concat('N', name), substr(sha256(concat('N', name, ':generated')), 1, 12) FROM k_components WHERE CAST(component_id AS INT) % 7 = 0)"""


def _defined(spark, sf) -> K.Catalog:
    catalog = _catalog(spark, sf)
    keys = catalog.components.filter("int(component_id) % 3 = 0").select("session_id", F.col("name").alias("key"))
    keys = keys.unionByName(catalog.components.filter("int(component_id) % 7 = 0").select("session_id", F.concat(F.lit("N"), "name").alias("key")))
    text = "CAST(NULL AS STRING)"
    entries = keys.selectExpr(
        "session_id", "key", "concat('about ', key) AS description",
        f"array(named_struct('name', 'label', 'type', 'enum', 'category', 'design', 'token_kind', {text}, 'required', CAST(NULL AS BOOLEAN), 'allowed', array('p', 'q')), named_struct('name', 'only', 'type', 'link', 'category', 'content', 'token_kind', 'color', 'required', true, 'allowed', CAST(array() AS ARRAY<STRING>))) AS properties",
        f"array(named_struct('name', 'body', 'required', true, 'description', 'b', 'allowed', array('Card')), named_struct('name', 'foot', 'required', CAST(NULL AS BOOLEAN), 'description', {text}, 'allowed', CAST(NULL AS ARRAY<STRING>))) AS slots",
    )
    return K.store_definitions(catalog, entries)


@query("a7_store_definitions", with_carriers(_ENTRIES + """
SELECT p.component_id, p.name, p.position, CASE WHEN e.key IS NOT NULL AND p.name = 'label' THEN 'enum' ELSE cdf_type END AS cdf_type, CASE WHEN e.key IS NOT NULL AND p.name = 'label' THEN 'design' ELSE category END AS category, token_kind, CASE WHEN e.key IS NOT NULL AND p.name = 'label' THEN false ELSE required END AS required
FROM k_props p LEFT JOIN e ON e.session_id = p.session_id AND e.component_id = p.component_id
UNION ALL SELECT component_id, 'label', 0, 'enum', 'design', NULL, false FROM e WHERE starts_with(key, 'N') UNION ALL SELECT component_id, 'only', 1, 'link', 'content', 'color', true FROM e WHERE starts_with(key, 'N')""", "k_components", "k_props"))
def a7(spark, sf):
    return _defined(spark, sf).props.select("component_id", "name", "position", "cdf_type", "category", "token_kind", "required")


@query("a7_store_slots", with_carriers(_ENTRIES + """
SELECT component_id, name, position, is_default, required, CAST(NULL AS VARCHAR) AS description, (SELECT count(*) FROM k_children c WHERE c.session_id = s.session_id AND c.component_id = s.component_id AND c.slot_name = s.name) AS children FROM k_slots s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = s.session_id AND e.component_id = s.component_id)
UNION ALL SELECT component_id, 'body', 0, EXISTS (SELECT 1 FROM k_slots s WHERE s.session_id = e.session_id AND s.component_id = e.component_id AND s.name = 'body'), true, 'b', 1 FROM e UNION ALL SELECT component_id, 'foot', 1, false, false, NULL, 0 FROM e""", "k_components", "k_slots", "k_children"))
def a7_slots(spark, sf):
    out = _defined(spark, sf)
    n = out.children.groupBy("session_id", "component_id", F.col("slot_name").alias("name")).agg(F.count("*").alias("children"))
    return out.slots.join(n, ["session_id", "component_id", "name"], "left").select("component_id", "name", "position", "is_default", "required", "description", F.coalesce("children", F.lit(0)).alias("children"))


@query("a7_store_components", with_carriers(_ENTRIES + """
SELECT c.component_id, c.name, CASE WHEN e.key IS NULL THEN status ELSE 'generated' END AS status, CASE WHEN e.key IS NULL THEN description ELSE concat('about ', key) END AS description FROM k_components c LEFT JOIN e ON e.session_id = c.session_id AND e.component_id = c.component_id
UNION ALL SELECT component_id, key, 'generated', concat('about ', key) FROM e WHERE starts_with(key, 'N')""", "k_components"))
def a7_components(spark, sf):
    return _defined(spark, sf).components.select("component_id", "name", "status", "description")


@query("a8_store_tokens", with_carriers("SELECT CAST(crc AS INT) AS session_id, path FROM (SELECT length(type) % 4 AS crc, path FROM tokens) WHERE crc <> 1 UNION ALL SELECT 1, concat('new.', path) FROM tokens WHERE type = 'color'", "tokens"))
def a8_store(spark, sf):
    tokens = carrier(spark, sf, "tokens").withColumn("session_id", F.expr("int(length(type) % 4)"))
    new = tokens.filter("type = 'color'").withColumns({"session_id": F.lit(1), "path": F.concat(F.lit("new."), "path")})
    groups = tokens.select("session_id", F.substring_index("path", ".", 1).alias("path")).distinct()
    return K.store_tokens(groups, tokens, groups.limit(0), new, new.select("session_id"))[1].select("session_id", "path")


@query("a8_store_tokens_by_session", with_carriers("SELECT CAST(crc AS INT) AS session_id, path FROM (SELECT length(type) % 4 AS crc, path FROM tokens) WHERE crc NOT IN (0, 1) UNION ALL SELECT 1, concat('new.', path) FROM tokens WHERE type = 'color'", "tokens"))
def a8_by_session(spark, sf):
    """The table lies in folders by session: session 1 is replaced, session 0 has no tokens left, the others' files stay."""
    tokens = carrier(spark, sf, "tokens").selectExpr("int(length(type) % 4) AS session_id", "path")
    folder = new_folder(spark)
    store_sessions(tokens, folder, tokens.select("session_id"))
    new = carrier(spark, sf, "tokens").filter("type = 'color'").selectExpr("1 AS session_id", "concat('new.', path) AS path")
    store_sessions(new, folder, spark.range(2).selectExpr("int(id) AS session_id"))
    return read_sessions(spark, folder, "path string, session_id int")


# ---- cached work: sessions 10 to 13 hold what was done before on the same components

_HITS = "+src AS (SELECT session_id, component_id, name, CASE WHEN position % 2 = 0 THEN 'media' END AS cdf_type, 'state' AS category, NOT required AS required, 'cached' AS description FROM k_props WHERE CAST(component_id AS INT) % 5 = 1)"


def _copied(spark, sf) -> K.Catalog:
    own = _catalog(spark, sf)
    done = lambda t, **columns: t.filter("int(component_id) % 5 = 1").withColumn("session_id", F.col("session_id") + 10).withColumns({c: F.expr(e) for c, e in columns.items()})
    both = K.Catalog(
        own.components.unionByName(done(own.components, description="'cached'", status="'accepted'")),
        own.props.unionByName(done(own.props, cdf_type="CASE WHEN position % 2 = 0 THEN 'media' END", category="'state'", required="NOT required", description="'cached'")),
        own.allowed_values.unionByName(done(own.components).selectExpr("session_id", "component_id", "'label' AS prop_name", "0 AS position", "'cached' AS value")),
        own.slots.unionByName(done(own.slots, description="'cached'")),
        own.children.unionByName(done(own.children, child="'cached'")),
    )
    hits = own.components.filter("int(component_id) % 5 = 1").select("session_id", "component_id", (F.col("session_id") + 10).alias("source_session"))
    out = K.copy_components(both, hits)
    return K.Catalog(*(t.filter("session_id < 10") for t in out))


@query("j6_copy_from_cache", with_carriers(_HITS + """
SELECT p.component_id, p.name, CASE WHEN s.name IS NULL THEN p.cdf_type ELSE s.cdf_type END AS cdf_type, CASE WHEN s.name IS NULL THEN p.category ELSE s.category END AS category, CASE WHEN s.name IS NULL THEN p.required ELSE s.required END AS required, CASE WHEN s.name IS NULL THEN p.description ELSE s.description END AS description
FROM k_props p LEFT JOIN src s ON s.session_id = p.session_id AND s.component_id = p.component_id AND s.name = p.name""", "k_props"))
def j6(spark, sf):
    return _copied(spark, sf).props.select("component_id", "name", "cdf_type", "category", "required", "description")


@query("j6_copy_lists", with_carriers("""+hit AS (SELECT component_id FROM k_components WHERE CAST(component_id AS INT) % 5 = 1)
SELECT component_id, prop_name AS name, value AS item FROM k_values WHERE component_id NOT IN (SELECT component_id FROM hit) UNION ALL SELECT component_id, 'label', 'cached' FROM hit
UNION ALL SELECT component_id, slot_name, CASE WHEN component_id IN (SELECT component_id FROM hit) THEN 'cached' ELSE child END FROM k_children""", "k_components", "k_values", "k_children"))
def j6_lists(spark, sf):
    out = _copied(spark, sf)
    return out.allowed_values.selectExpr("component_id", "prop_name AS name", "value AS item").unionByName(out.children.selectExpr("component_id", "slot_name AS name", "child AS item"))


# ---- stale runs

_RUNS = """+r AS (SELECT o_orderkey AS run_id, o_orderkey % 7 <> 0 AS known, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 500 END AS tp, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 50 END AS tm, CASE WHEN o_orderkey % 5 <> 0 THEN concat('h', CAST(o_orderkey % 100 AS STRING)) END AS th, o_orderkey % 300 AS cp, CASE WHEN o_orderkey % 2 = 0 THEN concat('h', CAST(o_orderkey % 300 AS STRING)) END AS ch FROM orders),
f AS (SELECT p_partkey AS path, p_size AS mtime, concat('h', CAST(p_partkey AS STRING)) AS hash FROM part WHERE p_partkey % 10 <> 0)"""


@query("c26_run_staleness", _RUNS.lstrip("+").join(["WITH ", """,
s AS (SELECT l_orderkey AS run_id, count(DISTINCT l_partkey) FILTER (f.path IS NOT NULL AND f.mtime <> l_quantity) AS changed, count(DISTINCT l_partkey) FILTER (f.path IS NULL) AS missing FROM lineitem LEFT JOIN f ON f.path = l_partkey GROUP BY 1),
j AS (SELECT r.*, coalesce(changed, 0) AS changed, coalesce(missing, 0) AS missing, tp IS NOT NULL AND (t.path IS NULL OR coalesce(tm <> t.mtime, false) OR coalesce(th <> t.hash, false)) AS st, ch IS NOT NULL AND (c.path IS NULL OR ch <> c.hash) AS ce FROM r LEFT JOIN s USING (run_id) LEFT JOIN f t ON t.path = tp LEFT JOIN f c ON c.path = cp)
SELECT run_id, CASE WHEN known THEN changed ELSE 0 END AS changed, CASE WHEN known THEN missing ELSE 0 END AS missing, known AND st AS stale_tokens, known AND ce AS components_edited, known AND (changed > 0 OR missing > 0 OR st OR ce) AS stale FROM j"""]))
def c26(spark, sf):
    for t in ("orders", "part"):
        spark.read.parquet(f"{sf}/{t}.parquet").createOrReplaceTempView(t)
    head = "WITH " + _RUNS.lstrip("+")
    runs = spark.sql(head + " SELECT run_id, known, tp AS tokens_path, tm AS tokens_mtime, th AS tokens_hash, cp AS components_path, ch AS components_hash, CAST(NULL AS BIGINT) AS saved_tokens_path, CAST(NULL AS STRING) AS saved_tokens_hash FROM r")
    files = spark.sql(head + " SELECT path, mtime, hash FROM f")
    prints = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS run_id", "l_partkey AS path", "l_quantity AS mtime", "string(l_partkey) AS component")
    out = K.run_staleness(runs, prints.withColumn("component", F.col("path")), files)
    return out.select("run_id", F.size("stale_components").cast("long").alias("changed"), F.size("missing_files").cast("long").alias("missing"), "stale_tokens", "components_edited", "stale")
