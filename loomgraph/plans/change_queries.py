"""Queries over catalog versions, caches and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.naming import COMPARED_TYPES
from loomgraph.operators import inspection as Z
from loomgraph.operators import diff as D
from loomgraph.operators import upserts as U
from loomgraph.plans.carriers import CARRIERS, carrier, with_carriers
from loomgraph.plans.component_queries import nested
from loomgraph.plans.registry import query

_CAT = ("catalog_current", "catalog_proposed")
_BUCKETS = """+d AS (SELECT coalesce(c.k, p.k) AS k, CASE WHEN c.k IS NULL THEN 'new' WHEN p.k IS NULL THEN 'removed' WHEN c.type IS NOT DISTINCT FROM p.type AND c.required IS NOT DISTINCT FROM p.required AND c.default_value IS NOT DISTINCT FROM p.default_value THEN 'unchanged' ELSE 'changed' END AS bucket
  FROM catalog_current c FULL JOIN catalog_proposed p ON c.k = p.k)
"""


def _both(spark, sf):
    return carrier(spark, sf, "catalog_current"), carrier(spark, sf, "catalog_proposed")


def _diff(spark, sf):
    return D.catalog_diff(*_both(spark, sf), "k")


@query("c2_catalog_diff", with_carriers(_BUCKETS + "SELECT k, bucket FROM d", *_CAT))
def c2(spark, sf):
    return _diff(spark, sf)


_KIND = "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in COMPARED_TYPES.items()) + "}[lower({0})], lower({0}))"
_OLD = f"+old AS (SELECT component_id, position, type, category, required, default_value FROM ({CARRIERS['cat_props']}) WHERE component_id % 10 <> 1),\nnew AS (SELECT component_id, position, CASE WHEN component_id % 10 = 3 THEN 'number' ELSE type END AS type, CASE WHEN component_id % 10 = 4 THEN 'state' ELSE category END AS category, required OR component_id % 10 = 5 AS required, CASE WHEN component_id % 10 = 6 THEN 'z' ELSE default_value END AS default_value FROM ({CARRIERS['cat_props']}) WHERE component_id % 10 <> 2),\n"
_PROPS = _OLD + f"""j AS (SELECT coalesce(o.component_id, n.component_id) AS component_id, coalesce(o.position, n.position) AS position, o.component_id IS NULL AS fresh, n.component_id IS NULL AS gone, coalesce(n.required, false) AS nreq, n.default_value AS ndef,
  concat_ws(',', CASE WHEN coalesce(o.type, '') <> '' AND coalesce(n.type, '') <> '' AND {_KIND.replace('{0}', 'o.type')} <> {_KIND.replace('{0}', 'n.type')} THEN 'type' END, CASE WHEN o.category IS DISTINCT FROM n.category THEN 'category' END,
    CASE WHEN coalesce(o.required, false) <> coalesce(n.required, false) THEN 'required' END, CASE WHEN o.default_value IS DISTINCT FROM n.default_value THEN 'default' END) AS what
  FROM old o FULL JOIN new n ON o.component_id = n.component_id AND o.position = n.position),
pd AS (SELECT *, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' WHEN what <> '' THEN 'modified' END AS change FROM j)
"""


def _versions(spark, sf):
    cols = ["component_id", "position", "type", "category", "required", "default_value"]
    props = carrier(spark, sf, "cat_props").select(cols)
    new = props.filter("component_id % 10 <> 2").selectExpr("component_id", "position", "CASE WHEN component_id % 10 = 3 THEN 'number' ELSE type END AS type", "CASE WHEN component_id % 10 = 4 THEN 'state' ELSE category END AS category", "required OR component_id % 10 = 5 AS required", "CASE WHEN component_id % 10 = 6 THEN 'z' ELSE default_value END AS default_value")
    return D.property_diff(props.filter("component_id % 10 <> 1"), new, ["component_id", "position"])


@query("c3_property_diff", with_carriers(_PROPS + "SELECT component_id, position, change, CASE WHEN change = 'modified' THEN what ELSE '' END AS differs FROM pd WHERE change IS NOT NULL", "nodes"))
def c3(spark, sf):
    return _versions(spark, sf).select("component_id", "position", "change", "differs")


@query("c5_classify_breaking", with_carriers(_PROPS + "SELECT component_id, position, CASE WHEN change = 'removed' THEN 'removed' WHEN change = 'added' AND nreq AND ndef IS NULL THEN 'added_required_no_default' WHEN change = 'modified' AND contains(what, 'type') THEN 'type_changed' END AS reason FROM pd WHERE change IS NOT NULL", "nodes"))
def c5(spark, sf):
    return D.breaking_reasons(_versions(spark, sf)).select("component_id", "position", "reason")


_NARROWED = """SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'a,b,c' END AS was, CASE p_size % 5 WHEN 0 THEN 'a,b,c,d' WHEN 1 THEN 'a,c' WHEN 2 THEN '' WHEN 3 THEN 'c,b,a' ELSE 'x' END AS now FROM part"""


@query("c5_validation_narrowed", f"SELECT k, CASE WHEN len(n) > 0 AND (len(w) = 0 OR len(list_filter(w, lambda x: NOT list_contains(n, x))) > 0) THEN 'validation_narrowed' END AS reason FROM (SELECT k, list_filter(string_split(was, ','), lambda x: x <> '') AS w, list_filter(string_split(now, ','), lambda x: x <> '') AS n FROM ({_NARROWED})) WHERE len(n) > 0 AND (len(w) = 0 OR len(list_filter(w, lambda x: NOT list_contains(n, x))) > 0)")
def c5_narrowed(spark, sf):
    carrier(spark, sf, "nodes")
    rows = spark.sql(_NARROWED)
    side = lambda c: rows.selectExpr("k", "'enum' AS type", "'content' AS category", "false AS required", "CAST(NULL AS STRING) AS default_value", f"filter(split({c}, ','), x -> x <> '') AS values")
    return D.breaking_reasons(D.property_diff(side("was"), side("now"), ["k"])).select("k", "reason")


_SLOTS = """+old AS (SELECT src, slot, list_sort(list(CAST(dst AS VARCHAR))) AS c FROM slot_edges WHERE src % 10 <> 1 GROUP BY 1, 2), new AS (SELECT src, slot, list_sort(list(CAST(CASE WHEN src % 10 = 3 THEN dst + 1 ELSE dst END AS VARCHAR))) AS c FROM slot_edges WHERE src % 10 <> 2 GROUP BY 1, 2),
j AS (SELECT coalesce(o.src, n.src) AS src, coalesce(o.slot, n.slot) AS slot, CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'children' END AS change FROM old o FULL JOIN new n ON o.src = n.src AND o.slot = n.slot)
"""


@query("c4_slot_diff", with_carriers(_SLOTS + "SELECT src, slot, change, CASE change WHEN 'removed' THEN 'slot_removed' WHEN 'children' THEN 'slot_allowed_components_narrowed' END AS reason FROM j WHERE change IS NOT NULL", "slot_edges"))
def c4(spark, sf):
    edges = carrier(spark, sf, "slot_edges")
    lists = lambda df: df.groupBy("src", "slot").agg(F.collect_list(F.col("dst").cast("string")).alias("children"))
    new = edges.filter("src % 10 <> 2").withColumn("dst", F.expr("CASE WHEN src % 10 = 3 THEN dst + 1 ELSE dst END"))
    return D.breaking_slots(D.slot_diff(lists(edges.filter("src % 10 <> 1")), lists(new), ["src", "slot"])).select("src", "slot", "change", "reason")


@query("c6_annotate_components", with_carriers(_BUCKETS + "SELECT k AS name, CASE WHEN bucket = 'changed' AND k % 20 = 3 THEN 'breaking' ELSE bucket END AS annotation FROM d WHERE bucket <> 'unchanged'", *_CAT))
def c6(spark, sf):
    diff = _diff(spark, sf).withColumnRenamed("k", "name")
    local = carrier(spark, sf, "catalog_proposed").selectExpr("k AS name")
    return D.annotate_components(local, diff, diff.filter("name % 20 = 3"))


@query("d3_diff_summary", with_carriers(_BUCKETS + "SELECT CASE WHEN k % 2 = 0 THEN 'token' ELSE 'component' END AS kind, count(*) FILTER (bucket = 'new') AS new, count(*) FILTER (bucket = 'changed') AS changed, count(*) FILTER (bucket = 'unchanged') AS unchanged, count(*) FILTER (bucket = 'removed') AS removed, count(*) FILTER (bucket = 'changed' AND k % 20 = 3) AS breaking, count(*) FILTER (bucket = 'changed' AND k % 4 = 0) AS draft_overwrites FROM d GROUP BY 1", *_CAT))
def d3(spark, sf):
    return D.diff_summary(_diff(spark, sf).selectExpr("*", "CASE WHEN k % 2 = 0 THEN 'token' ELSE 'component' END AS kind", "CASE WHEN k % 20 = 3 THEN 'breaking' ELSE 'safe' END AS classification", "k % 4 = 0 AS has_draft"))


@query("d4_is_empty_diff", with_carriers(_BUCKETS + "SELECT NOT bool_or(bucket <> 'unchanged') AS is_empty FROM d", *_CAT))
def d4(spark, sf):
    return D.is_empty_diff(_diff(spark, sf))


@query("d2_apply_summary", "SELECT o_orderpriority AS entity_type, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderstatus = 'O') AS created, count(*) FILTER (o_orderkey % 3 = 1 AND o_orderstatus = 'O') AS updated, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def d2(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return D.apply_summary(orders.selectExpr("o_orderpriority AS entity_type", "CASE o_orderkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS action", "CASE o_orderstatus WHEN 'O' THEN 'succeeded' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status"))


def _entities(spark, sf):
    return D.selectable_entities(_diff(spark, sf).selectExpr("CASE WHEN k % 2 = 0 THEN 'token' ELSE 'component' END AS kind", "k AS id", "bucket"))


_ENT = _BUCKETS.rstrip() + ",\ne AS (SELECT CASE WHEN k % 2 = 0 THEN 'token' ELSE 'component' END AS kind, k AS id, bucket, concat(CASE WHEN k % 2 = 0 THEN 'token' ELSE 'component' END, ':', k) AS key FROM d WHERE bucket IN ('new', 'changed'))\n"


@query("g6_selectable_entities", with_carriers(_ENT + "SELECT * FROM e", *_CAT))
def g6(spark, sf):
    return _entities(spark, sf)


@query("b24_pattern_select_entities", with_carriers(_ENT + "SELECT key FROM e WHERE (contains(key, 'token:1') OR contains(key, 'component')) AND NOT contains(key, '7')", *_CAT))
def b24(spark, sf):
    return D.pattern_select_entities(_entities(spark, sf), ["token:1", "component"], ["7"]).select("key")


@query("g3_filter_manifest", with_carriers(_ENT + "SELECT kind, id FROM e WHERE id % 3 = 0", *_CAT))
def g3(spark, sf):
    entities = _entities(spark, sf)
    return D.filter_manifest(entities.select("kind", "id"), entities.filter("id % 3 = 0"))


@query("g2_scope_decisions", with_carriers("SELECT component_id, CASE WHEN component_id % 4 = 0 THEN 'accepted' WHEN component_id % 6 = 0 THEN 'rejected' ELSE status END AS status FROM cat_components", "cat_components"))
def g2(spark, sf):
    c = carrier(spark, sf, "cat_components")
    return D.scope_decisions(c, c.filter("component_id % 4 = 0"), c.filter("component_id % 6 = 0")).select("component_id", "status")


@query("b33_breaking_rows", with_carriers("SELECT name, CASE WHEN component_id % 3 = 0 THEN 'p' END AS part, CASE WHEN component_id % 3 = 0 THEN 'removed' ELSE 'breaking' END AS reason FROM cat_components WHERE uses_context", "cat_components"))
def b33(spark, sf):
    rows = carrier(spark, sf, "cat_components").selectExpr("name", "uses_context AS breaking", "CASE WHEN component_id % 3 = 0 THEN array(named_struct('property_id', 'p', 'slot_id', CAST(NULL AS STRING), 'reason', 'removed'), named_struct('property_id', 'q', 'slot_id', CAST(NULL AS STRING), 'reason', 'odd')) END AS breaking_changes")
    return D.breaking_rows(D.sanitize_breaking_changes(rows))


# ---- upserts

@query("j1_upsert_tokens", with_carriers("""+b AS (SELECT 1 AS session_id, path, type, value, -1 AS seq FROM tokens UNION ALL SELECT 1, concat(path, CASE WHEN length(value) = 1 THEN '.x' ELSE '' END), 'number', concat(value, '!'), CAST(value AS BIGINT) FROM tokens WHERE type = 'color')
SELECT session_id, path, arg_max(type, (seq, type, value)) AS type, arg_max(value, (seq, type, value)) AS value FROM b GROUP BY 1, 2""", "tokens"))
def j1(spark, sf):
    tokens = carrier(spark, sf, "tokens").selectExpr("1 AS session_id", "path", "type", "value")
    calls = tokens.filter("type = 'color'").selectExpr("session_id", "concat(path, CASE WHEN length(value) = 1 THEN '.x' ELSE '' END) AS path", "'number' AS type", "concat(value, '!') AS value", "CAST(value AS BIGINT) AS seq")
    return U.upsert_tokens(tokens, calls)


_CACHE = """+o AS (SELECT content_hash, version, arg_max(entity, (updated_at, entity)) AS entity, arg_max(source, (updated_at, entity)) AS source, max(updated_at) AS updated_at, arg_max(human_edited, (updated_at, entity)) AS human_edited FROM cache WHERE entity % 3 <> 0 GROUP BY 1, 2),
n AS (SELECT content_hash, version, arg_max(entity, (updated_at, entity)) AS entity, arg_max(source, (updated_at, entity)) AS source, max(updated_at) + 1 AS updated_at FROM cache WHERE entity % 2 = 0 GROUP BY 1, 2)
"""


def _caches(spark, sf):
    cache = carrier(spark, sf, "cache")
    old = U.last_by_key(cache.filter("entity % 3 <> 0"), ["content_hash", "version"], ["updated_at", "entity"]).withColumn("created_at", F.lit(0).cast("long"))
    return cache, old


@query("j2_upsert_cache", with_carriers(_CACHE + "SELECT content_hash, version, coalesce(n.entity, o.entity) AS entity, coalesce(n.source, o.source) AS source, coalesce(n.updated_at, o.updated_at) AS updated_at, coalesce(o.human_edited, false) AS human_edited, CASE WHEN o.entity IS NULL THEN n.updated_at ELSE 0 END AS created_at FROM o FULL JOIN n USING (content_hash, version)", "cache"))
def j2(spark, sf):
    cache, old = _caches(spark, sf)
    return U.upsert_cache(old, cache.filter("entity % 2 = 0").withColumn("updated_at", F.col("updated_at") + 1).withColumn("human_edited", F.lit(False)))


@query("j4_incremental_split", with_carriers("SELECT entity, EXISTS (SELECT 1 FROM cache k WHERE k.entity % 3 <> 0 AND k.content_hash = c.content_hash AND k.version = c.version) AS reused FROM cache c", "cache"))
def j4(spark, sf):
    cache, old = _caches(spark, sf)
    reused, work = U.incremental_split(cache, old)
    return reused.select("entity").withColumn("reused", F.lit(True)).unionByName(work.select("entity").withColumn("reused", F.lit(False)))


@query("j5_reuse_or_pin", with_carriers("""+h AS (SELECT DISTINCT content_hash, version FROM cache WHERE entity % 3 = 0), e AS (SELECT entity % 50 AS entity, arg_max(content_hash, (updated_at, content_hash)) AS p FROM cache WHERE entity % 3 = 0 AND human_edited GROUP BY 1)
SELECT c.entity AS id, CASE WHEN h.version IS NOT NULL THEN 'reuse' WHEN p IS NOT NULL THEN 'pin' ELSE 'recompute' END AS action, CASE WHEN h.version IS NOT NULL THEN c.content_hash ELSE p END AS used_hash FROM cache c LEFT JOIN h USING (content_hash, version) LEFT JOIN e ON e.entity = c.entity % 50""", "cache"))
def j5(spark, sf):
    cache = carrier(spark, sf, "cache")
    known = cache.filter("entity % 3 = 0").withColumn("entity", F.expr("entity % 50"))
    got = U.reuse_or_pin(cache.selectExpr("entity % 50 AS entity", "content_hash", "version", "entity AS id").drop("id"), known)
    ids = cache.selectExpr("entity AS id", "entity % 50 AS entity", "content_hash", "version")
    return ids.join(got.distinct(), ["entity", "content_hash", "version"]).select("id", "action", "used_hash")


@query("f7_cache_latest_by_entity", with_carriers("SELECT source AS entity, arg_max(content_hash, (updated_at, content_hash)) AS content_hash, max(updated_at) AS updated_at FROM cache GROUP BY 1", "cache"))
def f7(spark, sf):
    return U.cache_latest_by_entity(carrier(spark, sf, "cache").selectExpr("source AS entity", "content_hash", "updated_at"))


@query("j7_mark_human_edited", with_carriers("SELECT entity, human_edited OR entity % 5 = 0 AS human_edited FROM cache", "cache"))
def j7(spark, sf):
    cache = carrier(spark, sf, "cache")
    return U.mark_human_edited(cache, cache.filter("entity % 5 = 0")).select("entity", "human_edited")


@query("j8_backfill_unclassified", with_carriers("SELECT component_id, position, CASE WHEN status = 'generated' THEN coalesce(cdf_type, 'string') ELSE cdf_type END AS cdf_type, CASE WHEN status = 'generated' AND cdf_type IS NULL THEN coalesce(category, 'content') ELSE category END AS category FROM cat_props JOIN cat_components USING (component_id)", "cat_props", "cat_components"))
def j8(spark, sf):
    return U.backfill_unclassified(carrier(spark, sf, "cat_props"), carrier(spark, sf, "cat_components")).select("component_id", "position", "cdf_type", "category")


@query("j9_snapshot_decisions", with_carriers("""SELECT session_id, component_id AS id, name, '' AS resolved_source_path, CAST(NULL AS VARCHAR) AS source_code, concat('{"name":"', name, '","source":"', source, '","framework":"', framework, '"}') AS original, concat('{"name":"', name, '","source":"', source, '","framework":"', framework, '"}') AS edited,
  CASE WHEN name IN (SELECT name FROM cat_components d WHERE d.session_id = c.session_id AND status = 'accepted') THEN 'accepted' ELSE 'rejected' END AS status FROM cat_components c""", "cat_components"))
def j9(spark, sf):
    c = carrier(spark, sf, "cat_components")
    got = U.snapshot_decisions(c, c.filter("status = 'accepted'"))
    return got.select("session_id", "id", "name", "resolved_source_path", "source_code", F.to_json("original_proposal").alias("original"), F.to_json("edited_proposal").alias("edited"), "status")


@query("j10_fingerprint_saved", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def j10(spark, sf):
    return U.fingerprint_saved(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "fingerprint")


@query("d12_composition_hash", with_carriers("SELECT file_id // 60 AS project, sha256(concat('agent|map|', string_agg(concat(path, ' ', sha256(content)), chr(10) ORDER BY concat(path, ' ', sha256(content))))) AS hash FROM files GROUP BY 1", "files"))
def d12(spark, sf):
    return U.composition_hash(carrier(spark, sf, "files").withColumn("project", F.floor(F.col("file_id") / 60)), "agent", "map")


@query("i11_component_input_hash", with_carriers("""+p AS (SELECT component_id, string_agg(concat(name, ':', type), ',' ORDER BY position) AS props FROM cat_props GROUP BY 1), s AS (SELECT component_id, string_agg(name, ',' ORDER BY position) AS slots FROM cat_slots GROUP BY 1)
SELECT component_id, sha256(concat(framework, '|', name, '|', source, '|', coalesce(props, ''), '|', coalesce(slots, ''))) AS input_hash FROM cat_components LEFT JOIN p USING (component_id) LEFT JOIN s USING (component_id)""", "cat_components", "cat_props", "cat_slots"))
def i11(spark, sf):
    return U.component_input_hash(nested(spark, sf)).select("component_id", "input_hash")


@query("f2_newest_run", with_carriers("SELECT project, arg_max(run_id, (created_at, run_id)) AS run_id, count(*) - 1 AS older FROM runs GROUP BY 1", "runs"))
def f2(spark, sf):
    return U.newest_run(carrier(spark, sf, "runs"))


@query("f3_cap_runs", with_carriers("SELECT run_id, row_number() OVER (PARTITION BY project ORDER BY created_at DESC, run_id DESC) <= 5 AS kept FROM runs", "runs"))
def f3(spark, sf):
    return U.cap_runs(carrier(spark, sf, "runs"), 5).select("run_id", "kept")


@query("b28_filter_runs", with_carriers("SELECT run_id, project, created_at, pushed_to FROM (SELECT * FROM runs WHERE created_at > TIMESTAMP '1996-01-01' ORDER BY created_at DESC, run_id DESC LIMIT 300) WHERE pushed_to IS NOT NULL", "runs"))
def b28(spark, sf):
    import datetime

    return U.filter_runs(carrier(spark, sf, "runs"), after=datetime.datetime(1996, 1, 1), limit=300, pushed=True)


@query("c12_seed_from_server", with_carriers("""SELECT component_id, position, coalesce(cdf_type, CASE WHEN component_id % 2 = 0 THEN 'enum' END) AS cdf_type, coalesce(category, CASE WHEN component_id % 2 = 0 THEN CASE WHEN component_id % 4 = 0 THEN 'content' ELSE 'state' END END) AS category, coalesce(default_value, CASE WHEN component_id % 2 = 0 THEN 'd' END) AS default_value FROM cat_props""", "cat_props"))
def c12(spark, sf):
    props = carrier(spark, sf, "cat_props")
    server = props.filter("component_id % 2 = 0").selectExpr("component_id", "name", "'Symbol' AS server_type", "CASE WHEN component_id % 4 = 0 THEN 'content' ELSE 'odd' END AS server_category", "'d' AS server_default")
    return U.seed_from_server(props, server).select("component_id", "position", "cdf_type", "category", "default_value")


@query("c11_seed_from_prior", with_carriers("""+p AS (SELECT CASE WHEN component_id % 2 = 0 THEN 1 ELSE 2 END AS session_id, component_id // 2 AS component_id, position, name, cdf_type, category, description FROM cat_props)
SELECT a.component_id, a.position, coalesce(a.description, b.description) AS description, coalesce(a.cdf_type, b.cdf_type) AS cdf_type, CASE WHEN a.cdf_type IS NULL THEN coalesce(b.category, a.category) ELSE a.category END AS category FROM p a LEFT JOIN p b ON b.session_id = 2 AND b.component_id = a.component_id AND b.name = a.name WHERE a.session_id = 1""", "cat_props"))
def c11(spark, sf):
    props = carrier(spark, sf, "cat_props").selectExpr("CASE WHEN component_id % 2 = 0 THEN 1 ELSE 2 END AS session_id", "component_id DIV 2 AS component_id", "position", "name", "cdf_type", "category", "description")
    sessions = props.select("session_id").distinct().withColumn("started_at", F.col("session_id"))
    return U.seed_from_prior(props, 1, sessions).select("component_id", "position", "cdf_type", "category", "description")


@query("d2_apply_failures", "SELECT o_orderpriority AS entity_type, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'no' ELSE 'unknown error' END AS error FROM orders WHERE o_orderstatus = 'F'")
def d2_failures(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return D.apply_failures(orders.selectExpr("o_orderpriority AS entity_type", "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS status", "CASE WHEN o_orderkey % 2 = 0 THEN 'no' END AS error"))


@query("b31_sanitize_breaking_changes", "SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'p:removed' WHEN 1 THEN 's:slot_removed' WHEN 2 THEN '' ELSE 'p:type_changed,s:slot_allowed_components_narrowed' END AS kept FROM part")
def b31(spark, sf):
    one = lambda p, s, r: f"named_struct('property_id', {p}, 'slot_id', {s}, 'reason', {r})"
    none = "CAST(NULL AS STRING)"
    listed = f"""CASE p_size % 4 WHEN 0 THEN array({one("'p'", none, "'removed'")}, {one("'p'", none, "'odd'")}) WHEN 1 THEN array({one(none, "'s'", "'slot_removed'")}, {one(none, "'s'", "'removed'")})
      WHEN 2 THEN array({one(none, none, "'removed'")}, {one("'p'", none, none)}) ELSE array({one("'p'", none, "'type_changed'")}, {one(none, "'s'", "'slot_allowed_components_narrowed'")}) END AS breaking_changes"""
    found = D.sanitize_breaking_changes(spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", listed))
    return found.selectExpr("id", "array_join(transform(breaking_changes, b -> concat(CASE WHEN b.property_id IS NULL THEN 's:' ELSE 'p:' END, b.reason)), ',') AS kept")


@query("c13_seed_defaults_from_server", with_carriers("""SELECT component_id, position, coalesce(default_value, CASE WHEN component_id % 2 = 0 THEN concat('[', CAST(position AS VARCHAR), ',7]') END) AS default_value, coalesce(cdf_type, CASE WHEN component_id % 2 = 0 THEN 'enum' END) AS cdf_type FROM cat_props""", "cat_props"))
def c13(spark, sf):
    props = carrier(spark, sf, "cat_props")
    server = props.filter("component_id % 2 = 0").selectExpr("component_id", "name", "'Symbol' AS server_type", "'content' AS server_category", "array(position, 7) AS server_default")
    return U.seed_defaults_from_server(props, server).select("component_id", "position", "default_value", "cdf_type")


_KEYED = """+c AS (SELECT o_custkey AS k, o_orderstatus AS version, o_orderkey AS updated_at, o_orderpriority AS body FROM orders), o AS (SELECT k, version, max(updated_at) AS updated_at, arg_max(body, updated_at) AS body FROM c WHERE updated_at % 3 <> 0 GROUP BY 1, 2), n AS (SELECT k, version, max(updated_at) + 7 AS updated_at, arg_max(body, updated_at) AS body FROM c WHERE updated_at % 2 = 0 GROUP BY 1, 2)
SELECT {keys}, coalesce(n.body, o.body) AS {body}, coalesce(n.updated_at, o.updated_at) AS updated_at, coalesce(o.updated_at - 1, n.updated_at) AS created_at FROM o FULL JOIN n USING (k, version)"""


def _keyed(spark, sf, keys: dict[str, str], body: str):
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*(f"{e} AS {n}" for n, e in keys.items()), f"o_orderpriority AS {body}", "o_orderkey AS updated_at")
    old = U.last_by_key(rows.filter("updated_at % 3 <> 0"), list(keys), ["updated_at"]).withColumn("created_at", F.col("updated_at") - 1)
    return old, rows.filter("updated_at % 2 = 0").withColumn("updated_at", F.col("updated_at") + 7)


@query("j3_upsert_extract_cache", with_carriers(_KEYED.format(keys="concat('f', k) AS file_hash, version AS cli_version", body="components_json"), "runs"))
def j3_extract(spark, sf):
    return U.upsert_extract_cache(*_keyed(spark, sf, {"file_hash": "concat('f', o_custkey)", "cli_version": "o_orderstatus"}, "components_json"))


@query("j3_upsert_select_cache", with_carriers(_KEYED.format(keys="concat('c', k) AS component_hash, 'p' AS prompt_hash, version AS cli_version", body="decision"), "runs"))
def j3_select(spark, sf):
    return U.upsert_select_cache(*_keyed(spark, sf, {"component_hash": "concat('c', o_custkey)", "prompt_hash": "'p'", "cli_version": "o_orderstatus"}, "decision"))


@query("j3_upsert_composition_cache", with_carriers(_KEYED.format(keys="concat('i', k) AS input_hash, version AS cli_version", body="agent_output"), "runs"))
def j3_composition(spark, sf):
    return U.upsert_composition_cache(*_keyed(spark, sf, {"input_hash": "concat('i', o_custkey)", "cli_version": "o_orderstatus"}, "agent_output"))


@query("j11_exclude_until_valid")
def j11(spark, sf):
    """Rounds and cycles are beyond plain SQL; tests/test_graph.py holds it against a small graph."""
    bad = carrier(spark, sf, "cat_components").filter("status = 'rejected'").selectExpr("component_id AS node")
    nodes = carrier(spark, sf, "nodes")
    return Z.exclude_until_valid(carrier(spark, sf, "slot_edges"), nodes, lambda left: left.join(bad, "node", "left_semi"))
