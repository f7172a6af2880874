"""Queries over tokens, manifests, runs and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import documents as M
from loomgraph.operators.dedupe import chunk
from loomgraph.functions.lineage import new_folder
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query
from loomgraph.sources.session_tables import read_sessions, store_sessions


@query("a8_load_tokens", with_carriers("+g AS (SELECT DISTINCT regexp_replace(path, '\\.[^.]*$', '') AS group_path FROM tokens UNION SELECT 'none') SELECT group_path, coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM tokens WHERE regexp_replace(path, '\\.[^.]*$', '') = group_path), '') AS members FROM g", "tokens"))
def a8(spark, sf):
    tokens = carrier(spark, sf, "tokens").withColumn("session_id", F.lit(1))
    groups = tokens.select("session_id", F.regexp_replace("path", r"\.[^.]*$", "").alias("group_path")).union(spark.sql("SELECT 1, 'none'")).distinct()
    return M.load_tokens(groups, tokens).select("group_path", F.array_join("members", ",").alias("members"))


@query("a15_record_scanned_files", with_carriers("SELECT file_id % 3 AS session_id, path FROM files WHERE file_id % 3 <> 1 UNION ALL SELECT 1, concat('new/', path) FROM files WHERE file_id % 3 = 1", "files"))
def a15(spark, sf):
    files = carrier(spark, sf, "files").selectExpr("file_id % 3 AS session_id", "path")
    return M.replace_sessions(files, files.filter("session_id = 1").withColumn("path", F.concat(F.lit("new/"), "path")))


@query("a15_record_by_session", with_carriers("SELECT file_id % 3 AS session_id, path FROM files WHERE file_id % 3 <> 1 UNION ALL SELECT 1, concat('new/', path) FROM files WHERE file_id % 3 = 1", "files"))
def a15_by_session(spark, sf):
    """a15 on a table in folders by session."""
    files, folder = carrier(spark, sf, "files").selectExpr("file_id % 3 AS session_id", "path"), new_folder(spark)
    store_sessions(files, folder, files.select("session_id"))
    store_sessions(files.withColumn("path", F.concat(F.lit("new/"), "path")), folder, spark.sql("SELECT 1L AS session_id"))
    return read_sessions(spark, folder, "path string, session_id long")


@query("a10_write_token_tree", with_carriers("""
+t AS (SELECT length(path) % 4 AS session_id, string_split(path, '.') AS seg, type, value FROM tokens),
l AS (SELECT session_id, seg[1] AS a, seg[2] AS b, string_agg(concat('"', seg[3], '":{"$type":"', type, '","$value":"', value, '"}'), ',' ORDER BY seg[3]) AS body FROM t GROUP BY 1, 2, 3),
m AS (SELECT session_id, a, string_agg(concat('"', b, '":{', body, '}'), ',' ORDER BY b) AS body FROM l GROUP BY 1, 2)
SELECT session_id, concat('{', string_agg(concat('"', a, '":{"$description":"of ', a, '",', body, '}'), ',' ORDER BY a), '}') AS document FROM m GROUP BY 1""", "tokens"))
def a10(spark, sf):
    tokens = carrier(spark, sf, "tokens").selectExpr("bigint(length(path) % 4) AS session_id", "path", "type", "value")
    groups = tokens.select("session_id", F.substring_index("path", ".", 1).alias("path")).distinct().withColumn("description", F.concat(F.lit("of "), "path"))
    return M.write_token_tree(tokens, groups)


@query("a11_read_review_events", "SELECT event_type AS type, ts AS timestamp, props AS body, CAST(user_id AS VARCHAR) AS who FROM events")
def a11(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS type", "ts AS timestamp", "map('body', props, 'who', string(user_id)) AS payload", "event_id % 2 AS half")
    path = new_folder(spark)
    for half in (0, 1):  # two appends
        M.append_review_events(events.filter(F.col("half") == half), path)
    return M.read_review_events(spark, path).selectExpr("type", "timestamp", "payload['body'] AS body", "payload['who'] AS who")


@query("a12_read_run_records", with_carriers("SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(project AS VARCHAR) AS project, CASE WHEN run_id % 3 = 0 THEN 1 ELSE 3 END AS version, CASE WHEN run_id % 3 <> 0 THEN pushed_to END AS pushed_to FROM runs", "runs"))
def a12(spark, sf):
    runs = carrier(spark, sf, "runs").selectExpr("string(run_id) AS run_id", "string(project) AS project", "timestamp(created_at) AS created_at", "pushed_to")
    old, new = runs.filter("run_id % 3 = 0").drop("pushed_to").withColumn("version", F.lit(1)), runs.filter("run_id % 3 <> 0").withColumn("version", F.lit(3))
    return M.upgrade_run_records(old, new).select("run_id", "project", "version", "pushed_to")


@query("a16_concat_token_sources", with_carriers("SELECT file_id % 3 AS project, string_agg(content, concat(chr(10), chr(10)) ORDER BY path, content) AS text FROM files WHERE trim(content) <> '' GROUP BY 1", "files"))
def a16(spark, sf):
    return M.concat_token_sources(carrier(spark, sf, "files").withColumn("project", F.col("file_id") % 3))


_ENTRIES = "SELECT concat('C', CAST(src AS STRING)) AS key, slot, CAST(dst AS STRING) AS child FROM slot_edges"


def _entries(spark, sf):
    carrier(spark, sf, "slot_edges").createOrReplaceTempView("slot_edges")
    slots = spark.sql(_ENTRIES).groupBy("key", "slot").agg(F.array_sort(F.collect_list("child")).alias("allowed"))
    listed = F.array_sort(F.collect_list(F.struct("slot", F.struct(F.lit(True).alias("required"), "allowed").alias("s"))))
    return slots.groupBy("key").agg(F.map_from_entries(listed).alias("slots"))


@query("a14_build_manifest", with_carriers(f"""+e AS (SELECT key, slot, string_agg(concat('"', child, '"'), ',' ORDER BY child) AS kids FROM ({_ENTRIES}) t GROUP BY 1, 2)
SELECT 'token' AS kind, path AS id, value AS body FROM tokens UNION ALL SELECT 'component', key, concat('{{', string_agg(concat('"', slot, '":{{"allowed":[', kids, ']}}'), ',' ORDER BY slot), '}}') FROM e GROUP BY key""", "tokens", "slot_edges"))
def a14(spark, sf):
    return M.build_manifest(_entries(spark, sf), carrier(spark, sf, "tokens"))[0]


@query("a14_manifest_sections", "SELECT 'plain' AS manifest, 'component' AS kind, 'listed' AS state FROM (SELECT count(*) FROM part) t UNION ALL SELECT 'plain', 'token', 'absent' FROM (SELECT count(*) FROM part) t UNION ALL SELECT 'delete', unnest(['component', 'token']), 'empty' FROM (SELECT count(*) FROM part) t")
def a14_sections(spark, sf):
    entries, tokens = _entries(spark, sf), carrier(spark, sf, "tokens")
    plain, delete = M.build_manifest(entries, tokens.limit(0))[1], M.build_manifest(entries, tokens, delete_all=True)[1]
    return plain.select(F.lit("plain").alias("manifest"), "*").unionByName(delete.select(F.lit("delete").alias("manifest"), "*"))


@query("b26_composition_mode", with_carriers("SELECT src, slot, 0 AS children FROM slot_edges GROUP BY 1, 2", "slot_edges"))
def b26(spark, sf):
    slots = carrier(spark, sf, "slot_edges").groupBy("src", "slot").agg(F.collect_list("dst").alias("children"))
    return M.strip_children(slots).select("src", "slot", F.size("children").alias("children"))


@query("c19_merge_ai_decisions", with_carriers("SELECT component_id, coalesce(CASE WHEN component_id % 2 = 0 THEN 'accepted' END, CASE WHEN component_id % 3 = 0 THEN 'rejected' END) AS decision FROM cat_components", "cat_components"))
def c19(spark, sf):
    c = carrier(spark, sf, "cat_components").withColumn("name", F.col("component_id").cast("string")).withColumn("decision", F.expr("CASE WHEN component_id % 2 = 0 THEN 'accepted' END"))
    streamed = c.filter("component_id % 3 = 0").select("name", F.lit("rejected").alias("decision"), F.lit(1).alias("seq"))
    return M.merge_ai_decisions(c, streamed).select("component_id", "decision")


@query("c23_attach_server_errors", with_carriers("SELECT component_id, CASE WHEN component_id % 3 = 0 THEN 'own,a,b' ELSE 'own' END AS issues FROM cat_components", "cat_components"))
def c23(spark, sf):
    c = carrier(spark, sf, "cat_components").withColumn("name", F.col("component_id").cast("string")).withColumn("issues", F.array(F.lit("own")))
    errors = c.filter("component_id % 3 = 0").select("name", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("message"))
    return M.attach_server_errors(c, errors)[0].select("component_id", F.array_join("issues", ",").alias("issues"))


@query("c24_pair_validation", with_carriers("SELECT component_id, name, component_id % 7 AS issues FROM cat_components WHERE component_id % 2 = 0", "cat_components"))
def c24(spark, sf):
    c = carrier(spark, sf, "cat_components")
    return M.pair_validation(c.filter("component_id % 2 = 0"), c.withColumn("issues", F.col("component_id") % 7)).select("component_id", "name", "issues")


@query("d7_generation_totals", "SELECT count(*) FILTER (l_linenumber = 1) AS failed, count(*) FILTER (l_linenumber = 2) AS cached, count(*) FILTER (l_linenumber > 2) AS generated, sum(l_linenumber) AS classified, sum(l_suppkey) AS excluded, sum(l_partkey) AS renamed FROM lineitem")
def d7(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return M.generation_totals(lines.selectExpr("CASE l_linenumber WHEN 1 THEN 'failed' WHEN 2 THEN 'cached' ELSE 'generated' END AS state", "bigint(l_linenumber) AS classified", "l_suppkey AS excluded", "l_partkey AS renamed"))


@query("l1_plugged_extractor", with_carriers("SELECT path, CAST(length(content) AS BIGINT) AS size FROM files", "files"))
def l1(spark, sf):
    return M.extract_with(carrier(spark, sf, "files"), lambda path, content: [{"path": path, "size": len(content)}], "path string, size long")


def _headings(path: str, content: str) -> tuple[list[dict], list[str]]:
    """The headings of a page and a warning of each that is short; every third length of a page is an error."""
    import re

    if len(content) % 3 == 0:
        raise ValueError("cannot be read")
    found = re.findall("<h1>([^<]*)</h1>", content)
    return [{"path": path, "heading": h} for h in found], [f"short heading: {h}" for h in found if len(h) < 30]


def _extracted(spark, sf):
    return M.extract_with_warnings(carrier(spark, sf, "files"), _headings, "path: string, heading: string")


@query("l1_plugged_rows", with_carriers("SELECT path, unnest(regexp_extract_all(content, '<h1>([^<]*)</h1>', 1)) AS heading FROM files WHERE length(content) % 3 <> 0", "files"))
def l1_rows(spark, sf):
    return _extracted(spark, sf)[0]


@query("l1_plugged_warnings", with_carriers("SELECT path, 'ValueError: cannot be read' AS warning FROM files WHERE length(content) % 3 = 0 UNION ALL SELECT path, concat('short heading: ', h) FROM (SELECT path, unnest(regexp_extract_all(content, '<h1>([^<]*)</h1>', 1)) AS h FROM files WHERE length(content) % 3 <> 0) WHERE length(h) < 30", "files"))
def l1_warnings(spark, sf):
    return _extracted(spark, sf)[1]


@query("l3_plugged_decision", with_carriers("SELECT name, CASE WHEN starts_with(name, 'p') OR length(name) % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS decision FROM components", "components"))
def l3(spark, sf):
    chunks = chunk(carrier(spark, sf, "components"), "arrival")
    return M.decide_with(chunks, lambda names: ["accepted" if n.startswith("p") or len(n) % 2 == 0 else "rejected" for n in names])


@query("l2_plugged_edge_parser", with_carriers("""+l AS (SELECT path AS parent, unnest(list_distinct(regexp_extract_all(content, 'href="([^"]*)"', 1))) AS child FROM files)
SELECT DISTINCT parent, child, child IN (SELECT path FROM files) AS accepted FROM l WHERE child <> '' AND parent <> ''""", "files"))
def l2(spark, sf):
    files = carrier(spark, sf, "files")

    def links(path: str, content: str) -> list[dict]:
        import re

        return [{"parent": path, "child": c, "slot": None, "confidence": 9} for c in set(re.findall(r'href="([^"]*)"', content or ""))]

    good, bad = M.edges_with(files, files.select(F.col("path").alias("name")), links)
    rows = good.filter("confidence IS NULL").select("parent", "child", F.lit(True).alias("accepted")).unionByName(bad.filter("reason <> 'empty endpoint'").select("parent", "child", F.lit(False).alias("accepted")))
    return rows.distinct()
