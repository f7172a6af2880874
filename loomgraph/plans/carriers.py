"""Catalog-shaped views of the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CARRIERS = {
    "sessions": "SELECT c_custkey AS session_id, c_name AS name FROM customer",
    "steps": """SELECT event_id AS step_id, user_id AS session_id,
  CASE event_type WHEN 'signup' THEN 'analyze extract' WHEN 'view' THEN 'analyze select' WHEN 'click' THEN 'generate components' WHEN 'purchase' THEN 'apply push' ELSE 'import' END AS command,
  CASE event_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'interrupted' ELSE 'complete' END AS status, ts AS started_at, props AS inputs FROM events""",
    "components": """SELECT p_partkey % 4 AS session_id, p_partkey AS arrival, replace(p_name, ' ', '_') AS name,
  concat('/repo/packages/', replace(p_brand, '#', ''), '/src/components/', replace(p_name, ' ', '_'), '/', CASE p_size % 3 WHEN 0 THEN 'index.tsx' WHEN 1 THEN concat(replace(p_name, ' ', '_'), '.tsx') ELSE concat('v', CAST(p_size AS STRING), '.vue') END) AS source,
  CASE p_size % 3 WHEN 2 THEN 'vue' ELSE 'react' END AS framework FROM part""",
    "props": """SELECT l_partkey AS component_key, l_orderkey AS origin, l_linenumber AS position,
  CASE l_linenumber WHEN 1 THEN 'onClick' WHEN 2 THEN 'label' WHEN 3 THEN 'bgColor' WHEN 4 THEN 'disabled' WHEN 5 THEN 'href' WHEN 6 THEN 'ref' ELSE 'data-x' END AS name,
  CASE l_returnflag WHEN 'A' THEN 'string' WHEN 'N' THEN 'boolean' ELSE '''a'' | ''b''' END AS type, l_linestatus = 'F' AS required FROM lineitem""",
    "slot_edges": """SELECT src, slot, dst FROM (SELECT p_partkey AS src, 'body' AS slot, (p_partkey * 7 + p_size) % n AS dst FROM part CROSS JOIN (SELECT count(*) AS n FROM part) WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 'aside', (p_partkey * 3 + 1) % n FROM part CROSS JOIN (SELECT count(*) AS n FROM part) WHERE p_partkey % 20 = 1
  UNION ALL SELECT p_partkey, 'next', p_partkey + 1 FROM part WHERE p_partkey % 20 = 5 UNION ALL SELECT p_partkey, 'prev', p_partkey - 1 FROM part WHERE p_partkey % 20 = 6) e""",
    "nodes": "SELECT p_partkey AS node FROM part",
    "composition_edges": """SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey AS parent, l_suppkey AS child,
  CASE l_linenumber % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'body' ELSE NULL END AS slot,
  CASE l_linenumber WHEN 1 THEN 'user' WHEN 2 THEN 'typed-slot' WHEN 3 THEN 'structural' WHEN 4 THEN 'manifest' WHEN 5 THEN 'doc' WHEN 6 THEN 'adapter:x' ELSE 'agent' END AS provenance FROM lineitem""",
    "files": "SELECT page_id AS file_id, regexp_replace(url, '^https?://', '') AS path, html AS content FROM pages",
    "transcripts": """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('{"tool":"classify_prop","prop":"p', CAST(turn AS STRING), '","cdf_type":"',
  CASE conv_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'enum' WHEN 2 THEN 'boolean' ELSE 'bogus' END, '","cdf_category":"content"}')
  WHEN turn % 3 = 1 THEN concat('{"tool":"exclude_prop","prop":"p', CAST(turn - 1 AS STRING), '"}') ELSE text END AS line FROM conversations""",
    "tokens": """SELECT concat(replace(p_brand, '#', ''), '.', p_type, '.t', CAST(p_partkey AS STRING)) AS path,
  CASE p_size % 5 WHEN 0 THEN 'colour' WHEN 1 THEN 'color' WHEN 2 THEN 'dimension' ELSE 'number' END AS type, CAST(p_size AS STRING) AS value FROM part""",
    "catalog_current": "SELECT p_partkey AS k, p_type AS type, p_size > 25 AS required, p_brand AS default_value FROM part WHERE p_partkey % 10 <> 1",
    "catalog_proposed": """SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 'CHANGED' ELSE p_type END AS type, p_size > 25 OR p_partkey % 10 = 4 AS required, p_brand AS default_value
  FROM part WHERE p_partkey % 10 <> 2""",
    "runs": "SELECT o_orderkey AS run_id, o_custkey AS project, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS pushed_to FROM orders",
    "command_events": """SELECT event_id, user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'started' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'invoked' END AS kind, value, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 130 ELSE 1 END END AS exit_code FROM events""",
    "cache": """SELECT d.doc_id AS entity, sha256(d.text) AS content_hash, d.source AS source, coalesce(l.toxic, 0) = 1 AS human_edited, d.n_chars AS updated_at, d.lang AS version
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}


CARRIERS["rule_props"] = """SELECT l_orderkey AS origin, l_linenumber AS position,
  CASE (l_orderkey + l_linenumber) % 26 WHEN 0 THEN 'onClick' WHEN 1 THEN 'label' WHEN 2 THEN 'bgColor' WHEN 3 THEN 'disabled' WHEN 4 THEN 'href' WHEN 5 THEN 'ref' WHEN 6 THEN 'data-x' WHEN 7 THEN 'key' WHEN 8 THEN 'className'
    WHEN 9 THEN 'aria-label' WHEN 10 THEN 'showIcon' WHEN 11 THEN 'isOpen' WHEN 12 THEN 'locale' WHEN 13 THEN 'imageUrl' WHEN 14 THEN 'titleText' WHEN 15 THEN 'count' WHEN 16 THEN 'variant' WHEN 17 THEN 'testId' WHEN 18 THEN 'name'
    WHEN 19 THEN 'setValue' WHEN 20 THEN 'children' WHEN 21 THEN 'iconSize' WHEN 22 THEN 'title' WHEN 23 THEN '' WHEN 24 THEN 'enabled' ELSE 'other' END AS name,
  CASE l_partkey % 9 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' WHEN 2 THEN 'number' WHEN 3 THEN '''a'' | ''b''' WHEN 4 THEN '() => void' WHEN 5 THEN 'ReactNode' WHEN 6 THEN 'ReactNode[] | null' WHEN 7 THEN 'Ref<string>' ELSE 'Record<string, any>' END AS type,
  CASE l_suppkey % 4 WHEN 0 THEN 'content' WHEN 1 THEN 'state' END AS category, l_suppkey % 5 = 0 AS dom_attribute FROM lineitem"""
CARRIERS["cat_components"] = """SELECT p_partkey % 4 AS session_id, p_partkey AS component_id, CASE WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '_') ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) END AS name, concat('/src/', p_name, '.tsx') AS source, CASE p_size % 3 WHEN 2 THEN 'vue' ELSE 'react' END AS framework,
  CASE p_size % 4 WHEN 0 THEN 'generated' WHEN 1 THEN 'extracted' WHEN 2 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN p_size % 5 <> 0 THEN p_type END AS description, p_partkey AS arrival, p_size % 7 = 0 AS uses_context FROM part"""
CARRIERS["cat_props"] = """SELECT l_partkey % 4 AS session_id, l_partkey AS component_id, CAST(l_linenumber AS INT) AS position,
  CASE l_linenumber WHEN 1 THEN 'onClick' WHEN 2 THEN 'label' WHEN 3 THEN 'bgColor' WHEN 4 THEN 'disabled' WHEN 5 THEN 'value' WHEN 6 THEN 'ref' ELSE ' ' END AS name,
  CASE l_suppkey % 6 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' WHEN 2 THEN 'any' WHEN 3 THEN 'string | number | null' WHEN 4 THEN '() => void' ELSE '''a'' | ''b''' END AS type,
  l_linestatus = 'F' AS required, CASE l_returnflag WHEN 'A' THEN 'content' WHEN 'N' THEN NULL ELSE 'design' END AS category, CASE l_suppkey % 5 WHEN 0 THEN 'string' WHEN 1 THEN 'boolean' WHEN 2 THEN 'excluded' WHEN 3 THEN 'enum' END AS cdf_type,
  CASE WHEN l_quantity > 25 THEN 'text' END AS description, CASE WHEN l_discount > 0.05 THEN CASE WHEN l_tax > 0.04 THEN 'true' ELSE 'x' END END AS default_value
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey) AS rn FROM lineitem WHERE l_partkey % 6 <> 0) t WHERE rn = 1"""
CARRIERS["cat_values"] = f"""SELECT session_id, component_id, position, idx, concat('v', CAST(idx AS STRING)) AS value FROM ({CARRIERS["cat_props"]}) p CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2) v WHERE cdf_type = 'enum'"""
CARRIERS["cat_slots"] = f"""SELECT src % 4 AS session_id, src AS component_id, CAST(row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS INT) AS position, CASE WHEN src % 9 = 2 THEN '' WHEN src % 13 = 1 THEN 'label' ELSE slot END AS name, slot = 'body' AS is_default, src % 3 = 0 AS required
  FROM (SELECT DISTINCT src, slot FROM ({CARRIERS["slot_edges"]}) t) u"""
CARRIERS["cat_children"] = f"""SELECT src % 4 AS session_id, src AS component_id, slot AS slot_name, CAST(row_number() OVER (PARTITION BY src, slot ORDER BY dst) - 1 AS INT) AS position, dst AS child FROM ({CARRIERS["slot_edges"]}) t"""
# A catalog in full: names are unique within their component.
CARRIERS["k_components"] = """SELECT CAST(p_partkey % 4 AS INT) AS session_id, CAST(p_partkey AS STRING) AS component_id, concat('C', CAST(p_partkey AS STRING)) AS name, concat('/src/', p_name, '.tsx') AS source, 'react' AS framework, 'extracted' AS status,
  CASE WHEN p_size % 5 <> 0 THEN p_type END AS description, CAST(NULL AS STRING) AS description_rationale, CAST(NULL AS STRING) AS props_rationale, CAST(NULL AS STRING) AS slots_rationale FROM part"""
CARRIERS["k_props"] = f"""SELECT CAST(session_id AS INT) AS session_id, CAST(component_id AS STRING) AS component_id, name, position, type, required, cdf_type, category, CAST(NULL AS STRING) AS token_kind, description, default_value, CAST(NULL AS STRING) AS rationale FROM ({CARRIERS["cat_props"]}) p"""
CARRIERS["k_values"] = f"""SELECT session_id, component_id, name AS prop_name, idx AS position, concat('v', CAST(idx AS STRING)) AS value FROM ({CARRIERS["k_props"]}) p CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 UNION ALL SELECT 2) v WHERE cdf_type = 'enum'"""
CARRIERS["k_slots"] = f"""SELECT CAST(src % 4 AS INT) AS session_id, CAST(src AS STRING) AS component_id, slot AS name, CAST(row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS INT) AS position, slot = 'body' AS is_default, src % 3 = 0 AS required, CAST(NULL AS STRING) AS description, CAST(NULL AS STRING) AS rationale
  FROM (SELECT DISTINCT src, slot FROM ({CARRIERS["slot_edges"]}) t) u"""
CARRIERS["k_children"] = f"""SELECT CAST(session_id AS INT) AS session_id, CAST(component_id AS STRING) AS component_id, slot_name, position, CAST(child AS STRING) AS child FROM ({CARRIERS["cat_children"]}) c"""
CARRIERS["k_calls"] = """SELECT CAST(l_partkey % 4 AS INT) AS session_id, CAST(l_partkey AS STRING) AS component_id, l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_linenumber <= 3 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'exclude_prop' ELSE 'classify_prop' END WHEN l_linenumber <= 5 THEN 'classify_slot' ELSE 'classify_component' END AS tool,
  CASE l_linenumber WHEN 1 THEN 'onClick' WHEN 2 THEN 'label' WHEN 3 THEN 'absent' WHEN 4 THEN 'body' WHEN 5 THEN 'gone' END AS name, l_returnflag AS cdf_type, 'content' AS cdf_category, l_linestatus AS token_kind,
  CASE WHEN l_suppkey % 4 <> 0 THEN l_linestatus = 'O' END AS required, CASE WHEN l_discount > 0.05 THEN 'said' END AS description, CASE WHEN l_tax > 0.04 THEN 'why' ELSE '' END AS reason,
  CASE WHEN l_quantity > 25 THEN 'dv' END AS default_value, CASE WHEN l_quantity > 40 THEN 'x,y,x' WHEN l_quantity > 30 THEN 'z' END AS listed
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) t WHERE rn = 1"""


#: What Spark orders lines by where the SQL leaves open which of several of a key comes first: their place in the table, by
#: file name and then by row, as DuckDB takes them with one thread. In a folder of one part file the other columns decide. All
#: tables of a query that are made of them, and all runs, then take the same one.
_OPEN = "ORDER BY l_orderkey)"
_SETTLED = "ORDER BY l_orderkey, __file, __place, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """A table with __file, a row's file where there are several, and __place, its place there; 0 in a folder of one file."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    one_part = len(files) == 1 and not files[0].endswith(os.path.basename(path))
    file = F.col("_metadata.file_name") if len(files) > 1 else F.lit("")
    return table.select("*", file.alias("__file"), (F.lit(0) if one_part else F.col("_metadata.row_index")).alias("__place"))


def tables(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Register the driver's tables that sql names as temporary views."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            path = f"{sf_dir}/{name}.parquet"
            placed = name == "lineitem" and "__place" in sql
            (_placed(spark, path) if placed else spark.read.parquet(path)).createOrReplaceTempView(name)


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CARRIERS[name].replace("sha256(d.text)", "sha2(d.text, 256)").replace(_OPEN, _SETTLED)
    tables(spark, sf_dir, sql)
    return spark.sql(sql)


def with_carriers(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with carriers as common table expressions before sql, which may go on with more of its own."""
    head = ",\n".join(f"{n} AS ({CARRIERS[n]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+')}"
