"""Queries over components and their props."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import naming as N
from loomgraph.operators import components as C
from loomgraph.operators import nested as T
from loomgraph.operators import props as P
from loomgraph.plans.carriers import carrier, with_carriers
from loomgraph.plans.registry import query


def nested(spark, sf):
    return T.load_components(carrier(spark, sf, "cat_components"), carrier(spark, sf, "cat_props"), carrier(spark, sf, "cat_slots"))


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_RULES = f"""
+r AS (SELECT *, trim(type) AS t, contains(type, '|') AND contains(type, '''') AS u FROM rule_props),
c AS (SELECT *, CASE
  WHEN regexp_matches(name, '^on[A-Z]') OR contains(type, '=> void') OR contains(type, 'EventHandler') OR name IN ('ref', 'innerRef', 'testId', 'data-testid', 'dataTestId', 'key') OR contains(type, 'Ref<')
    OR contains(type, 'Dispatch<') OR contains(type, 'SetStateAction') OR name IN {_in(P.PASS_THROUGH)} OR regexp_matches(name, '^aria[-A-Z]') OR starts_with(name, 'data-') OR (name = 'name' AND dom_attribute) THEN 'exclude|'
  WHEN u THEN 'design|enum'
  WHEN (t IN ('string', 'boolean', 'number') OR u) AND (regexp_matches(lower(name), '^(variant|size|spacing|gap|color|bg|theme|align|layout|orientation|position)') OR regexp_matches(name, '(Color|Size|Variant|Style)$')) THEN 'design|string'
  WHEN t = 'boolean' AND name IN {_in(P.STATES)} THEN 'state|boolean'
  WHEN t = 'boolean' AND regexp_matches(lower(name), '^(hide|show|enable|disable|vertical|horizontal|reverse|bold|italic|imageon|with)') THEN 'design|boolean'
  WHEN name IN {_in(P.IDENTIFIERS)} THEN 'state|string'
  WHEN t = 'string' THEN 'content|string' WHEN t = 'boolean' THEN 'design|boolean' WHEN t = 'number' THEN 'design|string' END AS rule FROM r)
"""


@query("b1_preclassify_props", with_carriers(_RULES + "SELECT origin, position, name, type, nullif(split_part(rule, '|', 1), '') AS rule_category, nullif(split_part(rule, '|', 2), '') AS type_hint FROM c", "rule_props"))
def b1(spark, sf):
    return P.preclassify_props(carrier(spark, sf, "rule_props")).select("origin", "position", "name", "type", "rule_category", "type_hint")


@query("b2_drop_excluded_props", with_carriers(_RULES + "SELECT origin, position, name, type, coalesce(category, nullif(split_part(rule, '|', 1), '')) AS category FROM c WHERE rule IS DISTINCT FROM 'exclude|'", "rule_props"))
def b2(spark, sf):
    return P.drop_excluded_props(carrier(spark, sf, "rule_props")).select("origin", "position", "name", "type", "category")


@query("b3_slot_typed_props", with_carriers(f"""
+r AS (SELECT *, array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(type, '\\s+', ' ', 'g')), '|'), lambda x: trim(x)), lambda x: x NOT IN ('null', 'undefined')), ' | ') AS k FROM rule_props)
SELECT origin, position, name, type, k IN {_in([f"{t}[]" for t in P.NODE_TYPES] + [f"Array<{t}>" for t in P.NODE_TYPES])} OR (k IN {_in(P.NODE_TYPES)} AND name NOT IN {_in(P.CONTENT_NAMES)}) AS is_slot FROM r""", "rule_props"))
def b3(spark, sf):
    return P.slot_typed_props(carrier(spark, sf, "rule_props")).select("origin", "position", "name", "type", "is_slot")


_COUNTS = """+ps AS (SELECT component_id, count(*) AS n, bool_or(name = 'value') AS has_value,
  bool_and(regexp_matches(type, '=>|EventHandler|Dispatch<|SetStateAction|Ref<|MutableRefObject') OR regexp_matches(name, '^(on|set)[A-Z]') OR name IN ('ref', 'innerRef')) AS wired FROM cat_props GROUP BY 1),
ss AS (SELECT component_id, count(*) AS m FROM cat_slots GROUP BY 1),
v AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, CASE WHEN n IS NULL AND m IS NULL THEN 'component has no props and no slots'
  WHEN uses_context AND has_value THEN 'source uses createContext and component exposes a Context.Provider value prop' WHEN uses_context AND n IS NULL THEN 'source uses createContext and component has no props'
  WHEN uses_context AND n = 1 AND NOT wired THEN 'source uses createContext and component has a single non-handler prop' WHEN n > 0 AND wired THEN 'every prop is a handler or ref' END AS skip_reason
  FROM cat_components c LEFT JOIN ps USING (component_id) LEFT JOIN ss USING (component_id))
"""


@query("b4_nonauthorable_verdict", with_carriers(_COUNTS + "SELECT component_id, name, skip_reason, skip_reason IS NOT NULL AS skip FROM v", "cat_components", "cat_props", "cat_slots"))
def b4(spark, sf):
    return C.nonauthorable_verdict(nested(spark, sf)).select("component_id", "name", "skip_reason", "skip")


@query("b5_drop_hooks", with_carriers("SELECT component_id, name FROM cat_components WHERE NOT regexp_matches(name, '^use[A-Z]')", "cat_components"))
def b5(spark, sf):
    return C.drop_hooks(carrier(spark, sf, "cat_components"))[0].select("component_id", "name")


_SCORE = _COUNTS.rstrip() + f""",
w AS (SELECT *, list_transform(string_split(type, '|'), lambda x: trim(x)) AS parts FROM cat_props),
k AS (SELECT *, len(list_filter(parts, lambda x: x IN ('string', 'number', 'boolean'))) AS b, len(list_filter(parts, lambda x: x IN ('null', 'undefined'))) AS e FROM w),
i AS (SELECT component_id, position, CASE WHEN trim(type) IN {_in(C.OPAQUE_TYPES)} THEN concat('opaque-type:', name) WHEN len(parts) >= 3 AND (b >= 3 OR (b >= 2 AND e > 0 AND b + e >= 3)) THEN concat('wide-union:', name)
  WHEN coalesce(description, '') = '' AND name NOT IN {_in(C.OBVIOUS_NAMES)} THEN 'props-missing-description' END AS issue FROM k),
f AS (SELECT component_id, arg_min(issue, position) AS issue FROM i WHERE issue IS NOT NULL GROUP BY 1)
"""


@query("b8_score_extraction", with_carriers(_SCORE + """
SELECT component_id, 5 - ((n = 0 AND m = 0)::INT + (n > 50)::INT + (issue IS NOT NULL)::INT) AS confidence,
  concat_ws(';', CASE WHEN n = 0 AND m = 0 THEN 'no-props-or-slots' END, issue) AS reasons, false AS needs_review FROM v LEFT JOIN f USING (component_id)""", "cat_components", "cat_props", "cat_slots"))
def b8(spark, sf):
    return C.score_extraction(nested(spark, sf)).select("component_id", "confidence", F.array_join("reasons", ";").alias("reasons"), "needs_review")


def _inspected(spark, sf):
    """Components with inspection columns made from their ids."""
    return nested(spark, sf).selectExpr(
        "*", "CAST(component_id % 6 AS INT) AS wrapper_confidence", "component_id % 4 = 0 AS keep_despite_zero_surface", "array('data-wrapper:infra-props') AS inspection_reasons",
        "CASE WHEN component_id % 10 = 0 THEN array('props-type-unresolved') END AS extractor_reasons",
    )


@query("b9_finalize_review_flags", with_carriers(_SCORE.rstrip() + """,
z AS (SELECT v.*, issue, component_id % 6 AS wc, component_id % 4 = 0 AS keep, component_id % 10 = 0 AS unresolved, skip_reason IS NOT NULL AND NOT coalesce(skip_reason = 'component has no props and no slots' AND component_id % 4 = 0, false) AS held FROM v LEFT JOIN f USING (component_id)),
y AS (SELECT *, greatest(1, 5 - ((n = 0 AND m = 0)::INT + (issue IS NOT NULL)::INT + CASE WHEN wc >= 4 THEN 2 WHEN wc = 3 THEN 1 ELSE 0 END + unresolved::INT + held::INT)) AS confidence FROM z)
SELECT component_id, confidence, confidence <= 2 OR wc >= 4 OR keep OR held OR unresolved AS needs_review,
  concat_ws(';', CASE WHEN n = 0 AND m = 0 THEN 'no-props-or-slots' END, issue, CASE WHEN unresolved THEN 'props-type-unresolved' END, 'data-wrapper:infra-props', CASE WHEN held THEN concat('non-authorable:', skip_reason) END) AS reasons FROM y""", "cat_components", "cat_props", "cat_slots"))
def b9(spark, sf):
    return C.finalize_review_flags(_inspected(spark, sf)).select("component_id", "confidence", "needs_review", F.array_join("reasons", ";").alias("reasons"))


_ISSUES = """
+named AS (SELECT c.*, count(*) OVER (PARTITION BY session_id, trim(name)) AS same FROM cat_components c),
slot AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY position) - 1 AS nr FROM cat_slots), prop AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY position) - 1 AS nr FROM cat_props),
issue AS (
  SELECT component_id, 'error' AS severity, 'EMPTY_COMPONENT_NAME' AS code, NULL AS field FROM cat_components WHERE trim(name) = ''
  UNION ALL SELECT component_id, 'error', 'EMPTY_PROP_NAME', concat('props['  , nr, '].name') FROM prop WHERE trim(name) = ''
  UNION ALL SELECT component_id, 'warning', 'EMPTY_SLOT_NAME', concat('slots['  , nr, '].name') FROM slot WHERE trim(name) = ''
  UNION ALL SELECT component_id, 'error', 'PROP_SLOT_NAME_COLLISION', concat('slots['  , nr, '].name') FROM slot s WHERE trim(name) <> '' AND EXISTS (SELECT 1 FROM prop p WHERE p.component_id = s.component_id AND trim(p.name) = trim(s.name))
  UNION ALL SELECT component_id, 'error', 'DUPLICATE_COMPONENT_NAME', NULL FROM named WHERE trim(name) <> '' AND same > 1
  UNION ALL SELECT component_id, 'warning', 'EMPTY_COMPONENT', NULL FROM cat_components c WHERE NOT EXISTS (SELECT 1 FROM prop p WHERE p.component_id = c.component_id) AND NOT EXISTS (SELECT 1 FROM slot p WHERE p.component_id = c.component_id))
"""
_CAT = ("cat_components", "cat_props", "cat_slots")


@query("b10_validate_components", with_carriers(_ISSUES + "SELECT * FROM issue", *_CAT))
def b10(spark, sf):
    return C.validate_components(nested(spark, sf)).select("component_id", F.explode("issues").alias("i")).select("component_id", "i.severity", "i.code", "i.field")


@query("b11_exclude_invalid", with_carriers(_ISSUES + "SELECT component_id, name FROM cat_components c WHERE NOT EXISTS (SELECT 1 FROM issue i WHERE i.component_id = c.component_id AND severity = 'error')", *_CAT))
def b11(spark, sf):
    return C.exclude_invalid(C.validate_components(nested(spark, sf)))[0].select("component_id", "name")


@query("d6_issue_counts", with_carriers(_ISSUES + "SELECT c.session_id, c.component_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM cat_components c LEFT JOIN issue i USING (component_id) GROUP BY 1, 2", *_CAT))
def d6(spark, sf):
    return C.issue_counts(C.validate_components(nested(spark, sf))).selectExpr("session_id", "component_id", "bigint(errors) AS errors", "bigint(warnings) AS warnings")


@query("b12_rename_empty_slots", with_carriers("""SELECT session_id, component_id, position, CASE WHEN trim(name) = '' THEN CASE WHEN count(*) OVER (PARTITION BY component_id) = 1 THEN 'children' ELSE concat('slot_', position) END ELSE name END AS name FROM cat_slots""", "cat_slots"))
def b12(spark, sf):
    return C.rename_empty_slots(carrier(spark, sf, "cat_slots")).select("session_id", "component_id", "position", "name")


@query("b20_kebab_to_pascal", "SELECT page_id, array_to_string(list_transform(list_filter(string_split(split_part(url, '/', 3), '-'), lambda x: x <> ''), lambda x: concat(upper(x[1]), x[2:])), '') AS pascal FROM pages")
def b20(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    return pages.select("page_id", N.kebab_to_pascal("host").alias("pascal"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.COMMANDS.items()) + "}"


@query("b21_normalize_command", with_carriers(f"SELECT step_id, {_MAP}[command] AS tracked FROM steps", "steps"))
def b21(spark, sf):
    return carrier(spark, sf, "steps").select("step_id", N.normalize_command("command").alias("tracked"))


@query("b22_map_server_type", "SELECT p_partkey, coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in N.SERVER_TYPES.items()) + "}[lower(t)], 'string') AS definition_type FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Symbol' WHEN 2 THEN 'MEDIA' WHEN 3 THEN 'Link' ELSE p_type END AS t FROM part)")
def b22(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("t", F.expr("CASE p_size % 5 WHEN 0 THEN 'Text' WHEN 1 THEN 'Symbol' WHEN 2 THEN 'MEDIA' WHEN 3 THEN 'Link' ELSE p_type END"))
    return part.select("p_partkey", N.map_server_type("t").alias("definition_type"))


@query("b23_pattern_status", with_carriers(_ISSUES + """SELECT component_id, name, CASE WHEN name = 'part_7' THEN 'rejected' WHEN contains(lower(name), '3') THEN 'rejected' WHEN EXISTS (SELECT 1 FROM issue i WHERE i.component_id = c.component_id AND severity = 'error') THEN 'rejected' ELSE 'accepted' END AS status FROM cat_components c""", *_CAT))
def b23(spark, sf):
    return C.pattern_status(C.validate_components(nested(spark, sf)), reject=["3"], select_all=True, exclude_invalid=True, exclude=["part_7"]).select("component_id", "name", "status")


@query("b27_ai_flag", with_carriers("SELECT component_id, flagged, NOT flagged AS included FROM (SELECT component_id, uses_context OR status IN ('rejected', 'failed') AS flagged FROM cat_components)", "cat_components"))
def b27(spark, sf):
    rows = carrier(spark, sf, "cat_components").withColumnsRenamed({"uses_context": "needs_review", "status": "decision"})
    return C.ai_flag(rows).select("component_id", "flagged", "included")


@query("b34_strip_scoring_fields", with_carriers("SELECT session_id, component_id, name FROM cat_components", "cat_components"))
def b34(spark, sf):
    return C.strip_scoring_fields(C.score_extraction(nested(spark, sf))).select("session_id", "component_id", "name")


@query("d5_duplicate_names", with_carriers("SELECT session_id, name, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM components GROUP BY 1, 2 HAVING count(DISTINCT source) > 1", "components"))
def d5(spark, sf):
    return C.duplicate_names(carrier(spark, sf, "components")).withColumn("sources", F.array_join("sources", ","))


@query("g5_reject_names", with_carriers("SELECT session_id, component_id, name, CASE WHEN name IN (SELECT name FROM cat_components d WHERE d.session_id = c.session_id AND component_id % 10 = 0) THEN 'rejected' ELSE status END AS status FROM cat_components c", "cat_components"))
def g5(spark, sf):
    components = carrier(spark, sf, "cat_components")
    return C.reject_names(components, components.filter("component_id % 10 = 0")).select("session_id", "component_id", "name", "status")


@query("i10_component_id", with_carriers("SELECT arrival, substr(sha256(concat(name, ':', source)), 1, 12) AS component_id, concat(name, '-', substr(sha256(concat(name, ':', source)), 1, 12)) AS review_id FROM components", "components"))
def i10(spark, sf):
    return carrier(spark, sf, "components").select("arrival", N.component_id("name", "source").alias("component_id"), N.review_id("name", "source").alias("review_id"))


@query("i12_prompt_hash", "SELECT doc_id, sha256(concat_ws('|', sha256(text), lang, source)) AS hash FROM documents")
def i12(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.prompt_hash("text", "lang", "source").alias("hash"))


@query("i13_truncate_and_snippet", """
+d AS (SELECT doc_id, text, position('the' IN text) AS hit FROM documents),
e AS (SELECT *, greatest(1, hit - 50) AS start, hit + 53 AS stop FROM d),
f AS (SELECT *, position(chr(10) IN reverse(text[1:start - 1])) AS back, position(chr(10) IN text[stop:]) AS ahead FROM e)
SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(text[1:100], '...') ELSE text END AS short,
  CASE WHEN hit > 0 THEN text[CASE WHEN back > 0 THEN start - back + 1 ELSE 1 END:CASE WHEN ahead > 0 THEN stop + ahead - 2 ELSE length(text) END] END AS snippet FROM f""".replace("+d", "WITH d", 1))
def i13(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", N.truncate_text("text", 100, "...").alias("short"), N.snippet("text", "the", 50).alias("snippet"))


_LISTS = """
+p AS (SELECT component_id, string_agg(concat(name, ':', type), ',' ORDER BY position) AS props FROM cat_props GROUP BY 1), s AS (SELECT component_id, string_agg(name, ',' ORDER BY position) AS slots FROM cat_slots GROUP BY 1)
SELECT component_id, name, coalesce(props, '') AS props, coalesce(slots, '') AS slots FROM cat_components c LEFT JOIN p USING (component_id) LEFT JOIN s USING (component_id)"""


@query("a5_load_components", with_carriers(_LISTS + " WHERE (session_id, name) IN (SELECT (session_id, name) FROM cat_components WHERE status = 'accepted')", *_CAT))
def a5(spark, sf):
    components = carrier(spark, sf, "cat_components")
    found = T.load_components(components, carrier(spark, sf, "cat_props"), carrier(spark, sf, "cat_slots"), components.filter("status = 'accepted'"))
    return found.selectExpr("component_id", "name", "array_join(transform(props, p -> concat(p.name, ':', p.type)), ',') AS props", "array_join(transform(slots, s -> s.name), ',') AS slots")


@query("a4_normalize_components", with_carriers("""
SELECT substr(sha256(concat(c.name, ':', c.source)), 1, 12) AS component_id, CAST(row_number() OVER (PARTITION BY p.component_id ORDER BY p.position) - 1 AS INT) AS position, p.name, p.type FROM cat_components c JOIN cat_props p USING (component_id)""", "cat_components", "cat_props"))
def a4(spark, sf):
    return T.normalize_components(nested(spark, sf))["props"].select("component_id", "position", "name", "type")


@query("a6_load_definitions", with_carriers("""
+v AS (SELECT component_id, position, string_agg(value, ';' ORDER BY idx) AS vals FROM cat_values GROUP BY 1, 2)
SELECT c.component_id, c.name AS key, p.name AS prop, p.cdf_type AS type, p.category, CASE WHEN p.required THEN true END AS required, CASE WHEN p.cdf_type = 'boolean' THEN CASE p.default_value = 'true' WHEN true THEN 'true' WHEN false THEN 'false' END ELSE p.default_value END AS "default", v.vals
FROM cat_components c LEFT JOIN cat_props p ON p.component_id = c.component_id AND p.cdf_type <> 'excluded' AND trim(p.name) <> '' LEFT JOIN v ON v.component_id = p.component_id AND v.position = p.position WHERE c.status = 'generated'""", "cat_components", "cat_props", "cat_values"))
def a6(spark, sf):
    got = T.load_definitions(*(carrier(spark, sf, n) for n in ("cat_components", "cat_props", "cat_values", "cat_slots", "cat_children")))
    rows = got.select("component_id", "key", F.explode_outer("properties").alias("prop", "e"))
    return rows.selectExpr("component_id", "key", "prop", "e.type", "e.category", "e.required", "e.default", "array_join(e.values, ';') AS vals")


@query("a9_write_component_documents", with_carriers("SELECT component_id // 100 AS session_id, count(DISTINCT name) AS entries FROM cat_components WHERE status = 'generated' GROUP BY 1", "cat_components"))
def a9(spark, sf):
    own = lambda n: carrier(spark, sf, n).withColumn("session_id", F.floor(F.col("component_id") / 100))
    got = T.load_definitions(*(own(n) for n in ("cat_components", "cat_props", "cat_values", "cat_slots", "cat_children")))
    documents, _ = T.write_component_documents(got, "https://example.org/components.schema.json")
    return documents.selectExpr("session_id", "bigint(size(json_object_keys(document)) - 1) AS entries")


_SAID = """+c AS (SELECT session_id, component_id, name, description, CASE WHEN CAST(component_id AS INT) % 3 = 0 THEN concat('why ', name) END AS description_rationale, CASE WHEN CAST(component_id AS INT) % 4 = 0 THEN 'props' END AS props_rationale FROM k_components WHERE CAST(component_id AS INT) % 5 <> 2),
p AS (SELECT session_id, component_id, string_agg(concat(name, '=', coalesce(CASE WHEN position % 2 = 0 THEN 'state' END, category, '?'), '/', coalesce(description, '-'), '/', CASE WHEN position % 3 = 0 THEN concat('r', position) ELSE '-' END), ',' ORDER BY position) AS props FROM k_props GROUP BY 1, 2),
s AS (SELECT session_id, component_id, string_agg(concat(name, '/', coalesce(description, '-'), '/', concat('s', position)), ',' ORDER BY position) AS slots FROM k_slots GROUP BY 1, 2)"""


@query("c9_rationale_view", with_carriers(_SAID + " SELECT c.*, coalesce(props, '') AS props, coalesce(slots, '') AS slots FROM c LEFT JOIN p USING (session_id, component_id) LEFT JOIN s USING (session_id, component_id)", "k_components", "k_props", "k_slots"))
def c9(spark, sf):
    components = carrier(spark, sf, "k_components").withColumns({"description_rationale": F.expr("CASE WHEN int(component_id) % 3 = 0 THEN concat('why ', name) END"), "props_rationale": F.expr("CASE WHEN int(component_id) % 4 = 0 THEN 'props' END")})
    props = carrier(spark, sf, "k_props").withColumns({"cdf_category": F.expr("CASE WHEN position % 2 = 0 THEN 'state' END"), "rationale": F.expr("CASE WHEN position % 3 = 0 THEN concat('r', position) END")})
    slots = carrier(spark, sf, "k_slots").withColumn("rationale", F.expr("concat('s', position)"))
    got = T.rationale_view(components, props, slots, components.filter("int(component_id) % 5 <> 2"))
    shown = "array_join(transform({c}, x -> {x}), ',') AS {c}"
    return got.selectExpr("session_id", "component_id", "name", "description", "description_rationale", "props_rationale", shown.format(c="props", x="concat(x.name, '=', coalesce(x.category, '?'), '/', coalesce(x.description, '-'), '/', coalesce(x.rationale, '-'))"), shown.format(c="slots", x="concat(x.name, '/', coalesce(x.description, '-'), '/', coalesce(x.rationale, '-'))"))


@query("c10_scope_rows", with_carriers("""
SELECT session_id, component_id, name, CASE status WHEN 'extracted' THEN 'undecided' ELSE status END AS decision, coalesce(CASE WHEN uses_context THEN 'asked' END, CASE WHEN component_id % 3 = 0 THEN 'no surface' END) AS reason FROM cat_components WHERE status IN ('extracted', 'accepted', 'rejected')""", "cat_components"))
def c10(spark, sf):
    rows = carrier(spark, sf, "cat_components").selectExpr("*", "CASE WHEN uses_context THEN 'asked' END AS reason", "CASE WHEN component_id % 3 = 0 THEN array('other', 'non-authorable:no surface') END AS review_reasons")
    return T.scope_rows(rows)


@query("c28_accepted_components", with_carriers("""SELECT session_id, component_id, name FROM cat_components c WHERE session_id > 1 OR name IN (SELECT name FROM cat_components d WHERE d.session_id = c.session_id AND status = 'accepted')""", "cat_components"))
def c28(spark, sf):
    components = carrier(spark, sf, "cat_components")
    return T.accepted_components(components, components.filter("session_id <= 1").select("session_id", "name", "status")).select("session_id", "component_id", "name")
