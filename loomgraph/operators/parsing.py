"""Text and JSON that tools, servers and people write, as rows."""

from __future__ import annotations

import itertools
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from loomgraph.functions.lineage import cut, rows

# Vocabularies of calls.
CALL_TYPES = ["string", "enum", "richtext", "media", "boolean", "token", "link"]
CATEGORIES = ["content", "design", "state"]
PROP_TOOLS = ["classify_prop", "exclude_prop", "classify_slot", "classify_component"]
TOKEN_TYPES = ["color", "dimension", "fontFamily", "fontWeight", "duration", "cubicBezier", "number", "strokeStyle", "border", "transition", "shadow", "gradient", "typography"]
# Keys whose values are masked, shapes of secrets inside texts, and what stands for them.
SECRET_KEYS = ["token", "secret", "password", "authorization", "^auth$", "apikey", "api_key", "credential", "bearer", "^cma$", "cmaToken"]
SECRET_SHAPES = [r"^(?i:Bearer)\s+\S+", r"CFPAT-[A-Za-z0-9_-]{20,}", r"sk-[A-Za-z0-9_-]{20,}", r"xox[baprs]-[A-Za-z0-9-]{10,}"]
REDACTED, MAX_TEXT = "«redacted»", 4000


def _calls(transcripts: DataFrame) -> DataFrame:
    """Lines that open an object, with the parsed value (null for bad JSON)."""
    line = F.trim("line")
    return transcripts.withColumn("line", line).filter(F.col("line").startswith("{")).withColumn("__v", F.try_parse_json("line"))


def _get(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("__v", f"$.{name}", kind)


def parse_prop_calls(transcripts: DataFrame, types=tuple(CALL_TYPES)) -> tuple[DataFrame, DataFrame]:
    """Valid calls that classify props, slots and components, and a warning for each other line that opens an object."""
    rows = _calls(transcripts).select("*", *(_get(n).alias(n) for n in ("tool", "prop", "slot", "cdf_type", "cdf_category", "description")), _get("required", "boolean").alias("required"))
    tool = F.col("tool")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    warning = (
        F.when(F.col("__v").isNull(), "bad JSON")
        .when(~F.coalesce(tool.isin(PROP_TOOLS), F.lit(False)), "unknown tool")
        .when(tool.isin("classify_prop", "exclude_prop") & blank("prop"), "missing prop")
        .when((tool == "classify_prop") & ~F.coalesce(F.col("cdf_type").isin(list(types)), F.lit(False)), "invalid type")
        .when((tool == "classify_prop") & ~F.coalesce(F.col("cdf_category").isin(CATEGORIES), F.lit(False)), "invalid category")
        .when((tool == "classify_slot") & blank("slot"), "missing slot")
    )
    rows = rows.withColumn("warning", warning).drop("__v")
    return rows.filter("warning IS NULL").drop("warning"), rows.filter("warning IS NOT NULL").select(*transcripts.columns, "warning")


def parse_select_calls(transcripts: DataFrame) -> DataFrame:
    """Decisions by component name; unknown tools are skipped, a confidence outside 1 to 5 is dropped."""
    rows = _calls(transcripts).select("*", _get("tool").alias("tool"), _get("name").alias("name"), _get("reason").alias("reason"), _get("confidence", "int").alias("confidence"))
    good = F.col("tool").isin("accept_component", "reject_component") & (F.coalesce(F.trim("name"), F.lit("")) != "")
    return rows.filter(good).withColumn("confidence", F.when(F.col("confidence").between(1, 5), F.col("confidence"))).drop("__v", "line")


def parse_token_calls(transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls that set a token: path, type and a value that is there, though it may be null; and warnings."""
    rows = _calls(transcripts).filter(F.coalesce(_get("tool") == "set_token", F.lit(False))).select("*", _get("path").alias("path"), _get("type").alias("type"))
    present = F.array_contains(F.json_object_keys("line"), "value")
    warning = F.when(F.col("path").isNull(), "missing path").when(F.col("type").isNull(), "missing type").when(~present, "missing value")
    rows = rows.withColumn("value", F.get_json_object("line", "$.value")).withColumn("warning", warning).drop("__v", "line")
    return rows.filter("warning IS NULL").drop("warning"), rows.filter("warning IS NOT NULL")


def parse_edge_calls(transcripts: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between known components; a bad confidence keeps the edge, without it, and warns."""
    rows = _calls(transcripts).filter(F.coalesce(_get("tool") == "map_edge", F.lit(False))).select("*", _get("parent").alias("parent"), _get("child").alias("child"), _get("slot").alias("slot"), _get("confidence", "int").alias("confidence"))
    known = lambda c: names.select(F.col("name").alias(c)).distinct().withColumn(f"__{c}", F.lit(True))
    rows = rows.join(known("parent"), "parent", "left").join(known("child"), "child", "left")
    bad = F.col("confidence").isNotNull() & ~F.col("confidence").between(1, 5)
    unknown = F.col("__parent").isNull() | F.col("__child").isNull()
    warning = F.when(unknown, "unknown endpoint").when(bad, "invalid confidence")
    rows = rows.withColumn("warning", warning).withColumn("confidence", F.when(~bad, F.col("confidence")))
    cols = ["parent", "child", "slot", "confidence"]
    return rows.filter(~unknown).select(cols), rows.filter("warning IS NOT NULL").select(*cols, "warning")


def step_call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool").agg(F.count("*").alias("n"))


def first_call_per_component(batch: DataFrame, calls: DataFrame) -> DataFrame:
    """The first call that names each component of a batch; failed where none does."""
    first = calls.groupBy("name").agg(F.min_by(F.struct("tool", "reason"), "seq").alias("c"))
    rows = batch.select("name").join(first, "name", "left")
    decision = F.when(F.col("c.tool") == "accept_component", "accepted").when(F.col("c.tool") == "reject_component", "rejected").otherwise("failed")
    return rows.select("name", decision.alias("decision"), F.coalesce("c.reason", F.when(F.col("c").isNull(), "no call names it")).alias("reason"))


def walk_documents(docs: DataFrame, is_leaf, max_depth: int | None = None) -> DataFrame:
    """doc, path, node (JSON text) and whether it is a leaf, for the objects of JSON documents (doc, value) below keys without a dollar sign.

    Levels are exploded until none is left. With max_depth, a deeper document is an error.
    """
    front = docs.select("doc", F.lit("").alias("path"), F.col("value").alias("node"), F.lit(False).alias("leaf"))
    found = None
    for depth in itertools.count():
        grown = front.filter(~F.col("leaf")).select("doc", "path", F.explode(F.from_json("node", "map<string,string>")).alias("key", "node"))
        grown = grown.filter(~F.col("key").startswith("$") & F.col("node").startswith("{"))
        path = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        front = cut(grown.select("doc", path.alias("path"), "node").withColumn("leaf", F.coalesce(is_leaf(F.col("node")), F.lit(False))))
        found = front if found is None else found.unionByName(front)
        if not rows(front):
            return found
        if depth == max_depth:
            raise ValueError(f"a document is deeper than {max_depth}")


def flatten_tokens(docs: DataFrame) -> DataFrame:
    """doc, path, type and value of the tokens of documents: objects with a $value."""
    leaf = lambda n: F.array_contains(F.json_object_keys(n), "$value")
    found = walk_documents(docs, leaf).filter("leaf").withColumn("m", F.from_json("node", "map<string,string>"))
    return found.select("doc", "path", F.col("m")["$type"].alias("type"), F.col("m")["$value"].alias("value"))


def _token_nodes(docs: DataFrame) -> DataFrame:
    leaf = lambda n: F.array_contains(F.json_object_keys(n), "$value")
    return walk_documents(docs, leaf).withColumn("kind", F.from_json("node", "map<string,string>")["$type"])


def validate_tokens(docs: DataFrame) -> DataFrame:
    """Problems of token documents: doc, path and code (not an object, unknown type, value without type, type without value)."""
    nodes = _token_nodes(docs)
    code = F.when(F.col("leaf") & F.col("kind").isNull(), "value without type").when(F.col("kind").isNotNull() & ~F.col("kind").isin(TOKEN_TYPES), "unknown type").when(~F.col("leaf") & F.col("kind").isNotNull(), "type without value")
    groups = nodes.filter(~F.col("leaf") & F.col("kind").isNull()).select("doc", "path", "node").unionByName(docs.select("doc", F.lit("").alias("path"), F.col("value").alias("node")))
    inside = groups.select("doc", "path", F.explode(F.from_json("node", "map<string,string>")).alias("key", "child")).filter(~F.col("key").startswith("$") & ~F.coalesce(F.col("child").startswith("{"), F.lit(False)))
    stray = inside.select("doc", F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.lit("not an object").alias("code"))
    return nodes.select("doc", "path", code.alias("code")).filter("code IS NOT NULL").unionByName(stray)


def token_counts(docs: DataFrame) -> DataFrame:
    """Per document how many tokens and groups it has; nodes with a type alone are neither."""
    return _token_nodes(docs).groupBy("doc").agg(F.count_if("leaf").alias("tokens"), F.count_if(~F.col("leaf") & F.col("kind").isNull()).alias("groups"))


def read_component_documents(docs: DataFrame) -> DataFrame:
    """doc, key (dotted) and entry (JSON text) of the components of documents: objects whose $type is component."""
    return walk_documents(docs, lambda n: F.get_json_object(n, "$['$type']") == "component").filter("leaf").select("doc", F.col("path").alias("key"), F.col("node").alias("entry"))


def validate_definitions(entries: DataFrame) -> DataFrame:
    """Problems of component entries (doc, key, entry): properties without or with an unknown $type or $category, and extra keys."""
    allowed = F.array(*map(F.lit, ("$type", "$category", "$description", "$required", "$default", "$values", "$token.kind")))
    props = entries.select("doc", "key", F.explode(F.from_json(F.from_json("entry", "map<string,string>")["$properties"], "map<string,string>")).alias("prop", "def"))
    m = F.from_json("def", "map<string,string>")
    rows = props.select("doc", "key", "prop", m["$type"].alias("t"), m["$category"].alias("c"), F.array_except(F.json_object_keys("def"), allowed).alias("extra"))
    kinds = F.coalesce(F.col("t").isin([*CALL_TYPES, "number"]), F.lit(False))
    codes = F.array_compact(F.array(F.when(~kinds, "invalid type"), F.when(~F.coalesce(F.col("c").isin(CATEGORIES), F.lit(False)), "invalid category"), F.when(F.size("extra") > 0, "extra key")))
    return rows.select("doc", "key", "prop", F.explode(codes).alias("code"))


# What a definition document may hold, and of which kind it is.
COMPONENT_KEYS = {"$type": "string", "$description": "string", "$properties": "object", "$slots": "object"}
PROPERTY_KEYS = {"$type": "string", "$category": "string", "$description": "string", "$required": "boolean", "$default": "any", "$values": "array of string", "$token.kind": "string"}
SLOT_KEYS = {"$description": "string", "$required": "boolean", "$allowedComponents": "array of string"}


def _kind(node: Column) -> Column:
    """object, array of string, array, string, boolean, number or null: of what kind JSON text is."""
    array = F.from_json(node, "array<string>")
    strings = F.coalesce(node.startswith("[") & F.forall(F.try_variant_get(F.try_parse_json(node), "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False))
    return (
        F.when(node.startswith("{"), "object").when(strings, "array of string").when(node.startswith("[") & array.isNotNull(), "array")
        .when(node == "null", "null").when(node.isin("true", "false"), "boolean").when(node.rlike(r"^-?[0-9]"), "number").otherwise("string")
    )


def _members(rows: DataFrame, node: str, name: str) -> DataFrame:
    """A row for each key of an object in JSON text: name, and its value as JSON text in node; texts keep their quotes."""
    each = rows.select("*", F.explode(F.from_json(node, "map<string,variant>")).alias("__k", "__v")).drop(node)  # the object is parsed once, not for each key
    return each.withColumns({name: F.col("__k"), node: F.to_json("__v")}).drop("__k", "__v")


def _checked(rows: DataFrame, allowed: dict[str, str], required: tuple[str, ...], values: dict[str, list[str]]) -> DataFrame:
    """doc, path and code of objects (doc, path, node) that lack a required key or have another, of another kind or value."""
    given = F.json_object_keys("node")
    lacking = rows.select("doc", "path", F.explode(F.array_except(F.array(*map(F.lit, required)), given)).alias("k")).select("doc", "path", F.concat(F.lit("missing "), "k").alias("code")) if required else None
    each = _members(rows.select("doc", "path", "node"), "node", "key").withColumn("node", F.coalesce("node", F.lit("null")))
    wanted = F.element_at(F.create_map(*(F.lit(x) for kv in allowed.items() for x in kv)), F.col("key"))
    code = F.when(wanted.isNull(), F.concat(F.lit("unknown key "), "key")).when((wanted != "any") & (wanted != _kind(F.col("node"))) & ~((wanted == "array of string") & (F.col("node") == "[]")), F.concat(F.lit("wrong kind of "), "key"))
    for k, known in values.items():
        code = F.coalesce(code, F.when((F.col("key") == k) & ~F.col("node").isin([json.dumps(v) for v in known]), F.lit(f"unknown {k}")))
    wrong = each.select("doc", "path", code.alias("code")).filter("code IS NOT NULL")
    return wrong if lacking is None else wrong.unionByName(lacking)


def validate_documents(docs: DataFrame, schema_url: str, types=(*CALL_TYPES,), categories=tuple(CATEGORIES)) -> DataFrame:
    """doc, path and code of what is wrong with definition documents (doc, value as JSON text).

    A document is an object whose $schema is schema_url and whose other keys are components or groups of such. A
    component has a $type and $properties; properties have a known $type and $category; slots have what slots may have.
    """
    parsed = docs.select("doc", F.col("value").alias("node")).repartition(docs.sparkSession.sparkContext.defaultParallelism)  # small files hold many documents
    is_object = F.coalesce(F.try_parse_json("node").isNotNull() & F.ltrim("node").startswith("{"), F.lit(False))
    bad = parsed.filter(~is_object).select("doc", F.lit("/").alias("path"), F.lit("not an object").alias("code"))
    good = parsed.filter(is_object)
    schema = F.when(~F.array_contains(F.json_object_keys("node"), "$schema"), "missing $schema").when(~F.coalesce(F.try_variant_get(F.try_parse_json("node"), "$['$schema']", "string") == schema_url, F.lit(False)), "wrong $schema")
    top = good.select("doc", F.lit("/$schema").alias("path"), schema.alias("code")).filter("code IS NOT NULL")
    nodes = cut(walk_documents(good.select("doc", F.col("node").alias("value")), lambda n: F.get_json_object(n, "$['$type']") == "component"))
    groups = nodes.filter("NOT leaf").select("doc", "path", "node").unionByName(good.select("doc", F.lit("").alias("path"), "node"))
    strays = _members(groups, "node", "key").filter(~F.col("key").startswith("$") & (_kind(F.col("node")) != "object"))
    strays = strays.select("doc", F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.lit("neither component nor group").alias("code"))
    notes = _members(nodes.filter("NOT leaf").select("doc", "path", "node"), "node", "key").filter(F.col("key").startswith("$"))
    notes = notes.filter((F.col("key") != "$description") | (_kind(F.col("node")) != "string")).select("doc", "path", F.concat(F.when(F.col("key") == "$description", F.lit("wrong kind of ")).otherwise(F.lit("unknown key ")), "key").alias("code"))
    components = nodes.filter("leaf").select("doc", "path", "node")

    def below(key: str) -> DataFrame:
        inner = components.select("doc", "path", F.to_json(F.try_variant_get(F.try_parse_json("node"), f"$['{key}']", "variant")).alias("node")).filter(F.col("node").startswith("{"))
        each = _members(inner, "node", "name")
        return each.select("doc", F.concat("path", F.lit("."), "name").alias("path"), F.coalesce("node", F.lit("null")).alias("node"))

    props, slots = cut(below("$properties")), cut(below("$slots"))
    found = [bad, top, strays, notes, _checked(components, COMPONENT_KEYS, ("$type", "$properties"), {})]
    for table, rule in ((props, (PROPERTY_KEYS, ("$type", "$category"), {"$type": list(types), "$category": list(categories)})), (slots, (SLOT_KEYS, (), {}))):
        objects = F.col("node").startswith("{")
        found += [table.filter(~objects).select("doc", "path", F.lit("not an object").alias("code")), _checked(table.filter(objects), *rule)]
    return reduce(DataFrame.unionByName, found).distinct()


def merge_token_documents(docs: DataFrame) -> DataFrame:
    """key and value of documents (path, value) merged by top-level key, the last path wins; text that isn't an object is skipped."""
    rows = docs.filter(F.try_parse_json("value").isNotNull()).select("path", F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    return rows.groupBy("key").agg(F.max_by("v", "path").alias("value"))


def token_group_members(groups: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sorted paths of the tokens right under each group."""
    child = tokens.select("session_id", "path", F.regexp_replace("path", r"\.[^.]*$", "").alias("group_path")).filter("path <> group_path")
    members = child.groupBy("session_id", "group_path").agg(F.array_sort(F.collect_set("path")).alias("members"))
    return groups.join(members, ["session_id", "group_path"], "left")


def _is_secret(key: str) -> bool:
    return re.search("|".join(SECRET_KEYS), key, re.IGNORECASE) is not None


def _masked(value: Column, kind: DataType) -> Column:
    """A value of a type with the secrets inside it masked, to any depth; what a struct's key hides becomes a text."""
    if isinstance(kind, StringType):
        long = F.concat(F.substring(value, 1, MAX_TEXT), F.lit("…«+"), (F.length(value) - MAX_TEXT).cast("string"), F.lit("»"))
        return F.when(value.rlike("|".join(SECRET_SHAPES)), REDACTED).when(F.length(value) > MAX_TEXT, long).otherwise(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _masked(x, kind.elementType))
    if isinstance(kind, MapType):
        hidden = lambda k: k.rlike(f"(?i){'|'.join(SECRET_KEYS)}")
        if isinstance(kind.valueType, StringType):
            return F.transform_values(value, lambda k, v: F.when(hidden(k), F.lit(REDACTED)).otherwise(_masked(v, kind.valueType)))
        return F.transform_values(value, lambda k, v: F.when(~hidden(k), _masked(v, kind.valueType)))
    if isinstance(kind, StructType):
        fields = [F.lit(REDACTED).alias(f.name) if _is_secret(f.name) else _masked(value[f.name], f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact(payload: DataFrame, column: str) -> DataFrame:
    """Mask a column's values by key or shape at every level of its type, and cut long texts with a count.

    Keys are fields of structs and keys of maps; a masked value of a map that doesn't hold texts is null.
    """
    return payload.withColumn(column, _masked(F.col(column), payload.schema[column].dataType))


def redact_json(payload: DataFrame, column: str) -> DataFrame:
    """redact for a column of JSON texts of any shape. Text that isn't JSON is masked as a text, null stays."""
    shapes = re.compile("|".join(SECRET_SHAPES))

    def masked(v):
        if isinstance(v, str):
            return REDACTED if shapes.search(v) else v if len(v) <= MAX_TEXT else f"{v[:MAX_TEXT]}…«+{len(v) - MAX_TEXT}»"
        if isinstance(v, list):
            return [masked(x) for x in v]
        if isinstance(v, dict):
            return {k: REDACTED if _is_secret(k) else masked(x) for k, x in v.items()}
        return v

    def line(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(masked(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return masked(text)

    @F.pandas_udf("string")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(line)

    return payload.withColumn(column, lines(column))


def validate_interchange(docs: DataFrame) -> DataFrame:
    """doc and errors of interchange documents: version 1, and groups an object of arrays of strings."""
    v = F.try_parse_json("value")
    version = F.try_variant_get(v, "$.version", "int")
    groups = F.try_variant_get(v, "$.groups", "map<string,array<string>>")
    errors = F.array_compact(F.array(F.when(v.isNull(), "bad JSON"), F.when(v.isNotNull() & ~F.coalesce(version == 1, F.lit(False)), "version must be 1"), F.when(v.isNotNull() & groups.isNull(), "groups must map names to lists")))
    return docs.select("doc", F.array_join(errors, ";").alias("errors"))


def parse_server_errors(bodies: DataFrame) -> DataFrame:
    """component, path and message of each detail of error bodies; a text body gives what follows `component X:`."""
    d = F.from_json("body", "details array<struct<component:string,path:string,message:string>>").getField("details")
    listed = bodies.select("id", F.explode(d).alias("d")).select("id", "d.component", "d.path", "d.message")
    plain = bodies.filter(F.try_parse_json("body").isNull()).select("id", F.regexp_extract("body", r"component \"?(\w+)\"?:\s*(.*)", 1).alias("component"), F.lit(None).cast("string").alias("path"), F.regexp_extract("body", r"component \"?(\w+)\"?:\s*(.*)", 2).alias("message"))
    return listed.unionByName(plain.filter("component <> ''"))


# Prefixes of log lines and of failed calls, and the forms in which bindings are reported.
LOG_PREFIX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\s+[0-9a-f-]+\s+ERROR\s+(?:\[dd\.[^\]]*\]\s*)?"
LOG_TAG = r"\[dd\.(?:trace_id|span_id)=[^\]]*\]\s*"
CALL_PREFIX = r"^((?:apply|preview|poll) failed: \d+)\n"
BINDING = r"(?i)binding configurations are invalid|Pointer path does not exist"
BINDING_CODE, BINDING_MESSAGE = "BindingValidationFailed", "One or more binding configurations are invalid."
POINTER = r"(?i)Pointer path does not exist for '\[object Object\]':\s*(.+?)(?=\.\s*Default\s*›|$)"


def parse_error_log(lines: DataFrame) -> DataFrame:
    """code, message, cycle (an array of names) and diagnostics (component, path, message) of error texts (line).

    Prefixes of failed calls and of logs go. Then the first form that fits counts: JSON (a code, message or cycle at the
    top or under details; a message about bindings is read as such), a text about bindings, an object literal at the
    end; a text of no form is its own message.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    body = F.regexp_replace("line", CALL_PREFIX, "")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, LOG_PREFIX, ""), LOG_TAG, ""))
    rows = lines.withColumns({"__prefix": F.regexp_extract("line", CALL_PREFIX, 1), "__t": text})
    rows = rows.withColumn("__j", F.when(F.try_parse_json("__t").isNotNull() & F.col("__t").startswith("{"), F.col("__t")))
    get = lambda *paths: F.coalesce(*(F.get_json_object("__j", p) for p in paths))
    rows = rows.withColumns({"__code": get("$.code", "$.details.code", "$.sys.id"), "__message": get("$.message", "$.details.message"), "__cycle": F.from_json(get("$.cycle", "$.details.cycle"), "array<string>")})
    is_json = F.coalesce("__code", "__message", F.array_join("__cycle", ",")).isNotNull()
    about = F.coalesce(F.when(is_json, F.col("__message")), F.when(~is_json, F.col("__t")))
    binding = F.coalesce(about.rlike(BINDING), F.lit(False))
    heading = none(F.trim(F.regexp_extract(about, r"(?i)^(.*?)(?=\.?\s*Pointer path does not exist|\.?\s*Default\s*›)", 1)))
    literal = F.regexp_extract("__t", r"(\{[^{]*)$", 1)
    literal_code = none(F.regexp_extract(literal, r"code:\s*['\"]([^'\"]+)['\"]", 1))
    literal_cycle = none(F.trim(F.regexp_extract(literal, r"cycle:\s*\[\s*([^\]]*)\s*\]", 1)))
    names = F.filter(F.transform(F.split(literal_cycle, ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")
    is_literal = literal_code.isNotNull() | literal_cycle.isNotNull()
    head = none(F.trim(F.regexp_replace("__t", r"\{[^{]*$", "")))
    errors = F.from_json(get("$.details.errors"), "array<struct<message:string,details:string,error:string,name:string,path:array<string>,component:string,componentName:string,componentId:string>>")
    place = lambda e: none(F.array_join(e["path"], " › "))
    named = lambda e: F.coalesce(none(F.regexp_extract(place(e), "manifest:components/([^/›]+)", 1)), none(F.regexp_extract(place(e), r"(?:^|[›/])\s*components\s*[›/]\s*([^›/]+?)\s*(?:[›/]|$)", 1)))
    component = lambda e: F.coalesce(e["component"], e["componentName"], e["componentId"], named(e))
    listed = F.transform(errors, lambda e: F.struct(component(e).alias("component"), place(e).alias("path"), F.coalesce(e["message"], e["details"], e["error"], e["name"], F.lit("Validation failed")).alias("message")))
    pointer = none(F.trim(F.regexp_extract(about, POINTER, 1)))
    where = none(F.regexp_extract(about, r"(?:^|\.\s)([A-Za-z0-9_$-]+(?:\s*›\s*[A-Za-z0-9_$-]+){2,})(?!.*›.*›)", 1))
    pointed = F.when(pointer.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("component"), where.alias("path"), pointer.alias("message"))))
    out = rows.withColumns(
        {
            "code": F.when(binding, BINDING_CODE).when(is_json, F.col("__code")).when(is_literal, literal_code),
            "message": F.when(binding, F.coalesce(heading, F.lit(BINDING_MESSAGE))).when(is_json, F.coalesce("__message", none(F.col("__t")), "__prefix")).when(is_literal, F.coalesce(head, "__t")).otherwise(F.coalesce(none(F.col("__t")), none(F.col("__prefix")), "line")),
            "cycle": F.when(~binding & is_json, F.col("__cycle")).when(~binding & is_literal & (F.size(names) > 0), names),
            "diagnostics": F.when(binding, pointed).when(is_json, listed),
        }
    )
    return out.drop("__prefix", "__t", "__j", "__code", "__message", "__cycle")


# Characters of a path, keys that no path may hold, and how an item of a list is named.
SAFE_PATH = r"^[a-zA-Z0-9_.$\[\]=]+$"
FORBIDDEN_KEYS = ("__proto__", "constructor", "prototype")
ITEM = r"^(.+)\[name=(.+)\]$"


def set_at(proposal: dict, path: str, value) -> str | None:
    """Set the value at a dotted path (field[name=x] is the first item of that name) of a parsed proposal, or say why it can't be."""
    if not re.search(SAFE_PATH, path):
        return f"path contains invalid characters: '{path}'"
    *way, last = path.split(".")
    if any(p in FORBIDDEN_KEYS for p in (*way, last)):
        return f"path contains forbidden key: '{path}'"
    at = proposal
    for part in way:
        if named := re.search(ITEM, part):
            field, name = named.groups()
            items = at.get(field) if isinstance(at, dict) else None
            if isinstance(items, list):
                at = next((x for x in items if isinstance(x, dict) and x.get("name") == name), None)
                if at is None:
                    return f"array item [name={name}] not found in '{field}'"
            continue  # a field that is no list is passed over
        inner = _entry(at, part)
        if not isinstance(inner, (dict, list)):
            return f"path '{path}' — '{part}' is not an object"
        at = inner
    if isinstance(at, dict):
        at[last] = value
    elif last.isdigit() and int(last) < len(at):
        at[int(last)] = value
    return None  # other names of a list aren't part of its JSON


def _entry(at: dict | list, key: str):
    if isinstance(at, dict):
        return at.get(key)
    return at[int(key)] if key.isdigit() and int(key) < len(at) else None


def apply_patch(components: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (name, status, proposal as JSON text) after the first op (name, seq, status, sets) of their name, and what went wrong: name, path and warning.

    sets is an array of (path, value as JSON text), applied in order; a null status stays. Ops that name no component
    are warned of too. A proposal that isn't an object takes no sets.
    """
    first = ops.groupBy("name").agg(F.min_by(F.struct("status", "sets"), "seq").alias("__op"))
    named = components.join(first, "name", "left").withColumn("status", F.coalesce("__op.status", "status"))

    @F.pandas_udf("proposal string, warnings array<struct<path: string, warning: string>>")
    def patched(proposals: pd.Series, sets: pd.Series) -> pd.DataFrame:
        out = []
        for text, listed in zip(proposals, sets, strict=True):
            warnings = []
            if listed is not None and len(listed):
                proposal = json.loads(text) if text else None
                for s in listed:
                    said = set_at(proposal, s["path"], json.loads(s["value"])) if isinstance(proposal, dict) else "proposal is not an object"
                    if said:
                        warnings.append({"path": s["path"], "warning": said})
                text = json.dumps(proposal, ensure_ascii=False, separators=(",", ":"))
            out.append((text, warnings))
        return pd.DataFrame(out, columns=["proposal", "warnings"])

    done = named.withColumn("__p", patched("proposal", "__op.sets"))
    warnings = done.select("name", F.explode("__p.warnings").alias("w")).select("name", "w.path", "w.warning")
    unknown = ops.select("name").distinct().join(components.select("name").distinct(), "name", "left_anti")
    warnings = warnings.unionByName(unknown.select("name", F.lit(None).cast("string").alias("path"), F.lit("no component of this name").alias("warning")))
    return done.withColumn("proposal", F.col("__p.proposal")).drop("__op", "__p"), warnings


def fuzzy_score_of(text: Column, query: Column) -> Column:
    """Score of query as a subsequence of text, null if it isn't one: 10 a letter, 5 more in the same case, 15 at the start, 5 next to the last, less a tenth of the length."""
    letters, lower, size = F.split(query, ""), F.split(F.lower(query), ""), F.length(query)
    start = F.struct(F.lit(0).alias("q"), F.lit(-2).alias("last"), F.lit(0).alias("score"))

    def step(s: Column, i: Column) -> Column:
        c = text.substr(i + 1, F.lit(1))
        hit = (s["q"] < size) & (F.lower(c) == F.get(lower, s["q"]))
        gain = 10 + F.when(c == F.get(letters, s["q"]), 5).otherwise(0) + F.when((i == 0) & (s["q"] == 0), 15).otherwise(0) + F.when(i == s["last"] + 1, 5).otherwise(0)
        return F.struct(F.when(hit, s["q"] + 1).otherwise(s["q"]).alias("q"), F.when(hit, i).otherwise(s["last"]).alias("last"), F.when(hit, s["score"] + gain).otherwise(s["score"]).alias("score"))

    end = F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), start, step)
    return F.when(end["q"] == size, end["score"] - F.length(text) * 0.1)


def fuzzy_score(text: Column, query: str) -> Column:
    """fuzzy_score_of for one query."""
    return fuzzy_score_of(text, F.lit(query))


def fuzzy_search(names: DataFrame, query: str, k: int) -> DataFrame:
    """The k best names (name, arrival) for a query; an empty one returns all."""
    if not query:
        return names.withColumn("score", F.lit(0.0))
    return names.withColumn("score", F.round(fuzzy_score(F.col("name"), query), 6)).filter("score IS NOT NULL").orderBy(F.desc("score"), "arrival").limit(k)


def _letters(text: Column) -> Column:
    """Which of a-z, 0-9 and other characters a text holds, as bits."""
    return F.aggregate(F.array_distinct(F.split(F.lower(text), "")), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(63)).cast("int")))))


def fuzzy_search_all(names: DataFrame, queries: DataFrame, k: int, max_queries: int = 10_000) -> DataFrame:
    """query, arrival, name, score and rank: the k best names (name, arrival) for each distinct query; a query of no letters takes the first names.

    A name is scored once, for its k first arrivals, and only for queries all of whose letters it holds, which is told by
    63 bits of each. Queries are sent to the names in parts of max_queries; the best of each part of the names go on to
    the ranking.
    """
    asked = cut(queries.select("query").distinct().withColumn("bits", _letters(F.col("query"))).withColumn("__part", F.pmod(F.xxhash64("query"), F.lit(1 << 16))))
    parts = max(1, -(-rows(asked) // max_queries))
    place = F.row_number().over(Window.partitionBy("name").orderBy("arrival"))
    firsts = names.select("arrival", "name").filter("name IS NOT NULL").withColumn("__place", place).filter(F.col("__place") <= k)
    kept = firsts.groupBy("name").agg(F.array_sort(F.collect_list("arrival")).alias("__arrivals"))
    signed = cut(kept.withColumn("__bits", _letters(F.col("name"))))
    best = None
    for i in range(parts):
        part = F.broadcast(asked.filter(F.pmod("__part", F.lit(parts)) == i).select("query", "bits"))  # about max_queries rows
        pairs = signed.join(part, (F.col("bits").bitwiseAND(F.bitwise_not("__bits")) == 0) & (F.length("query") <= F.length("name")))
        scored = pairs.withColumn("score", F.when(F.col("query") == "", F.lit(0.0)).otherwise(F.round(fuzzy_score_of(F.col("name"), F.col("query")), 6))).filter("score IS NOT NULL")
        scored = scored.select("query", "name", "score", F.explode("__arrivals").alias("arrival"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "arrival")
        top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "arrival", "name", "score", "rank")
        best = top if best is None else best.unionByName(top)
    return best


def collapse_warnings(warnings: DataFrame, least: int = 3) -> DataFrame:
    """Warnings (session_id, text, seq) of unresolved types: `least` or more of a session become one summary, placed first."""
    unresolved = F.col("text").contains("unresolved type")
    n = F.count_if(unresolved).over(Window.partitionBy("session_id"))
    rows = warnings.withColumn("__u", unresolved).withColumn("__n", n)
    many = F.col("__u") & (F.col("__n") >= least)
    summary = rows.filter(many).groupBy("session_id").agg(F.first("__n").alias("n")).select("session_id", F.concat(F.col("n").cast("string"), F.lit(" unresolved types")).alias("text"), F.lit(-1).cast("long").alias("seq"))
    return rows.filter(~many).select("session_id", "text", F.col("seq").cast("long").alias("seq")).unionByName(summary)


def partition_warnings(warnings: DataFrame, names: DataFrame) -> DataFrame:
    """Add component, the known name that a warning starts with, null for global ones."""
    prefix = F.nullif(F.regexp_extract("text", "^([^:]+):", 1), F.lit(""))
    known = names.select(F.col("name").alias("component")).distinct()
    return warnings.withColumn("component", prefix).join(known.withColumn("__k", F.lit(True)), "component", "left").withColumn("component", F.when(F.col("__k"), F.col("component"))).drop("__k")
