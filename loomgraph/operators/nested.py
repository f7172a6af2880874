"""Between nested components and the five flat tables: components, props, values, slots and children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.naming import component_id

KEY = ["session_id", "component_id"]


def _listed(df: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of each key as an array of structs in order of position."""
    rows = F.array_sort(F.collect_list(F.struct("position", *fields)))
    drop = F.transform(rows, lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return df.groupBy(*keys).agg(drop.alias(name))


def load_components(components: DataFrame, props: DataFrame, slots: DataFrame, allowed_names: DataFrame | None = None) -> DataFrame:
    """Components with their props and slots as ordered arrays; only of names allowed, if given."""
    if allowed_names is not None:
        components = components.join(allowed_names.select("session_id", "name").distinct(), ["session_id", "name"], "left_semi")
    p = _listed(props, KEY, [c for c in props.columns if c not in (*KEY, "position")], "props")
    s = _listed(slots, KEY, [c for c in slots.columns if c not in (*KEY, "position")], "slots")
    out = components.join(p, KEY, "left").join(s, KEY, "left")
    none = lambda n, t: F.coalesce(n, F.array().cast(t.schema[n].dataType))
    return out.withColumn("props", none("props", p)).withColumn("slots", none("slots", s))


def normalize_components(nested: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of nested components (session_id, name, source, framework, props, slots with children): ids from name and source, positions from array order."""
    keyed = nested.withColumn("component_id", component_id("name", "source"))
    props = keyed.select(*KEY, F.posexplode("props").alias("position", "p")).select(*KEY, "position", "p.*")
    slots = keyed.select(*KEY, F.posexplode("slots").alias("position", "s"))
    tables = {"components": keyed.drop("props", "slots"), "props": props, "slots": slots.select(*KEY, "position", *(F.col(f"s.{f}") for f in slots.schema["s"].dataType.names if f != "children"))}
    if "children" in slots.schema["s"].dataType.names:
        tables["children"] = slots.select(*KEY, F.col("s.name").alias("slot_name"), F.posexplode("s.children").alias("position", "child"))
    if "values" in [f.name for f in keyed.schema["props"].dataType.elementType.fields]:
        tables["values"] = props.select(*KEY, "name", F.posexplode("values").alias("idx", "value"))
        tables["props"] = props.drop("values")
    return tables


def load_definitions(components: DataFrame, props: DataFrame, values: DataFrame, slots: DataFrame, children: DataFrame) -> DataFrame:
    """session_id, key, description, properties and slots (maps) of generated components.

    A prop counts with a type other than excluded and a name that isn't blank; required shows only when true, a
    boolean's default is read from its text. Components without props stay.
    """
    listed = values.groupBy(*KEY, "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("values"))
    used = props.filter(F.col("cdf_type").isNotNull() & (F.col("cdf_type") != "excluded") & (F.trim("name") != "")).join(listed, [*KEY, "position"], "left")
    default = F.when(F.col("cdf_type") == "boolean", (F.col("default_value") == "true").cast("string")).otherwise(F.col("default_value"))
    entry = F.struct("position", "name", F.struct(F.col("cdf_type").alias("type"), "category", F.when(F.col("required"), F.lit(True)).alias("required"), default.alias("default"), "values", "description").alias("entry"))
    as_map = lambda c: F.map_from_entries(F.transform(F.array_sort(F.collect_list(c)), lambda x: F.struct(x["name"], x["entry"])))
    p = used.dropDuplicates([*KEY, "name"]).groupBy(*KEY).agg(as_map(entry).alias("properties"))
    kids = children.groupBy(*KEY, "slot_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "child"))), lambda x: x["child"]).alias("allowed"))
    s = slots.filter(F.trim("name") != "").join(kids.withColumnRenamed("slot_name", "name"), [*KEY, "name"], "left").dropDuplicates([*KEY, "name"])
    s = s.groupBy(*KEY).agg(as_map(F.struct("position", "name", F.struct("required", "allowed").alias("entry"))).alias("slots"))
    done = components.filter("status = 'generated'").join(p, KEY, "left").join(s, KEY, "left")
    return done.select("session_id", "component_id", F.col("name").alias("key"), "description", "properties", "slots")


def write_component_documents(definitions: DataFrame, schema_url: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document for each session, and the keys without a description."""
    entry = F.struct(F.lit("component").alias("$type"), F.col("description").alias("$description"), F.col("properties").alias("$properties"), F.col("slots").alias("$slots"))
    body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "entry")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))))
    documents = definitions.select("session_id", "key", entry.alias("entry")).dropDuplicates(["session_id", "key"]).groupBy("session_id").agg(body.alias("body"))
    documents = documents.select("session_id", F.concat(F.lit(f'{{"$schema":"{schema_url}",'), F.col("body").substr(F.lit(2), F.length("body"))).alias("document"))
    return documents, definitions.filter(F.coalesce("description", F.lit("")) == "").select("session_id", "key")


def rationale_view(components: DataFrame, props: DataFrame, slots: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """What is said of each component, or of those of names (session_id, name): descriptions and rationales of its own, of its props and of its slots.

    props is an array of (name, category, description, rationale) in order, the category being what was decided or else
    what was found; slots one of (name, description, rationale). Empty arrays stand for none.
    """
    picked = components if names is None else components.join(names.select("session_id", "name").distinct(), ["session_id", "name"], "left_semi")
    shown = props.withColumn("category", F.coalesce("cdf_category", "category")) if "cdf_category" in props.columns else props
    p = _listed(shown, KEY, ["name", "category", "description", "rationale"], "props")
    s = _listed(slots, KEY, ["name", "description", "rationale"], "slots")
    out = picked.select(*KEY, "name", "description", "description_rationale", "props_rationale", "slots_rationale").join(p, KEY, "left").join(s, KEY, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("props", "slots")})


def accepted_components(components: DataFrame, review: DataFrame) -> DataFrame:
    """Components whose name the session's review accepted; sessions without a review keep all."""
    reviewed = review.select("session_id").distinct().withColumn("__reviewed", F.lit(True))
    ok = review.filter("status = 'accepted'").select("session_id", "name").distinct().withColumn("__ok", F.lit(True))
    out = components.join(reviewed, "session_id", "left").join(ok, ["session_id", "name"], "left")
    return out.filter(F.col("__reviewed").isNull() | F.col("__ok")).drop("__reviewed", "__ok")


def scope_rows(components: DataFrame) -> DataFrame:
    """Components to scope, their decision and its reason, which falls back to the one that holds them for review."""
    held = F.get(F.filter("review_reasons", lambda x: x.startswith("non-authorable:")), F.lit(0))
    rows = components.filter(F.col("status").isin("extracted", "accepted", "rejected"))
    decision = F.when(F.col("status") == "accepted", "accepted").when(F.col("status") == "rejected", "rejected").otherwise("undecided")
    return rows.select(*KEY, "name", decision.alias("decision"), F.coalesce(F.col("reason"), F.regexp_replace(held, "^non-authorable:", "")).alias("reason"))
