"""Writes to the five tables of a catalog: calls, definitions, earlier classifications and cached work. Each gives the new tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENT, PROP, SLOT = ["session_id", "component_id"], ["session_id", "component_id", "prop_name"], ["session_id", "component_id", "slot_name"]


class Catalog(NamedTuple):
    """The tables of a catalog; rows of props and slots are named within their component.

    components: session_id, component_id, name, source, framework, status, description, description_rationale,
    props_rationale, slots_rationale. props: session_id, component_id, name, position, type, required, cdf_type,
    category, token_kind, description, default_value, rationale. allowed_values: session_id, component_id, prop_name,
    position, value. slots: session_id, component_id, name, position, is_default, required, description, rationale.
    children: session_id, component_id, slot_name, position, child.
    """

    components: DataFrame
    props: DataFrame
    allowed_values: DataFrame
    slots: DataFrame
    children: DataFrame


#: The columns of each table, as a catalog in folders has them.
SCHEMAS = {
    "components": "session_id int, component_id string, name string, source string, framework string, status string, description string, description_rationale string, props_rationale string, slots_rationale string",
    "props": "session_id int, component_id string, name string, position int, type string, required boolean, cdf_type string, category string, token_kind string, description string, default_value string, rationale string",
    "allowed_values": "session_id int, component_id string, prop_name string, position int, value string",
    "slots": "session_id int, component_id string, name string, position int, is_default boolean, required boolean, description string, rationale string",
    "children": "session_id int, component_id string, slot_name string, position int, child string",
}


def _last(value: Column, when: Column) -> Column:
    """The value of the last call that `when` lets write it, in a struct, so that a null written differs from none."""
    return F.max_by(F.struct(value.alias("v")), F.when(when, F.col("seq")))


def _written(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with each column taken from its write __column where there is one; the writes go."""
    out = rows.withColumns({c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v")).otherwise(F.col(c)) for c in columns})
    return out.drop(*(f"__{c}" for c in columns))


def _replaced(table: DataFrame, keys: list[str], new: DataFrame, value: str) -> DataFrame:
    """table with the rows of new's keys replaced by new's list of values, each value once."""
    rows = new.select(*keys, F.posexplode("list").alias("position", value)).groupBy(*keys, value).agg(F.min("position").cast(table.schema["position"].dataType).alias("position"))
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def apply_calls(catalog: Catalog, calls: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog after calls in order of seq, and warnings (session_id, component_id, tool, name) of calls for props and slots that aren't there.

    calls: session_id, component_id, seq, tool, name (of the prop or slot), cdf_type, cdf_category, token_kind,
    required, description, reason, default_value, list (allowed values or children) and about, a struct of a
    component's rationales (description, props, slots). Each column takes the last call that writes it:
    classify_prop writes type, category, token kind, required (false if null), description and rationale, values if
    there are any, and a default that isn't null; exclude_prop only the first three and the rationale; classify_slot
    writes required (true if null) and description, a rationale and children if they aren't null; classify_component a
    description and rationales that aren't null. Components with calls become generated.
    """
    tool, keys = F.col("tool"), [*COMPONENT, "name"]
    classify, exclude, slot = tool == "classify_prop", tool == "exclude_prop", tool == "classify_slot"

    own = calls.filter(tool.isin("classify_prop", "exclude_prop")).join(catalog.props.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
    both = F.lit(True)
    props = own.agg(
        _last(F.when(classify, F.col("cdf_type")).otherwise("excluded"), both).alias("__cdf_type"),
        _last(F.when(classify, F.col("cdf_category")), both).alias("__category"),
        _last(F.when(classify, F.col("token_kind")), both).alias("__token_kind"),
        _last(F.when(classify, F.col("reason")).otherwise(F.nullif("reason", F.lit(""))), both).alias("__rationale"),
        _last(F.coalesce("required", F.lit(False)), classify).alias("__required"),
        _last(F.col("description"), classify).alias("__description"),
        _last(F.col("default_value"), classify & F.col("default_value").isNotNull()).alias("__default_value"),
        F.max_by("list", F.when(classify & (F.size("list") > 0), F.col("seq"))).alias("list"),
    )
    written = _written(catalog.props.join(props.drop("list"), keys, "left"), "cdf_type", "category", "token_kind", "rationale", "required", "description", "default_value")
    values = _replaced(catalog.allowed_values, PROP, props.filter("list IS NOT NULL").withColumnRenamed("name", "prop_name"), "value")

    own = calls.filter(slot).join(catalog.slots.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
    slots = own.agg(
        _last(F.coalesce("required", F.lit(True)), slot).alias("__required"),
        _last(F.col("description"), slot).alias("__description"),
        _last(F.col("reason"), F.col("reason").isNotNull()).alias("__rationale"),
        F.max_by("list", F.when(F.col("list").isNotNull(), F.col("seq"))).alias("list"),
    )
    placed = _written(catalog.slots.join(slots.drop("list"), keys, "left"), "required", "description", "rationale")
    children = _replaced(catalog.children, SLOT, slots.filter("list IS NOT NULL").withColumnRenamed("name", "slot_name"), "child")

    about = lambda c: _last(F.col(c), (tool == "classify_component") & F.col(c).isNotNull())
    named = calls.groupBy(*COMPONENT).agg(
        about("description").alias("__description"),
        about("about.description").alias("__description_rationale"),
        about("about.props").alias("__props_rationale"),
        about("about.slots").alias("__slots_rationale"),
        F.struct(F.lit("generated").alias("v")).alias("__status"),
    )
    components = _written(catalog.components.join(named, COMPONENT, "left"), "description", "description_rationale", "props_rationale", "slots_rationale", "status")

    missing = lambda test, table: calls.filter(test).join(table.select(*keys).distinct(), keys, "left_anti").select(*COMPONENT, "tool", "name")
    warnings = missing(classify, catalog.props).unionByName(missing(slot, catalog.slots))
    return Catalog(*(new.select(*old.columns) for new, old in zip((components, written, values, placed, children), catalog, strict=True))), warnings


def restore(old: Catalog, new: Catalog) -> Catalog:
    """The catalog of a new extraction with what the old one had classified.

    Types, categories and token kinds of old props go to the new props of their name; those whose name is gone, to the
    new prop at their position if it has no type by then. Allowed values come back for restored props of their name.
    Descriptions of components come back in sessions that had classified anything.
    """
    keys, kinds = [*COMPONENT, "name"], ("cdf_type", "category", "token_kind")
    had = old.props.filter("cdf_type IS NOT NULL")
    kept = lambda rows, mark, by: rows.select(*by, F.struct(*kinds).alias(mark)).dropDuplicates(by)
    lost = had.join(new.props.select(*keys).distinct(), keys, "left_anti")
    rows = new.props.join(kept(had, "__name", keys), keys, "left").join(kept(lost, "__place", [*COMPONENT, "position"]), [*COMPONENT, "position"], "left")
    from_name = F.col("__name").isNotNull()
    from_place = ~from_name & F.col("cdf_type").isNull() & F.col("__place").isNotNull()
    restored = rows.filter(from_name | from_place).select(*COMPONENT, F.col("name").alias("prop_name"))
    values = {c: F.when(from_name, F.col(f"__name.{c}")).when(from_place, F.col(f"__place.{c}")).otherwise(F.col(c)) for c in kinds}
    props = rows.withColumns(values)

    back = old.allowed_values.join(restored.distinct(), PROP, "left_semi")
    allowed = new.allowed_values.join(back.select(*PROP).distinct(), PROP, "left_anti").unionByName(back.select(*new.allowed_values.columns))
    said = old.components.filter("description IS NOT NULL").join(had.select("session_id").distinct(), "session_id", "left_semi")
    said = said.select(*COMPONENT, F.col("description").alias("__said")).dropDuplicates(COMPONENT)
    components = new.components.join(said, COMPONENT, "left").withColumn("description", F.coalesce("__said", "description"))
    return new._replace(components=components.select(*new.components.columns), props=props.select(*new.props.columns), allowed_values=allowed)


def store_definitions(catalog: Catalog, entries: DataFrame) -> Catalog:
    """The catalog after definitions: session_id, key (a component's name), description, properties and slots.

    properties is an array of (name, type, category, token_kind, required, allowed), slots one of (name, required,
    description, allowed). A component of that name (the one with the least id) becomes generated with the new
    description; its props of the names given are classified, values replaced where some are given; all its slots are
    replaced, those of a name that was there keep is_default. A key without a component makes one, with the first 12
    digits of a hash for its id.
    """
    named = catalog.components.groupBy("session_id", F.col("name").alias("key")).agg(F.min("component_id").alias("component_id"))
    rows = entries.join(named, ["session_id", "key"], "left")
    rows = rows.withColumn("__new", F.col("component_id").isNull()).withColumn("component_id", F.coalesce("component_id", F.sha2(F.concat("key", F.lit(":generated")), 256).substr(1, 12)))
    write = lambda c: F.struct(F.col(c).alias("v"))
    blank = lambda table, given: [given[c].alias(c) if c in given else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns]

    updates = rows.filter(~F.col("__new")).select("session_id", F.col("key").alias("name"), write("description").alias("__description"), F.struct(F.lit("generated").alias("v")).alias("__status"))
    components = _written(catalog.components.join(updates.dropDuplicates(["session_id", "name"]), ["session_id", "name"], "left"), "description", "status")
    fresh = {"session_id": F.col("session_id"), "component_id": F.col("component_id"), "name": F.col("key"), "source": F.lit(""), "framework": F.lit("react"), "status": F.lit("generated"), "description": F.col("description")}
    components = components.select(*catalog.components.columns).unionByName(rows.filter("__new").select(*blank(catalog.components, fresh)))

    given = rows.select(*COMPONENT, "__new", F.posexplode("properties").alias("at", "p")).withColumn("name", F.col("p.name"))
    required = F.coalesce("p.required", F.lit(False))
    changes = given.filter(~F.col("__new")).select(*COMPONENT, "name", *(F.struct(c.alias("v")).alias(f"__{n}") for n, c in (("cdf_type", F.col("p.type")), ("category", F.col("p.category")), ("token_kind", F.col("p.token_kind")), ("required", required))))
    props = _written(catalog.props.join(changes.dropDuplicates([*COMPONENT, "name"]), [*COMPONENT, "name"], "left"), "cdf_type", "category", "token_kind", "required")
    fresh = {"session_id": F.col("session_id"), "component_id": F.col("component_id"), "name": F.col("name"), "position": F.col("at"), "type": F.lit(""), "required": required, "cdf_type": F.col("p.type"), "category": F.col("p.category"), "token_kind": F.col("p.token_kind")}
    props = props.select(*catalog.props.columns).unionByName(given.filter("__new").select(*blank(catalog.props, fresh)))
    listed = given.filter(F.size("p.allowed") > 0).select(*COMPONENT, F.col("name").alias("prop_name"), F.col("p.allowed").alias("list")).dropDuplicates(PROP)
    values = _replaced(catalog.allowed_values, PROP, listed, "value")

    touched = rows.select(*COMPONENT).distinct()
    before = catalog.slots.groupBy(*COMPONENT, "name").agg(F.bool_or("is_default").alias("__default"))
    given = rows.select(*COMPONENT, F.posexplode("slots").alias("at", "s")).withColumn("name", F.col("s.name")).join(before, [*COMPONENT, "name"], "left")
    fresh = {"session_id": F.col("session_id"), "component_id": F.col("component_id"), "name": F.col("name"), "position": F.col("at"), "is_default": F.coalesce("__default", F.lit(False)), "required": F.coalesce("s.required", F.lit(False)), "description": F.col("s.description")}
    slots = catalog.slots.join(touched, COMPONENT, "left_anti").unionByName(given.select(*blank(catalog.slots, fresh)))
    listed = given.filter(F.size("s.allowed") > 0).select(*COMPONENT, F.col("name").alias("slot_name"), F.col("s.allowed").alias("list"))
    children = _replaced(catalog.children.join(touched, COMPONENT, "left_anti"), SLOT, listed, "child")
    return Catalog(components, props, values, slots, children)


def store_tokens(groups: DataFrame, tokens: DataFrame, new_groups: DataFrame, new_tokens: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and tokens after those of the sessions are replaced by the new ones; a session without new ones has none left."""
    gone = sessions.select("session_id").distinct()
    put = lambda old, new: old.join(gone, "session_id", "left_anti").unionByName(new.join(gone, "session_id", "left_semi").select(*old.columns))
    return put(groups, new_groups), put(tokens, new_tokens)


def copy_components(catalog: Catalog, hits: DataFrame) -> Catalog:
    """The catalog after cached work is copied: hits has session_id, component_id and source_session, where the same component has been worked on.

    Description and status; of props of the same name type, category, token kind, required, description and default; of
    slots of the same name required and description; allowed values and children as a whole.
    """
    hits = hits.select(*COMPONENT, "source_session").dropDuplicates(COMPONENT)

    def copied(table: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
        source = table.select(F.col("session_id").alias("source_session"), *(c for c in by if c != "session_id"), *(F.struct(F.col(c).alias("v")).alias(f"__{c}") for c in columns))
        given = hits.join(source, ["source_session", "component_id"]).drop("source_session").dropDuplicates(by)
        return _written(table.join(given, by, "left"), *columns).select(*table.columns)

    def moved(table: DataFrame) -> DataFrame:
        source = table.withColumnRenamed("session_id", "source_session").join(hits, ["source_session", "component_id"]).select(*table.columns)
        return table.join(hits.select(*COMPONENT), COMPONENT, "left_anti").unionByName(source)

    return Catalog(
        copied(catalog.components, COMPONENT, ("description", "status")),
        copied(catalog.props, [*COMPONENT, "name"], ("cdf_type", "category", "token_kind", "required", "description", "default_value")),
        moved(catalog.allowed_values),
        copied(catalog.slots, [*COMPONENT, "name"], ("required", "description")),
        moved(catalog.children),
    )


def copy_tokens(groups: DataFrame, tokens: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and tokens after those of each session_id of hits are replaced by copies of its source_session's."""
    hits = hits.select("session_id", "source_session").dropDuplicates(["session_id"])
    copies = lambda t: t.withColumnRenamed("session_id", "source_session").join(hits, "source_session").select(*t.columns)
    return store_tokens(groups, tokens, copies(groups), copies(tokens), hits)


def run_staleness(runs: DataFrame, fingerprints: DataFrame, files: DataFrame) -> DataFrame:
    """Per run (run_id) whether what it was made from or what it saved is another now.

    runs: run_id, known (whether it has a fingerprint), tokens_path, tokens_mtime, tokens_hash, and path and hash of what
    it saved: components_path, components_hash, saved_tokens_path, saved_tokens_hash. fingerprints: run_id, path, mtime,
    component. files: path, mtime, hash as they are now. A source file is stale by its time; the tokens by time or hash,
    where the run has them; a saved file by its hash; missing ones count as stale or edited. Without a fingerprint
    nothing is known, and the run isn't stale.
    """
    now = files.select("path", F.col("mtime").alias("__mtime"), F.col("hash").alias("__hash"), F.lit(True).alias("__there")).dropDuplicates(["path"])
    rows = fingerprints.join(now, "path", "left")
    changed = F.col("__there") & (F.col("__mtime") != F.col("mtime"))
    listed = lambda c: F.array_sort(F.array_compact(F.collect_set(c)))
    sources = rows.groupBy("run_id").agg(listed(F.when(changed, F.coalesce("component", "path"))).alias("stale_components"), listed(F.when(F.col("__there").isNull(), F.col("path"))).alias("missing_files"))

    def state(out: DataFrame, path: str, mark: str) -> DataFrame:
        return out.join(now.select(F.col("path").alias(path), F.struct("__there", "__mtime", "__hash").alias(mark)), path, "left")

    out = state(state(state(runs, "tokens_path", "__t"), "components_path", "__c"), "saved_tokens_path", "__s").join(sources, "run_id", "left")
    differs = lambda mark, field, own: F.coalesce(F.col(own).isNotNull() & (F.col(f"{mark}.{field}") != F.col(own)), F.lit(False))
    stale_tokens = F.col("tokens_path").isNotNull() & (F.col("__t").isNull() | differs("__t", "__mtime", "tokens_mtime") | differs("__t", "__hash", "tokens_hash"))
    edited = lambda mark, own: F.col(own).isNotNull() & (F.col(mark).isNull() | differs(mark, "__hash", own))
    known = F.coalesce("known", F.lit(False))
    none = F.array().cast("array<string>")
    out = out.select(
        "run_id",
        F.when(known, F.coalesce("stale_components", none)).otherwise(none).alias("stale_components"),
        F.when(known, F.coalesce("missing_files", none)).otherwise(none).alias("missing_files"),
        *((known & x).alias(n) for n, x in (("stale_tokens", stale_tokens), ("components_edited", edited("__c", "components_hash")), ("tokens_edited", edited("__s", "saved_tokens_hash")))),
        known.alias("known"),
    )
    stale = (F.size("stale_components") > 0) | (F.size("missing_files") > 0) | F.col("stale_tokens") | F.col("components_edited") | F.col("tokens_edited")
    return out.withColumn("stale", stale)
