"""Keyed tables that later rows replace, and work saved by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.naming import map_server_type


def last_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v"))
    return last.select(*keys, "__v.*").select(*rows.columns)


def upsert_tokens(tokens: DataFrame, calls: DataFrame) -> DataFrame:
    """tokens (session_id, path, type, value) with calls (and seq) put in or over them; the last call of a path wins."""
    both = tokens.withColumn("seq", F.lit(-1).cast("long")).unionByName(calls.select("session_id", "path", "type", "value", F.col("seq").cast("long").alias("seq")))
    return last_by_key(both, ["session_id", "path"], ["seq", "type", "value"]).drop("seq")


def upsert_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows over the cache by content_hash and version: source and updated_at are the new ones, created_at stays, human_edited sticks."""
    keys = ["content_hash", "version"]
    old, new = cache.alias("o"), last_by_key(rows, keys, ["updated_at", "entity"]).alias("n")
    at = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    edited = F.coalesce("o.human_edited", F.lit(False)) | F.coalesce("n.human_edited", F.lit(False))
    created = F.coalesce("o.created_at", "n.updated_at").alias("created_at")
    return old.join(new, keys, "full_outer").select(*keys, at("entity"), at("source"), at("updated_at"), edited.alias("human_edited"), created)


def upsert_keyed(cache: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The cache after rows (the last by updated_at of each key): they replace what is there, whose created_at stays."""
    values = [c for c in cache.columns if c not in (*keys, "created_at")]
    new = last_by_key(rows.select(*keys, *values), keys, ["updated_at", *[v for v in values if v != "updated_at"]])
    both = cache.alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full_outer")
    pick = lambda c: F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*keys, *map(pick, values), F.coalesce("o.created_at", "n.updated_at").alias("created_at")).select(*cache.columns)


def upsert_extract_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """What files gave: file_path and components_json by file_hash and cli_version."""
    return upsert_keyed(cache, rows, ["file_hash", "cli_version"])


def upsert_select_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions and reasons by component_hash, prompt_hash and cli_version."""
    return upsert_keyed(cache, rows, ["component_hash", "prompt_hash", "cli_version"])


def upsert_composition_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Agents' outputs by input_hash and cli_version."""
    return upsert_keyed(cache, rows, ["input_hash", "cli_version"])


def incremental_split(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs whose content_hash and version are in the cache, and those that need work."""
    known = cache.select("content_hash", "version").distinct()
    return inputs.join(known, ["content_hash", "version"], "left_semi"), inputs.join(known, ["content_hash", "version"], "left_anti")


def reuse_or_pin(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """What to do with each input (entity, content_hash, version): reuse an exact hit, else pin the entity's newest entry edited by hand, else recompute."""
    exact = cache.select("content_hash", "version").distinct().withColumn("__hit", F.lit(True))
    edited = cache.filter("human_edited").groupBy("entity").agg(F.max_by("content_hash", F.struct("updated_at", "content_hash")).alias("pinned_hash"))
    rows = inputs.join(exact, ["content_hash", "version"], "left").join(edited, "entity", "left")
    action = F.when(F.col("__hit"), "reuse").when(F.col("pinned_hash").isNotNull(), "pin").otherwise("recompute")
    used = F.when(action == "reuse", F.col("content_hash")).when(action == "pin", F.col("pinned_hash"))
    return rows.select("entity", "content_hash", "version", action.alias("action"), used.alias("used_hash"))


def cache_latest_by_entity(cache: DataFrame) -> DataFrame:
    return last_by_key(cache, ["entity"], ["updated_at", "content_hash"])


def mark_human_edited(cache: DataFrame, entities: DataFrame) -> DataFrame:
    """human_edited for all entries of the entities."""
    named = entities.select("entity").distinct().withColumn("__e", F.lit(True))
    return cache.join(named, "entity", "left").withColumn("human_edited", F.col("human_edited") | F.coalesce("__e", F.lit(False))).drop("__e")


def backfill_unclassified(props: DataFrame, components: DataFrame) -> DataFrame:
    """On generated components, a missing type becomes string and a missing category content."""
    done = components.filter("status = 'generated'").select("session_id", "component_id").distinct().withColumn("__g", F.lit(True))
    rows = props.join(done, ["session_id", "component_id"], "left")
    fill = F.col("__g") & F.col("cdf_type").isNull()
    category = F.when(fill, F.coalesce("category", F.lit("content"))).otherwise(F.col("category"))
    return rows.withColumn("category", category).withColumn("cdf_type", F.when(fill, "string").otherwise(F.col("cdf_type"))).drop("__g")


#: What a proposal keeps of a component, where the table has it.
PROPOSED = ("name", "source", "framework", "props", "slots", "extraction_confidence", "review_reasons", "needs_review")


def snapshot_decisions(components: DataFrame, accepted: DataFrame) -> DataFrame:
    """session_id, id, name, status (accepted or rejected), and what was proposed, as it was found and as it was edited, which is the same here; the source's path and text are left open."""
    named = accepted.select("session_id", "name").distinct().withColumn("__a", F.lit(True))
    rows = components.join(named, ["session_id", "name"], "left")
    proposal = F.struct(*(c for c in PROPOSED if c in components.columns))
    status = F.when(F.col("__a"), "accepted").otherwise("rejected")
    return rows.select("session_id", F.col("component_id").alias("id"), "name", F.lit("").alias("resolved_source_path"), F.lit(None).cast("string").alias("source_code"), proposal.alias("original_proposal"), proposal.alias("edited_proposal"), status.alias("status"))


def fingerprint_saved(documents: DataFrame, text: str = "text") -> DataFrame:
    """SHA-256 of each saved document; null stays null."""
    return documents.withColumn("fingerprint", F.sha2(text, 256))


def composition_hash(files: DataFrame, agent: str, kind: str) -> DataFrame:
    """A digest of each project's files that doesn't depend on their order."""
    each = F.concat("path", F.lit(" "), F.sha2("content", 256))
    listed = F.array_join(F.array_sort(F.collect_list(each)), "\n")
    return files.groupBy("project").agg(F.sha2(F.concat_ws("|", F.lit(agent), F.lit(kind), listed), 256).alias("hash"))


def component_input_hash(components: DataFrame) -> DataFrame:
    """Hash of what a component was made from: framework, name, source, props' names and types, slots' names with their children sorted; not what agents wrote.

    slots may do without children.
    """
    fields = components.schema["slots"].dataType.elementType.names
    kids = (lambda s: F.concat(F.lit("["), F.array_join(F.array_sort(F.coalesce(s["children"], F.array().cast("array<string>"))), ","), F.lit("]"))) if "children" in fields else (lambda s: F.lit(""))
    props = F.array_join(F.transform("props", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    slots = F.array_join(F.transform("slots", lambda s: F.concat(s["name"], kids(s))), ",")
    return components.withColumn("input_hash", F.sha2(F.concat_ws("|", "framework", "name", "source", props, slots), 256))


def token_input_hash(tokens: DataFrame) -> DataFrame:
    """Hash of a token's path, type and value, each trimmed."""
    return tokens.withColumn("input_hash", F.sha2(F.concat_ws("|", *(F.trim(c) for c in ("path", "type", "value"))), 256))


def newest_run(runs: DataFrame) -> DataFrame:
    """Each project's newest run and how many older ones there are."""
    return runs.groupBy("project").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), (F.count("*") - 1).alias("older"))


def cap_runs(runs: DataFrame, cap: int = 200) -> DataFrame:
    """Add kept: the newest runs up to the cap."""
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created_at"), F.desc("run_id")))
    return runs.withColumn("kept", n <= cap)


def filter_runs(runs: DataFrame, project=None, before=None, after=None, pushed: bool | None = None, limit: int | None = None) -> DataFrame:
    """Runs of a project between two times, both exclusive, the newest first. The limit comes before the test of pushed."""
    if project is not None:
        runs = runs.filter(F.col("project") == project)
    if before is not None:
        runs = runs.filter(F.col("created_at") < F.lit(before))
    if after is not None:
        runs = runs.filter(F.col("created_at") > F.lit(after))
    if limit is not None:
        runs = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    return runs if pushed is None else runs.filter(F.col("pushed_to").isNotNull() == F.lit(pushed))


def seed_from_prior(props: DataFrame, target, sessions: DataFrame) -> DataFrame:
    """Missing classifications and descriptions of the target session from the latest prior session that shares a component; sessions has session_id and started_at."""
    own = props.filter(F.col("session_id") == target)
    prior = props.filter(F.col("session_id") != target).join(own.select("component_id").distinct(), "component_id", "left_semi").select("session_id").distinct()
    chosen = prior.join(sessions, "session_id").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))
    old = props.join(chosen, "session_id", "left_semi").dropDuplicates(["component_id", "name"]).select("component_id", "name", *(F.col(c).alias(f"__{c}") for c in ("cdf_type", "category", "description")))
    rows = own.join(old, ["component_id", "name"], "left")
    empty = F.col("cdf_type").isNull()
    rows = rows.withColumn("category", F.when(empty, F.coalesce("__category", "category")).otherwise(F.col("category")))
    return rows.withColumn("cdf_type", F.coalesce("cdf_type", "__cdf_type")).withColumn("description", F.coalesce("description", "__description")).select(*props.columns)


def seed_from_server(props: DataFrame, server: DataFrame) -> DataFrame:
    """Missing types, categories and defaults from the server's summary (component_id, name, server_type, server_category, server_default)."""
    rows = props.join(server.dropDuplicates(["component_id", "name"]), ["component_id", "name"], "left")
    category = F.when(F.col("server_category").isin("content", "design", "state"), F.col("server_category")).when(F.col("server_category").isNotNull(), "state")
    return (
        rows.withColumn("cdf_type", F.coalesce("cdf_type", F.when(F.col("server_type").isNotNull(), map_server_type("server_type"))))
        .withColumn("category", F.coalesce(F.col("category"), category))
        .withColumn("default_value", F.coalesce("default_value", "server_default"))
        .drop("server_type", "server_category", "server_default")
    )


def seed_defaults_from_server(props: DataFrame, server: DataFrame) -> DataFrame:
    """seed_from_server with defaults of any type: one that isn't text is written as JSON."""
    kind = server.schema["server_default"].dataType.simpleString()
    plain = kind == "string" or kind.startswith(("int", "bigint", "double", "float", "decimal", "boolean", "smallint", "tinyint"))
    text = F.col("server_default").cast("string") if plain else F.to_json("server_default")
    return seed_from_server(props, server.withColumn("server_default", text))
