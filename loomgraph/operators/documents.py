"""Tokens, manifests, runs and review logs: reading, storing and checking them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions.lineage import cut
from loomgraph.operators.edges import sanitize_edges

#: Fields that later versions of run records added.
RUN_FIELDS = {
    "run_id": "string",
    "project": "string",
    "created_at": "timestamp",
    "version": "int",
    "fingerprint": "map<string,double>",
    "pushed_to": "string",
    "artifacts": "map<string,string>",
}


#: Times of review events keep their microseconds.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def load_tokens(groups: DataFrame, tokens: DataFrame) -> DataFrame:
    """Groups with the sorted paths of their direct tokens, empty where there are none."""
    parent = F.regexp_replace("path", r"\.[^.]*$", "").alias("group_path")
    members = tokens.select("session_id", "path", parent).filter("path <> group_path").groupBy("session_id", "group_path").agg(F.array_sort(F.collect_list("path")).alias("members"))
    rows = groups.join(members, ["session_id", "group_path"], "left")
    return rows.withColumn("members", F.coalesce("members", F.array().cast("array<string>")))


def replace_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after the sessions of `new` have their rows replaced."""
    return old.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new, allowMissingColumns=True)


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def write_token_tree(tokens: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """session_id and document: the tokens (session_id, path, type, value) as nested JSON, a group's description first, then what is in it by name.

    groups has session_id, path and description. Levels are joined from the deepest upward, each group by itself. A path
    that is a token and a group as well is an error.
    """
    at = F.split("path", r"\.")
    leaf = F.to_json(F.create_map(F.lit("$type"), F.col("type"), F.lit("$value"), F.col("value")))
    nodes = tokens.select("session_id", at.alias("at"), leaf.alias("json"), F.lit(True).alias("leaf"))
    said = None if groups is None else groups.filter("description IS NOT NULL").select("session_id", at.alias("at"), "description").dropDuplicates(["session_id", "at"])
    for level in range(tokens.agg(F.max(F.size(at))).first()[0] or 0, 0, -1):
        here = nodes.filter(F.size("at") == level)
        inside = here.groupBy("session_id", F.slice("at", 1, level - 1).alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("at", -1).alias("key"), "json"))).alias("entries"))
        clash = F.exists(F.sequence(F.lit(1), F.size("entries")), lambda i: F.get("entries", i)["key"] == F.get("entries", i - 1)["key"])
        body = F.array_join(F.transform("entries", lambda x: F.concat(_quoted(x["key"]), F.lit(":"), x["json"])), ",")
        body = F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.lit("a path is a token and a group"))).otherwise(body)
        if said is not None:
            inside = inside.join(said, ["session_id", "at"], "left")
            body = F.concat(F.coalesce(F.concat(F.lit('"$description":'), _quoted(F.col("description")), F.lit(",")), F.lit("")), body)
        nodes = nodes.filter(F.size("at") < level).unionByName(inside.select("session_id", "at", F.concat(F.lit("{"), body, F.lit("}")).alias("json"), F.lit(False).alias("leaf")))
    return nodes.select("session_id", F.col("json").alias("document"))


def append_review_events(events: DataFrame, path: str) -> None:
    events.select("type", F.col("timestamp").cast("timestamp").alias("timestamp"), "payload").write.mode("append").option("timestampFormat", _TIME).json(path)


def read_review_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("type string, timestamp timestamp, payload map<string,string>").option("timestampFormat", _TIME).json(path)


def upgrade_run_records(*versions: DataFrame) -> DataFrame:
    """Run records of versions 1 to 3 in one shape, what a version lacks null; another version is an error when read."""
    out = None
    for rows in versions:
        missing = [F.lit(None).cast(kind).alias(name) for name, kind in RUN_FIELDS.items() if name not in rows.columns]
        part = rows.select("*", *missing).select(*RUN_FIELDS)
        out = part if out is None else out.unionByName(part)
    known = F.col("version").isin(1, 2, 3)
    return out.withColumn("version", F.when(known, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unknown run record version "), F.col("version").cast("string"))).cast("int")))


def build_manifest(entries: DataFrame, tokens: DataFrame, delete_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """kind, id and body of a manifest, slots without their required flag; and its sections (kind, state).

    A section is listed where it has entries, absent, which changes nothing, where it has none. With delete_all nothing
    is listed and both sections are empty, which deletes everything.
    """
    body = F.transform_values("slots", lambda _, s: F.struct(s["allowed"].alias("allowed")))
    components = entries.select(F.lit("component").alias("kind"), F.col("key").alias("id"), F.to_json(body).alias("body"))
    rows = components.unionByName(tokens.select(F.lit("token").alias("kind"), F.col("path").alias("id"), F.col("value").alias("body"))).filter(F.lit(not delete_all))
    kinds = entries.sparkSession.range(2).select(F.when(F.col("id") == 0, "component").otherwise("token").alias("kind"))
    there = rows.select("kind").distinct().withColumn("__there", F.lit(True))
    state = F.lit("empty") if delete_all else F.when(F.col("__there"), "listed").otherwise("absent")
    return rows, kinds.join(there, "kind", "left").select("kind", state.alias("state"))


def strip_children(slots: DataFrame) -> DataFrame:
    """Slots as they are, with no limits on their children."""
    return slots.withColumn("children", F.array().cast(slots.schema["children"].dataType))


def concat_token_sources(files: DataFrame) -> DataFrame:
    """project and text: the texts of a project's files in order of path, empty ones left out, a blank line between."""
    kept = files.filter(F.trim("content") != "")
    return kept.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: x["content"]), "\n\n").alias("text"))


def merge_ai_decisions(components: DataFrame, streamed: DataFrame) -> DataFrame:
    """Stored decisions, and streamed ones where there is none."""
    given = streamed.groupBy("name").agg(F.min_by("decision", "seq").alias("__d"))
    return components.join(given, "name", "left").withColumn("decision", F.coalesce("decision", "__d")).drop("__d")


def attach_server_errors(components: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (with issues, an array of text) with the errors of their name added, and error names that are no component's."""
    listed = errors.groupBy("name").agg(F.array_sort(F.collect_list("message")).alias("__e"))
    rows = components.join(listed, "name", "left")
    patched = rows.withColumn("issues", F.concat("issues", F.coalesce("__e", F.array().cast("array<string>")))).drop("__e")
    return patched, errors.select("name").distinct().join(components.select("name").distinct(), "name", "left_anti")


def pair_validation(filtered: DataFrame, validated: DataFrame) -> DataFrame:
    """Each component with the issues of its own row: paired by id, for names may repeat."""
    return filtered.join(validated.select("session_id", "component_id", "issues"), ["session_id", "component_id"], "left")


def generation_totals(results: DataFrame) -> DataFrame:
    """One row: failed, cached and generated results, and sums of what they classified, excluded and renamed."""
    return results.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("failed", "cached", "generated")), *(F.sum(c).alias(c) for c in ("classified", "excluded", "renamed")))


def extract_with(files: DataFrame, extractor: Callable[[str, str], list[dict]], schema: str) -> DataFrame:
    """Rows that a plug-in extractor makes of each file's path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in extractor(p, c)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return files.select("path", "content").mapInArrow(run, schema)


def extract_with_warnings(files: DataFrame, extractor: Callable[[str, str], tuple[list[dict], list[str]]], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a plug-in extractor makes of each file's path and content, and its warnings (path, warning).

    The extractor is called once for a file. One that fails gives a warning with its error, and the other files go on.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(f"path string, row struct<{schema}>, warning string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows, warnings = extractor(path, content)
                except Exception as error:
                    rows, warnings = [], [f"{type(error).__name__}: {error}"]
                out += [{"path": path, "row": r, "warning": None} for r in rows] + [{"path": path, "row": None, "warning": w} for w in warnings]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    both = cut(files.select("path", "content").mapInArrow(run, f"path string, row struct<{schema}>, warning string"))
    return both.filter("row IS NOT NULL").select("row.*"), both.filter("warning IS NOT NULL").select("path", "warning")


def decide_with(chunks: DataFrame, decide: Callable[[list[str]], list[str]]) -> DataFrame:
    """name and decision from a plug-in that sees one chunk of names at a time; chunks has session_id, chunk, place and name.

    The rows of a chunk meet in one task, which goes through many chunks.
    """
    keys = ["session_id", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in (*keys, "name")), strict=True)

        for _, chunk in itertools.groupby(rows(), key=lambda r: r[:2]):
            names = [r[2] for r in chunk]
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(decide(names), pa.string())], names=["name", "decision"])

    dealt = chunks.select(*keys, "place", "name").repartition(*keys).sortWithinPartitions(*keys, "place")
    return dealt.mapInArrow(run, "name string, decision string")


def edges_with(files: DataFrame, names: DataFrame, parser: Callable[[str, str], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """Edges (parent, child, slot, confidence) that a plug-in parser finds in each file's path and content, and those refused, with a reason: no plug-in's word is taken unchecked."""
    return sanitize_edges(extract_with(files, parser, "parent string, child string, slot string, confidence int"), names)
