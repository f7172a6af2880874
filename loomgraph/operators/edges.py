"""Composition edges: collecting, checking and placing them in slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.dedupe import merge_edges


def map_to_edges(maps: DataFrame) -> DataFrame:
    """Distinct (parent, child) of rows with groups, a map from parent to children."""
    return maps.select(F.explode("groups").alias("parent", "children")).select("parent", F.explode("children").alias("child")).distinct()


def edges_to_map(edges: DataFrame) -> DataFrame:
    """Sorted distinct children of each parent."""
    return edges.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def collect_edges(**sources: DataFrame) -> DataFrame:
    """All edges of several sources, in the order given, numbered by `seq` within and between sources."""
    out = None
    for i, (name, edges) in enumerate(sources.items()):
        part = edges.select("parent", "child", "slot", F.lit(name.replace("_", "-")).alias("provenance"), F.lit(i).alias("source"), F.col("seq"))
        out = part if out is None else out.unionByName(part)
    return out


def sanitize_edges(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between two known, different names; and the others with a reason. A confidence outside 1 to 5 becomes null."""
    known = lambda c: names.select(F.col("name").alias(c)).distinct().withColumn(f"__{c}", F.lit(True))
    rows = edges.join(known("parent"), "parent", "left").join(known("child"), "child", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    reason = F.when(blank("parent") | blank("child"), "empty endpoint").when(F.col("parent") == F.col("child"), "self edge").when(F.col("__parent").isNull(), "unknown parent").when(F.col("__child").isNull(), "unknown child")
    rows = rows.withColumn("reason", reason).drop("__parent", "__child")
    if "confidence" in edges.columns:
        rows = rows.withColumn("confidence", F.when(F.col("confidence").between(1, 5), F.col("confidence")))
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def residue_parents(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components that are no edge's parent."""
    return components.join(edges.select(F.col("parent").alias("name")).distinct(), "name", "left_anti")


def apply_mapping(components: DataFrame, slots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each edge's child goes: (parent, slot, is_default, synthesized, children); and edges dropped, with a reason.

    A named slot takes it if the parent has it; user, typed-slot and adapter edges make a missing one. Without a name
    the first default slot takes it, or a new one named children. slots has parent, name, is_default and position.
    """
    names = components.select("name").distinct()
    good, bad = sanitize_edges_known(edges, names)
    own = slots.select("parent", F.col("name").alias("slot"), F.lit(True).alias("__has")).distinct()
    default = slots.filter("is_default").groupBy("parent").agg(F.min_by("name", "position").alias("__default"))
    rows = good.join(own, ["parent", "slot"], "left").join(default, "parent", "left")
    trusted = F.col("provenance").isin("user", "typed-slot") | F.col("provenance").startswith("adapter:")
    placed = F.when(F.coalesce("slot", F.lit("")) == "", F.coalesce("__default", F.lit("children"))).when(F.col("__has") | trusted, F.col("slot"))
    made = F.when(F.coalesce("slot", F.lit("")) == "", F.col("__default").isNull()).otherwise(F.col("__has").isNull())
    rows = rows.withColumn("__placed", placed).withColumn("__made", made)
    dropped = rows.filter("__placed IS NULL").select("parent", "child", F.lit("slot not found").alias("reason"))
    out = rows.filter("__placed IS NOT NULL").groupBy("parent", F.col("__placed").alias("slot")).agg(F.bool_and("__made").alias("synthesized"), F.array_sort(F.collect_set("child")).alias("children"))
    return out, bad.select("parent", "child", "reason").unionByName(dropped)


def sanitize_edges_known(edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are both known, and the others with a reason; self edges are fine here."""
    known = lambda c: names.select(F.col("name").alias(c)).withColumn(f"__{c}", F.lit(True))
    rows = edges.join(known("parent"), "parent", "left").join(known("child"), "child", "left")
    rows = rows.withColumn("reason", F.when(F.col("__parent").isNull(), "unknown parent").when(F.col("__child").isNull(), "unknown child")).drop("__parent", "__child")
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL")


def resolve_mapping(components: DataFrame, slots: DataFrame, edges: DataFrame, agent_edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Edges of all sources, agents asked only for parents without any, merged by rank and placed in slots."""
    if agent_edges is not None:
        asked = residue_parents(components, edges).select(F.col("name").alias("parent"))
        edges = edges.unionByName(agent_edges.join(asked, "parent", "left_semi"))
    merged, conflicts = merge_edges(edges)
    placed, dropped = apply_mapping(components, slots, merged)
    return {"slots": placed, "edges": merged, "conflicts": conflicts, "warnings": dropped}


def uncovered_directories(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Directories in which no file is selected."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("directory")
    return files.select(folder).distinct().join(selected.select(folder).distinct(), "directory", "left_anti")


def expand_by_directories(files: DataFrame, selected: DataFrame, chosen: DataFrame) -> DataFrame:
    """The selected files and all of the directories chosen, which must be uncovered ones."""
    offered = uncovered_directories(files, selected).join(chosen.select("directory").distinct(), "directory", "left_semi")
    more = files.withColumn("directory", F.regexp_replace("path", "/[^/]*$", "")).join(offered, "directory", "left_semi").select("path")
    return selected.select("path").union(more).distinct()
