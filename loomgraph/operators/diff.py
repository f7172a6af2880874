"""What changes between two versions of a catalog, and what of it breaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.naming import compared_type

# Reasons of breaking changes that are passed on.
PROPERTY_REASONS = ["removed", "added_required_no_default", "type_changed", "validation_narrowed"]
SLOT_REASONS = ["slot_removed", "slot_allowed_components_narrowed"]


def catalog_diff(current: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """key and bucket (new, removed, changed or unchanged) of each entry; other columns are compared, null equal to null."""
    values = [c for c in current.columns if c != key]
    c = current.select(F.col(key), F.struct(*values).alias("__c"))
    p = proposed.select(F.col(key), F.struct(*values).alias("__p"))
    bucket = F.when(F.col("__c").isNull(), "new").when(F.col("__p").isNull(), "removed").when(F.col("__c").eqNullSafe(F.col("__p")), "unchanged").otherwise("changed")
    return c.join(p, key, "full_outer").select(key, bucket.alias("bucket"))


def property_diff(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed or modified) and what differs; props without a change are left out.

    Types compare by kind, an empty one equals any; category, required and default compare as they are. Where both
    sides have values (an array), it counts that a value that was allowed isn't any more; no values allow any.
    """
    fields = ["type", "category", "required", "default_value"]
    if "values" in current.columns and "values" in proposed.columns:
        fields.append("values")
    side = lambda df, mark: df.select(*keys, *(F.col(f).alias(f"{f}_{mark}") for f in fields), F.lit(True).alias(f"__{mark}"))
    both = side(current, "old").join(side(proposed, "new"), keys, "full_outer")
    given = (F.coalesce("type_old", F.lit("")) != "") & (F.coalesce("type_new", F.lit("")) != "")
    differs = {
        "type": given & (compared_type("type_old") != compared_type("type_new")),
        "category": ~F.col("category_old").eqNullSafe(F.col("category_new")),
        "required": ~F.coalesce("required_old", F.lit(False)).eqNullSafe(F.coalesce("required_new", F.lit(False))),
        "default": ~F.col("default_value_old").eqNullSafe(F.col("default_value_new")),
    }
    if "values" in fields:
        old, new = (F.coalesce(f"values_{x}", F.array().cast("array<string>")) for x in ("old", "new"))
        differs["values"] = (F.size(new) > 0) & ((F.size(old) == 0) | (F.size(F.array_except(old, new)) > 0))
    what = F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in differs.items())))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(what) > 0, "modified")
    out = both.withColumn("change", change).withColumn("differs", F.when(change == "modified", F.array_join(what, ",")).otherwise(""))
    return out.filter("change IS NOT NULL").drop("__old", "__new")


def slot_diff(current: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (added, removed or children) and sorted children before and after; an empty list lets any child in."""
    side = lambda df, mark: df.select(*keys, F.array_sort(F.filter("children", lambda x: x != "")).alias(f"children_{mark}"), F.lit(True).alias(f"__{mark}"))
    both = side(current, "old").join(side(proposed, "new"), keys, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("children_old") != F.col("children_new"), "children")
    return both.withColumn("change", change).filter("change IS NOT NULL").drop("__old", "__new")


def breaking_reasons(diff: DataFrame) -> DataFrame:
    """Add reason to rows of property_diff: removed, added_required_no_default, type_changed or validation_narrowed, null where it doesn't break. These rules are our own."""
    reason = (
        F.when(F.col("change") == "removed", "removed")
        .when((F.col("change") == "added") & F.coalesce("required_new", F.lit(False)) & F.col("default_value_new").isNull(), "added_required_no_default")
        .when((F.col("change") == "modified") & F.array_contains(F.split("differs", ","), "type"), "type_changed")
        .when((F.col("change") == "modified") & F.array_contains(F.split("differs", ","), "values"), "validation_narrowed")
    )
    return diff.withColumn("reason", reason)


def breaking_slots(diff: DataFrame) -> DataFrame:
    """Add reason to rows of slot_diff: slot_removed, or slot_allowed_components_narrowed where a child let in before isn't any more."""
    old, new = F.col("children_old"), F.col("children_new")
    narrowed = (F.size(new) > 0) & ((F.size(old) == 0) | (F.size(F.array_except(old, new)) > 0))
    return diff.withColumn("reason", F.when(F.col("change") == "removed", "slot_removed").when((F.col("change") == "children") & narrowed, "slot_allowed_components_narrowed"))


def push_gate(components: DataFrame) -> DataFrame:
    """Components that stop a push: breaking, with an impact."""
    return components.filter(F.col("breaking") & (F.coalesce("impact", F.lit(0)) > 0))


def annotate_components(local: DataFrame, diff: DataFrame, breaking: DataFrame) -> DataFrame:
    """name and annotation: breaking, changed, removed or new; unchanged names are left out. A local name in no bucket is new."""
    rows = diff.select("name", "bucket").join(breaking.select("name").distinct().withColumn("__b", F.lit(True)), "name", "left")
    rows = rows.join(local.select("name").distinct().withColumn("__l", F.lit(True)), "name", "full_outer")
    mark = F.when((F.col("bucket") == "changed") & F.col("__b"), "breaking").when(F.col("bucket").isin("changed", "removed"), F.col("bucket")).when((F.coalesce("bucket", F.lit("new")) == "new") & F.col("__l"), "new")
    return rows.select("name", mark.alias("annotation")).filter("annotation IS NOT NULL")


def sanitize_breaking_changes(changes: DataFrame) -> DataFrame:
    """Keep the entries of the array breaking_changes (property_id, slot_id, reason) whose reason is known."""
    known = lambda x: (x["property_id"].isNotNull() & x["reason"].isin(PROPERTY_REASONS)) | (x["slot_id"].isNotNull() & x["reason"].isin(SLOT_REASONS))
    return changes.withColumn("breaking_changes", F.filter("breaking_changes", known))


def breaking_rows(diff: DataFrame) -> DataFrame:
    """A row for each reason of a breaking component, one without a reason where none is listed."""
    rows = diff.filter("breaking").select("name", F.explode_outer("breaking_changes").alias("b"))
    return rows.select("name", F.coalesce("b.property_id", "b.slot_id").alias("part"), F.coalesce("b.reason", F.lit("breaking")).alias("reason"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Counts of each kind and bucket; of the changed ones, those that break (a classification of breaking) and those over a draft (has_draft)."""
    changed = F.col("bucket") == "changed"
    buckets = [F.count_if(F.col("bucket") == b).alias(b) for b in ("new", "changed", "unchanged", "removed")]
    return diff.groupBy("kind").agg(*buckets, F.count_if(changed & (F.col("classification") == "breaking")).alias("breaking"), F.count_if(changed & F.col("has_draft")).alias("draft_overwrites"))


def is_empty_diff(diff: DataFrame) -> DataFrame:
    return diff.agg((~F.coalesce(F.bool_or(F.col("bucket") != "unchanged"), F.lit(False))).alias("is_empty"))


def apply_summary(items: DataFrame) -> DataFrame:
    """Per entity type: created and updated that succeeded, and failed ones of any action."""
    done = lambda a: F.count_if((F.col("action") == a) & (F.col("status") == "succeeded"))
    return items.groupBy("entity_type").agg(done("create").alias("created"), done("update").alias("updated"), F.count_if(F.col("status") == "failed").alias("failed"))


def apply_failures(items: DataFrame) -> DataFrame:
    """entity_type, id and error of the items that failed; an error without a message says so."""
    return items.filter("status = 'failed'").select("entity_type", "id", F.coalesce("error", F.lit("unknown error")).alias("error"))


def selectable_entities(diff: DataFrame) -> DataFrame:
    """New and changed entries with their key kind:id."""
    return diff.filter(F.col("bucket").isin("new", "changed")).select("kind", "id", "bucket", F.concat_ws(":", "kind", F.col("id").cast("string")).alias("key"))


def pattern_select_entities(entities: DataFrame, select=(), deselect=(), select_all: bool = False) -> DataFrame:
    """Entities whose key contains a pattern to select, or all without such; those that match one to deselect go. select_all takes all. Case counts."""
    if select_all:
        return entities
    hit = lambda patterns: reduce(Column.__or__, (F.col("key").contains(p) for p in patterns), F.lit(False))
    chosen = hit(select) if select else F.lit(True)
    return entities.filter(chosen & ~hit(deselect))


def filter_manifest(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Manifest entries (kind, id) that are chosen."""
    return entries.join(chosen.select("kind", "id").distinct(), ["kind", "id"], "left_semi")


def scope_decisions(components: DataFrame, accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Status by two lists of ids: accepted wins over rejected, others keep theirs."""
    mark = lambda df, m: df.select("component_id").distinct().withColumn(m, F.lit(True))
    rows = components.join(mark(accepted, "__a"), "component_id", "left").join(mark(rejected, "__r"), "component_id", "left")
    return rows.withColumn("status", F.when(F.col("__a"), "accepted").when(F.col("__r"), "rejected").otherwise(F.col("status"))).drop("__a", "__r")
