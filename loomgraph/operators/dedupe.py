"""Components and edges that say the same: one stays, by rank, and the rest are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far evidence of an edge is trusted, the most first; adapters come next and agents last.
RANKS = {"user": 1, "typed-slot": 2, "structural": 3, "manifest": 4, "doc": 5}
ADAPTER_RANK, AGENT_RANK = 6, 7


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: x != "")


def _at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def path_score(path: str | Column) -> Column:
    """How much a path is preferred: index files most, then shallow ones; a file named like its folder and components folders cost."""
    s = _segments(F.col(path) if isinstance(path, str) else path)
    n = F.size(s)
    file = F.get(s, n - 1)
    base = F.regexp_replace(file, r"\.[^.]+$", "")
    own = F.when((base != "") & (F.get(s, n - 2) == base), 10).otherwise(0)
    return F.when(file.rlike(r"^index\.[jt]sx?$"), 100).otherwise(0) - own - 8 * F.size(F.filter(s, lambda x: x == "components")) - n


def _root_and_rest(path: Column) -> tuple[Column, Column]:
    """Segments of the package's root and those below it: packages/x, else what precedes the last src; null where neither is there."""
    s = _segments(path)
    n = F.size(s)
    positions = F.sequence(F.lit(0), n - 1)
    package = F.get(F.filter(positions, lambda i: F.get(s, i).isin(".packages", "packages") & (i + 1 < n)), F.lit(0))
    src = F.array_max(F.filter(positions, lambda i: F.get(s, i) == "src"))
    cut = F.coalesce(package + 2, src)
    return F.slice(s, F.lit(1), cut), F.slice(s, cut + 1, n)


def _family(rest: Column) -> Column:
    """The top-level family that a path below its root opens, or null."""
    a, b, c, d = (_at(rest, i) for i in range(4))
    is_file = lambda f, name, kinds: f.isin([f"index.{k}" for k in kinds if k != "vue" or len(kinds) > 2]) | F.coalesce(F.array_contains(F.array(*(F.concat(name, F.lit(f".{k}")) for k in kinds)), f), F.lit(False))
    return (
        F.when(F.size(rest) == 1, F.regexp_replace(a, r"\.[^.]+$", ""))
        .when((a == "src") & (b == "components") & c.isNotNull(), F.when(is_file(d, c, ["tsx", "ts"]), c))
        .when((a == "src") & b.isNotNull(), F.when(is_file(c, b, ["vue", "tsx", "ts"]), b))
        .when(a.isNotNull(), F.when(is_file(b, a, ["tsx", "ts", "vue"]), a))
    )


def _within_family(rest: Column, name: Column) -> Column:
    a, b, c = (_at(rest, i) for i in range(3))
    own = F.array(*(F.concat(name, F.lit(f".{k}")) for k in ("tsx", "ts", "vue")))
    files = F.concat(own, F.array(*(F.lit(f"index.{k}") for k in ("tsx", "ts", "vue"))))
    has = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))
    return (
        F.when(F.size(rest) == 1, has(own, a))
        .when((a == "src") & (b == "components") & (c == name), True)
        .when((a == "components") & (b == name), True)
        .when((a == "src") & (b == name), True)
        .when(a == name, has(files, b) | (F.size(rest) > 2))
        .otherwise(False)
    )


def family_scope_key(components: DataFrame) -> DataFrame:
    """Add scope, what a component's name must be unique in: a family of its package if the package opens one by that name, else a folder of it."""
    root, rest = _root_and_rest(F.col("source"))
    named = components.withColumn("__root", F.array_join(root, "/")).withColumn("__rest", rest)
    families = named.select("session_id", "__root", _family(F.col("__rest")).alias("name")).filter("name IS NOT NULL").distinct().withColumn("__top", F.lit(True))
    out = named.join(families, ["session_id", "__root", "name"], "left")
    r, rest = F.col("__root"), F.col("__rest")
    a, b, c = (_at(rest, i) for i in range(3))
    join = lambda *parts: F.concat(r, *(F.lit(p) if isinstance(p, str) else p for p in parts))
    key = (
        F.when(r.isNull(), F.regexp_replace("source", r"\\", "/"))
        .when(F.col("__top") & _within_family(rest, F.col("name")), join("::", F.col("name")))
        .when((a == "src") & (b == "components") & c.isNotNull(), join("/src/components/", c))
        .when((a == "components") & b.isNotNull(), join("/components/", b))
        .when((a == "src") & b.isNotNull() & (F.size(rest) > 2), join("/src/", b))
        .when(a.isNotNull() & (F.size(rest) > 1), join("/", a))
        .otherwise(r)
    )
    return out.withColumn("scope", key).drop("__root", "__rest", "__top")


def dedupe_components(components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of components of one name and scope the best path stays, then the shorter, then the first seen; and a warning row for each other and for names in several scopes."""
    scored = family_scope_key(components).withColumn("score", path_score("source"))
    order = Window.partitionBy("session_id", "name", "scope").orderBy(F.desc("score"), F.length("source"), "arrival")
    ranked = scored.withColumn("rn", F.row_number().over(order)).withColumn("kept_source", F.first("source").over(order))
    kept = ranked.filter("rn = 1").drop("rn", "kept_source")
    losers = ranked.filter("rn > 1").select("session_id", "name", F.lit("duplicate").alias("kind"), F.col("source").alias("dropped"), F.col("kept_source").alias("kept"))
    several = kept.groupBy("session_id", "name").agg(F.count("*").alias("n"), F.min("source").alias("kept")).filter("n > 1")
    return kept, losers.unionByName(several.select("session_id", "name", F.lit("collision").alias("kind"), F.lit(None).cast("string").alias("dropped"), "kept"))


def provenance_rank(provenance: str | Column) -> Column:
    p = F.col(provenance) if isinstance(provenance, str) else provenance
    rank = F.when(p.startswith("adapter:"), ADAPTER_RANK).otherwise(AGENT_RANK)
    for name, r in reversed(RANKS.items()):
        rank = F.when(p == name, r).otherwise(rank)
    return rank


def merge_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per parent and child the edge of the best rank, the first of equals; and a conflict for each edge whose slot differs from that of the winner so far.

    Of edges that repeat each other one wins.
    """
    ranked = edges.withColumn("__rank", provenance_rank("provenance"))
    pair, first = Window.partitionBy("parent", "child"), ("seq", "slot", "provenance")
    best = F.struct("__rank", *first)
    so_far = F.min(best).over(pair.orderBy(*first).rowsBetween(Window.unboundedPreceding, -1))
    rows = ranked.withColumn("__w", so_far).withColumn("__place", F.row_number().over(pair.orderBy("__rank", *first)))
    merged = rows.filter("__place = 1").drop("__rank", "__w", "__place")
    differs = F.coalesce(F.col("__w.slot"), F.lit("")) != F.coalesce("slot", F.lit(""))
    wins = F.col("__rank") < F.col("__w.__rank")
    conflicts = rows.filter(F.col("__w").isNotNull() & differs).select(
        "parent", "child", "seq", F.when(wins, F.col("provenance")).otherwise(F.col("__w.provenance")).alias("winner"), F.when(wins, F.col("__w.provenance")).otherwise(F.col("provenance")).alias("loser")
    )
    return merged, conflicts


def first_seen(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(arrival))).filter("__rn = 1").drop("__rn")


def first_component_per_file(components: DataFrame) -> DataFrame:
    return components.groupBy("session_id", "source").agg(F.min_by("name", "arrival").alias("name"))


#: Fields of props that the last source that gives one decides.
GIVEN = ("type", "category", "default_value", "description", "values")


def merge_props(rows: DataFrame, replace: bool = False) -> DataFrame:
    """Props of several sources by name, sources in order of source_rank: a later one overwrites what it gives, required holds if all say so.

    The fields are those of GIVEN that rows has; an empty list of values gives nothing. With replace, the last source
    that names a prop replaces it as a whole.
    """
    fields = [c for c in GIVEN if c in rows.columns]
    if replace:
        whole = F.max_by(F.struct(*fields, "required"), F.struct("source_rank", *(c for c in fields if c != "values"))).alias("p")
        return rows.groupBy("component_key", "name").agg(whole).select("component_key", "name", "p.*")
    there = lambda c: F.col(c).isNotNull() & (F.size(c) > 0 if c == "values" else F.lit(True))
    last = lambda c: F.max_by(c, F.when(there(c), F.struct("source_rank", c))).alias(c)
    return rows.groupBy("component_key", "name").agg(*map(last, fields), F.bool_and("required").alias("required"))


def chunk(rows: DataFrame, order: str, size: int = 5, by: str = "session_id") -> DataFrame:
    """Add chunk and place, both from 0: rows in order, so many to a chunk."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("chunk", F.floor(n / size)).withColumn("place", n % size)
