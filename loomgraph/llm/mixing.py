"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. Targets. Sources in code-point order weigh 3, 1, 2, repeating; they share `total` times all words, no source more
   than `most` times its own (water filling).
2. Draws. A source's documents lie in hash blocks, in permuted order. The mix takes whole passes over the source and
   then blocks of one more pass, in order, until the target's remaining words are used up. The block at the border
   is searched by finer hashes down to a document, so that the words taken equal the target.
3. Shards. The exact block quota of each source is split among output shards by a binary tree: at each node, the
   left half's share is a multivariate hypergeometric draw from the node's quotas. A shard's blocks follow one
   another in the permuted order, so shards are disjoint; rows are shuffled inside a shard by hash order.

The plan has one row for each source and a bounded number of blocks. Shards grow in number with the words drawn, up to
MAX_SHARDS, and beyond that a shard is written by several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import WORD, materialize, with_ordinal

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL, MOST = 1.5, 2.0
BLOCKS_PER_SHARD, SEED = 32, 17
#: Shards are so many, or as many as hold SHARD_WORDS words each; a task writes about so many words.
LEAST_SHARDS, MAX_SHARDS, SHARD_WORDS = 64, 4096, 20_000_000
#: A plan of more sources than this is joined as a table of unknown size, not broadcast.
MAX_BROADCAST_SOURCES = 100_000
_FINE = 1024
_PRIME = 2_147_483_647  # a prime over any number of blocks, so that multiplying by it permutes them


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*columns, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Per source: source, source_size, docs, weight, target. sizes has source and size; null is a source, the last."""
    found = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("docs"))
    ranked = with_ordinal(found, [F.col("source").isNull(), F.col("source")], "ordinal")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ordinal") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    share, capped = float(total) * (ranked.agg(F.sum("source_size")).first()[0] or 0), -1
    level = math.inf
    while True:  # each round stops the sources whose share is above their limit; at most one round for each source
        over = F.col("weight") * level > most * F.col("source_size") if level < math.inf else F.lit(False)
        row = ranked.agg(F.count_if(over), F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == capped:
            break
        capped, level = row[0], (share - (row[1] or 0.0)) / row[2] if row[2] else math.inf
    target = F.least(F.col("weight") * F.lit(min(level, 1e300)), most * F.col("source_size"))
    return ranked.withColumn("target", target)


def _descend(docs: DataFrame, plan: DataFrame, key: str, at: str) -> DataFrame:
    """Where the remaining words of each source end: adds the key's value as column `at` and lessens `rest` by what lies before."""
    sums = docs.groupBy("source", key).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy(key)) - F.col("words")
    found = sums.withColumn("before", before).withColumnRenamed("source", "__s")
    same = plan["source"].eqNullSafe(found["__s"]) & (found["before"] <= plan["rest"]) & (plan["rest"] < found["before"] + found["words"])
    out = plan.join(found, same, "left").withColumn("rest", F.col("rest") - F.coalesce("before", F.lit(0))).withColumn(at, F.col(key))
    return out.withColumn(f"{at}_rows", F.coalesce("rows", F.lit(1))).drop("__s", "before", "words", "rows", key)


def _inside(docs: DataFrame, plan: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The documents that lie at the border found so far."""
    border = plan.select(F.col("source").alias("__s"), *keys.values())
    match = docs["source"].eqNullSafe(border["__s"])
    for key, at in keys.items():
        match = match & (docs[key] == border[at])
    return docs.join(F.broadcast(border) if plan.count() <= MAX_BROADCAST_SOURCES else border, match).select(docs["*"])


#: Fixed text of the draw from a hypergeometric law: n draws from total of which good are wanted, by inversion of u
#: over the mean and 8 deviations to either side, where weights follow from their neighbours' ratio.
_RATIO = "double(good - x) * (n - x) / (double(x + 1) * (total - good - n + x + 1))"
_LOW = "greatest(0L, n + good - total, bigint(floor(n * (good / total) - 8 * sd - 2)))"
_HIGH = "least(n, good, bigint(ceil(n * (good / total) + 8 * sd + 2)))"
_SD = "sqrt(greatest(0D, double(n) * (good / total) * (1 - good / total) * (total - n) / greatest(1L, total - 1)))"


def _bound(text: str, **names: str) -> str:
    """text with its names as fields of other expressions."""
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: f"({names[m[1]]})", text)


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for one hypergeometric draw."""
    law = {"total": "p.total", "good": "p.good", "n": "p.n", "sd": "p.sd"}
    ratio = _bound(_RATIO, x="x", **law)
    start = f"transform(array(named_struct('total', {total}, 'good', {good}, 'n', {n}, 'u', {u})), p -> struct(p.*, {_bound(_SD, total='p.total', good='p.good', n='p.n')} AS sd))"
    start = start.replace("struct(p.*, ", "named_struct('total', p.total, 'good', p.good, 'n', p.n, 'u', p.u, 'sd', ").replace(" AS sd)", ")")
    xs = f"sequence({_bound(_LOW, **law)}, {_bound(_HIGH, **law)})"
    whole = f"aggregate({xs}, named_struct('w', 1D, 's', 0D), (a, x) -> named_struct('w', a.w * ({ratio}), 's', a.s + a.w)).s"
    pick = (
        f"aggregate({xs}, named_struct('w', 1D, 's', 0D, 'at', CAST(NULL AS BIGINT)), (a, x) -> named_struct('w', a.w * ({ratio}), 's', a.s + a.w,"
        f" 'at', CASE WHEN a.at IS NULL AND a.s + a.w >= p.u * p.whole THEN x ELSE a.at END)).at"
    )
    fields = "'total', p.total, 'good', p.good, 'n', p.n, 'u', p.u, 'sd', p.sd"
    chosen = f"transform(transform({start}, p -> named_struct({fields}, 'whole', {whole})), p -> coalesce({pick}, {_bound(_HIGH, **law)}))[0]"
    return f"CASE WHEN {n} <= 0 OR {good} <= 0 THEN 0L WHEN {good} >= {total} THEN {n} WHEN {n} >= {total} THEN {good} ELSE {chosen} END"


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Split each source's quota among shards: (ordinal, quota) to (ordinal, shard, quota), sums kept exactly.

    Shards get equal capacities up to one block. The tree's nodes are rows; a node holds one quota for each source.
    """
    tree = quotas.agg(F.array_sort(F.collect_list(F.struct("ordinal", "quota"))).alias("q"))
    tree = tree.select(F.lit(0).alias("first"), F.lit(shards).alias("width"), "q", F.expr("aggregate(q, 0L, (a, x) -> a + x.quota)").alias("blocks"))
    blocks = tree.select("blocks").first()[0]
    u = f"(pmod(xxhash64({seed}, first, width, x.ordinal), 1000000007) + 0.5D) / 1000000007D"
    cap = f"bigint(floor(double({blocks}) * (first + width DIV 2) / {shards})) - bigint(floor(double({blocks}) * first / {shards}))"
    for _ in range(max(1, math.ceil(math.log2(max(shards, 1)))) if shards > 1 else 0):
        fold = (
            f"aggregate(q, named_struct('left', {cap}, 'total', blocks, 'out', CAST(array() AS ARRAY<BIGINT>)), (s, x) -> transform(array({_draw('s.total', 'x.quota', 's.left', u)}),"
            " d -> named_struct('left', s.left - d, 'total', s.total - x.quota, 'out', concat(s.out, array(d))))[0]).out"
        )
        grown = tree.withColumn("took", F.when(F.col("width") > 1, F.expr(fold)))
        halves = F.expr(
            "CASE WHEN width = 1 THEN array(named_struct('first', first, 'width', 1, 'q', q, 'blocks', blocks)) ELSE array("
            "named_struct('first', first, 'width', bigint(width) DIV 2, 'q', transform(q, (x, i) -> named_struct('ordinal', x.ordinal, 'quota', took[i])), 'blocks', aggregate(took, 0L, (a, t) -> a + t)),"
            "named_struct('first', first + width DIV 2, 'width', width - width DIV 2, 'q', transform(q, (x, i) -> named_struct('ordinal', x.ordinal, 'quota', x.quota - took[i])), 'blocks', blocks - aggregate(took, 0L, (a, t) -> a + t))) END"
        )
        tree = materialize(grown.select(F.explode(halves).alias("h")).select(F.col("h.first").cast("int").alias("first"), F.col("h.width").cast("int").alias("width"), "h.q", "h.blocks"), "tree")
    return tree.select(F.col("first").alias("shard"), F.explode("q").alias("q")).select("q.ordinal", "shard", "q.quota")


def _keyed(docs: DataFrame, plan: DataFrame, seed: int, bounded: bool, kept: list[str] | None = None) -> DataFrame:
    """docs (with doc_id, source and __size) joined to their source's plan row as __p, with the keys of the permuted order."""
    plan = plan.select(F.col("source").alias("__source"), F.struct(*(kept or plan.columns)).alias("__p"))
    out = docs.join(F.broadcast(plan) if bounded else plan, docs["source"].eqNullSafe(plan["__source"]), "left").drop("__source")
    block = F.pmod(_hash("doc_id", "__size", seed=seed), F.col("__p.n_blocks"))
    out = out.withColumn("__block", F.pmod(block * F.lit(_PRIME) + F.col("__p.shift"), F.col("__p.n_blocks")))
    return out.withColumn("__fine", F.pmod(_hash("doc_id", "__size", seed=seed + 1), F.lit(_FINE))).withColumn("__last", _hash("doc_id", "__size", seed=seed + 2))


def plan_mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, shards: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """One row for each source: its target, where its draws end, the shard of each of its blocks, and how many parts a shard has."""
    sizes = materialize(docs.select("doc_id", "source", words_in("text").alias("size")), "sizes")
    plan = targets(sizes, weights, total, most)
    words = plan.agg(F.sum("target")).first()[0] or 0.0
    shards = shards or min(MAX_SHARDS, max(LEAST_SHARDS, math.ceil(words / SHARD_WORDS)))
    parts = max(1, math.ceil(words / shards / SHARD_WORDS))
    per_block = max(1, math.ceil(words / (shards * blocks_per_shard)))
    size = F.col("source_size")
    passes = F.when(size > 0, F.floor(F.round("target") / size)).otherwise(0).cast("long")
    plan = plan.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(size / per_block)).cast("long")).withColumn("passes", passes)
    plan = plan.withColumn("rest", F.round("target").cast("long") - F.col("passes") * size)
    plan = materialize(plan.withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "ordinal"), "n_blocks")), "plan")
    bounded = plan.count() <= MAX_BROADCAST_SOURCES
    keyed = _keyed(sizes.withColumn("__size", F.col("size")), plan, seed, bounded, ["n_blocks", "shift"]).drop("__p", "__size")
    plan = materialize(_descend(keyed, plan, "__block", "at_block"), "blocks")
    near = materialize(_inside(keyed, plan, {"__block": "at_block"}), "border")
    plan = materialize(_descend(near, plan, "__fine", "at_fine"), "fine")
    near = _inside(near, plan, {"__block": "at_block", "__fine": "at_fine"})
    plan = materialize(_descend(near, plan, "__last", "at_last"), "last")
    # words of each document at the very border: the rest is dealt evenly among rows that tie
    plan = plan.withColumn("cut", F.floor(F.col("rest") / F.col("at_last_rows")).cast("long"))
    quota = F.col("passes") * F.col("n_blocks") + F.coalesce(F.col("at_block") + 1, F.lit(0))
    plan = plan.withColumn("quota", F.when(size > 0, quota).otherwise(0).cast("long"))
    shares = split_quotas(plan.select("ordinal", "quota"), shards, seed)
    shards_of = shares.groupBy("ordinal").agg(
        F.expr("flatten(transform(array_sort(collect_list(struct(shard, quota))), s -> array_repeat(s.shard, int(s.quota))))").alias("shard_of")
    )
    plan = plan.join(shards_of, "ordinal", "left").withColumn("parts", F.lit(parts))
    return materialize(plan.select("source", "source_size", "weight", "target", "passes", "n_blocks", "shift", "at_block", "at_fine", "at_last", "cut", "quota", "shard_of", "parts"), "mix")


def _drawn(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """docs, all columns as they are, with __size, __p (the plan's row) and __draws."""
    bounded = plan.count() <= MAX_BROADCAST_SOURCES
    keyed = _keyed(docs.withColumn("__size", words_in("text")), plan, seed, bounded)
    at = [F.col("__p.at_block"), F.col("__p.at_fine"), F.col("__p.at_last")]
    keys = [F.col("__block"), F.col("__fine"), F.col("__last")]
    part = F.when(keys[0] < at[0], F.col("__size")).when(keys[0] > at[0], 0)
    part = part.when(keys[1] < at[1], F.col("__size")).when(keys[1] > at[1], 0)
    part = part.when(keys[2] < at[2], F.col("__size")).when(keys[2] > at[2], 0).when(at[2].isNotNull(), F.least("__p.cut", "__size")).otherwise(0)
    keyed = keyed.withColumn("__part", part.cast("long"))
    each = F.expr(
        "filter(transform(sequence(0L, __p.passes), p -> named_struct('pass', int(p), 'shard', get(__p.shard_of, int(p * __p.n_blocks + __block)),"
        " 'words', CASE WHEN p < __p.passes THEN __size ELSE __part END)), d -> d.words > 0)"
    )
    return keyed.select(*docs.columns, "__size", "__p", each.alias("__draws"))


def draws(docs: DataFrame, plan: DataFrame | None = None, seed: int = SEED, **settings) -> DataFrame:
    """Add to each row of docs what the mix takes of it: size, source_size, target and draws, an array of (pass, shard, words).

    Columns of these names are replaced; others stay, whatever their names. A null or empty text has size 0 and is never
    drawn, its row stays with no draws. Null is a source of its own. Equal rows share what falls on them. An empty table
    gives none.
    """
    plan = plan_mix(docs, seed=seed, **settings) if plan is None else plan
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "draws")]
    drawn = _drawn(docs, plan, seed)
    return drawn.select(*own, F.col("__size").alias("size"), F.col("__p.source_size").alias("source_size"), F.col("__p.target").alias("target"), F.col("__draws").alias("draws"))


def mix(docs: DataFrame, seed: int = SEED, **settings) -> DataFrame:
    """The mix itself: a row for each draw with the columns of docs, its text cut to the words drawn, and pass, shard and words.

    Columns named pass, shard or words are replaced; others stay as they are. Rows of a shard lie together in a random
    order that reruns repeat; a very large shard is written in parts. Texts without words, null ones too, are never
    drawn. Equal rows share what falls on them. An empty table gives none.
    """
    plan = plan_mix(docs, seed=seed, **settings)
    out = _drawn(docs, plan, seed).withColumn("__d", F.explode("__draws"))
    cut = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    head = F.when(F.col("__d.words") >= F.col("__size"), F.col("text")).otherwise(F.concat(cut, first_words("text", "__d.words")))
    out = out.withColumn("text", head).withColumn("__order", _hash("doc_id", "__d.pass", "__size", seed=seed + 3))
    out = out.withColumn("__part", F.pmod("__order", "__p.parts"))
    own = [c for c in docs.columns if c not in ("pass", "shard", "words")]
    out = out.select(*own, F.col("__d.pass").alias("pass"), F.col("__d.shard").alias("shard"), F.col("__d.words").alias("words"), "__part", "__order")
    shuffled = out.repartition("shard", "__part").sortWithinPartitions("shard", "__part", "__order", "doc_id")
    return shuffled.drop("__part", "__order")


def first_words(text: str, n: str) -> Column:
    """The text from its first word to its n-th, white space between them as it is."""
    spaced = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    return F.regexp_replace(F.array_join(F.slice(spaced, F.lit(1), F.col(n).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
