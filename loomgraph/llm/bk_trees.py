"""Near-duplicate groups of documents by SimHash fingerprints and BK-trees.

1. A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed 42) of a text's shingles of 4 words.
   Rows of one fingerprint are one node from here on.
2. Fingerprints are dealt to shards. Of `blocks` runs of bits, two fingerprints at most RADIUS bits apart agree in
   blocks - RADIUS of them, so each choice of that many runs with their values is a shard, and any two that link meet in
   one. The number of runs follows the number of fingerprints, so that a shard holds few unless they are alike.
3. Each shard gets a BK-tree: a node's children are keyed by their integer Hamming distance to it, at most one for each.
   A query goes down from the root, follows only the edges whose key is within RADIUS of its distance to the node, and
   finds all nodes within RADIUS. The trees of a task's shards are built and searched level by level as arrays.
4. Shards of more than `SHARD` members, which near copies make, first link their members with one of them, the
   fingerprint of most rows. What is left there between different components is cut into blocks of at most about SHARD
   members of one component or of small ones; each block's tree goes to the other blocks that hold other components.
5. Links make components.

The trees aren't sent through the driver: they hold the fingerprints of all documents, whose number has no bound. They
are built where their shard's rows are, and a large shard's trees are copied to the blocks of its queries.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one
from loomgraph.llm.near_dedup import _group_starts, components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a shard whose tree one task builds.
SHARD = 4096
#: Fingerprints that are to meet in a shard by chance, at most about.
BY_CHANCE = 256
#: Shingles whose bits are counted together, and queries that go down a tree together.
_TOGETHER, _QUERIES = 8192, 1024
_WEIGHTS = (np.uint64(1) << np.arange(64, dtype=np.uint64))[None, :]


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of a text; 0 without words."""
    own = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    n = max(len(own) - size + 1, 1)
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(size, len(own)) - 1 :].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _TOGETHER):
        part = hashes[at : at + _TOGETHER].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int((1 << np.arange(64, dtype=np.uint64))[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t, size) for t in one_by_one(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return of_texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


class Trees:
    """BK-trees of several shards, side by side: values by shard, each shard's first value its root.

    Nodes are numbered level by level, so a node's children follow each other in the order of their keys.
    """

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        """values: of all shards, one after the other; starts: where each begins (and the end of the last)."""
        self.n_roots = len(starts) - 1
        place, node = np.delete(np.arange(len(values)), starts[:-1]), [starts[:-1]]
        parent = np.repeat(np.arange(self.n_roots), np.diff(starts) - 1)
        keys, first, total = [np.zeros(self.n_roots, np.int64)], [], self.n_roots
        root_of, level = values, starts[:-1]
        low = 0  # number of the level's first node
        while len(level):
            # all that is still to be placed belongs below a node of this level
            edge = (parent - low) * 65 + np.bitwise_count(values[place] ^ root_of[level[parent - low]])
            distinct, at, back = np.unique(edge, return_index=True, return_inverse=True)
            first.append(total + np.searchsorted(distinct, np.arange(len(level) + 1) * 65))
            keys.append(distinct % 65)
            low, level = total, place[at]
            total += len(distinct)
            node.append(level)
            rest = np.ones(len(place), bool)
            rest[at] = False
            place, parent = place[rest], low + back[rest]
        self.place = np.concatenate(node)  # where a node's value stands among those given
        self.values, self.keys = values[self.place], np.concatenate(keys)
        self.first = np.concatenate([f[:-1] for f in first])
        self.last = np.concatenate([f[1:] for f in first])
        # children by (node, key): one sorted array answers every range of keys
        owner = np.repeat(np.arange(len(self.first)), self.last - self.first)
        self.edges = owner * 65 + self.keys[self.n_roots :]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, place of a value) at most radius apart, each query in the tree of its root."""
        for at in range(0, len(queries), _QUERIES):
            query, node = np.arange(at, min(at + _QUERIES, len(queries))), roots[at : at + _QUERIES]
            while len(query):
                apart = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
                hit = apart <= radius
                if hit.any():
                    yield query[hit], self.place[node[hit]]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
                many = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), "right") - low
                query = np.repeat(query, many)
                node = self.n_roots + np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)


def _linked(values: np.ndarray, starts: np.ndarray, component: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (a, b) that connects the values of each shard that are within radius of each other, beyond what component says."""
    trees = Trees(values, starts)
    least = np.unique(component, return_inverse=True)[1]
    first = np.full(len(values), len(values))
    np.minimum.at(first, least, np.arange(len(values)))
    least = first[least]  # each value's component by its first member
    began = least.copy()
    found = [(q, p) for q, p in trees.within(values, np.repeat(np.arange(len(starts) - 1), np.diff(starts)), radius)]
    pairs = [(q[keep], p[keep]) for q, p in found if (keep := (q < p) & (began[q] != began[p])).any()]
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = (np.concatenate(s) for s in zip(*pairs, strict=True))
    while True:
        new = least.copy()
        a, b = least[x], least[y]
        np.minimum.at(new, a, b)
        np.minimum.at(new, b, a)
        np.minimum(new, new[new], out=new)
        new = np.minimum(new, new[least])
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero((least != began) & (np.arange(len(values)) == began))
    return moved, least[moved]


def _blocks_for(count: int, radius: int) -> int:
    """Runs of bits, so that about BY_CHANCE of so many fingerprints meet in a shard at most."""
    for blocks in range(radius + 1, 2 * radius + 1):
        if count >> (64 // blocks * (blocks - radius)) <= BY_CHANCE:
            return blocks
    return 2 * radius


def shard_keys(fingerprint, blocks: int, radius: int):
    """The shards of a fingerprint, as an array of hashes of the choice of runs and their values."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    return F.array(*(F.xxhash64(F.lit(n), *(runs[i] for i in chosen)) for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius))))


def _whole_groups(keys: list[str], names: list[str], link):
    """A function for mapInArrow over rows sorted by keys: link(rows, starts) of the complete groups at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            starts = _group_starts(whole[0], keys)
            yield link(whole[0].slice(0, starts[-1]), starts)
            rest = [whole[0].slice(starts[-1])]  # the last group may go on in the next batch
        for whole in pa.Table.from_batches(rest).combine_chunks().to_batches() if rest else ():
            yield link(whole, np.append(_group_starts(whole, keys), whole.num_rows))

    return run


def _forest_of(rows: pa.RecordBatch, starts: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links (a, b) of fingerprints within each group."""
    if not rows.num_rows:
        return pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
    own = np.asarray(rows.column(rows.schema.get_field_index("fingerprint")))
    component = np.asarray(rows.column(rows.schema.get_field_index("component")))
    a, b = _linked(own.view(np.uint64), starts, component, radius)
    return pa.record_batch([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])


def _star_links(large: DataFrame, radius: int) -> DataFrame:
    """Links between the members of each large shard and the one of most rows in it."""
    centre = F.expr("max_by(fingerprint, struct(copies, ~fingerprint))").alias("centre")
    both = large.join(large.groupBy("shard").agg(centre), "shard")
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("centre"))) <= radius
    return both.filter(near & (F.col("fingerprint") != F.col("centre"))).select(F.col("fingerprint").alias("a"), F.col("centre").alias("b")).distinct()


def _between(large: DataFrame, radius: int) -> DataFrame:
    """Links between different components of each large shard (shard, fingerprint, component).

    A component of many members has blocks of its own, small ones share theirs; two blocks meet unless both hold one
    and the same component.
    """
    sizes = large.groupBy("shard", "component").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") > SHARD // 2, F.col("component"))
    pools = sizes.groupBy("shard", own.alias("pool")).agg(F.ceil(F.sum("n") / SHARD).alias("blocks"))
    pools = materialize(pools.select("shard", F.hash("pool").alias("h"), "pool", "blocks"), "pools")
    table = pools.select("shard", "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    side = lambda x: table.select("shard", F.col("pool").alias(f"pool_{x}"), F.col("block").alias(f"block_{x}"), F.xxhash64(F.coalesce("pool", F.lit(-1)), F.col("pool").isNull(), "block").alias(x))
    meets = side("i").join(side("j"), "shard").filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("pool_i") == F.col("pool_j"), F.lit(False)))
    meets = meets.select("shard", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    at = large.join(sizes, ["shard", "component"]).withColumn("pool", own)
    at = at.join(pools.drop("h"), (at.shard == pools.shard) & at.pool.eqNullSafe(pools.pool)).select(at.shard, "fingerprint", "component", at.pool, "blocks")
    block = F.pmod(F.xxhash64("fingerprint"), F.col("blocks"))
    at = at.select("shard", "fingerprint", "component", F.xxhash64(F.coalesce("pool", F.lit(-1)), F.col("pool").isNull(), block).alias("own"))
    keys = ["shard", "i", "j"]
    dealt = at.join(meets, ["shard", "own"]).select(*keys, "fingerprint", "component").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_whole_groups(keys, dealt.columns, lambda rows, starts: _forest_of(rows, starts, radius)), "a long, b long")


def fingerprint_components(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """node and component (both fingerprints) of each fingerprint that links with another; nodes: fingerprint, copies."""
    runs = blocks or _blocks_for(nodes.count(), radius)
    dealt = nodes.select("fingerprint", "copies", F.explode(shard_keys(F.col("fingerprint"), runs, radius)).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes, "shards")
    members = dealt.join(sizes, "shard")
    small = members.filter(F.col("n") <= SHARD).select("shard", "fingerprint", F.col("fingerprint").alias("component"))
    small = small.repartition("shard").sortWithinPartitions("shard")
    links = small.mapInArrow(_whole_groups(["shard"], small.columns, lambda rows, starts: _forest_of(rows, starts, radius)), "a long, b long").distinct()
    links = materialize(links, "links")
    if not sizes.filter(F.col("n") > SHARD).isEmpty():
        large = materialize(members.filter(F.col("n") > SHARD).select("shard", "fingerprint", "copies"), "large")
        links = links.unionByName(materialize(_star_links(large, radius), "stars"))
        where = materialize(components(links), "where").withColumnRenamed("node", "fingerprint")
        large = large.join(where, "fingerprint", "left").select("shard", "fingerprint", F.coalesce("component", "fingerprint").alias("component"))
        links = links.unionByName(materialize(_between(materialize(large, "left"), radius).distinct(), "between"))
    return components(links)


def groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs (doc_id, text; other columns are left out).

    Null and empty texts and those of white space only have the fingerprint 0, which links like any other. A row
    without doc_id is in the component of its fingerprint like others, but never names one; a component of such rows
    only has a null component_id. Repeated rows are in one component. An empty table gives none.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    nodes = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "nodes")
    where = materialize(fingerprint_components(nodes, radius), "components")
    named = nodes.join(where.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(first, "component").select("fingerprint", "component_id", "copies"), "named")
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return _looked_up(rows, named).select("doc_id", shown, "component_id")


#: A fingerprint with more than this part of all rows is looked up by a broadcast.
HOT_PART = 1000


def _looked_up(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with the component_id of their fingerprint: those of frequent fingerprints, under HOT_PART, by a broadcast."""
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = named.filter(F.col("copies") * HOT_PART > total).select("fingerprint", F.col("component_id").alias("hot"), F.lit(True).alias("is_hot"))
    at = rows.join(F.broadcast(hot), "fingerprint", "left")
    common = at.filter("is_hot").select("doc_id", "fingerprint", F.col("hot").alias("component_id"))
    return common.unionByName(at.filter("is_hot IS NULL").select("doc_id", "fingerprint").join(named.select("fingerprint", "component_id"), "fingerprint"))
