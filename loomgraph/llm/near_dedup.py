"""Near-duplicate groups of documents by SetSketch registers.

1. A document's set is its distinct 5-word shingles (64-bit hashes). Documents with equal sets form a class.
2. A class has a SetSketch: each register keeps the least of exponential hashes of the set's elements, on a scale of
   powers of `base`. Runs of `ROWS` registers are bands; classes that agree in a band are candidates.
3. In each bucket all members are paired with one of them; a second round does so with another member, in buckets that
   still hold several components. What is left is examined in full: tasks get a bucket's members in blocks and compare
   all pairs of different components by their registers, then tasks get the full sets of the members that weren't
   ruled out, in blocks again. They give out forests that connect what is linked, never the pairs of a group, and no
   candidate between components stays untested.
4. A pair is judged by the joint likelihood of its registers for all similarities; it is put aside only if every
   similarity from the threshold up is e^-12 times less likely than the best. The others are confirmed on full sets.
5. Links make components (large-star and small-star rounds).

A pair at the very threshold agrees in none of the bands with probability (1 - 0.75^4)^40, under 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize, of_texts, one_by_one, small_table

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Ids up to this many are broadcast to filter the documents that are read again; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Rounds that pair a bucket's members with one of them, before all pairs left are taken.
STAR_ROUNDS = 2
#: A task compares at most so many members of a bucket with as many others at a time.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1000, 500_000
_RULED_OUT = 12.0
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return (x ^ (x >> np.uint64(29))) * _M2


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run, one without words none."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    length = min(size, len(words))
    runs = np.full(len(one) - length + 1, length, np.uint64)
    for k in range(length):
        runs = _mix(runs) + one[k : len(one) - length + 1 + k]
    return np.unique(_mix(runs))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set; the sketch of a union is the maximum of sketches."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        x = hashes[None, i : i + 1024] * _FACTORS[:, None]
        x ^= x >> np.uint64(31)
        np.minimum(least, x.min(axis=1), out=least)
    values = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    levels = np.floor(1 - np.log(np.maximum(values, 1e-300)) / np.log(BASE))
    return np.clip(levels, 0, TOP + 1).astype(np.uint16)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_hash and bands of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bands = [], [], []
            for text in one_by_one(batch.column(1)):
                found = shingle_set(text, size)
                counts.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(registers(found).view(np.int64) if len(found) else None)
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_hash", "bands"],
            )

    return of_texts(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_hash binary, bands array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """class_id and full set of the documents given."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, size).view(np.int64) for t in one_by_one(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["class_id", "shingles"])

    return of_texts(docs).select("doc_id", "text").mapInArrow(run, f"class_id {kind}, shingles array<long>")


def _log_scale(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of `least` or more isn't ruled out, for registers of pairs (rows) and sizes of their sets."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    tiny = 1e-12

    def likelihood(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        j = low + (high - low) * np.linspace(0, 1, 30)[None, :]
        p, q = np.maximum(_log_scale(np.maximum(u - v * j, 0)), tiny), np.maximum(_log_scale(np.maximum(v - u * j, 0)), tiny)
        return (up * np.log(p) + down * np.log(q) + same * np.log(np.maximum(1 - p - q, tiny))).max(1)

    sizes_allow = most[:, 0] >= least - 1e-12
    return sizes_allow & (likelihood(np.full_like(u, least), np.maximum(most, least)) >= likelihood(np.zeros_like(u), most) - _RULED_OUT)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sketches = [np.array(batch.column(i).flatten()).view(np.uint16).reshape(batch.num_rows, -1) for i in (2, 4)]
                sizes = [np.array(batch.column(i)).astype(np.float64) for i in (3, 5)]
                yield batch.select([0, 1]).filter(pa.array(possible(*sketches, *sizes, percent / 100)))

    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("bands").alias(f"bands_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))
    kind = classes.schema["class_id"].dataType.simpleString()
    return both.select("a", "b", "bands_a", "n_a", "bands_b", "n_b").mapInArrow(run, f"a {kind}, b {kind}")


def _dealt(members: DataFrame, group: str, blocks, columns: list[str]) -> DataFrame:
    """Members of each group dealt to the pairs of its blocks (i, j), rows of a pair together and sorted; own is a row's block."""
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")))
    cut = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other"))
    keys = [group, "i", "j"]
    cut = cut.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    return cut.repartition(*keys).sortWithinPartitions(*keys)


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the least row each is connected to, for a matrix of links between rows left and right of size rows in all."""
    x, y = np.nonzero(linked)
    x, y, least = left[x], right[y], np.arange(size)
    while True:
        new = least.copy()
        np.minimum.at(new, x, least[y])
        np.minimum.at(new, y, least[x])
        new = new[new]
        if (new == least).all():
            moved = np.flatnonzero(least != np.arange(size))
            return moved, least[moved]
        least = new


def _by_group(group: str, names: list[str], linked):
    """A function for mapInArrow: links found by linked(rows, left, right) in each pair of blocks, as a forest of (a, b)."""
    keys = [group, "i", "j"]

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = lambda n: np.asarray(rows.column(names.index(n)))
        i, j, own = (column(n) for n in ("i", "j", "own"))
        everyone = np.arange(rows.num_rows)
        left, right = (everyone, everyone) if i[0] == j[0] else (everyone[own == i[0]], everyone[own == j[0]])
        found = linked(rows, column, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
        a, b = _forest(found, left, right, rows.num_rows)
        ids = rows.column(names.index("class_id"))
        return pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            starts = _group_starts(whole[0], keys)
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                yield compare(whole[0].slice(start, stop - start))
            rest = [whole[0].slice(starts[-1])]  # the last group may go on in the next batch
        for whole in pa.Table.from_batches(rest).combine_chunks().to_batches() if rest else ():
            yield compare(whole)

    return run


def _group_starts(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where each group of equal keys starts in sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for k in keys:
        x = np.asarray(rows.column(k))
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _suspects(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect members (bucket, class_id, component) of one bucket and different components that their registers don't rule out.

    A bucket's pairs are compared in tasks, by blocks; what comes out is a forest, not the pairs.
    """
    kind = classes.schema["class_id"].dataType.simpleString()
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    rows = members.join(sizes, "bucket").join(classes, "class_id")
    columns = ["class_id", "component", "n_shingles", "bands"]
    dealt = _dealt(rows, "bucket", F.ceil(F.col("n") / BLOCK_MEMBERS), columns)

    def linked(rows: pa.RecordBatch, column, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sketch = np.asarray(rows.column(rows.schema.get_field_index("bands")).flatten()).view(np.uint16).reshape(rows.num_rows, -1)
        component, size = column("component"), column("n_shingles").astype(np.int64)
        a, b = sketch[left], sketch[right]
        same = np.zeros((len(left), len(right)), np.uint8)
        for r in range(sketch.shape[1]):
            same += a[:, r, None] == b[None, :, r]
        # at the threshold, so few equal registers are 7 deviations off; many are left to the full sets as they are
        near = same >= (percent / 100 - 0.25) * sketch.shape[1]
        near &= component[left][:, None] != component[right][None, :]
        x, y = np.nonzero(near & (same < (percent / 100 - 0.125) * sketch.shape[1]))
        for part in range(0, len(x), 20_000):
            u, v = x[part : part + 20_000], y[part : part + 20_000]
            near[u, v] = possible(a[u], b[v], size[left][u].astype(np.float64), size[right][v].astype(np.float64), percent / 100)
        return near

    return dealt.mapInArrow(_by_group("bucket", dealt.columns, linked), f"a {kind}, b {kind}")


def _confirmed_within(groups: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect all members of each group (node, component) whose full sets overlap enough, as a forest."""
    kind = classes.schema["class_id"].dataType.simpleString()
    members = groups.select(F.col("node").alias("class_id"), F.col("component").alias("suspects"))
    few = members.count() <= MAX_BROADCAST_IDS
    ids = members.select(F.col("class_id").alias("doc_id"))
    sets = _sets(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), size).dropDuplicates(["class_id"])
    weight = members.join(classes.select("class_id", "n_shingles"), "class_id").groupBy("suspects").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("total") / BLOCK_SHINGLES))
    dealt = _dealt(materialize(sets, "sets").join(members, "class_id").join(weight, "suspects"), "suspects", blocks, ["class_id", "shingles"])

    def linked(rows: pa.RecordBatch, column, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sets = rows.column(rows.schema.get_field_index("shingles"))
        lengths = np.asarray(sets.value_lengths()).astype(np.int64)
        owner = np.repeat(np.arange(rows.num_rows), lengths)
        _, place, times = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
        shared = times[place] > 1
        owner, (_, place) = owner[shared], np.unique(place[shared], return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, int(place[-1]) + 1 if len(place) else 0, 1024):
            of = slice(*np.searchsorted(place, [start, start + 1024]))
            held = np.zeros((rows.num_rows, 1024), np.float32)
            held[owner[of], place[of] - start] = 1
            both += held[left] @ held[right].T
        out = 100 * both >= percent * (lengths[left][:, None] + lengths[right][None, :] - both)
        if left is right:
            np.fill_diagonal(out, False)
        return out

    return dealt.mapInArrow(_by_group("suspects", dealt.columns, linked), f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets overlap by percent or more of their union."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    few = ids.count() <= MAX_BROADCAST_IDS
    sets = materialize(_sets(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), size).dropDuplicates(["class_id"]), "sets")
    side = lambda x: sets.select(F.col("class_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and component (least node reachable) of each end of the links (a, b), by large-star and small-star rounds."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = materialize(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = materialize(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text; other columns are left out).

    A null or empty text, or one of white space only, has an empty set and stays alone. Rows that repeat a doc_id, and
    so its text, are in the same group, each kept or not as the other. Nulls of doc_id stay alone too. An empty table
    gives none.
    """
    sketches = materialize(_sketched(docs, size), "sketches")
    full = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    named = materialize(full.groupBy("set_hash").agg(F.min("doc_id").alias("class_id")), "classes")
    own = full.join(named.withColumnRenamed("class_id", "doc_id"), ["set_hash", "doc_id"], "left_semi")
    classes = materialize(own.select(F.col("doc_id").alias("class_id"), "n_shingles", "bands").dropDuplicates(["class_id"]), "reps")
    where = materialize(_components_of(docs, classes, size, percent), "components")
    named = named.join(where.withColumnRenamed("node", "class_id"), "class_id", "left").select("set_hash", F.coalesce("component", "class_id").alias("component"))
    out = sketches.join(named, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components_of(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    kind = classes.schema["class_id"].dataType.simpleString()
    buckets = classes.select("class_id", F.posexplode("bands").alias("band", "value"))
    shared = buckets.groupBy("band", "value").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).filter("first < last")
    shared = shared.select("band", "value", F.monotonically_increasing_id().alias("bucket"))
    members = materialize(buckets.join(shared, ["band", "value"]).select("bucket", "class_id"), "members")
    links = tested = small_table(spark, [], f"a {kind}, b {kind}")
    where = small_table(spark, [], f"node {kind}, component {kind}")
    for turn in range(STAR_ROUNDS + 1):
        at = members.join(where.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        # a bucket is open while it holds more than one component; its centre is another member in each round
        centre = F.expr(f"min_by(struct(class_id, component), xxhash64({turn}, class_id))")
        mixed = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), centre.alias("centre")).filter("low < high")
        members = materialize(at.join(mixed.select("bucket", "centre"), "bucket").select("bucket", "class_id", "component", "centre"), "open")
        if members.isEmpty():
            break
        if turn < STAR_ROUNDS:
            pairs = members.filter("component <> centre.component").select("class_id", F.col("centre.class_id").alias("other"))
            pairs = pairs.select(F.least("class_id", "other").alias("a"), F.greatest("class_id", "other").alias("b")).distinct()
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            tested = tested.unionByName(pairs)
            found = materialize(confirmed(materialize(_likely(pairs, classes, percent), "likely"), docs, size, percent), "links")
        else:
            suspects = materialize(_suspects(members.drop("centre"), classes, percent).distinct(), "suspects")
            if suspects.isEmpty():
                break
            found = materialize(_confirmed_within(components(suspects), classes, docs, size, percent).distinct(), "links")
        members = members.select("bucket", "class_id")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        where = materialize(components(links), "where")
    return where


def dedupe(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that groups() keeps, one for each group, with their own columns."""
    kept = groups(docs, size, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    few = (kept := materialize(kept, "kept")).count() <= MAX_BROADCAST_IDS
    named = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]) if _repeats(docs) else docs.filter("doc_id IS NOT NULL")
    return named.join(F.broadcast(kept) if few else kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty()
