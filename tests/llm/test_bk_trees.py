"""Fingerprints, BK-trees and their groups against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import bk_trees

DOCS = "doc_id long, text string, fingerprint string, component_id string, shard string"


def union(n, pairs):
    least = list(range(n))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return [find(i) for i in range(n)]


def close(values, radius=4):
    x, y = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    return list(zip(x.tolist(), y.tolist()))


def flipped(r, x, bits):
    for b in r.sample(range(64), bits):
        x ^= 1 << b
    return x


def test_trees_find_all_within_the_radius():
    r = random.Random(1)
    values = np.array(list({flipped(r, x, r.randrange(6)) for x in [r.getrandbits(64) for _ in range(150)] for _ in range(5)}), np.uint64)
    starts = np.array([0, 200, 201, 450, len(values)])
    trees = bk_trees.Trees(values, starts)
    assert sorted(trees.place.tolist()) == list(range(len(values)))
    # the tree that inserting one after the other gives: no two children of a node at the same distance
    assert len(set(trees.edges.tolist())) == len(trees.edges) and (np.diff(trees.edges) > 0).all()
    roots = np.repeat(np.arange(4), np.diff(starts))
    for radius in (0, 2, 4):
        got = {p for q, v in trees.within(values, roots, radius) for p in zip(q.tolist(), v.tolist())}
        want = {(x + s, y + s) for s, e in zip(starts[:-1], starts[1:]) for x, y in close(values[s:e], radius)}
        assert got == want


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_every_link_meets_in_a_shard(spark, blocks):
    r = random.Random(2)
    pairs = [(x := r.getrandbits(64), flipped(r, x, r.randrange(5))) for _ in range(300)]
    signed = [tuple(int(np.uint64(v).view(np.int64)) for v in p) for p in pairs]
    df = spark.createDataFrame(signed, "a long, b long")
    keys = [bk_trees.shard_keys(F.col(c), blocks, 4) for c in "ab"]
    assert df.filter(F.arrays_overlap(*keys)).count() == 300


def test_components_of_fingerprints(spark, monkeypatch):
    """Clusters around centres, with shards so small that most are cut into blocks."""
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(4)]
    chained = [base[0]]
    for _ in range(60):
        chained.append(flipped(r, chained[-1], 3))
    values = list({*chained, *(flipped(r, x, r.randrange(1, 9)) for x in base for _ in range(150)), *(r.getrandbits(64) for _ in range(100)), 0, 1 << 63, (1 << 64) - 1})
    arr = np.array(values, np.uint64)
    want = union(len(arr), close(arr))
    nodes = spark.createDataFrame([(int(v), i % 7 + 1) for i, v in enumerate(arr.view(np.int64).tolist())], "fingerprint long, copies long")
    for shard in (4096, 16, 3):
        monkeypatch.setattr(bk_trees, "SHARD", shard)
        found = {x.node: x.component for x in bk_trees.fingerprint_components(nodes).collect()}
        own = [found.get(v, v) for v in arr.view(np.int64).tolist()]
        assert len(set(zip(own, want))) == len(set(own)) == len(set(want))


def test_groups_of_texts(spark):
    r = random.Random(6)
    word = lambda: f"W{r.randrange(300)}é"
    long = [word() for _ in range(400)]
    texts = ["", None, " \n\t", "One", "one", "one two three four", "ONE two\nthree   four", "one two three four five", " ".join(long), " ".join(long[:399]), " ".join([*long[:200], "new", *long[201:]]), " ".join(word() for _ in range(50))]
    texts += [" ".join(word() for _ in range(r.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(3, "One", "x", "y", "z"), (None, "", "x", "y", "z"), (None, "only here", "x", "y", "z")], DOCS).repartition(4)
    # the same hash by Spark's own function, bits counted one by one
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    runs = docs.select("doc_id", words.alias("w")).filter("size(w) > 0").select("doc_id", F.expr("explode(transform(sequence(1, greatest(size(w) - 3, 1)), i -> array_join(slice(w, i, 4), ' ')))").alias("s"))
    hashes = {}
    for doc, h in runs.select("doc_id", F.xxhash64("s")).collect():
        hashes.setdefault(doc, []).append(h)
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes.get(i, [])) > len(hashes.get(i, []))) for i in range(len(texts))]
    prints[3] = prints[4]  # id 3 stands twice, with the same hash each
    least = union(len(texts), close(np.array(prints, np.uint64)))
    got = bk_trees.groups(docs).collect()
    assert len(got) == len(texts) + 3
    rows = {(x.doc_id, x.fingerprint, x.component_id) for x in got}
    assert {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, least))} <= rows
    assert (None, "0" * 16, 0) in rows and sum(x.doc_id is None and x.component_id is None for x in got) == 1
    assert bk_trees.groups(docs.limit(0)).count() == 0
