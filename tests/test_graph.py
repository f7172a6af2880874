"""Walks over blocks of edges and the joins for graphs that don't fit one, against brute force on random graphs."""

import random

import numpy as np
import pytest

from loomgraph.operators import graph as G
from loomgraph.operators import local_graph as L


def random_graph(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def reach_of(pairs, nodes):
    out = {n: {n: 0} for n in nodes}
    for root, depth in out.items():
        front = [root]
        while front:
            front = sorted({b for a, b in pairs if a in front and b not in depth})
            depth.update(dict.fromkeys(front, max(depth.values()) + 1))
    return out


def units_of(reach, pairs):
    unit = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    sizes = [*unit.values()]
    return {a: u for a, u in unit.items() if sizes.count(u) > 1 or (a, a) in pairs}


def cycles_of(pairs):
    found = set()

    def grow(path):
        for a, b in pairs:
            if a == path[-1]:
                if b == path[0]:
                    found.add(tuple(path))
                elif b > path[0] and b not in path:
                    grow([*path, b])

    for n in {a for a, _ in pairs}:
        grow([n])
    return found


def chains_of(pairs, start):
    found = []

    def climb(path):
        ahead = [a for a, b in pairs if b == path[-1] and a not in path]
        if not ahead:
            found.append(tuple(path))
        for a in ahead:
            climb([*path, a])

    climb([start])
    return sorted(found)


@pytest.mark.parametrize("seed", range(60))
def test_walks_of_one_block(seed):
    pairs = random_graph(seed, 2 + seed % 7, 3 + seed % 14)
    graph = L.Adjacency(*(np.array(x) for x in zip(*pairs)))
    names = graph.names.tolist()
    reach = reach_of(pairs, names)
    every = np.arange(len(names))
    assert L.strong(graph).tolist() == [names.index(min(b for b in reach[a] if a in reach[b])) for a in names]
    start, node = L.Condensed(graph).reach(every)
    assert sorted(zip(start.tolist(), node.tolist())) == sorted((names.index(a), names.index(b)) for a in names for b in reach[a])
    levels = {(s, n): d for d, starts, nodes in L.spread(graph, every) for s, n in zip(starts.tolist(), nodes.tolist())}
    assert levels == {(names.index(a), names.index(b)): d for a in names for b, d in reach[a].items()}


def test_a_long_path_needs_no_recursion():
    n = 50_000
    ring = L.Adjacency(np.arange(n), np.roll(np.arange(n), -1))
    assert set(L.strong(ring).tolist()) == {0}
    assert sum(1 for _ in L.circuits([[(i + 1) % n] for i in range(n)], [[(i - 1) % n] for i in range(n)], 0, 1, None)) == 1
    assert len(next(L.chains(ring, 0, None))) == n - 1


PAIRS = random_graph(7, 16, 18) + [(100 + i, 100 + (i + 1) % 4) for i in range(4)] + [(5, 100), (103, 7), (200, 200), (3, 5)]


@pytest.mark.parametrize("limit", [1_000_000, 9, 0])
def test_large_graphs_give_the_same(spark, monkeypatch, limit):
    """limit 9 contracts blocks of nine edges in several rounds, 0 leaves all to joins."""
    monkeypatch.setattr(G, "LOCAL_EDGES", limit or 1)
    monkeypatch.setattr(G, "SLOW_ROUND", 0.97)
    pairs = sorted(set(PAIRS)) if limit != 9 else sorted(set(PAIRS) - {(a, b) for a, b in PAIRS if b < a < 100})
    e = spark.createDataFrame([(f"n{a:03}", "s", f"n{b:03}") for a, b in pairs], "src string, slot string, dst string")
    names = sorted({x for p in pairs for x in p})
    n = spark.createDataFrame([(f"n{a:03}",) for a in names], "node string")
    reach = reach_of(pairs, names)
    shown = lambda x: f"n{x:03}"
    units = {(r.node, r.unit) for r in G.strong_components(e).collect()}
    assert units == {(shown(a), shown(u)) for a, u in units_of(reach, pairs).items()}
    closed = G.closure(e, n, n)
    found = closed.collect()
    assert {(r.root, r.node, r.depth) for r in found} == {(shown(a), shown(b), d) for a in names for b, d in reach[a].items()} and len(found) == sum(map(len, reach.values()))
    few = G.closure_paths(closed.filter("root IN ('n005', 'n100', 'n200')"), e).collect()
    assert len(few) == sum(len(reach[x]) for x in (5, 100, 200))
    for r in few:
        way = [int(x[1:]) for x in r.path]
        assert shown(way[0]) == r.root and shown(way[-1]) == r.node and len(way) == r.depth + 1
        # each step back goes to the least node one step nearer
        assert all(a == min(x for x, y in pairs if y == b and reach[way[0]].get(x) == d) for d, (a, b) in enumerate(zip(way, way[1:])))
    up = [(r.node, r.ancestor) for r in G.ancestors(e, n, n.filter("node < 'n100'")).collect()]
    assert sorted(up) == sorted((shown(b), shown(a)) for a in names for b in reach[a] if a != b and b < 100)
    starts = spark.createDataFrame([("n005",), ("n999",)], "node string")
    assert {r.node for r in G.accept_cascade(e, starts).collect()} == {"n999", *map(shown, reach[5])}


def test_hot_sources_pass_contraction(spark, monkeypatch):
    """A node with more edges than a block holds, between units that are contracted around it."""
    monkeypatch.setattr(G, "LOCAL_EDGES", 10)
    pairs = [(50, i) for i in range(14)] + [(i, i + 1) for i in range(8)] + [(8, 50)] + [(70 + i, 70 + (i + 1) % 3) for i in range(3)]
    e = spark.createDataFrame([(a, "s", b) for a, b in pairs], "src long, slot string, dst long")
    want = units_of(reach_of(pairs, {x for p in pairs for x in p}), pairs)
    assert {(r.node, r.unit) for r in G.strong_components(e).collect()} == set(want.items())


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_cycles_and_chains_with_slots(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "LOCAL_EDGES", limit)
    pairs = random_graph(3, 6, 10)
    e = spark.createDataFrame([(a, s, b) for a, b in pairs for s in ("x", "y")[: 1 + (a + b) % 2]], "src long, slot string, dst long")
    n = spark.createDataFrame([(i,) for i in range(7)], "node long")
    slots = lambda a, b: 1 + (a + b) % 2
    found = G.elementary_cycles(e).collect()
    by_path = {}
    for r in found:
        by_path.setdefault(tuple(r.path), set()).add(tuple(r.slots))
    want = cycles_of(pairs)
    assert set(by_path) == want and sum(map(len, by_path.values())) == len(found)
    assert all(len(by_path[p]) == np.prod([slots(a, b) for a, b in zip(p, [*p[1:], p[0]])]) for p in want)
    up = [(a, b) for a, b in pairs if a != b]
    chains = G.ancestor_chains(e, n, n).collect()
    assert sorted({tuple(r.chain) for r in chains}) == sorted({c for i in range(7) for c in chains_of(up, i)})
    assert len(chains) == sum(int(np.prod([slots(a, b) for a, b in zip(c, c[1:])])) for i in range(7) for c in chains_of(up, i))


def test_entries_go_until_what_is_left_is_valid(spark):
    """Two rounds of offenders, the second only seen after the first; then the targets of the edges that break cycles."""
    from loomgraph.operators.inspection import exclude_until_valid

    e = spark.createDataFrame([(a, "s", b) for a, b in [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5)]], "src long, slot string, dst long")
    n = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    rounds = []

    def offenders(left):
        rounds.append(sorted(r.node for r in left.collect()))
        return left.filter(f"node IN ({'5' if len(rounds) == 1 else '8' if len(rounds) == 2 else '7'})")

    got = {r.node for r in exclude_until_valid(e, n, offenders).collect()}
    assert rounds == [[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 6, 7, 8]]
    assert got == {1, 3, 4, 6, 7}  # the cycle 1, 2, 3 breaks at its first edge, whose target is 2; 6 is on none any more


def test_a_start_costs_no_more_than_it_reaches(spark):
    """Chains of one start don't turn the whole graph into lists, and nodes on no cycle are left out of the depth-first walk."""

    class Whole(np.ndarray):
        def tolist(self):
            raise AssertionError("the whole graph as a list")

    graph = L.Adjacency(np.array([0, 1, 1, 5, 6, 6]), np.array([1, 2, 3, 6, 5, 7]))
    graph.first, graph.targets = graph.first.view(Whole), graph.targets.view(Whole)
    assert [[int(graph.targets[e]) for e in taken] for taken in L.chains(graph, 0, None)] == [[1, 2], [1, 3]]
    assert L._peeled(L.Adjacency(np.array([0, 1, 1, 5, 6, 6]), np.array([1, 2, 3, 6, 5, 7]))).tolist() == [False] * 4 + [True] * 2 + [False]
    assert L.strong(L.Adjacency(np.array([0, 1, 1, 5, 6, 6]), np.array([1, 2, 3, 6, 5, 7]))).tolist() == [0, 1, 2, 3, 4, 4, 6]
    numbers, names = (spark.createDataFrame([], f"src {t}, dst {t}") for t in ("long", "string"))
    assert (G._most(numbers), G._most(names)) == (G.LOCAL_EDGES, G.OBJECT_EDGES)
    slots = spark.createDataFrame([(1, None, 2), (2, "s", 3)], "src long, slot string, dst long")
    nodes = spark.createDataFrame([(3,)], "node long")
    assert [tuple(r) for r in G.ancestor_chains(slots, nodes.union(slots.select("src")), nodes).collect()] == [(3, [3, 2, 1], ["s", None])]


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_many_starts_walk_together(monkeypatch, most):
    rng = np.random.default_rng(5)
    graph = L.Adjacency(rng.integers(0, 900, 950), rng.integers(0, 900, 950))
    starts = rng.permutation(len(graph))
    want = {(int(s) + at, int(n), d) for at in range(0, len(starts), L.BITS) for d, first, nodes in L.spread(graph, starts[at : at + L.BITS]) for s, n in zip(first, nodes)}
    calls = []
    monkeypatch.setattr(L, "PAIRS", most)
    monkeypatch.setattr(L.Adjacency, "steps", lambda self, nodes, own=L.Adjacency.steps: calls.append(1) or own(self, nodes))
    got = [(int(s), int(n), d) for d, first, nodes in L.spread_many(graph, starts) for s, n in zip(first, nodes)]
    assert len(got) == len(set(got)) and set(got) == want
    depth = max(d for *_, d in want) + 1
    assert most < len(want) or len(calls) <= depth  # not once more for every 64 starts


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_cycles_below_starts_need_no_closures(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "LOCAL_EDGES", limit)
    pairs = sorted(set(PAIRS))
    e = spark.createDataFrame([(a, "s", b) for a, b in pairs], "src long, slot string, dst long")
    n = spark.createDataFrame([(x,) for x in [*sorted({x for p in pairs for x in p}), 999, 999]], "node long")
    units = G.strong_components(e)
    want = sorted(tuple(r) for r in G.contains_cycle(G.closure(e, n, n), units).collect())
    assert {c for _, c in want} == {True, False} and (999, False) in want
    monkeypatch.setattr(G, "closure", None)
    assert sorted(tuple(r) for r in G.reaches_cycle(e, n, units).collect()) == want
