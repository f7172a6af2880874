"""Graph operators over slot edges (src, slot, dst).

Graphs of up to LOCAL_EDGES distinct edges (OBJECT_EDGES where nodes aren't integers) are sent to the tasks, which deal the starts among themselves and walk the
edges as arrays. Larger ones are worked on by joins: strong components contract blocks of edges until so few are left,
closures keep a row of BITS starts as the bits of a long for each node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.functions.lineage import cut, drop, new_folder, rows
from loomgraph.operators import local_graph as L

#: Edges that one task holds as arrays of numbers and that are sent to all tasks, at most: some 25 bytes each.
LOCAL_EDGES = 12_000_000
#: The same where nodes have names that aren't integers, or where edges are held as Python objects.
OBJECT_EDGES = 1_000_000
#: A round of contraction that leaves more than this part of the edges is the last one.
SLOW_ROUND = 0.9
_PATHS = 2000
_ROWS = 1 << 16


def _column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


class Kind(str):
    """The name of a column's type, with the Arrow type of its values."""

    arrow: pa.DataType


def _type(df: DataFrame, column: str) -> Kind:
    kind = Kind(df.schema[column].dataType.simpleString())
    kind.arrow = to_arrow_type(df.schema[column].dataType)
    return kind


def _most(edges: DataFrame) -> int:
    """How many of these edges one task holds."""
    return LOCAL_EDGES if _type(edges, edges.columns[0]).arrow in (pa.int64(), pa.int32()) else min(LOCAL_EDGES, OBJECT_EDGES)


def _arrow(values: np.ndarray, kind: Kind) -> pa.Array:
    return pa.array(values.tolist() if values.dtype == object else values, kind.arrow)


def _sent(edges: DataFrame, make) -> Broadcast:
    """make(table of the edges) for every task; the caller has checked that there are at most LOCAL_EDGES of them."""
    return edges.sparkSession.sparkContext.broadcast(make(edges.toArrow()))


def _adjacency(edges: pa.Table) -> L.Adjacency:
    return L.Adjacency(_column(edges, "src"), _column(edges, "dst"))


def _dealt(starts: DataFrame) -> DataFrame:
    """Starts dealt to as many tasks as there are cores."""
    return starts.repartition(max(1, starts.sparkSession.sparkContext.defaultParallelism))


def _in_parts(walk):
    """A function for mapInArrow over starts (node): the record batches that walk gives for some of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = _column(batch, "node")
            for at in range(0, len(names), L.STARTS):
                yield from walk(names[at : at + L.STARTS])

    return run


def build_slot_edges(slots: DataFrame, nodes: DataFrame, stripped: DataFrame | None = None) -> DataFrame:
    """Edges from nodes to the children of their slots (src, slot, children); children that aren't nodes don't count, nor out-edges of stripped nodes."""
    edges = slots.select("src", "slot", F.explode("children").alias("dst"))
    known = nodes.select(F.col("node").alias("dst")).distinct()
    edges = edges.join(known, "dst", "left_semi").select("src", "slot", "dst")
    return edges if stripped is None else edges.join(stripped.select(F.col("node").alias("src")), "src", "left_anti").select("src", "slot", "dst")


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def _known(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    return _pairs(edges).join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst")


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that no other node points to."""
    pointed = _known(edges, nodes).filter("src <> dst").select(F.col("dst").alias("node")).distinct()
    return nodes.select("node").distinct().join(pointed, "node", "left_anti")


def closure(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """root, node and depth (steps on the shortest way) of all that each start reaches; a start outside the graph reaches itself."""
    steps, firsts = cut(_known(edges, nodes)), starts.select("node").distinct()
    out = _local_closure(steps, firsts) if rows(steps) <= _most(steps) else _closure_in_rounds(steps, firsts)
    drop(steps)
    return out


def _levels(graph: L.Adjacency, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """depth, start (its place) and node for all that the starts reach, many levels at once."""
    held, size = [], 0
    for depth, start, node in L.spread_many(graph, starts):
        held.append((np.full(len(node), depth, np.int32), start, node))
        size += len(node)
        if size >= _ROWS:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _local_closure(steps: DataFrame, starts: DataFrame) -> DataFrame:
    kind = _type(starts, "node")
    graph = _sent(steps, _adjacency)

    def walk(names: np.ndarray) -> Iterator[pa.RecordBatch]:
        g, kept = graph.value, ["root", "node", "depth"]
        at = g.find(names)
        lone, known = names[at < 0], names[at >= 0]
        if len(lone):
            yield pa.record_batch([_arrow(lone, kind), _arrow(lone, kind), pa.array(np.zeros(len(lone), np.int32))], names=kept)
        for depth, start, node in _levels(g, at[at >= 0]):
            yield pa.record_batch([_arrow(known[start], kind), _arrow(g.names[node], kind), pa.array(depth)], names=kept)

    return cut(_dealt(starts).mapInArrow(_in_parts(walk), f"root {kind}, node {kind}, depth int"))


def _numbered_starts(starts: DataFrame) -> DataFrame:
    """start, block and bit: each block holds at most BITS starts."""
    number = F.monotonically_increasing_id()
    return cut(starts.select(F.col("node").alias("start"), number.alias("n"))).select("start", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(63).cast("int").alias("bit"))


def _closure_in_rounds(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Level by level over the whole table of edges: a row for each node and block of starts, whose bits say which of them reach it.

    A round joins only the bits that are new, and writes them to a partition of its own that is read once more, for
    the result. What was seen is one table, replaced in each round.
    """
    spark, kind = steps.sparkSession, _type(starts, "node")
    ids = _numbered_starts(starts)
    one = F.expr("shiftleft(1L, bit)")
    base, depth = new_folder(spark), 0
    level = ids.select(F.col("start").alias("node"), "block", one.alias("bits")).groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
    seen = cut(level)
    front = seen
    while rows(front):
        front.write.parquet(f"{base}/depth={depth}")
        depth += 1
        grown = front.join(steps, front["node"] == steps["src"]).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
        fresh = grown.join(seen.withColumnRenamed("bits", "old"), ["node", "block"], "left")
        fresh = cut(fresh.select("node", "block", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0"))
        both = cut(seen.unionByName(fresh).groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))
        drop(*({front, seen}))
        front, seen = fresh, both
    drop(*{front, seen})
    if not depth:
        return ids.select(F.col("start").alias("root"), F.col("start").alias("node"), F.lit(0).alias("depth"))
    levels = spark.read.schema(f"node {kind}, block long, bits long, depth int").parquet(base)
    each = levels.select("node", "block", "depth", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)).alias("bit"))
    return each.join(ids, ["block", "bit"]).select(F.col("start").alias("root"), "node", "depth")


def reachable(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """root and node of all that each start reaches, itself included, over the condensation: strong components stand as one node and are unfolded in the result."""
    steps, firsts = cut(_known(edges, nodes)), starts.select("node").distinct()
    if rows(steps) <= _most(steps):
        out = _local_reach(steps, firsts)
        drop(steps)
        return out
    units = cut(_all_units(steps))
    unit_of = lambda df, c: df.join(units.select(F.col("node").alias(c), F.col("unit").alias(f"__{c}")), c, "left").withColumn(f"__{c}", F.coalesce(f"__{c}", c))
    folded = unit_of(unit_of(steps, "src"), "dst").select(F.col("__src").alias("src"), F.col("__dst").alias("dst")).filter("src <> dst").distinct()
    tops = cut(unit_of(firsts, "node").select("node", F.col("__node").alias("top")))
    found = _closure_in_rounds(cut(folded), tops.select(F.col("top").alias("node")).distinct()).select(F.col("root").alias("top"), F.col("node").alias("unit"))
    members = found.join(units, "unit", "left").select("top", F.coalesce("node", "unit").alias("member"))
    out = cut(tops.join(members, "top").select(F.col("node").alias("root"), F.col("member").alias("node")))
    drop(steps)
    return out


def _local_reach(steps: DataFrame, starts: DataFrame) -> DataFrame:
    kind = _type(starts, "node")

    graph = _sent(steps, _adjacency)

    def walk(names: np.ndarray) -> Iterator[pa.RecordBatch]:
        g = graph.value
        at = g.find(names)
        lone, known = names[at < 0], names[at >= 0]
        if len(lone):
            yield pa.record_batch([_arrow(lone, kind), _arrow(lone, kind)], names=["root", "node"])
        for _, start, node in _levels(g, at[at >= 0]):
            yield pa.record_batch([_arrow(known[start], kind), _arrow(g.names[node], kind)], names=["root", "node"])

    return cut(_dealt(starts).mapInArrow(_in_parts(walk), f"root {kind}, node {kind}"))


def with_parents(closures: DataFrame, edges: DataFrame) -> DataFrame:
    """closures with parent: the least node one step nearer from which a node is reached; null for the start."""
    nearer = closures.select("root", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")).join(_pairs(edges), "src")
    parents = nearer.groupBy("root", F.col("dst").alias("node"), "depth").agg(F.min("src").alias("parent"))
    return closures.join(parents, ["root", "node", "depth"], "left")


def closure_paths(closures: DataFrame, edges: DataFrame) -> DataFrame:
    """closures with parent and path: from the root over the parents to the node.

    A root's rows come to one task by depth, where each path is its parent's and one more; in graphs of more than
    LOCAL_EDGES edges, levels are joined.
    """
    pairs = cut(_pairs(edges))
    closures = cut(with_parents(closures, pairs))
    if rows(pairs) > _most(pairs):
        return _paths_in_rounds(closures)
    drop(pairs)
    kind, own = _type(closures, "node"), closures.select("root", "node", "depth", "parent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = {}
        for batch in batches:
            out = []
            for _, node, depth, parent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if depth == 0:
                    paths = {}  # the next root's
                paths[node] = [*paths[parent], node] if depth else [node]
                out.append(paths[node])
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(kind.arrow))], names=[*batch.schema.names, "path"])

    dealt = own.repartition("root").sortWithinPartitions("root", "depth")
    return dealt.mapInArrow(run, f"root {kind}, node {kind}, depth int, parent {kind}, path array<{kind}>")


def _paths_in_rounds(closures: DataFrame) -> DataFrame:
    """Paths level by level, by joins."""
    front = cut(closures.filter("depth = 0").withColumn("path", F.array("node")))
    found = front
    while rows(front):
        last = front.select("root", F.col("node").alias("parent"), F.col("path").alias("before"))
        depth = F.lit(front.agg(F.max("depth")).first()[0] + 1)
        front = cut(closures.filter(F.col("depth") == depth).join(last, ["root", "parent"]).select(*closures.columns, F.concat("before", F.array("node")).alias("path")))
        found = found.unionByName(front)
    drop(closures)
    return found


def contains_cycle(closures: DataFrame, units: DataFrame) -> DataFrame:
    """root and contains_cycle: whether its closure has a node on a cycle."""
    marks = units.select("node").distinct().withColumn("__cycle", F.lit(True))
    return closures.join(marks, "node", "left").groupBy("root").agg(F.coalesce(F.bool_or("__cycle"), F.lit(False)).alias("contains_cycle"))


def reaches_cycle(edges: DataFrame, starts: DataFrame, units: DataFrame) -> DataFrame:
    """contains_cycle of the closures of all starts, without these: the nodes on cycles are walked up from, each once."""
    found = cycle_auto_reject(edges, units).select(F.col("node").alias("root"), F.lit(True).alias("__cycle"))
    roots = starts.select(F.col("node").alias("root")).distinct()
    return roots.join(found, "root", "left").select("root", F.coalesce("__cycle", F.lit(False)).alias("contains_cycle"))


def all_closures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The closure of every root."""
    return closure(edges, nodes, roots(edges, nodes))


def closure_parents(closures: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted parents of each node of a closure inside it."""
    inner = closures.select("root", "node").join(_pairs(edges), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.col("src").alias("parent"))
    return inner.join(closures.select("root", "node"), ["root", "node"], "left_semi").groupBy("root", "node").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def shared_dependencies(closures: DataFrame) -> DataFrame:
    """Nodes other than roots that are in several closures, with the roots sorted."""
    found = closures.filter("node <> root").groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    return found.filter(F.size("roots") >= 2)


def direct_parents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (node, parent, slot) of the targets, without self edges."""
    own = edges.filter("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("parent"), "slot").distinct()
    return own.join(targets.select("node").distinct(), "node", "left_semi")


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), "slot", F.col("src").alias("dst"))


def ancestors(edges: DataFrame, nodes: DataFrame, targets: DataFrame, include_self: bool = False) -> DataFrame:
    """node and ancestor for all that reach each target."""
    found = reachable(_reversed(edges), nodes, targets).select(F.col("root").alias("node"), F.col("node").alias("ancestor"))
    return found if include_self else found.filter("node <> ancestor")


def _check_length(length: int, max_len: int | None) -> None:
    if max_len is not None and length > max_len:
        raise ValueError(f"a path has more than {max_len} nodes")


def ancestor_chains(edges: DataFrame, nodes: DataFrame, targets: DataFrame, max_len: int | None = None) -> DataFrame:
    """Upward paths from each target that end at a node without parents or before a repeat: node, chain and slots. A path of more than max_len nodes is an error.

    Tasks walk up from their targets and give chains out as they end; more edges than LOCAL_EDGES are joined.
    """
    up = cut(edges.filter("src <> dst").join(_known(edges, nodes), ["src", "dst"], "left_semi").select(F.col("dst").alias("at"), F.col("src").alias("parent"), "slot").distinct())
    if rows(up) > _most(up):
        return _joined_chains(up, targets, max_len)
    kind, slot_kind = _type(targets, "node"), _type(up, "slot")

    def climbed(table: pa.Table):
        graph = L.Adjacency(_column(table, "at"), _column(table, "parent"))
        slots = table.column("slot").combine_chunks().dictionary_encode()
        known = slots.dictionary.to_pylist()
        return graph, slots.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)[graph.order], [*known, None]

    sent = _sent(up, climbed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, slot_of, slots = sent.value

        def found() -> Iterator[tuple]:
            for batch in batches:
                names = _column(batch, "node")
                for name, at in zip(names.tolist(), graph.find(names).tolist(), strict=True):
                    if at < 0:
                        yield [name], [], False
                        continue
                    for taken in L.chains(graph, at, max_len):
                        over = taken is None
                        yield [name, *graph.names[graph.targets[taken or []]].tolist()], [slots[i] for i in slot_of[taken or []].tolist()], over

        yield from _in_batches(found(), kind, slot_kind)

    paths = cut(_dealt(targets.select("node")).mapInArrow(run, f"path array<{kind}>, slots array<string>, over boolean"))
    drop(up)
    return _none_over(paths, max_len).select(F.col("path")[0].alias("node"), F.col("path").alias("chain"), "slots")


def _joined_chains(up: DataFrame, targets: DataFrame, max_len: int | None) -> DataFrame:
    """Chains by joining all open paths with the edges, a step in each round."""
    front = cut(targets.select("node", F.array("node").alias("chain"), F.array().cast("array<string>").alias("slots"), F.col("node").alias("at")))
    done = None
    for length in itertools.count(1):
        _check_length(length, max_len)
        grown = front.join(up, "at", "left")
        ahead = F.col("parent").isNotNull() & ~F.array_contains("chain", F.coalesce("parent", "at"))
        go = grown.filter(ahead).select("node", F.concat("chain", F.array("parent")).alias("chain"), F.concat("slots", F.array("slot")).alias("slots"), F.col("parent").alias("at"))
        stop = cut(grown.groupBy("node", "chain", "slots").agg(F.max(ahead.cast("int")).alias("more")).filter("more = 0").drop("more"))
        done = stop if done is None else done.unionByName(stop)
        front, before = cut(go), front
        drop(before)
        if not rows(front):
            drop(front, up)
            return done


def neighborhood(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """The matches and their neighbours, one step either way."""
    m = matches.select("node").distinct()
    down = edges.join(m.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    up = edges.join(m.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return m.union(down).union(up).distinct()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) left when nodes without in- or out-edges are taken away again and again."""
    core = cut(_pairs(edges))
    while True:
        inner = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        inner = cut(inner.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        done = rows(inner) == rows(core)
        drop(core)
        if done:
            return inner
        core = inner


def strong_components(edges: DataFrame) -> DataFrame:
    """node and unit (its least node) for the nodes on cycles, self edges included.

    Tasks find the units inside blocks of edges and contract them, round by round, until what is left fits one block.
    Where contraction gets stuck, the rest is coloured by labels that spread over the whole table.
    """
    pairs = cut(_pairs(edges))
    units = _all_units(pairs)
    alone = pairs.filter("src = dst").select(F.col("src").alias("node")).join(units.select("node"), "node", "left_anti")
    out = cut(units.unionByName(alone.select("node", F.col("node").alias("unit"))))
    drop(pairs)
    return out


def _all_units(pairs: DataFrame) -> DataFrame:
    """node and unit of the strong components of several nodes."""
    if rows(pairs) <= _most(pairs):
        return _local_units(pairs)
    core, moves, key = _trimmed(pairs), [], "src"
    while (before := rows(core)) > _most(core):
        told = _contracted(core, key)
        moved = cut(told.filter("moved").select(F.col("a").alias("node"), F.col("b").alias("unit")))
        to = lambda c: moved.select(F.col("node").alias(c), F.col("unit").alias(f"__{c}"))  # noqa: B023, E731
        edges = told.filter("NOT moved").select(F.col("a").alias("src"), F.col("b").alias("dst")).join(to("src"), "src", "left").join(to("dst"), "dst", "left")
        left = _trimmed(edges.select(F.coalesce("__src", "src").alias("src"), F.coalesce("__dst", "dst").alias("dst")).filter("src <> dst").distinct())
        drop(core, told)
        core, key = left, "dst" if key == "src" else "src"
        moves.append(moved)
        if rows(core) > SLOW_ROUND * before:
            break
    units = _local_units(core) if rows(core) <= _most(core) else _coloured(core)
    for moved in reversed(moves):
        above = moved.withColumnRenamed("unit", "top").join(units.withColumnRenamed("node", "top"), "top", "left").select("node", F.coalesce("unit", "top").alias("unit"))
        heads = moved.select(F.col("unit").alias("node")).distinct().join(units, "node", "left_anti").select("node", F.col("node").alias("unit"))
        units = cut(units.unionByName(above).unionByName(heads))
    return units


def _local_units(pairs: DataFrame) -> DataFrame:
    """node and unit of the components of several nodes, found in one task; pairs holds at most LOCAL_EDGES rows."""
    kind = _type(pairs, "src")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            graph = _adjacency(pa.Table.from_batches(held))
            unit = L.strong(graph)
            own = np.flatnonzero(np.bincount(unit, minlength=len(graph))[unit] > 1)
            yield pa.record_batch([_arrow(graph.names[own], kind), _arrow(graph.names[unit[own]], kind)], names=["node", "unit"])

    return cut(pairs.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, unit {kind}"))


def _contracted(core: DataFrame, key: str) -> DataFrame:
    """moved, a and b: the components inside blocks of edges as rows (node, its unit) that are moved, and the edges between different units.

    Rows are in ranges of key (src or dst) and a block holds all edges of a key, so that a node is moved by one block
    only. The edges of a key that has more than a block holds pass as they are.
    """
    kind = _type(core, "src")
    limit = min(LOCAL_EDGES, OBJECT_EDGES)
    many = -(-rows(core) // limit)
    names = ["moved", "a", "b"]

    def told(table: pa.Table, contract: bool) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        src, dst = _column(table, "src"), _column(table, "dst")
        if contract:
            graph = L.Adjacency(src, dst)
            unit = L.strong(graph)
            gone = np.flatnonzero(unit != np.arange(len(graph)))
            yield pa.record_batch([pa.array(np.ones(len(gone), bool)), _arrow(graph.names[gone], kind), _arrow(graph.names[unit[gone]], kind)], names=names)
            pairs = np.stack([unit[graph.find(src)], unit[graph.find(dst)]], 1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            src, dst = graph.names[pairs[:, 0]], graph.names[pairs[:, 1]]
        yield pa.record_batch([pa.array(np.zeros(len(src), bool)), _arrow(src, kind), _arrow(dst, kind)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [], None
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = _column(table, key)
            at = int(np.searchsorted(keys, keys[-1]))  # sorted: the last key may go on
            if passing is not None and keys[0] == passing:
                passed = int(np.searchsorted(keys, passing, "right"))
                yield from told(table.slice(0, passed), False)
                table, keys, at = table.slice(passed), keys[passed:], max(at - passed, 0)
            if at:
                yield from told(table.slice(0, at), True)
            elif table.num_rows >= limit:
                yield from told(table, False)
                passing, at = keys[-1], table.num_rows
            held = table.slice(at).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            passed = int(np.searchsorted(_column(table, key), passing, "right")) if passing is not None else 0
            yield from told(table.slice(0, passed), False)
            yield from told(table.slice(passed), True)

    dealt = core.select("src", "dst").repartitionByRange(many, key).sortWithinPartitions(key)
    return cut(dealt.mapInArrow(run, f"moved boolean, a {kind}, b {kind}"))


def _trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs without self edges whose source something points to and whose target points on; the others are on no cycle."""
    pairs = pairs.filter("src <> dst").select("src", "dst")
    inner = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return cut(inner.join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def _coloured(edges: DataFrame) -> DataFrame:
    """node and unit for the nodes on cycles, self edges included, by joins only.

    In the core, each node takes the least label that reaches it; the nodes that reach a label's owner inside its
    colour are a unit. They go, and the rest is coloured again.
    """
    core = cyclic_core(edges)
    found = None
    while rows(core):
        nodes = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
        colour = _spread(core, nodes.withColumn("label", F.col("node")))
        same = core.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b")
        owners = colour.filter("node = label").select("node")
        # a unit's nodes are those from which its owner is reached without leaving the colour
        unit = cut(_reach(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), owners).join(colour, "node"))
        on_cycle = unit.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
        selfish = core.filter("src = dst").select(F.col("src").alias("label"))
        kept = cut(unit.join(on_cycle.union(selfish).distinct(), "label", "left_semi").select("node", F.col("label").alias("unit")))
        found = kept if found is None else found.unionByName(kept)
        gone = unit.select("node")
        rest = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        core, before = cyclic_core(rest), core
        drop(before, colour, unit)
    drop(core)
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("unit")).limit(0)


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Least label that reaches each node (node, label)."""
    front = labels = cut(labels)
    while True:
        given = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        new = cut(given.join(labels, "node").filter("new < label").select("node", F.col("new").alias("label")))
        if front is not labels:
            drop(front)
        front = new
        if not rows(front):
            drop(front)
            return labels
        better = cut(labels.join(front.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        drop(labels)
        labels = better


def _reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """All nodes reached from any start."""
    edges, starts = cut(edges.select("src", "dst")), starts.select("node").distinct()
    if rows(edges) <= _most(edges):
        out = _local_from_any(edges, starts)
        drop(edges)
        return out
    front = cut(starts)
    seen = cut(front)
    while rows(front):
        grown = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = cut(grown.join(seen, "node", "left_anti"))
        both = cut(seen.unionByName(fresh))
        drop(front, seen)
        front, seen = fresh, both
    drop(edges, front)
    return seen


def _local_from_any(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct nodes reached from any start; each task walks the edges once for its starts."""
    kind = _type(starts, "node")
    sent = _sent(edges, _adjacency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = sent.value
        seen = np.zeros(len(graph), bool)
        for batch in batches:
            names = _column(batch, "node")
            at = graph.find(names)
            yield batch.select(["node"]).filter(pa.array(at < 0))
            front = np.unique(at[at >= 0])
            front = front[~seen[front]]
            while len(front):
                seen[front] = True
                yield pa.record_batch([_arrow(graph.names[front], kind)], names=["node"])
                front = np.unique(graph.steps(front)[1])
                front = front[~seen[front]]

    return cut(_dealt(starts).mapInArrow(run, f"node {kind}").distinct())


def elementary_cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """Each simple cycle, once for each choice of slots: path (from its least node) and slots. An open path of more than max_len nodes is an error.

    The edges inside units are sent to the tasks, which deal the first steps of cycles among themselves and search on
    by backtracking with blocked nodes; cycles go out as they are found. More edges than LOCAL_EDGES are joined.
    """
    units = strong_components(edges)
    inner = edges.join(units.select(F.col("node").alias("src"), F.col("unit").alias("a")), "src").join(units.select(F.col("node").alias("dst"), F.col("unit").alias("b")), "dst")
    inner = cut(inner.filter("a = b").select("src", "slot", "dst").distinct())
    if rows(inner) > min(LOCAL_EDGES, OBJECT_EDGES):
        return _joined_cycles(inner, max_len)
    kind, slot_kind = _type(inner, "src"), _type(inner, "slot")

    def searched(table: pa.Table):
        names, (src, dst) = L.numbered(_column(table, "src"), _column(table, "dst"))
        out, back, slots = [[] for _ in names], [[] for _ in names], {}
        for s, d, slot in sorted(zip(src.tolist(), dst.tolist(), table.column("slot").to_pylist(), strict=True), key=lambda e: (e[0], e[1], e[2] or "")):
            if (s, d) not in slots:
                out[s].append(d)
                back[d].append(s)
            slots.setdefault((s, d), []).append(slot)
        return names.tolist(), out, back, slots

    sent = _sent(inner, searched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, back, slots = sent.value
        number = {n: i for i, n in enumerate(names)}

        def found() -> Iterator[tuple]:
            for batch in batches:
                for first, second in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for path in L.circuits(out, back, number[first], number[second], max_len):
                        if path is None:
                            yield None, None, True
                        else:
                            shown = [names[i] for i in path]
                            yield from ((shown, list(chosen), False) for chosen in L.slot_choices(path, slots))

        yield from _in_batches(found(), kind, slot_kind)

    steps = inner.filter("dst >= src").select("src", "dst").distinct()
    cycles = cut(_dealt(steps).mapInArrow(run, f"path array<{kind}>, slots array<{slot_kind}>, over boolean"))
    drop(inner)
    return _none_over(cycles, max_len).select("path", "slots")


def _in_batches(found: Iterator[tuple], kind: Kind, slot_kind: Kind) -> Iterator[pa.RecordBatch]:
    """Rows (path, slots, over) as record batches."""
    while part := list(itertools.islice(found, _PATHS)):
        path, slots, over = zip(*part, strict=True)
        yield pa.record_batch([pa.array(path, pa.list_(kind.arrow)), pa.array(slots, pa.list_(slot_kind.arrow)), pa.array(over)], names=["path", "slots", "over"])


def _none_over(found: DataFrame, max_len: int | None) -> DataFrame:
    if max_len is not None and not found.filter("over").isEmpty():
        raise ValueError(f"a path has more than {max_len} nodes")
    return found


def _joined_cycles(inner: DataFrame, max_len: int | None) -> DataFrame:
    """Cycles by joining all open paths with the edges of units, a step in each round."""
    front = cut(inner.filter("dst >= src").select(F.array("src").alias("path"), F.array("slot").alias("slots"), F.col("src").alias("start"), F.col("dst").alias("at")))
    cycles = None
    for length in itertools.count(1):
        _check_length(length, max_len)
        closed = cut(front.filter("at = start").select("path", "slots"))
        cycles = closed if cycles is None else cycles.unionByName(closed)
        open_ = front.filter("at > start AND NOT array_contains(path, at)")
        front, before = cut(open_.join(inner, open_["at"] == inner["src"]).select(F.concat("path", F.array("at")).alias("path"), F.concat("slots", F.array("slot")).alias("slots"), "start", F.col("dst").alias("at")).filter("at >= start")), front
        drop(before)
        if not rows(front):
            drop(front, inner)
            return cycles


def cycle_edges(cycles: DataFrame) -> DataFrame:
    """The edges of each cycle in order: path, slots, place, src, slot and dst."""
    rows = cycles.select("path", "slots", F.posexplode("path").alias("place", "src"))
    return rows.withColumn("slot", F.get("slots", "place")).withColumn("dst", F.coalesce(F.get("path", F.col("place") + 1), F.get("path", F.lit(0))))


def edge_indegree_over_cycles(cycles: DataFrame) -> DataFrame:
    """How many cycle edges point to each node."""
    return cycle_edges(cycles).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def break_edge(cycles: DataFrame) -> DataFrame:
    """Of each cycle, the edge whose target most cycle edges point to; the first of equals."""
    rows = cycle_edges(cycles).join(edge_indegree_over_cycles(cycles).withColumnRenamed("node", "dst"), "dst")
    best = F.max_by(F.struct("src", "slot", "dst"), F.struct("n", -F.col("place"))).alias("b")
    return rows.groupBy("path", "slots").agg(best).select("path", "slots", "b.src", "b.slot", "b.dst")


def _with_units(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """The nodes and all members of the units they touch."""
    touched = units.join(nodes.select("node").distinct(), "node", "left_semi").select("unit").distinct()
    return nodes.select("node").union(units.join(touched, "unit", "left_semi").select("node")).distinct()


def accept_cascade(edges: DataFrame, targets: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """The targets and all they reach; units touched on the way come in whole."""
    return _cascade(_pairs(edges), targets, units)


def _cascade(steps: DataFrame, targets: DataFrame, units: DataFrame | None) -> DataFrame:
    """What targets reach over steps, and over edges to and from the least member of each unit, which is its name."""
    if units is not None:
        to = units.filter("node <> unit").select(F.col("node").alias("src"), F.col("unit").alias("dst"))
        steps = steps.unionByName(to).unionByName(to.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return _reach(steps, targets)


def reject_cascade(edges: DataFrame, targets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rejected (the targets, all that reach them, with units whole), deselected (what the rejected reach beside them), and partners (other members of the targets' units)."""
    back = _pairs(_reversed(edges))
    rejected = _cascade(back, targets, units)
    deselected = accept_cascade(edges, rejected, units).join(rejected, "node", "left_anti")
    partners = _with_units(targets, units).join(targets.select("node"), "node", "left_anti")
    return rejected, deselected, partners


def reachable_cycle_units(edges: DataFrame, seeds: DataFrame, units: DataFrame) -> DataFrame:
    """Members of the units that the seeds reach."""
    touched = units.join(_reach(_pairs(edges), seeds), "node", "left_semi").select("unit").distinct()
    return units.join(touched, "unit", "left_semi").select("node", "unit")


def cycle_auto_reject(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Nodes on cycles and all that reach them."""
    return _reach(_pairs(_reversed(edges)), units.select("node"))


def cycle_units(edges: DataFrame) -> DataFrame:
    """unit and its sorted members: cycles that share nodes are one unit."""
    return strong_components(edges).groupBy("unit").agg(F.array_sort(F.collect_list("node")).alias("members"))


def cycle_view(edges: DataFrame, rejected: DataFrame) -> DataFrame:
    """Nodes on cycles of the graph with or without its rejected nodes, which is what structural says; blocking if one is left without them."""
    gone = lambda c: rejected.select(F.col("node").alias(c)).distinct()
    left = edges.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti")
    blocking = strong_components(left).select("node").withColumn("blocking", F.lit(True))
    every = strong_components(edges).select("node").withColumn("structural", F.lit(True))
    out = every.join(blocking, "node", "full_outer")
    return out.select("node", F.lit(True).alias("structural"), F.coalesce("blocking", F.lit(False)).alias("blocking"))


def without_cycle_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """The edges that don't stay inside a unit."""
    end = lambda c, name: units.select(F.col("node").alias(c), F.col("unit").alias(name))
    rows = edges.join(end("src", "__a"), "src", "left").join(end("dst", "__b"), "dst", "left")
    return rows.filter(F.coalesce(F.col("__a") != F.col("__b"), F.lit(True))).select(*edges.columns)


def cycle_gate(edges: DataFrame) -> DataFrame:
    """One row: whether cycles block a write, and how many nodes and units are on them."""
    return strong_components(edges).agg((F.count("*") > 0).alias("blocked"), F.count("*").alias("nodes"), F.countDistinct("unit").alias("units"))


def assert_acyclic(edges: DataFrame) -> DataFrame:
    """The edges; reading them fails if there is a cycle."""
    core = cyclic_core(edges).select(F.count("*").alias("n"))
    return edges.crossJoin(core).filter(F.when(F.col("n") > 0, F.raise_error(F.lit("slots form a cycle"))).otherwise(F.lit(True))).drop("n")  # one row of counts


# Severities, the least first.
SEVERITIES = ("ok", "warning", "error")


def _rank(status: str):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.coalesce(status, F.lit("ok")))


def worst_status(closures: DataFrame, status: DataFrame) -> DataFrame:
    """The worst status in each root's closure (root, status); nodes without one are ok."""
    worst = closures.join(status.select("node", "status"), "node", "left").groupBy("root").agg(F.max(_rank("status")).alias("r"))
    return worst.select("root", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int")).alias("status"))


def inherited_status(closures: DataFrame, issues: DataFrame) -> DataFrame:
    """root, status and sources: a root's own issue, else the worst below it with the nodes that have it; issues has node and status."""
    below = closures.join(issues.select("node", "status"), "node").withColumn("r", _rank("status")).filter("r > 1")
    own = F.max(F.when(F.col("depth") == 0, F.col("r")))
    rows = below.groupBy("root").agg(own.alias("own"), F.max("r").alias("worst"), F.collect_list(F.struct("r", "node", "depth")).alias("all"))
    top = F.coalesce("own", "worst")
    sources = F.array_sort(F.transform(F.filter("all", lambda x: (x["r"] == top) & F.when(F.col("own").isNotNull(), x["depth"] == 0).otherwise(F.lit(True))), lambda x: x["node"]))
    return rows.select("root", F.element_at(F.array(*map(F.lit, SEVERITIES)), top.cast("int")).alias("status"), sources.alias("sources"))


def drill_target(closures: DataFrame, issues: DataFrame) -> DataFrame:
    """For roots without an issue of their own, where to go first: the worst severity, then the nearest, then the least node."""
    below = closures.join(issues.select("node", "status"), "node").withColumn("r", _rank("status")).filter("r > 1")
    own = below.filter("depth = 0").select("root")
    best = F.min_by("node", F.struct(-F.col("r"), "depth", "node")).alias("target")
    return below.join(own, "root", "left_anti").groupBy("root").agg(best)


def group_root(keys: DataFrame, closures: DataFrame, units: DataFrame) -> DataFrame:
    """The group each key shows under: itself if on a cycle or a root, else the least root whose closure has it, else itself."""
    first = closures.groupBy("node").agg(F.min("root").alias("__root"))
    marks = units.select("node").distinct().withColumn("__cycle", F.lit(True))
    tops = closures.select(F.col("root").alias("node")).distinct().withColumn("__top", F.lit(True))
    rows = keys.select("node").join(first, "node", "left").join(marks, "node", "left").join(tops, "node", "left")
    return rows.select("node", F.when(F.col("__cycle") | F.col("__top"), F.col("node")).otherwise(F.coalesce("__root", "node")).alias("group_root"))


def scope_counters(nodes: DataFrame, closures: DataFrame, state: DataFrame) -> DataFrame:
    """One row: accepted, rejected and undecided nodes (those without a state), and accepted roots with more than one node."""
    rows = nodes.select("node").join(state.select("node", "state"), "node", "left")
    counts = rows.agg(*(F.count_if(F.coalesce("state", F.lit("undecided")) == s).alias(s) for s in ("accepted", "rejected", "undecided")))
    sizes = closures.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    groups = sizes.join(state.filter("state = 'accepted'").select(F.col("node").alias("root")), "root", "left_semi").agg(F.count("*").alias("accepted_groups"))
    return counts.crossJoin(groups)  # one row each


def group_dependency_counts(closures: DataFrame, state: DataFrame, units: DataFrame) -> DataFrame:
    """Dependencies of each accepted root and members of each cycle unit, cycles first: tier, group_key and n."""
    accepted = state.filter("state = 'accepted'").select(F.col("node").alias("root"))
    plain = closures.filter("node <> root").join(accepted, "root", "left_semi").groupBy(F.col("root").alias("group_key")).agg(F.count("*").alias("n")).withColumn("tier", F.lit(1))
    rings = units.groupBy(F.col("unit").alias("group_key")).agg(F.count("*").alias("n")).withColumn("tier", F.lit(0))
    return rings.unionByName(plain).select("tier", "group_key", "n")
