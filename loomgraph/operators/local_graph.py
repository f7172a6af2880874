"""What one task does on a bounded block of edges: strong components, reachability of many starts at once, paths and cycles."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

BITS = 64


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted distinct names in all columns, and the columns as numbers of names."""
    names, numbers = np.unique(np.concatenate(columns), return_inverse=True)
    return names, np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])


class Adjacency:
    """Edges between numbered nodes by their source: the targets of node i are targets[first[i]:first[i + 1]]."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.names, (s, d) = numbered(src, dst)
        number = np.int32 if max(len(self.names), len(s)) < 1 << 31 else np.int64
        order = np.lexsort((d, s))
        self.order = order.astype(number)  # edge numbers of those given, by source
        self.targets = d[order].astype(number)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=len(self.names)))]).astype(number)

    def __len__(self) -> int:
        return len(self.names)

    def find(self, names: np.ndarray) -> np.ndarray:
        """Numbers of names, -1 for those without edges."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def steps(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each out-edge of nodes: the place of its source among nodes, and its target."""
        many = self.first[nodes + 1] - self.first[nodes]
        place = np.repeat(np.arange(len(nodes)), many)
        return place, self.targets[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[nodes], many)]


#: Rounds in which nodes that are on no cycle are taken away before the depth-first walk.
_PEELED = 1000


def _peeled(graph: Adjacency) -> np.ndarray:
    """Whether each node is left when nodes without in- or out-edges are taken away again and again, _PEELED times at most."""
    left = np.ones(len(graph), bool)
    out = np.diff(graph.first)
    src = np.repeat(np.arange(len(graph), dtype=graph.targets.dtype), out)
    by_target = np.argsort(graph.targets, kind="stable")
    into = np.bincount(graph.targets, minlength=len(graph))
    back = Adjacency.__new__(Adjacency)
    back.targets, back.first = src[by_target], np.concatenate([[0], np.cumsum(into)])
    for ahead, waits in ((graph, into), (back, out)):
        front = np.flatnonzero((waits == 0) & left)
        for _ in range(_PEELED):
            if not len(front):
                break
            left[front] = False
            met, times = np.unique(ahead.steps(front)[1], return_counts=True)
            waits[met] -= times.astype(waits.dtype)
            front = met[(waits[met] == 0) & left[met]]
    return left


def strong(graph: Adjacency) -> np.ndarray:
    """Of each node, the least node of its strong component; one depth-first walk over the edges that can be on cycles."""
    left = _peeled(graph)
    kept = np.flatnonzero(left)
    at, ahead = graph.steps(kept)
    at, ahead = at[left[ahead]], np.searchsorted(kept, ahead[left[ahead]])
    unit = np.arange(len(graph), dtype=np.int64)
    unit[kept] = kept[_walked(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(kept)))]), ahead)]
    return unit


def _walked(firsts: np.ndarray, aheads: np.ndarray) -> np.ndarray:
    n, first, targets = len(firsts) - 1, firsts.tolist(), aheads.tolist()
    seen, low, unit = [-1] * n, [0] * n, list(range(n))
    open_: list[int] = []
    is_open = bytearray(n)
    clock = 0
    for start in range(n):
        if seen[start] >= 0:
            continue
        walk = [(start, first[start])]
        seen[start] = low[start] = clock
        clock += 1
        open_.append(start)
        is_open[start] = 1
        while walk:
            node, edge = walk.pop()
            while edge < first[node + 1]:
                ahead = targets[edge]
                edge += 1
                if seen[ahead] < 0:
                    walk.append((node, edge))
                    node, edge = ahead, first[ahead]
                    seen[node] = low[node] = clock
                    clock += 1
                    open_.append(node)
                    is_open[node] = 1
                elif is_open[ahead] and seen[ahead] < low[node]:
                    low[node] = seen[ahead]
            if low[node] == seen[node]:
                at = len(open_) - 1
                while open_[at] != node:
                    at -= 1
                members, least = open_[at:], min(open_[at:])
                del open_[at:]
                for m in members:
                    is_open[m] = 0
                    unit[m] = least
            if walk and low[node] < low[walk[-1][0]]:
                low[walk[-1][0]] = low[node]
    return np.array(unit, np.int64)


def _or_by(nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes, and all bits given for each."""
    order = np.argsort(nodes, kind="stable")
    distinct, at = np.unique(nodes[order], return_index=True)
    return distinct, np.bitwise_or.reduceat(bits[order], at) if len(at) else bits[:0]


def spread(graph: Adjacency, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level by level, the nodes that are new to some of at most BITS starts: depth, start (its place) and node."""
    seen = np.zeros(len(graph), np.uint64)
    nodes, bits, depth = starts, np.uint64(1) << np.arange(len(starts), dtype=np.uint64), 0
    while len(nodes):
        node, start = np.nonzero((bits[:, None] >> np.arange(len(starts), dtype=np.uint64)[None, :]) & np.uint64(1))
        yield depth, start, nodes[node]
        seen[nodes] |= bits
        place, ahead = graph.steps(nodes)
        nodes, bits = _or_by(ahead, bits[place])
        bits &= ~seen[nodes]
        nodes, bits = nodes[bits != 0], bits[bits != 0]
        depth += 1


#: Starts that walk together as pairs (start, node), and how many pairs they may come to before they walk as bits.
STARTS, PAIRS = 1 << 12, 1 << 20


def spread_many(graph: Adjacency, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """spread for any number of starts: as sorted pairs while these are few, otherwise BITS starts at a time.

    Pairs cost nothing for each start and level by themselves, which is most of the work where starts reach little.
    """
    for at in range(0, len(starts), STARTS):
        part = starts[at : at + STARTS]
        levels = _spread_pairs(graph, part)
        if levels is not None:
            yield from ((depth, start + at, node) for depth, start, node in levels)
            continue
        for low in range(0, len(part), BITS):
            yield from ((depth, start + at + low, node) for depth, start, node in spread(graph, part[low : low + BITS]))


def _spread_pairs(graph: Adjacency, starts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]] | None:
    """The levels of spread; None if there are more than PAIRS pairs, seen ones counted again in each level."""
    n, levels, work = len(graph), [], 0
    new = seen = np.arange(len(starts), dtype=np.int64) * n + starts
    active = len(starts)
    while len(new):
        work += len(seen)
        if work > PAIRS:
            return None
        start, node = np.divmod(new, n)
        levels.append((len(levels), start, node))
        place, ahead = graph.steps(node)
        new = np.unique(start[place] * n + ahead)
        at = np.searchsorted(seen, new)
        fresh = seen[np.minimum(at, len(seen) - 1)] != new
        seen, new = np.insert(seen, at[fresh], new[fresh]), new[fresh]
        going = np.unique(new // n)
        if 2 * len(going) < active:  # starts that have ended meet nothing any more
            seen, active = seen[np.isin(seen // n, going)], len(going)
    return levels


class Condensed:
    """The acyclic graph of strong components, by topological level: each edge is used once for BITS starts."""

    def __init__(self, graph: Adjacency):
        unit = strong(graph)
        self.units, self.unit_of = np.unique(unit, return_inverse=True)
        self.members = np.argsort(self.unit_of, kind="stable")
        self.first = np.searchsorted(self.unit_of[self.members], np.arange(len(self.units) + 1))
        src = np.repeat(self.unit_of, np.diff(graph.first))
        pairs = np.unique(np.stack([src, self.unit_of[graph.targets]], 1)[src != self.unit_of[graph.targets]], axis=0)
        src, dst = (pairs[:, 0], pairs[:, 1]) if len(pairs) else (np.empty(0, np.int64),) * 2
        waits = np.bincount(dst, minlength=len(self.units))
        begins = np.searchsorted(src, np.arange(len(self.units) + 1))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # edges of the units of each level, sorted by target
        ready = np.flatnonzero(waits == 0)
        while len(ready):
            many = begins[ready + 1] - begins[ready]
            edge = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begins[ready], many)
            edge = edge[np.argsort(dst[edge], kind="stable")]
            self.levels.append((src[edge], dst[edge]))
            reached, times = np.unique(dst[edge], return_counts=True)
            waits[reached] -= times
            ready = reached[waits[reached] == 0]

    def reach(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start (its place) and node for all nodes that at most BITS starts reach, each start itself included."""
        row = np.zeros(len(self.units), np.uint64)
        np.bitwise_or.at(row, self.unit_of[starts], np.uint64(1) << np.arange(len(starts), dtype=np.uint64))
        for src, dst in self.levels:
            reached, at = np.unique(dst, return_index=True)
            if len(at):
                row[reached] |= np.bitwise_or.reduceat(row[src], at)
        units = np.flatnonzero(row)
        unit, start = np.nonzero((row[units, None] >> np.arange(len(starts), dtype=np.uint64)[None, :]) & np.uint64(1))
        unit = units[unit]
        many = self.first[unit + 1] - self.first[unit]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[unit], many)
        return np.repeat(start, many), self.members[place]


def chains(graph: Adjacency, start: int, max_len: int | None) -> Iterator[list[int] | None]:
    """Simple paths from start that end where every step leads back into the path, as edge numbers; None for one of more than max_len nodes."""
    first, targets = graph.first.item, graph.targets.item  # the whole arrays as lists would cost each start the whole graph
    path, on_path, taken = [(start, first(start))], {start}, []
    went = [False]
    while path:
        node, edge = path.pop()
        stop = first(node + 1)
        while edge < stop and targets(edge) in on_path:
            edge += 1
        if edge < stop:
            if max_len is not None and len(path) + 2 > max_len:
                yield None
                return
            ahead = targets(edge)
            path += [(node, edge + 1), (ahead, first(ahead))]
            went[-1] = True
            went.append(False)
            on_path.add(ahead)
            taken.append(edge)
            continue
        if not went.pop():
            yield list(taken)
        on_path.discard(node)
        if taken:
            taken.pop()


def _around(out: list[list[int]], back: list[list[int]], start: int) -> set[int]:
    """The nodes from start up that are reached from it and reach it, by nodes from start up."""
    both = []
    for step in (out, back):
        found, todo = {start}, [start]
        while todo:
            for x in step[todo.pop()]:
                if x >= start and x not in found:
                    found.add(x)
                    todo.append(x)
        both.append(found)
    return both[0] & both[1]


def circuits(out: list[list[int]], back: list[list[int]], start: int, second: int, max_len: int | None) -> Iterator[list[int] | None]:
    """Elementary cycles whose least node is start and that go on to second; None for an open path of more than max_len nodes.

    A node from which the start wasn't reached stays blocked until a node ahead of it leaves the path.
    """
    if second == start:
        yield [start]
        return
    inside = _around(out, back, start)
    if second not in inside:
        return
    path, blocked, waiting = [start, second], {start, second}, defaultdict(set)
    walk, closed = [iter(out[second])], [False]
    while walk:
        if max_len is not None and len(path) > max_len:
            yield None
            return
        ahead = next((x for x in walk[-1] if x in inside and (x == start or x not in blocked)), None)
        if ahead == start:
            closed[-1] = True
            yield list(path)
        elif ahead is not None:
            path.append(ahead)
            blocked.add(ahead)
            walk.append(iter(out[ahead]))
            closed.append(False)
        else:
            walk.pop()
            node = path.pop()
            if closed.pop():
                if closed:
                    closed[-1] = True
                free = [node]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free += waiting.pop(x, ())
            else:
                for x in out[node]:
                    if x in inside:
                        waiting[x].add(node)


def slot_choices(path: list[int], slots: dict[tuple[int, int], list[str]]) -> Iterator[tuple[str, ...]]:
    """Every choice of slots along a cycle."""
    return itertools.product(*(slots[e] for e in zip(path, [*path[1:], path[0]])))
