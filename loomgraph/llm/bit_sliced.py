"""Exact top-k by a bit-sliced index.

Vectors are quantised to integers; a block of the index keeps, for each attribute and bit, a bitmap of its rows. A
query's inner product with all rows of a block is built as bit slices too: the attribute slices that the query's
coefficients select are summed by full adders over bitmaps. The top rows are then picked from the most significant
slice downward, and rows that tie at the border are resolved by the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import tiles

SCALE, K, EVERY = 256, 5, 50
BLOCK_ROWS, TILE_QUERIES = 16_384, 4096


def quantised(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Whole numbers; components so large that an inner product might leave 64 bits are an error."""
    found = np.floor(scale * x)
    if np.abs(found).max(initial=0) ** 2 * x.shape[1] >= 2.0**61:
        raise ValueError("components are too large: an inner product of 64 bits can't hold theirs")
    return found.astype(np.int64)


def build(ids: np.ndarray, x: np.ndarray, scale: int = SCALE) -> dict[str, bytes | int]:
    """Slices of a block: for each attribute its least value, and bitmaps of the bits above it."""
    q = quantised(x, scale)
    low = q.min(axis=0)
    up = (q - low).astype(np.uint64)
    bits = max(1, int(up.max()).bit_length())
    words = -(-len(ids) // 64)
    planes = np.zeros((x.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((up.T >> np.uint64(b)) & np.uint64(1) == 1, axis=1, bitorder="little")
        planes[:, b, : packed.shape[1]] = packed
    return {"rows": len(ids), "bits": bits, "ids": ids.astype(np.int64).tobytes(), "low": low.tobytes(), "slices": planes.tobytes()}


_SCHEMA = "rows long, bits long, ids binary, low binary, slices binary"


def add_slices(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps, levels[i] holding stacks of bitmaps that count 2^i each: the sum's slices, the least significant first.

    A full adder turns three bitmaps of a level into one there and one a level up.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(levels):
        rows = np.concatenate(levels[i]) if levels[i] else None
        while rows is not None and len(rows) > 1:
            if i + 1 == len(levels):
                levels.append([])
            if len(rows) == 2:
                levels[i + 1].append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
                break
            n = len(rows) // 3
            a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
            x = a ^ b
            levels[i + 1].append((a & b) | (x & c))
            x ^= c
            rows = np.concatenate([x, rows[3 * n :]])
        out.append(rows[0] if rows is not None else None)
        i += 1
    return out


def inner_products(slices: np.ndarray, low: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of the inner products with a query of integers, and the number to add to each.

    A negative coefficient takes the complement of its attribute's slices, so that all terms are positive.
    """
    bits = slices.shape[1]
    levels: list[list[np.ndarray]] = [[] for _ in range(bits + int(np.abs(query).max(initial=0)).bit_length())]
    size = np.abs(query)
    for k in range(int(size.max(initial=0)).bit_length()):
        chosen = np.flatnonzero(size >> k & 1)
        if len(chosen):
            picked = slices[chosen]
            flip = query[chosen] < 0
            picked[flip] = ~picked[flip]
            for b in range(bits):
                levels[k + b].append(picked[:, b])
    shift = int(query @ low) - int(size[query < 0].sum()) * ((1 << bits) - 1)
    empty = np.zeros(slices.shape[2], np.uint64)
    return [empty if x is None else x for x in add_slices(levels)], shift


def top_rows(slices: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows with the highest numbers among those of a bitmap, ties to lower positions."""
    sure, maybe = np.zeros_like(among), among
    for s in reversed(slices):
        both = sure | (maybe & s)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            maybe = maybe & s
        else:
            sure, maybe = both, maybe & ~s
            if n == k:
                break
    first = positions(sure)
    return np.concatenate([first, positions(maybe)[: k - len(first)]]) if len(first) < k else first


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(row: dict, query_ids: np.ndarray, queries: np.ndarray, k: int = K, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
    slices = np.frombuffer(row["slices"], np.uint64).reshape(len(low), row["bits"], -1)
    everyone = np.zeros(slices.shape[2] * 8, np.uint8)
    whole = np.packbits(np.ones(len(ids), bool), bitorder="little")
    everyone[: len(whole)] = whole
    asked, got, scores = [], [], []
    for query_id, query in zip(query_ids, quantised(queries, scale), strict=True):
        sums, shift = inner_products(slices, low, query)
        among = everyone.copy()
        for i in range(*np.searchsorted(ids, [query_id, query_id + 1])):
            among[i >> 3] &= ~np.uint8(1 << (i & 7))
        rows = top_rows(sums, among.view(np.uint64), k)
        value = np.full(len(rows), shift, np.int64)
        for i, s in enumerate(sums):
            value += (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << i
        asked.append(np.full(len(rows), query_id))
        got.append(ids[rows])
        scores.append(value)
    return tuple(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (asked, got, scores))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products of quantised vectors (vec_id, embedding).

    Queries are the rows whose vec_id is divisible by every, each against all rows with another vec_id. Rows whose
    vector is null or has a null, NaN or infinite component take no part, nor do empty vectors and null ids. Repeated
    rows count as candidates as often as they are there, and once as queries. Extra columns are left out; an empty
    table gives none. Vectors of different lengths and components over about 1e6 are errors.
    """
    rows = tiles.usable(vectors, zero=True)
    index = tiles.blocks(rows, block_rows, lambda ids, x: build(ids, x, scale), _SCHEMA)
    asked = tiles.query_tiles(rows.filter(F.col("vec_id") % every == 0), tile_queries)
    return tiles.nearest(index, asked, lambda row, ids, x: search(row, ids, x, k, scale), tiles.kind_of(rows), k, "long", F.desc)
