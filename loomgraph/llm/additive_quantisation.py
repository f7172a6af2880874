"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several full-dimensional codebooks. Codebooks start as
residual k-means of a bounded sample and are then fitted jointly: beam-search encoding and least squares in turn.
The index keeps codes and the norms of the coded vectors. A query makes a table of its inner products with all
codewords; a row's distance is its norm less twice the sum of looked-up products. Each block's best rows by that are
reranked by exact distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import tiles
from loomgraph.llm.common import small_table

K, EVERY = 10, 100
#: Codebooks and their size, beam width, rounds of joint fitting, and the rows (by hash order) they are fitted on at most.
BOOKS, WORDS, BEAM, ROUNDS, SAMPLE, RIDGE = 16, 256, 4, 1, 10_000, 1.0
BLOCK_ROWS, TILE_QUERIES = 16_384, 4096
#: Rows of a block that a query reranks exactly.
SHORTLIST = 400


def _sums(groups: np.ndarray, x: np.ndarray, count: int) -> np.ndarray:
    """Sums of the rows of x by group."""
    return (groups[None, :] == np.arange(count)[:, None]).astype(np.float32) @ x.astype(np.float32)


def _kmeans(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)]
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]))])
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        counts, sums = np.bincount(near, minlength=k), _sums(near, x, k)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Codebooks (books, words, dimensions)."""
    random, rest, out = np.random.default_rng(seed), sample.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, random)
        rest = rest - centres[np.argmin((centres**2).sum(1)[None, :] - 2 * rest @ centres.T, axis=1)]
        out.append(centres)
    code = np.stack(out)
    for _ in range(rounds):
        places = encode(sample, code, beam).astype(np.int64) + np.arange(books) * words
        pairs, sums = np.empty((books * words, books * words), np.float32), np.empty((books * words, sample.shape[1]), np.float32)
        for i in range(books):
            own = slice(i * words, (i + 1) * words)
            sums[own] = _sums(places[:, i] - i * words, sample, words)
            for j in range(books):
                both = (places[:, i] - i * words) * words + places[:, j] - j * words
                pairs[own, j * words : (j + 1) * words] = np.bincount(both, minlength=words * words).reshape(words, words)
        pairs[np.diag_indices(len(pairs))] += RIDGE
        code = np.linalg.solve(pairs, sums).astype(np.float64).reshape(code.shape)
    return code


def encode(x: np.ndarray, code: np.ndarray, beam: int = BEAM, rows: int = 2048) -> np.ndarray:
    """Codes (rows, books) found by beam search: each book extends the best partial sums, and the best `beam` go on."""
    return np.concatenate([_encode(x[i : i + rows], code, beam) for i in range(0, len(x), rows)]) if len(x) else np.empty((0, len(code)), np.uint8)


def _encode(x: np.ndarray, code: np.ndarray, beam: int) -> np.ndarray:
    rest, lost, picks = x[:, None, :], (x**2).sum(1)[:, None], np.empty((len(x), 1, 0), np.uint8)
    for book in code:
        error = lost[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
        flat = error.reshape(len(x), -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(flat, width - 1, axis=1)[:, :width]
        parent, word = best // len(book), best % len(book)
        take = lambda a: np.take_along_axis(a, parent[:, :, None], axis=1)  # noqa: B023, E731
        rest = take(rest) - book[word]
        lost = np.take_along_axis(flat, best, axis=1)
        picks = np.concatenate([take(picks), word[:, :, None].astype(np.uint8)], axis=2)
    return picks[np.arange(len(x)), lost.argmin(axis=1)]


def decoded(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, i]] for i, book in enumerate(code))


def build(ids: np.ndarray, x: np.ndarray, code: np.ndarray, kind: str = "<f8", beam: int = BEAM) -> dict[str, bytes]:
    """A block: ids, codes by book, norms of the coded vectors, and the vectors themselves in the type they came in."""
    codes = encode(x, code, beam)
    norms = (decoded(codes, code) ** 2).sum(1).astype(np.float32)
    return {"ids": ids.astype(np.int64).tobytes(), "codes": codes.T.tobytes(), "norms": norms.tobytes(), "vectors": x.astype(kind).tobytes()}


_SCHEMA = "ids binary, codes binary, norms binary, vectors binary"


def search(row: dict, query_ids: np.ndarray, queries: np.ndarray, code: np.ndarray, kind: str = "<f8", k: int = K, shortlist: int = SHORTLIST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, norms = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float32)
    codes = np.frombuffer(row["codes"], np.uint8).reshape(len(code), -1)
    vectors = np.frombuffer(row["vectors"], kind).reshape(len(ids), -1)
    asked, got, scores = [], [], []
    for query_id, query in zip(query_ids, queries, strict=True):
        far, table = norms.copy(), (2 * (code @ query)).astype(np.float32)
        for products, places in zip(table, codes, strict=True):
            far -= products[places]
        # rows with the query's own id don't use up its shortlist
        own = np.searchsorted(ids, [query_id, query_id + 1])
        far[own[0] : own[1]] = np.inf
        some = np.argpartition(far, shortlist)[:shortlist] if len(far) > shortlist else np.arange(len(far))
        some = some[(some < own[0]) | (some >= own[1])]
        exact = np.sqrt(((vectors[some].astype(np.float64) - query) ** 2).sum(1))
        order = np.lexsort((ids[some], exact))[:k]
        asked.append(np.full(len(order), query_id))
        got.append(ids[some[order]])
        scores.append(exact[order])
    joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    return joined(asked, np.int64), joined(got, np.int64), joined(scores, np.float64)


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, tile_queries: int = TILE_QUERIES, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each query.

    Queries are the rows of vectors (vec_id, embedding) whose vec_id is divisible by every, each against all rows with
    another vec_id. Zero vectors, nulls, and vectors with null, NaN or infinite components take no part. Repeated rows
    count as candidates as often as they are there, and once as queries. The codebooks are fitted on at most `sample`
    rows; every row is in the index. Extra columns are left out; an empty table gives none; vectors of different lengths
    are an error.
    """
    rows = tiles.usable(vectors, zero=False)
    seen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    if not seen.num_rows:
        return small_table(rows.sparkSession, [], "query_id long, rank int, vec_id long, score double")
    code = fit(tiles.matrix(seen["embedding"].combine_chunks(), seen.num_rows))
    kind = tiles.kind_of(rows)
    index = tiles.blocks(rows, block_rows, lambda ids, x: build(ids, x, code, kind), _SCHEMA)
    asked = tiles.query_tiles(rows.filter(F.col("vec_id") % every == 0), tile_queries)
    return tiles.nearest(index, asked, lambda row, ids, x: search(row, ids, x, code, kind, k, shortlist), kind, k, "double", F.asc)
