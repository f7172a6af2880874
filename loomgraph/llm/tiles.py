"""Searches of a query set against all rows, in blocks: rows become blocks, queries become tiles, each block one task's work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import materialize

#: A task takes a block with at most so many tiles; beyond them the block goes to another task too.
TILES_PER_TASK = 16


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding (floats as they are, else doubles) of rows whose vector is not null, has no null or non-finite component and, unless zero, isn't zero.

    A null vec_id takes no part. Vectors of different lengths are an error.
    """
    finite = F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    same = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    out = vectors.select("vec_id", F.col("embedding") if same else F.col("embedding").cast("array<double>").alias("embedding"))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return out if zero else out.filter(F.expr("exists(embedding, x -> x <> 0)"))


def kind_of(vectors: DataFrame) -> str:
    """The numpy type in which vectors of usable() are packed."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    flat = np.asarray(column.flatten())
    lengths = np.asarray(column.value_lengths())
    if flat.size % max(rows, 1) or (lengths != lengths[:1]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1).astype(np.float64)


def blocks(vectors: DataFrame, rows_per_block: int, build: Callable[[np.ndarray, np.ndarray], dict[str, bytes | int]], schema: str) -> tuple[DataFrame, int]:
    """One row for each block, block and what build makes of its ids (ascending) and vectors; and how many blocks there may be.

    Blocks are hash buckets of about rows_per_block rows. Ids that repeat without end would make a block large, so rows
    of one id are spread by their vectors.
    """
    count = max(1, -(-vectors.count() // rows_per_block))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, x = np.asarray(table["vec_id"].combine_chunks()), matrix(table["embedding"].combine_chunks(), table.num_rows)
        order = np.argsort(ids, kind="stable")
        made = build(ids[order], x[order]) | {"block": table["block"][0].as_py()}
        return pa.table({n: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for n, v in made.items()}).select(names)

    names = ["block", *(x.split()[0] for x in schema.split(", "))]
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)))
    keyed = keyed.repartition(_tasks(count), "block")
    return materialize(keyed.groupBy("block").applyInArrow(run, f"block long, {schema}"), "blocks"), count


def _tasks(groups: int) -> int:
    """Partitions for so many groups, each about a task's work: more than groups, so that few of them meet in one."""
    return min(10_000, 2 * groups)


def query_tiles(queries: DataFrame, rows_per_tile: int) -> tuple[DataFrame, int]:
    """tile, query_ids and queries (row by row) of the distinct ids of queries; and how many tiles there may be."""
    queries = queries.dropDuplicates(["vec_id"])
    count, kind = max(1, -(-queries.count() // rows_per_tile)), kind_of(queries)

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table["embedding"].combine_chunks(), table.num_rows)
        made = [table["tile"][0].as_py(), np.asarray(table["vec_id"].combine_chunks()).astype(np.int64).tobytes(), x.astype(kind).tobytes()]
        return pa.table({n: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for n, v in zip(("tile", "query_ids", "queries"), made, strict=True)})

    keyed = queries.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    return materialize(keyed.groupBy("tile").applyInArrow(run, "tile long, query_ids binary, queries binary"), "tiles"), count


def nearest(index: tuple[DataFrame, int], tiles: tuple[DataFrame, int], search: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str, k: int, score: str, best_first: Callable[[str], Column]) -> DataFrame:
    """Each query's k best over all blocks: query_id, rank, vec_id and score.

    search gives the best of one block for the queries of one tile, as query ids, row ids and scores. Tiles are copied
    to the blocks and meet them by a join on the block's number: a block is moved once for TILES_PER_TASK tiles. The k
    best of a block meet those of others by a window whose limit Spark applies before the shuffle.
    """
    (index, n_blocks), (tiles, n_tiles) = index, tiles
    groups = max(1, -(-n_tiles // TILES_PER_TASK))
    fields = [c for c in index.columns if c != "block"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    spread = tiles.withColumn("group", F.pmod("tile", F.lit(groups))).withColumn("block", numbers(n_blocks)).drop("tile")
    held = index.withColumn("group", numbers(groups))
    tasks = _tasks(n_blocks * groups)
    pairs = held.repartition(tasks, "block", "group").join(spread.repartition(tasks, "block", "group"), ["block", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("query_ids", "queries", *fields)}
                ids = np.frombuffer(row["query_ids"], np.int64)
                found = search(row, ids, np.frombuffer(row["queries"], kind).reshape(len(ids), -1).astype(np.float64))
                yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = pairs.select("query_ids", "queries", *fields).mapInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best_first("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
