"""Budgets along an order, for projects of any size: blocks of rows are summed up, the sums scanned, then the blocks finished.

Rows are put in ranges of (project, order), and each range is cut at projects: these are the blocks. What a block does to
what comes before it is a small table, so one short row for each block is all that a project's scan sees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lineage import cut

#: Rows of a range, about.
BLOCK_ROWS = 200_000


def cost(content: str | Column, per_token: int) -> Column:
    return F.ceil(F.length(content) / per_token).cast("long")


def in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, short ones, with block: rising along (project, *order), at most a range of rows in one."""
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    return cut(rows.repartitionByRange(n, "project", *order).withColumn("block", F.spark_partition_id()))


def running_total(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows of in_blocks() with the sum of value over all rows of the project up to each."""
    sums = rows.groupBy("project", "block").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("project").orderBy("block")) - F.col("__sum")
    sums = sums.select("project", "block", before.alias("__before"))
    within = F.sum(value).over(Window.partitionBy("project", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, ["project", "block"]).withColumn(name, F.col("__before") + within).drop("__before")


def cap_to_budget(files: DataFrame, budget: int = 80_000, per_token: int = 4) -> DataFrame:
    """Add kept: the shortest files of a project whose tokens fit the budget, ties by path. Costs ascend, so the cut is a prefix.

    Files with length in place of content go to their blocks without their texts.
    """
    own = files.columns
    length = F.length("content") if "content" in own else F.col("length")
    rows = in_blocks(files.withColumns({"__length": length, "__cost": F.ceil(length / per_token).cast("long")}), ["__length", "path"])
    return running_total(rows, ["__length", "path"], "__cost", "__total").select(*own, (F.col("__total") <= budget).alias("kept"))


class Fits:
    """Next-fit over the costs of a block: where the batch that begins at a file ends, and what is left open after the last."""

    def __init__(self, costs: np.ndarray, budget: int):
        self.n, self.budget = len(costs), budget
        self.sums = np.concatenate([[0], np.cumsum(costs)])
        fits = np.searchsorted(self.sums, self.sums[:-1] + budget, "right") - 1
        self.stop = np.maximum(fits, np.arange(self.n) + 1)  # a file over the budget has a batch of its own
        self.alone = costs > budget

    def joined(self, spent: int) -> int:
        """How many files join an open batch in which `spent` is spent; spent < 0 means that none is open."""
        return 0 if spent < 0 else int(np.searchsorted(self.sums, self.budget - spent, "right")) - 1

    def begins(self, at: int) -> list[int]:
        """Where batches begin from file `at` on."""
        out = []
        while at < self.n:
            out.append(at)
            at = int(self.stop[at])
        return out

    def left(self, begins: list[int]) -> int:
        """What is spent in the last batch of begins, -1 if it is closed."""
        return -1 if self.alone[begins[-1]] else int(self.sums[-1] - self.sums[begins[-1]])

    def table(self) -> tuple[list[int], list[int], list[int]]:
        """For each number of files that can join an open batch: the most that may be spent for it, the batches begun, and what is left then.

        The whole block may join; then no batch begins, and what is left is the last entry plus what was spent.
        """
        joined = sorted({self.joined(s) for s in (-1, *(self.budget - self.sums[self.sums <= self.budget]).tolist())})
        most, begun, left = [], [], []
        for k in joined:
            begins = self.begins(k)
            most.append(int(self.budget - self.sums[k]))
            begun.append(len(begins))
            left.append(self.left(begins) if begins else int(self.sums[-1]))
        return most, begun, left


def next_state(state: tuple[int, int], table: tuple[list[int], list[int], list[int]]) -> tuple[int, int]:
    """The last batch's number and what is spent in it (-1: closed) after a block."""
    batch, spent = state
    most, begun, left = table
    k = 0
    while spent >= 0 and k + 1 < len(most) and spent <= most[k + 1]:
        k += 1
    if begun[k]:
        return batch + begun[k], left[k]
    return batch, spent + left[k]


def batch_by_budget(files: DataFrame, budget: int = 6000, per_token: int = 4) -> DataFrame:
    """project, path and batch: files of a project in order of path, a new batch where the next file doesn't fit; a file over the budget has one of its own.

    Each block's table says what it makes of any open batch; tables are applied one after another in a scan, and each
    block then numbers its own files.
    """
    project, path = (files.schema[c].dataType.simpleString() for c in ("project", "path"))
    rows = in_blocks(files.select("project", "path", cost("content", per_token).alias("cost")), ["path", "cost"])

    def sized(block: pa.Table) -> tuple[pa.Table, Fits]:
        block = block.sort_by([("path", "ascending"), ("cost", "ascending")])
        return block, Fits(block.column("cost").to_numpy(), budget)

    def told(block: pa.Table) -> pa.Table:
        most, begun, left = sized(block)[1].table()
        lists = {n: pa.array([v], pa.list_(pa.int64())) for n, v in (("most", most), ("begun", begun), ("left", left))}
        return pa.table({"project": block.column("project").slice(0, 1), "block": block.column("block").slice(0, 1), **lists})

    tables = rows.groupBy("project", "block").applyInArrow(told, f"project {project}, block int, most array<long>, begun array<long>, left array<long>")

    def scanned(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        states, state = [], (-1, -1)
        for table in zip(*(blocks.column(c).to_pylist() for c in ("most", "begun", "left")), strict=True):
            states.append(state)
            state = next_state(state, table)
        return pa.table({"project": blocks.column("project"), "block": blocks.column("block"), "before": pa.array([s[0] for s in states], pa.int64()), "spent": pa.array([s[1] for s in states], pa.int64())})

    states = tables.groupBy("project").applyInArrow(scanned, f"project {project}, block int, before long, spent long")  # a row for each block

    def numbered(block: pa.Table) -> pa.Table:
        block, fits = sized(block)
        before, spent = block.column("before")[0].as_py(), block.column("spent")[0].as_py()
        joined = fits.joined(spent)
        begins = fits.begins(joined)
        batch = before + np.searchsorted(np.array(begins, np.int64), np.arange(fits.n), "right")
        return pa.table({"project": block.column("project"), "path": block.column("path"), "batch": pa.array(batch, pa.int64())})

    return rows.join(states, ["project", "block"]).groupBy("project", "block").applyInArrow(numbered, f"project {project}, path {path}, batch long")
