"""Tables whose rows belong to groups that batches replace: a log of deltas, merged on read.

A batch writes the new rows of the groups that it touches, nothing else. Readers take, for each group, the rows of the
last batch that touched it. When many deltas have come together, compaction writes one base and, with the next
compaction, what lies before the last base goes, so that readers that began earlier can end.

Under the folder: delta/<number>/<table> and delta/<number>/touched, base/<number>/<table>, and done/<kind>-<number>,
an empty file that says that a delta or base is whole. A batch that runs again after a failure writes its delta anew
from the state before it, and one that is in a base already is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources import folders

Tables = dict[str, DataFrame]


class GroupLog:
    """Tables in a folder, all with the columns of groups; schemas gives each table's columns as DDL."""

    def __init__(self, spark: SparkSession, folder: str, groups: list[str], schemas: dict[str, str], max_deltas: int = 20):
        self.spark, self.folder, self.groups, self.schemas, self.max_deltas = spark, folder.rstrip("/"), groups, schemas, max_deltas

    def numbers(self, kind: str) -> list[int]:
        """Numbers of whole deltas or bases, ascending."""
        found = (n.rsplit("-", 1) if not n.startswith(f"{kind}--") else (kind, n[len(kind) + 1 :]) for n in folders.names(self.spark, f"{self.folder}/done"))
        return sorted(int(n) for k, n in found if k == kind)

    def start(self, tables: Tables, number: int = -1) -> None:
        """Write the first base."""
        self._write("base", number, tables)

    def _write(self, kind: str, number: int, tables: Tables) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/{number}/{name}")
        folders.mark(self.spark, f"{self.folder}/done/{kind}-{number}")

    def _table(self, kind: str, numbers: list[int], name: str, schema: str) -> DataFrame:
        parts = [f"{self.folder}/{kind}/{n}/{name}" for n in numbers]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*parts)

    def read(self, before: int | None = None, only: DataFrame | None = None) -> Tables:
        """The tables after all batches, or after those before a number; only some groups if `only` (groups) names them."""
        early = lambda ns: [n for n in ns if before is None or n < before]
        bases = early(self.numbers("base"))
        deltas = [n for n in early(self.numbers("delta")) if not bases or n > bases[-1]]
        picked = lambda t: t if only is None else t.join(only.select(*self.groups).distinct(), self.groups, "left_semi")
        keys = [f"{g} {self._group_type(g)}" for g in self.groups]
        touched = picked(self._table("delta", deltas, "touched", ", ".join([*keys, "__number long"])))
        last = touched.groupBy(*self.groups).agg(F.max("__number").alias("__number"))
        out = {}
        for name, schema in self.schemas.items():
            base = picked(self._table("base", bases[-1:], name, schema))
            if not deltas:
                out[name] = base
                continue
            rows = picked(self._table("delta", deltas, name, f"{schema}, __number long")).join(last, [*self.groups, "__number"], "left_semi")
            out[name] = base.join(last, self.groups, "left_anti").unionByName(rows.drop("__number")).select(*base.columns)
        return out

    def _group_type(self, group: str) -> str:
        first = next(iter(self.schemas.values()))
        return next(c.split()[1] for c in first.split(", ") if c.split()[0] == group)

    def apply(self, number: int, touched: DataFrame, change: Callable[[Tables], Tables]) -> bool:
        """Write the delta of a batch: change gets the rows of the touched groups as they were before it and gives the new ones. False if it is in a base already."""
        if (bases := self.numbers("base")) and number <= bases[-1]:
            return False
        touched = touched.select(*self.groups).distinct()
        new = change(self.read(before=number, only=touched))
        numbered = {name: rows.select(*(c.split()[0] for c in self.schemas[name].split(", "))).withColumn("__number", F.lit(number).cast("long")) for name, rows in new.items()}
        self._write("delta", number, numbered | {"touched": touched.withColumn("__number", F.lit(number).cast("long"))})
        if len([n for n in self.numbers("delta") if not bases or n > bases[-1]]) >= self.max_deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Write all that there is as a base, and delete what the base before it had replaced."""
        bases, deltas = self.numbers("base"), self.numbers("delta")
        newest = max([*bases, *deltas])
        if bases and newest == bases[-1]:
            return
        self._write("base", newest, self.read())
        if bases:
            for kind, numbers in (("delta", [n for n in deltas if n <= bases[-1]]), ("base", bases[:-1])):
                for n in numbers:
                    folders.delete(self.spark, f"{self.folder}/done/{kind}-{n}")
                    folders.delete(self.spark, f"{self.folder}/{kind}/{n}")
