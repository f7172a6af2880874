"""A Python data source for source trees: format("source_tree"), for batches and streams.

The listing is split over tasks: the driver lists the root only, each task walks some of the folders below it and reads
the files it finds, a record batch at a time. Folders that are never scanned are not opened, and files that aren't
scanned are not read. A filter on path (equal, or starting with a text) narrows the walk. A stream takes the files
that have appeared or changed since the offsets before; an offset is the newest time and the paths that have it.

Options: path, the root; tasks, how many tasks share the walk (16). The root must be readable from all executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, StringStartsWith

from loomgraph.operators.files import IGNORED_FOLDERS, is_scanned

SCHEMA = "path string, mtime timestamp, content string"
_ROWS = 200


@dataclass
class Part(InputPartition):
    """What one task reads: folders to walk, and files."""

    folders: tuple[str, ...]
    files: tuple[str, ...]


@dataclass
class Timed(Part):
    """Files with the times at which they were listed."""

    times: tuple[float, ...] = ()


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """Files to scan and folders to walk in a folder, sorted; links to folders aren't followed."""
    with os.scandir(folder) as found:
        for e in sorted(found, key=lambda e: e.name):
            if e.is_dir(follow_symlinks=False):
                if e.name not in IGNORED_FOLDERS:
                    yield e
            elif e.is_file() and is_scanned(e.name):
                yield e


def walk(folder: str) -> Iterator[str]:
    """Paths of the files to scan below a folder."""
    todo = [folder]
    while todo:
        for e in _entries(todo.pop()):
            if e.is_dir(follow_symlinks=False):
                todo.append(e.path)
            else:
                yield e.path


def _read(paths: Iterator[str], times: dict[str, float] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of files; those that are gone by now, or that changed after the time given for them, are left out."""
    rows = []

    def batch() -> pa.RecordBatch:
        path, mtime, content = zip(*rows, strict=True)
        rows.clear()
        return pa.record_batch([pa.array(path, pa.string()), pa.array(mtime, pa.timestamp("us", tz="UTC")), pa.array(content, pa.string())], names=["path", "mtime", "content"])

    for path in paths:
        try:
            at = os.stat(path).st_mtime
            if times is not None and at > times[path]:
                continue  # it comes with a later offset
            with open(path, encoding="utf-8", errors="replace", newline="") as f:
                rows.append((path, int(at * 1e6), f.read()))
        except FileNotFoundError:
            continue
        if len(rows) >= _ROWS:
            yield batch()
    if rows:
        yield batch()


def _dealt(folders: list[str], files: list[str], tasks: int) -> list[Part]:
    parts = [Part(tuple(folders[i::tasks]), tuple(files[i::tasks])) for i in range(tasks)]
    return [p for p in parts if p.folders or p.files]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.tasks = options["path"].rstrip("/"), int(options.get("tasks", 16))
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on the beginning of path; Spark applies the others, and equality again."""
        for f in filters:
            if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path",) and isinstance(f.value, str):
                self.starts.append(f.value)
            if not (isinstance(f, StringStartsWith) and f.attribute == ("path",)):
                yield f

    def _may_hold(self, folder: str) -> bool:
        return all(s.startswith(f"{folder}/") or f"{folder}/".startswith(s) for s in self.starts)

    def _wanted(self, path: str) -> bool:
        return all(path.startswith(s) for s in self.starts)

    def partitions(self) -> list[Part]:
        """Folders are opened up, level by level, until there are enough to share."""
        folders, files = [self.root], []
        while folders and len(folders) < 4 * self.tasks:
            below = []
            for folder in folders:
                for e in _entries(folder):
                    if not e.is_dir(follow_symlinks=False):
                        files.append(e.path)
                    elif self._may_hold(e.path):
                        below.append(e.path)
            if not below:
                folders = []
                break
            folders = below
        return _dealt(folders, [f for f in files if self._wanted(f)], self.tasks)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        def paths() -> Iterator[str]:
            yield from partition.files
            for folder in partition.folders:
                yield from (p for p in walk(folder) if self._wanted(p))

        yield from _read(paths())


class TreeStreamReader(DataSourceStreamReader):
    """Files by the time they were changed; several of one time are told apart by their paths."""

    def __init__(self, options: dict):
        self.root, self.tasks = options["path"].rstrip("/"), int(options.get("tasks", 16))

    def _listed(self) -> dict[str, float]:
        return {p: os.stat(p).st_mtime for p in walk(self.root)}

    def initialOffset(self) -> dict:
        return {"time": -1.0, "paths": "[]"}

    def latestOffset(self) -> dict:
        listed = self._listed()
        newest = max(listed.values(), default=-1.0)
        return {"time": newest, "paths": json.dumps(sorted(p for p, t in listed.items() if t == newest))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, until = set(json.loads(start["paths"])), set(json.loads(end["paths"]))
        new = {p: t for p, t in self._listed().items() if (start["time"] < t or (t == start["time"] and p not in before)) and (t < end["time"] or p in until)}
        return [Timed(part.folders, part.files, tuple(new[f] for f in part.files)) for part in _dealt([], sorted(new), self.tasks)]

    def read(self, partition: Timed) -> Iterator[pa.RecordBatch]:
        yield from _read(iter(partition.files), dict(zip(partition.files, partition.times, strict=True)))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make format("source_tree") known to a session, with filters pushed into it."""
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
