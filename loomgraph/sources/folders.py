"""Folders through Spark's file system layer, so that they may be in any store that Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none where it isn't there."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file: it is there or it isn't, whatever fails meanwhile."""
    fs, where = _at(spark, path)
    fs.create(where, True).close()
