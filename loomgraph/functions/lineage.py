"""Cutting the lineage of tables that a loop builds on."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Tables that cut() wrote and that are still in use: their folder and number of rows.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, tuple[str, int]] = weakref.WeakKeyDictionary()


def _shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session in one process gets a temporary folder, on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, deleted when the driver ends."""
    path = f"{_shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that driver and executors share and read back: one job, which counts the rows too."""
    path = new_folder(df.sparkSession)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path, seen.get["n"]
    return out


def rows(table: DataFrame) -> int:
    """How many rows a table that cut() gave has."""
    return _WRITTEN[table][1]


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() gave; nothing may read them any more."""
    for table in tables:
        _delete(table.sparkSession, _WRITTEN.pop(table)[0])


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone by now
        return
