"""What the operators of this subpackage share: scratch tables in the shared folder, ordinals, word patterns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the session was given by setCheckpointDir.

    Where neither is set, a session in one process gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="loomgraph-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path.rpartition("/")[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer; a stopped session leaves it alone."""
    jvm = spark._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone by now
        return


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows, sent as Arrow, which starts no Python worker on the executors."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), schema=StructType.fromDDL(schema))


#: Rows of an Arrow batch where texts go to Python.
TEXT_ROWS = 500


def of_texts(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python: from now on Arrow batches of its session hold TEXT_ROWS rows at most, for texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= TEXT_ROWS:
        df.sparkSession.conf.set(name, TEXT_ROWS)
    return df


def one_by_one(column: pa.Array) -> Iterator:
    """The values of a column, each made when its turn comes, so that a batch isn't held twice."""
    return (x.as_py() for x in column)


def with_ordinal(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Add the position (from 0) of each row in the order of keys, without one task for all rows.

    Rows are range-partitioned and sorted; a partition's offset is the count of rows before it, and there are as
    many counts as partitions.
    """
    raw = "__id"
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(raw, F.monotonically_increasing_id())
    spread = materialize(spread, "ordered")
    part = F.shiftright(raw, 33)
    counts = sorted(spread.groupBy(part.alias("p")).count().collect())
    offsets, before = [], 0
    for p, n in counts:
        offsets.append((p, before))
        before += n
    if not offsets:
        return spread.withColumn(name, F.lit(0).cast("long")).drop(raw)
    table = small_table(df.sparkSession, offsets, "__p long, __before long")
    within = F.col(raw) - F.shiftleft(part, 33)
    out = spread.withColumn("__p", part).join(F.broadcast(table), "__p")
    return out.withColumn(name, F.col("__before") + within).drop(raw, "__p", "__before")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
