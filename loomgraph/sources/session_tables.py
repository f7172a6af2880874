"""Tables in a folder for each session: a write replaces the files of its sessions and leaves all others alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.lineage import cut
from loomgraph.sources import folders

BY = "session_id"


def store_sessions(rows: DataFrame, folder: str, sessions: DataFrame) -> None:
    """Replace the rows of sessions (session_id) in a table by rows; those of other sessions aren't written.

    Spark overwrites the partitions that rows has; a session without rows loses its partition. A session's rows come
    from few tasks, a large one's from several.
    """
    spark = rows.sparkSession
    sessions = sessions.select(BY).distinct()
    own = cut(rows.join(sessions, BY, "left_semi"))
    own.hint("rebalance", BY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BY).parquet(folder)
    for r in sessions.join(own.select(BY).distinct(), BY, "left_anti").toLocalIterator():
        folders.delete(spark, f"{folder}/{BY}={r[0]}")


def read_sessions(spark: SparkSession, folder: str, schema: str, sessions: list | None = None) -> DataFrame:
    """A table by sessions, or some of its sessions: the folders of others aren't listed by the scan."""
    table = spark.read.schema(schema).parquet(folder)
    return table if sessions is None else table.filter(F.col(BY).isin(sessions))
