"""Structured Streaming jobs over transcripts and command events. Watermarks and time-outs are parameters; their defaults are ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import catalog, parsing
from loomgraph.sources.group_log import GroupLog
from loomgraph.streaming.processors import Lifecycle, StepStatus, processed

DAY = 24 * 60 * 60 * 1000


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of transcript files as they arrive, with the file's path."""
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def stream_tool_calls(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and warnings of arriving lines, by the rules of the batch parser."""
    return parsing.parse_prop_calls(lines)


def route_calls(lines: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """Calls of every kind in arriving or stored lines, and their warnings, by the rules of the batch parsers; names (name) are the known components."""
    props, prop_warnings = parsing.parse_prop_calls(lines)
    tokens, token_warnings = parsing.parse_token_calls(lines)
    edges, edge_warnings = parsing.parse_edge_calls(lines, names)
    return {"props": props, "prop_warnings": prop_warnings, "selects": parsing.parse_select_calls(lines), "tokens": tokens, "token_warnings": token_warnings, "edges": edges, "edge_warnings": edge_warnings}


def stream_routed_calls(lines: DataFrame, names: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each kind of call of arriving lines to a table of its own under folder, in a folder for each batch: one that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for kind, rows in route_calls(batch, names).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog_log(spark: SparkSession, folder: str, max_deltas: int = 20) -> GroupLog:
    """The catalog under a folder, as a log of changed components."""
    return GroupLog(spark, folder, catalog.COMPONENT, catalog.SCHEMAS, max_deltas)


def stream_apply_calls(calls: DataFrame, folder: str, checkpoint: str, max_deltas: int = 20) -> StreamingQuery:
    """Apply each micro-batch of calls to the catalog under folder, whose first tables store_catalog has written.

    A batch writes the rows of the components that it touches, made from those before it, so that one that is run again
    after a failure gives the same tables.
    """
    log = catalog_log(calls.sparkSession, folder, max_deltas)

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        log.apply(number, batch, lambda old: catalog.apply_calls(catalog.Catalog(**old), batch)[0]._asdict())
        batch.unpersist()

    return calls.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_catalog(tables: catalog.Catalog, folder: str, number: int = -1) -> None:
    """Write a catalog as the base of a log."""
    catalog_log(tables.props.sparkSession, folder).start(tables._asdict(), number)


def load_catalog(spark: SparkSession, folder: str, before: int | None = None) -> catalog.Catalog:
    """The catalog after all batches, or after those before a number."""
    return catalog.Catalog(**catalog_log(spark, folder).read(before))


def stream_upserts(rows: DataFrame, folder: str, checkpoint: str, keys: list[str], schema: str, upsert: Callable[[DataFrame, DataFrame], DataFrame], max_deltas: int = 20) -> StreamingQuery:
    """Put arriving rows into a keyed table under folder by upsert(old rows of their keys, new rows); reading it is GroupLog(...).read()."""
    log = GroupLog(rows.sparkSession, folder, keys, {"rows": schema}, max_deltas)

    def apply(batch: DataFrame, number: int) -> None:
        log.apply(number, batch, lambda old: {"rows": upsert(old["rows"], batch)})

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_session_started_once(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """One start for each session within the watermark."""
    return events.filter("kind = 'started'").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["session_id"])


def stream_step_status(steps: DataFrame, watermark: str = "1 hour", keep: int = DAY) -> DataFrame:
    """Per session and command, the last step and how many of its pending ones a later start interrupted, updated as steps arrive. Late steps within the watermark take their place in time.

    A key without steps for `keep` milliseconds after the watermark leaves the state.
    """
    return processed(steps.withWatermark("started_at", watermark), ["session_id", "command"], StepStatus("started_at", "step_id", keep), "update")


def stream_command_lifecycle(events: DataFrame, watermark: str = "1 hour", keep: int = DAY) -> DataFrame:
    """Each invocation once it has ended, by the rules of sessions.command_lifecycle: when its end is before the watermark, the next invocation is, or its session has been silent for so long."""
    codes = events.withColumn("exit_code", F.coalesce("exit_code", F.lit(0)).cast("int"))
    return processed(codes.withWatermark("ts", watermark), ["session_id"], Lifecycle("ts", "event_id", keep), "append")
