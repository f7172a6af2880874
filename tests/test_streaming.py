"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F
from test_catalog import CALLS, call, full_catalog

from loomgraph.operators import parsing, sessions
from loomgraph.streaming import jobs


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_arriving_transcripts(spark, tmp_path):
    lines = ['{"tool":"exclude_prop","prop":"a"}', "prose", '{"tool":"odd"}', "{bad"]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    calls, warnings = jobs.stream_tool_calls(jobs.read_transcripts(spark, str(tmp_path)))
    batch = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r.tool for r in run(calls, "calls").collect()] == [r.tool for r in parsing.parse_prop_calls(batch)[0].collect()] == ["exclude_prop"]
    assert sorted(r.warning for r in run(warnings, "warnings").collect()) == ["bad JSON", "unknown tool"]


def test_calls_of_every_kind_go_to_their_tables(spark, tmp_path):
    lines = ['{"tool":"exclude_prop","prop":"a"}', '{"tool":"accept_component","name":"Card","confidence":9}', '{"tool":"set_token","path":"a.b","type":"color","value":null}', '{"tool":"set_token","path":"a.c","type":"color"}', '{"tool":"map_edge","parent":"Card","child":"Hero","confidence":7}', '{"tool":"map_edge","parent":"Card","child":"Nobody"}', "prose", "{bad"]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((lines[:3], lines[3:])):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(part))
    names = spark.createDataFrame([("Card",), ("Hero",)], "name string")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    for _ in range(2):  # the second finds nothing new
        jobs.stream_routed_calls(stream, names, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    for kind, rows in jobs.route_calls(spark.createDataFrame([(x,) for x in lines], "line string"), names).items():
        written = spark.read.schema(rows.schema).parquet(f"{tmp_path}/out/{kind}").select(rows.columns)
        assert sorted(map(repr, written.collect())) == sorted(map(repr, rows.collect())), kind


def test_starts_once(spark, tmp_path):
    rows = [(i, i % 3, f"2024-01-01 00:00:{i:02d}", "started") for i in range(9)]
    events = spark.createDataFrame(rows, "event_id long, session_id long, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    assert run(jobs.stream_session_started_once(stream), "starts").count() == sessions.session_started_once(events).count() == 3


def stamped(spark, rows, schema, *times):
    table = spark.createDataFrame(rows, schema)
    return table.withColumns({t: F.to_timestamp(F.concat(F.lit("2024-01-01 "), t)) for t in times})


def arriving(spark, folder, *tables):
    """A stream that takes a table at a time."""
    for i, table in enumerate(tables):
        table.coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(tables[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_step_status_in_order_of_time(spark, tmp_path):
    kind = "step_id long, session_id long, command string, status string, started_at string"
    first = stamped(spark, [(1, 1, "import", "pending", "00:00:01"), (3, 1, "import", "complete", "00:00:03"), (4, 2, "import", "pending", "00:00:01")], kind, "started_at")
    late = stamped(spark, [(2, 1, "import", "pending", "00:00:02")], kind, "started_at")
    stream = jobs.stream_step_status(arriving(spark, str(tmp_path / "steps"), first, late), "1 hour")
    last = {(r.session_id, r.status, r.interrupted, r.step_id) for r in run(stream, "status", "update").collect()}
    assert {(1, "complete", 2, 3), (2, "pending", 0, 4)} <= last
    stale = sessions.interrupt_stale_steps(first.unionByName(late)).filter("status = 'interrupted'").groupBy("session_id").count().collect()
    assert {(r.session_id, r["count"]) for r in stale} == {(1, 2)}


def test_commands_and_their_ends(spark, tmp_path):
    kind = "event_id long, session_id long, ts string, kind string, exit_code int"
    rows = [(1, 1, "00:00:01", "invoked", None), (2, 1, "00:00:03", "completed", None), (3, 1, "00:00:04", "failed", 1), (4, 1, "00:00:05", "invoked", None), (5, 1, "00:00:06", "invoked", None), (6, 1, "00:00:08", "failed", 130), (7, 2, "00:00:01", "invoked", None), (8, 3, "00:00:01", "completed", None)]
    first = stamped(spark, rows, kind, "ts")
    late = stamped(spark, [(9, 2, "00:00:04", "failed", 2)], kind, "ts")
    end = stamped(spark, [(10, 9, "09:00:00", "other", None)], kind, "ts")
    got = run(jobs.stream_command_lifecycle(arriving(spark, str(tmp_path / "events"), first, late, end), "10 minutes"), "lifecycle").collect()
    ended = {(r.session_id, r.run, r.outcome, r.seconds) for r in got}
    assert len(got) == len(ended) and ended == {(r.session_id, r.run, r.outcome, r.seconds) for r in sessions.command_lifecycle(first.unionByName(late).unionByName(end)).collect()}
    assert (1, 3, "interrupted", 2.0) in ended and (2, 1, "error", 3.0) in ended and (1, 2, "open", None) in ended


def test_calls_are_applied_once_even_when_run_again(spark, tmp_path):
    start = full_catalog(spark)
    folder = str(tmp_path / "catalog")
    jobs.store_catalog(start, folder)
    calls = [spark.createDataFrame([call(1, "classify_prop", "size", "enum", "design", list=["a"])], CALLS), spark.createDataFrame([call(2, "exclude_prop", "size", reason="no")], CALLS)]
    stream = arriving(spark, str(tmp_path / "calls"), *calls)
    jobs.stream_apply_calls(stream, folder, str(tmp_path / "first")).awaitTermination()
    once = sorted(map(repr, jobs.load_catalog(spark, folder).props.collect()))
    jobs.stream_apply_calls(stream, folder, str(tmp_path / "again")).awaitTermination()
    assert sorted(map(repr, jobs.load_catalog(spark, folder).props.collect())) == once
    size = jobs.load_catalog(spark, folder).props.filter("name = 'size' AND component_id = 'c1'").first()
    assert (size.cdf_type, size.rationale) == ("excluded", "no") and jobs.load_catalog(spark, folder, before=1).props.filter("cdf_type = 'enum'").count() == 1


def test_a_restart_goes_on_from_its_state(spark, tmp_path):
    """The second half of the events, late ones among them, is taken up by another query from the checkpoint of the first."""
    kind = "event_id long, session_id long, ts string, kind string, exit_code int"
    first = stamped(spark, [(1, 1, "00:00:01", "invoked", None), (3, 1, "00:05:00", "invoked", None), (4, 2, "00:00:02", "invoked", None)], kind, "ts")
    second = stamped(spark, [(2, 1, "00:00:03", "completed", None), (5, 1, "00:05:02", "failed", 130)], kind, "ts")
    end = stamped(spark, [(6, 9, "09:00:00", "other", None)], kind, "ts")
    folder, out, checkpoint = (str(tmp_path / x) for x in ("events", "out", "checkpoint"))

    def go(*tables):
        for i, table in enumerate(tables):
            table.coalesce(1).write.parquet(f"{folder}/{len(list((tmp_path / 'events').glob('*'))) if (tmp_path / 'events').exists() else i}")
        stream = jobs.stream_command_lifecycle(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder), "10 minutes")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return {(r.session_id, r.run, r.outcome, r.seconds) for r in spark.read.schema(stream.schema).parquet(out).collect()} if (tmp_path / "out").exists() else set()

    assert go(first) == set()
    ended = go(second, end)
    whole = sessions.command_lifecycle(first.unionByName(second).unionByName(end)).collect()
    assert {e for e in ended if e[2] != "open"} == {(r.session_id, r.run, r.outcome, r.seconds) for r in whole if r.outcome != "open"} == {(1, 1, "ok", 2.0), (1, 2, "interrupted", 2.0)}


def test_rocksdb_is_asked_for(spark):
    from loomgraph.streaming import processors

    other = spark.newSession()
    other.conf.set(processors.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        processors.needs_rocksdb(other)
    processors.use_rocksdb(other)
    processors.needs_rocksdb(other)
