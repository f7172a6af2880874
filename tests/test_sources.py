"""Tables in folders: what a write touches, what a replay gives, what compaction leaves."""

import os
import time

from pyspark.sql import functions as F
from test_catalog import CALLS, call, full_catalog
from test_streaming import arriving

from loomgraph.operators import catalog as K
from loomgraph.operators import upserts as U
from loomgraph.sources import folders
from loomgraph.sources.group_log import GroupLog
from loomgraph.sources.session_tables import read_sessions, store_sessions
from loomgraph.streaming import jobs

CACHE = "file_hash string, cli_version string, file_path string, updated_at long, created_at long"


def rows_of(table):
    return sorted(map(repr, table.collect()))


def cache_rows(spark, *rows):
    return spark.createDataFrame([(h, "1", p, u, None) for h, p, u in rows], CACHE)


def upsert(old, new):
    return U.upsert_keyed(old, new, ["file_hash", "cli_version"])


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_deltas_hold_their_batch_and_merge_on_read(spark, tmp_path):
    log = GroupLog(spark, str(tmp_path), ["file_hash", "cli_version"], {"rows": CACHE}, max_deltas=100)
    base = spark.range(20_000).selectExpr("concat('h', id) AS file_hash", "'1' AS cli_version", "concat('/p', id) AS file_path", "id AS updated_at", "id AS created_at")
    log.start({"rows": base})
    batches = [cache_rows(spark, ("h1", "/new", 50_000), ("x", "/x", 1)), cache_rows(spark, ("h1", "/newer", 50_001), ("h2", "/two", 50_002)), cache_rows(spark, ("x", "/y", 2))]
    whole = base
    for number, batch in enumerate(batches):
        assert log.apply(number, batch, lambda old, batch=batch: {"rows": upsert(old["rows"], batch)})
        whole = upsert(whole, batch)
    assert rows_of(log.read()["rows"]) == rows_of(whole)
    assert size(tmp_path / "delta") < size(tmp_path / "base") / 20
    created = log.read()["rows"].filter("file_hash = 'h1'").first()
    assert (created.file_path, created.created_at) == ("/newer", 1)
    # a batch that runs again writes the same, and earlier states stay readable
    assert log.apply(1, batches[1], lambda old: {"rows": upsert(old["rows"], batches[1])})
    assert rows_of(log.read()["rows"]) == rows_of(whole)
    assert log.read(before=1)["rows"].filter("file_hash = 'h1'").first().file_path == "/new"
    only = spark.createDataFrame([("h2", "1")], "file_hash string, cli_version string")
    assert [r.file_path for r in log.read(only=only)["rows"].collect()] == ["/two"]


def test_compaction_bounds_deltas(spark, tmp_path):
    log = GroupLog(spark, str(tmp_path), ["file_hash", "cli_version"], {"rows": CACHE}, max_deltas=3)
    whole = cache_rows(spark).limit(0)
    for number in range(8):
        batch = cache_rows(spark, (f"h{number % 3}", f"/{number}", number))
        log.apply(number, batch, lambda old, batch=batch: {"rows": upsert(old["rows"], batch)})
        whole = upsert(whole, batch)
    assert rows_of(log.read()["rows"]) == rows_of(whole) and log.numbers("base") == [2, 5]
    assert log.numbers("delta") == [3, 4, 5, 6, 7] and folders.names(spark, f"{tmp_path}/delta") == ["3", "4", "5", "6", "7"]
    assert not log.apply(4, cache_rows(spark, ("h0", "/late", 9)), lambda old: old)  # in a base already
    # a delta without its mark is not read
    folders.delete(spark, f"{tmp_path}/done/delta-7")
    assert log.read()["rows"].filter("file_path = '/7'").isEmpty()


def test_a_catalog_in_deltas_is_the_catalog_in_one_go(spark, tmp_path):
    start, folder = full_catalog(spark), str(tmp_path / "catalog")
    jobs.store_catalog(start, folder)
    calls = [
        [call(1, "classify_prop", "size", "enum", "design", list=["a", "b"]), call(2, "classify_slot", "body", list=[])],
        [call(3, "classify_prop", "size", "string", "content", cid="c2")],
        [call(4, "classify_prop", "size", "enum", "design", list=["z"]), call(5, "classify_component", description="a card")],
        [call(6, "exclude_prop", "label", reason="no")],
    ]
    stream = arriving(spark, str(tmp_path / "calls"), *(spark.createDataFrame(c, CALLS) for c in calls))
    jobs.stream_apply_calls(stream, folder, str(tmp_path / "checkpoint"), max_deltas=3).awaitTermination()
    once = K.apply_calls(start, spark.createDataFrame(sum(calls, []), CALLS))[0]
    got = jobs.load_catalog(spark, folder)
    for name in K.Catalog._fields:
        assert rows_of(getattr(got, name)) == rows_of(getattr(once, name)), name
    # the second batch touched one component, and its delta holds no other
    assert {r.component_id for r in spark.read.parquet(f"{folder}/delta/1/components").collect()} == {"c2"}


def test_streamed_upserts(spark, tmp_path):
    batches = [cache_rows(spark, ("a", "/1", 1), ("b", "/1", 1)), cache_rows(spark, ("a", "/2", 2))]
    stream = arriving(spark, str(tmp_path / "rows"), *batches)
    jobs.stream_upserts(stream, str(tmp_path / "cache"), str(tmp_path / "checkpoint"), ["file_hash", "cli_version"], CACHE, upsert).awaitTermination()
    log = GroupLog(spark, str(tmp_path / "cache"), ["file_hash", "cli_version"], {"rows": CACHE})
    assert {(r.file_hash, r.file_path, r.created_at) for r in log.read()["rows"].collect()} == {("a", "/2", 1), ("b", "/1", 1)}


def test_a_write_touches_the_files_of_its_sessions_only(spark, tmp_path):
    folder, schema = str(tmp_path / "tokens"), "session_id int, path string, value string"
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    every = spark.range(1, 5).selectExpr("int(id) AS session_id")
    store_sessions(frame(*((s, f"p{i}", "v") for s in range(1, 5) for i in range(3))), folder, every)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    before = files()
    time.sleep(0.05)
    # session 2 gets new rows, 3 has none left, and rows of session 4 aren't meant
    store_sessions(frame((2, "new", "w"), (4, "stray", "w")), folder, every.filter("session_id IN (2, 3)"))
    after = files()
    untouched = {f: t for f, t in before.items() if "session_id=1/" in f or "session_id=4/" in f}
    assert untouched.items() <= after.items() and len(after) == len(untouched) + 1
    table = read_sessions(spark, folder, schema)
    assert {(r.session_id, r.path) for r in table.collect()} == {(s, f"p{i}") for s in (1, 4) for i in range(3)} | {(2, "new")}
    plan = read_sessions(spark, folder, schema, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and read_sessions(spark, folder, schema, [2]).count() == 1
    assert table.filter(F.col("session_id") == 3).isEmpty()


def plant(root, names):
    for n in names:
        path = root / n
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"// {n}")


TREE = ["a.ts", "src/B.tsx", "src/deep/er/C.vue", "src/deep/README.md", "src/deep/notes.md", "node_modules/x/D.ts", "src/dist/E.ts", "src/F.test.ts", "src/G.d.ts", "package.json", "data.json", "src/H.css", "pkg/I.astro"]
SCANNED = {"a.ts", "src/B.tsx", "src/deep/er/C.vue", "src/deep/notes.md", "data.json", "pkg/I.astro"}


def test_a_tree_is_read_as_the_batch_reader_reads_it(spark, tmp_path, monkeypatch):
    from loomgraph.operators.files import read_source_files
    from loomgraph.sources import trees

    plant(tmp_path, TREE)
    trees.register(spark)
    rows = spark.read.format("source_tree").option("tasks", 3).load(str(tmp_path))
    got = {r.path.removeprefix(f"{tmp_path}/"): r.content for r in rows.collect()}
    assert got == {n: f"// {n}" for n in SCANNED}
    batch = {r.path.removeprefix(f"file:{tmp_path}/"): (r.mtime.replace(microsecond=0), r.content) for r in read_source_files(spark, str(tmp_path)).collect()}
    assert batch == {r.path.removeprefix(f"{tmp_path}/"): (r.mtime.replace(microsecond=0), r.content) for r in rows.collect()}
    deep = rows.filter(F.col("path").startswith(f"{tmp_path}/src/deep"))
    assert {r.path.removeprefix(f"{tmp_path}/") for r in deep.collect()} == {"src/deep/er/C.vue", "src/deep/notes.md"}
    assert rows.filter(F.col("path") == f"{tmp_path}/a.ts").count() == 1


def test_ignored_folders_are_never_opened(tmp_path, monkeypatch):
    from loomgraph.sources import trees

    plant(tmp_path, TREE)
    opened = []
    scandir = os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scandir(p))
    reader = trees.TreeReader({"path": str(tmp_path), "tasks": "2"})
    list(reader.pushFilters([trees.StringStartsWith(("path",), f"{tmp_path}/src/deep/")]))
    parts = reader.partitions()
    assert sum(len(b) for p in parts for b in reader.read(p)) == 2
    assert set(opened) == {".", "src", "src/deep", "src/deep/er"}


def test_a_tree_as_a_stream(spark, tmp_path):
    from loomgraph.sources import trees

    root, out = tmp_path / "tree", str(tmp_path / "out")
    plant(root, ["a.ts", "src/b.ts"])
    trees.register(spark)

    def go():
        stream = spark.readStream.format("source_tree").load(str(root))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        return sorted(os.path.relpath(r.path, root) for r in spark.read.schema(trees.SCHEMA).parquet(out).collect())

    assert go() == ["a.ts", "src/b.ts"]
    plant(root, ["c.ts", "node_modules/d.ts"])
    assert go() == ["a.ts", "c.ts", "src/b.ts"]
    os.utime(root / "a.ts", (time.time() + 5, time.time() + 5))
    assert go() == ["a.ts", "a.ts", "c.ts", "src/b.ts"] == go()
