from datetime import datetime, timedelta

from pyspark.sql import functions as F

from grapheion.sources import extract
from grapheion.streaming import watch

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(p, op, h, T0 + timedelta(seconds=s), i) for i, (p, op, h, s) in enumerate(rows)], "path string, op string, hash string, ts timestamp, event_id long")


def test_last_event_wins_and_removals_count(spark):
    batch = events(spark, [("a", "update", "1", 0), ("a", "remove", "", 1), ("b", "remove", "", 0), ("b", "update", "2", 0), ("c", "update", "3", 5)])
    state, todo = watch.apply_batch(spark.createDataFrame([], watch.Store.SCHEMA), batch)
    assert {(r.path, r.op) for r in state.collect()} == {("a", "remove"), ("b", "update"), ("c", "update")}
    assert {r.path for r in todo.collect()} == {"b", "c"}
    again = events(spark, [("b", "update", "2", 9), ("c", "update", "4", 9)])
    assert [r.path for r in watch.apply_batch(state, again)[1].collect()] == ["c"]


def test_store_applies_a_batch_once(spark, tmp_path):
    store = watch.Store(spark, f"file://{tmp_path}/s")
    store.apply(events(spark, [("a", "update", "1", 0)]), 0)
    store.apply(events(spark, [("a", "update", "changed", 0)]), 0)
    assert store.version() == 0 and store.read().first().hash == "1"


def test_bursts(spark):
    rows = events(spark, [("a", "update", "", s) for s in (0, 1, 2, 100, 101)])
    assert sorted((r.session, r["n"]) for r in watch.debounced(rows, 10).collect()) == [(1, 3), (2, 2)]


def test_sessions_on_a_stream(spark, tmp_path):
    events(spark, [("a", "update", "", s) for s in (0, 1, 2, 100, 4000)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, op string, hash string, ts timestamp, event_id long").parquet(str(tmp_path / "in"))
    q = watch.sessions(stream, "10 seconds", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select n from bursts").collect()) == [1, 3]


def test_replay_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = watch.last_per_path(watch.as_file_events(spark.read.parquet(path))).filter("op = 'update'").select("path", "hash")
    assert sorted(map(tuple, watch.replay(spark, path, 5).collect())) == sorted(map(tuple, batch.collect()))


def test_stream_updates_the_graph(spark, tmp_path):
    from grapheion.sources import extract
    from grapheion.sources.store import GraphStore

    store = GraphStore(spark, f"file://{tmp_path}/g")
    parsed = []

    def parse(files):
        parsed.append(sorted(r.file_path for r in files.select("file_path").collect()))
        return extract.parse(files)

    def content(rows):
        return spark.createDataFrame([(p, op, T0 + timedelta(seconds=s), i, c) for i, (p, op, s, c) in enumerate(rows)], "path string, op string, ts timestamp, event_id long, content string")

    sources = lambda last: last.selectExpr("path AS file_path", "encode(content, 'UTF-8') AS content", "sha2(content, 256) AS file_hash")
    watch_ = watch.GraphWatch(store, sources, parse)
    one, two = "def one():\n    return two()\n", "def two():\n    return 2\n"
    assert watch_.apply(content([("a.py", "update", 0, "def old(): pass"), ("a.py", "update", 1, one), ("b.py", "update", 0, two)]), 0) > 0
    names = lambda: {r.qualified_name for r in store.read().nodes.collect()}
    assert names() == {"a.py", "a.py::one", "b.py", "b.py::two"} and parsed == [["a.py", "b.py"]]
    # the batch again, then one whose only content is stored: nothing is parsed
    assert watch_.apply(content([("a.py", "remove", 0, None)]), 0) == 0 and len(parsed) == 1
    assert watch_.apply(content([("a.py", "update", 5, one)]), 1) == 0 and parsed[1:] == [[]]
    watch_.apply(content([("b.py", "remove", 9, None), ("c.py", "update", 9, two)]), 2)
    assert names() == {"a.py", "a.py::one", "c.py", "c.py::two"}
    whole = extract.build(sources(content([("a.py", "update", 0, one), ("c.py", "update", 0, two)])).withColumnRenamed("file_hash", "h"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read().edges) == rows(whole.edges)


def test_vectors_of_vanished_nodes_go(spark, tmp_path, monkeypatch):
    from grapheion.sources import store as st

    monkeypatch.setattr(st, "GARBAGE_AFTER", 3)
    store = st.GraphStore(spark, f"file://{tmp_path}/g")
    watch_ = watch.GraphWatch(store, lambda last: last.selectExpr("path AS file_path", "encode('def f(): pass', 'UTF-8') AS content", "sha2(path, 256) AS file_hash"))
    event = lambda p, op, i: spark.createDataFrame([(p, op, T0, i)], "path string, op string, ts timestamp, event_id long")
    watch_.apply(event("a.py", "update", 0), 0)
    store.write_embeddings(spark.createDataFrame([("a.py::f", "node", "p", [1.0]), ("a.py", "file", "p", [1.0]), ("gone::x", "node", "p", [1.0])], "key string, level string, provider string, vec array<float>"))
    watch_.apply(event("b.py", "update", 1), 1)
    assert {r.key for r in store.embeddings().collect()} == {"a.py::f", "a.py"} and store.metadata()["changes_since_gc"] == "0"
    assert store.reset_embeddings("other") == 0
    store.compact()
    assert store.read().nodes.count() == 4


def test_large_batches_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Forty small files went to one task, and each batch of a replayed table was one file."""
    monkeypatch.setattr(watch, "FILES", 4)
    monkeypatch.setattr(watch, "EVENTS", 100)
    rows = [(i, 1000 * i, i % 40) for i in range(1000)]
    table = f"file://{tmp_path}/events"
    spark.createDataFrame(rows, "event_id long, at long, user long").select("event_id", F.timestamp_millis("at").alias("ts"), "user").write.parquet(table)
    content = lambda e: e.select(F.concat(F.lit("u"), "user", F.lit(".py")).alias("path"), F.lit("update").alias("op"), "ts", "event_id", F.concat(F.lit("def f"), "event_id", F.lit("(): pass\n")).alias("content"))
    seen, real = [], watch.GraphWatch.__init__
    parse = lambda files: seen.append(files.rdd.getNumPartitions()) or extract.parse(files)
    monkeypatch.setattr(watch.GraphWatch, "__init__", lambda self, store, sources, _: real(self, store, sources, parse))
    folder = f"file://{tmp_path}/w"
    monkeypatch.setattr(watch, "shared_folder", lambda *_: folder)
    graph = watch.replay_graph(spark, table, content, batches=2)
    assert seen == [10, 10]
    assert spark.read.parquet(f"{folder}/in").select(F.input_file_name()).distinct().count() == 10
    last = {f"u{i % 40}.py::f{i}" for i in range(960, 1000)}
    assert {r.qualified_name for r in graph.nodes.filter("kind = 'Function'").collect()} == last
