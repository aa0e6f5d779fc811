"""The log-structured store: updates in proportion, writers that meet or die, compaction; streams in any order."""

import itertools
import os
from datetime import datetime, timedelta

import pytest

from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA
from grapheion.sources import extract
from grapheion.sources import store as st
from grapheion.sources.commits import Commits, Conflict
from grapheion.sources.store import GraphStore
from grapheion.streaming import watch

T0 = datetime(2024, 1, 1)


def sources_of(spark, texts):
    rows = spark.createDataFrame(sorted(texts.items()), "file_path string, text string")
    return rows.selectExpr("file_path", "encode(text, 'UTF-8') AS content", "sha2(text, 256) AS file_hash")


def change(spark, store, texts, gone=(), since=None):
    nodes, edges = extract.parse(sources_of(spark, texts))
    files = spark.createDataFrame([(f,) for f in [*texts, *gone]], "file_path string")
    store.update(files, nodes, edges, since=since)
    extract.release(nodes)


def names(store, version=None):
    return {r.qualified_name for r in store.read(version).nodes.collect()}


def size(store, folder):
    top = f"{store.folder.removeprefix('file://')}/{folder}"
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs)


@pytest.fixture
def store(spark, tmp_path):
    s = GraphStore(spark, f"file://{tmp_path}/g")
    texts = {f"m{i}.py": "".join(f"def f{i}_{j}():\n    return g{j}()\n" for j in range(60)) for i in range(40)}
    s.write(extract.build(sources_of(spark, texts)))
    return s


def test_an_update_costs_what_changed(spark, store):
    before = names(store)
    change(spark, store, {"m3.py": "def only():\n    pass\n"}, ["m4.py"])
    head = store.head()
    assert len(head["segments"]) == 1 and size(store, head["segments"][0]) * 5 < size(store, head["base"][0][0])
    assert names(store) == {n for n in before if not n.startswith(("m3.py", "m4.py"))} | {"m3.py", "m3.py::only"}
    assert names(store, 0) == before  # readers of the version before can finish
    assert {r.qualified_name for r in store.read_files(["m3.py", "m5.py"]).nodes.collect()} == {n for n in names(store) if n.startswith(("m3.py", "m5.py"))}
    change(spark, store, {"m3.py": "def again():\n    pass\n"})
    assert {n for n in names(store) if n.startswith("m3.py")} == {"m3.py", "m3.py::again"}


def test_compaction_moves_touched_buckets_alone(spark, store):
    change(spark, store, {"m3.py": "def only():\n    pass\n"}, ["m4.py"])
    rows = lambda: (sorted(map(str, store.read().nodes.collect())), sorted(map(str, store.read().edges_raw.collect())))
    before, first = rows(), store.head()["base"]
    store.compact()
    head = store.head()
    assert rows() == before and head["segments"] == [] and len(head["base"]) == 2
    assert head["base"][0][0] == first[0][0] and len(head["base"][1][1]) <= 2
    assert sorted(b for _, mine in head["base"] for b in mine) == list(range(st.BUCKETS))
    for i in range(st.SEGMENTS + 1):
        change(spark, store, {"n.py": f"def x{i}(): pass\n"})
    assert store.tidy() and store.head()["segments"] == [] and {n for n in names(store) if n.startswith("n.py")} == {"n.py", f"n.py::x{st.SEGMENTS}"}


def test_two_writers(spark, store):
    since = store.version()
    change(spark, store, {"a.py": "def a(): pass\n"})
    change(spark, store, {"b.py": "def b(): pass\n"}, since=since)  # apart: goes on top
    assert {"a.py::a", "b.py::b"} <= names(store)
    folders = set(os.listdir(store.folder.removeprefix("file://")))
    with pytest.raises(Conflict):
        change(spark, store, {"a.py": "def other(): pass\n"}, since=since)
    assert "a.py::a" in names(store) and set(os.listdir(store.folder.removeprefix("file://"))) <= folders
    # compaction beside an update keeps the update
    commit = Commits.commit
    late = GraphStore(spark, store.folder)
    done = []

    def meets(self, n, text):
        if not done:
            done.append(1)
            change(spark, late, {"c.py": "def c(): pass\n"})
        return commit(self, n, text)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(Commits, "commit", meets)
        store.compact()
    assert {"a.py::a", "b.py::b", "c.py::c"} <= names(store) and len(store.head()["segments"]) == 1
    # a rewrite of the whole graph does not go on top of an update that it has not seen
    graph = store.read()
    done.clear()
    with pytest.MonkeyPatch.context() as m, pytest.raises(Conflict):
        m.setattr(Commits, "commit", meets)
        store.write(graph)


def test_commits_are_made_once(spark, tmp_path):
    log = Commits(spark, f"file://{tmp_path}/c")
    log.commit(0, "é")
    with pytest.raises(Conflict):
        log.commit(0, "b")
    assert log.text(0) == "é" and log.numbers() == [0] and [f for f in os.listdir(tmp_path / "c") if f[0] == "_"] == []


def test_a_writer_that_dies_leaves_the_old_version(spark, store, monkeypatch):
    before, version = names(store), store.version()
    save = GraphStore._save
    for step in ("files", "nodes", "edges_raw", "state"):

        def dies(self, df, path, *more, step=step):
            if path.endswith(f"/{step}"):
                raise OSError("gone")
            save(self, df, path, *more)

        monkeypatch.setattr(GraphStore, "_save", dies)
        with pytest.raises(OSError):
            change(spark, store, {"m1.py": "def x(): pass\n"})
        with pytest.raises(OSError) if step != "files" else pytest.MonkeyPatch.context():
            if step != "files":
                store.write(store.read())
    monkeypatch.setattr(GraphStore, "_save", save)
    assert names(store) == before and store.version() == version
    assert store.vacuum() and names(store) == before and store.vacuum() == []


def test_vectors_are_replaced_whole(spark, store):
    vectors = lambda k: spark.createDataFrame([(k, "file", [1.0])], "key string, level string, vec array<float>")
    store.write_embeddings(vectors("a"))
    change(spark, store, {"a.py": "def a(): pass\n"})
    assert [r.key for r in store.embeddings().collect()] == ["a"]
    store.write_embeddings(vectors("b"))
    assert [r.key for r in store.embeddings().collect()] == ["b"]


# streams -------------------------------------------------------------------------------
def events(spark, rows):
    return spark.createDataFrame([(p, op, T0 + timedelta(seconds=s), i, c) for p, op, s, i, c in rows], "path string, op string, ts timestamp, event_id long, content string")


def watcher(spark, folder):
    sources = lambda last: last.selectExpr("path AS file_path", "encode(content, 'UTF-8') AS content", "sha2(content, 256) AS file_hash")
    return watch.GraphWatch(GraphStore(spark, folder), sources)


BATCHES = [
    [("a.py", "update", 1, 1, "def a1(): pass"), ("b.py", "update", 1, 2, "def b1(): pass"), ("c.py", "update", 5, 3, "def c5(): pass")],
    [("a.py", "update", 2, 4, "def a2(): pass"), ("b.py", "remove", 2, 5, None), ("c.py", "update", 5, 9, "def c5b(): pass")],
    [("a.py", "remove", 3, 6, None), ("b.py", "update", 1, 7, "def b_late(): pass"), ("c.py", "remove", 4, 8, None), ("d.py", "update", 1, 1, "def d(): pass")],
]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_batches_in_any_order_end_in_one_graph(spark, tmp_path, order):
    w = watcher(spark, f"file://{tmp_path}/g")
    for i, k in enumerate(order):
        w.apply(events(spark, BATCHES[k]), i)
    assert names(w.store) == {"c.py", "c.py::c5b", "d.py", "d.py::d"}
    assert {(r.file_path, r.op, r.event_id) for r in w.store.state().collect()} == {("a.py", "remove", 6), ("b.py", "remove", 5), ("c.py", "update", 9), ("d.py", "update", 1)}


def test_a_new_stream_on_an_old_store_loses_nothing(spark, tmp_path):
    w = watcher(spark, f"file://{tmp_path}/g")
    assert w.apply(events(spark, BATCHES[0]), 0, "one") > 0 and w.apply(events(spark, BATCHES[0]), 0, "one") == 0
    assert w.apply(events(spark, [("e.py", "update", 0, 0, "def e(): pass")]), 0, "two") == 2
    assert "e.py::e" in names(w.store) and w.store.applied("one") == w.store.applied("two") == 0
    w.store.compact()
    # late for a path whose events were compacted
    w.apply(events(spark, [("a.py", "remove", 0, 99, None), ("b.py", "remove", 7, 0, None)]), 1, "two")
    assert {"a.py::a1", "e.py::e"} <= names(w.store) and "b.py" not in names(w.store)


def test_streams_with_checkpoints_of_their_own(spark, tmp_path):
    """Two queries, each with its own first batch, into one store."""
    store = GraphStore(spark, f"file://{tmp_path}/g")
    schema = events(spark, []).schema
    w = watcher(spark, store.folder)
    for i in (0, 1):
        events(spark, BATCHES[i]).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}"))
        watch.watch_graph(stream, store, w.sources, str(tmp_path / f"check{i}")).awaitTermination()
    assert names(store) == {"a.py", "a.py::a2", "c.py", "c.py::c5b"} and len(store.head()["streams"]) == 2


def test_settled_bursts(spark, tmp_path):
    schema = events(spark, []).schema
    rows = [[("a", "update", 0, 1, "x"), ("a", "update", 1, 2, "y"), ("b", "update", 0, 3, "z")], [("a", "update", 2, 4, "w"), ("a", "update", 100, 5, "v")], [("z", "update", 2000, 6, "")], [("z", "update", 9000, 7, "")]]
    for i, part in enumerate(rows):
        events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = watch.settled(stream, "10 seconds", "1 minute").writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.event_id) for r in spark.sql("select * from settled").collect()) == [("a", 4), ("a", 5), ("b", 3), ("z", 6)]


def test_schemas_are_kept(store):
    assert store.read().nodes.schema.names == NODE_SCHEMA.names and store.read().edges_raw.schema.names == EDGE_SCHEMA.names
