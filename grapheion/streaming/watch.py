"""File events as a stream: debounce, last event per path, hash skip, state and graph equal to a batch run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.operators import maintain
from grapheion.operators.lineage import shared_folder
from grapheion.shipping import ship
from grapheion.sources import extract
from grapheion.sources.commits import Commits, Conflict, filesystem, path_of
from grapheion.sources.store import GraphStore

#: Versions of the state that stay.
COMPACT_EVERY = 50
#: Files that a task parses, and events of a file of a replayed table, about.
FILES, EVENTS = 2_000, 500_000


def as_file_events(events: DataFrame) -> DataFrame:
    """(path, op, hash, ts, event_id): errors remove, everything else updates."""
    return events.select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("update").alias("op"), F.sha2("props", 256).alias("hash"), "ts", "event_id")


def last_per_path(events: DataFrame) -> DataFrame:
    """The last event of each path; an aggregate, so that it combines before the shuffle."""
    return events.groupBy("path").agg(F.max(F.struct("ts", "event_id", "op", "hash")).alias("e")).select("path", "e.op", "e.hash", "e.ts", "e.event_id")


def debounced(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Bursts of events of a path with pauses of at most ``gap_seconds``: session number, count, first and last time."""
    by = Window.partitionBy("path").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("ts") > F.lag("ts").over(by) + F.expr(f"INTERVAL {gap_seconds} SECOND")).cast("int"), F.lit(1))
    numbered = events.withColumn("new", fresh).withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def sessions(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The same on a stream, with event time and a watermark."""
    return events.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap)).agg(F.count("*").alias("n"))


def apply_batch(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, files to parse): removals first, then updates whose hash is not stored.

    ``state``: (path, hash, ts, event_id, op); events older than what is stored do nothing.
    """
    last = last_per_path(batch)
    merged = last_per_path(state.select("path", "op", "hash", "ts", "event_id").unionByName(last.select("path", "op", "hash", "ts", "event_id")))
    live = state.filter("op = 'update'").select("path", "hash")
    todo = last.filter("op = 'update'").join(live, ["path", "hash"], "left_anti").select("path", "hash")
    return merged, todo


def _stream_id(spark: SparkSession, stream: str | None) -> str:
    """A stream is its query's id, which its checkpoint keeps: a new checkpoint is another stream."""
    return stream or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "default"


class Store:
    """State in versioned folders under numbered commits, each with the last batch of every stream in it.

    A batch that runs twice (after a failure) finds itself applied and changes nothing; batches in
    any order, of any stream, end in the same state.
    """

    SCHEMA = "path string, op string, hash string, ts timestamp, event_id long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._commits = filesystem(spark, self.folder), Commits(spark, f"{self.folder}/commits")

    def _head(self) -> dict:
        last = self._commits.last()
        return {"folder": None, "streams": {}} if last < 0 else json.loads(self._commits.text(last))

    def version(self, stream: str | None = None) -> int:
        """The last batch of a stream that is applied."""
        return self._head()["streams"].get(_stream_id(self.spark, stream), -1)

    def read(self) -> DataFrame:
        folder = self._head()["folder"]
        return self.spark.createDataFrame([], self.SCHEMA) if folder is None else self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/{folder}")

    def apply(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        name = _stream_id(self.spark, stream)
        while batch_id > self.version(name):
            last, head = self._commits.last(), self._head()
            state, _ = apply_batch(self.read(), batch)
            fresh = f"v-{uuid.uuid4().hex[:12]}"
            state.select("path", "op", "hash", "ts", "event_id").write.parquet(f"{self.folder}/{fresh}")
            try:
                self._commits.commit(last + 1, json.dumps({"folder": fresh, "streams": head["streams"] | {name: batch_id}}))
            except Conflict:  # another stream was first: apply the batch to what it left
                self._fs.delete(path_of(self.spark, f"{self.folder}/{fresh}"), True)
                continue
            for old in self._commits.numbers()[:-COMPACT_EVERY]:
                self._fs.delete(path_of(self.spark, f"{self.folder}/{json.loads(self._commits.text(old))['folder']}"), True)
            self._commits.forget(last + 2 - COMPACT_EVERY)


class GraphWatch:
    """A stored graph kept up to date by batches of file events (path, op, ts, event_id, ...).

    The store keeps the last event of each path beside the graph, keyed as the graph is. Of a batch
    the last event of each path counts, if it is newer (ts, then event_id) than the one kept: late
    events, repeated batches and batches in any order end in the same graph. Removed files leave
    the graph; updated ones are read by ``sources`` (from the last updates to (file_path, content,
    file_hash)), skipped if their hash is stored, else parsed and put in place of what was stored.
    Edges into them come back by themselves, as edges are resolved anew. Graph, events and the
    number of the batch, under the id of its stream, become one version; an update writes a
    segment of the changed files and reads only the last events and the nodes of named files.
    """

    def __init__(self, store: GraphStore, sources: Callable[[DataFrame], DataFrame], parse: Callable = extract.parse):
        self.store, self.sources, self.parse = store, sources, parse

    def apply(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> int:
        """How many names changed."""
        spark = self.store.spark
        name = _stream_id(spark, stream)
        while True:
            since = self.store.version()
            head = self.store.head(since)
            if head["streams"].get(name, -1) >= batch_id:
                return 0
            try:
                return self._apply(batch, since, name, batch_id)
            except Conflict:  # another writer changed one of these files: apply the batch to what it left
                continue

    def _apply(self, batch: DataFrame, since: int, stream: str, batch_id: int) -> int:
        rest = [c for c in batch.columns if c not in ("path", "ts", "event_id")]
        last = batch.groupBy("path").agg(F.max(F.struct("ts", "event_id", *rest)).alias("e")).select("path", "e.*")
        kept = self.store.state().select(F.col("file_path").alias("path"), F.struct("ts", "event_id").alias("kept"))
        kept = kept.join(last.select("path"), "path", "left_semi")
        last = last.join(kept, "path", "left").filter(F.col("kept").isNull() | (F.struct("ts", "event_id") > F.col("kept"))).drop("kept").cache()
        updated = last.filter("op = 'update'")
        found = self.sources(updated).cache()
        graph = self.store.read(since)
        # a few bytes a file: Spark would put thousands of them into one task
        tasks = -(-updated.count() // FILES) or 1
        files, nodes, edges, changed = maintain.changed_parts(graph, found, last.select(F.col("path").alias("file_path")), lambda todo: self.parse(todo.repartition(tasks, "file_path")))
        files = files.cache()
        try:
            n = changed.count()
            self.store.update(files, nodes, edges, last.select(F.col("path").alias("file_path"), "ts", "event_id", "op"), stream, batch_id, since, last_build_type="incremental")
        finally:
            extract.release(nodes)
            for df in (files, found, last):
                df.unpersist()
        self.store.collect_garbage(self.store.read(), n)
        self.store.tidy()
        return n


def watch_graph(events: DataFrame, store: GraphStore, sources: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True, parse: Callable = extract.parse, debounce: str | None = None, late: str = "10 minutes"):
    """Start the stream of file events into a stored graph; ``debounce`` waits for pauses of that length first."""
    watch = GraphWatch(store, sources, parse)
    events = events if debounce is None else settled(events, debounce, late)
    writer = events.writeStream.foreachBatch(lambda df, i: watch.apply(df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start()


def settled(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Of each burst of a path's events the last one, once no other has followed for ``gap``.

    Keyed state with a timer in event time: a path's last event and nothing more is kept, until the
    watermark, ``late`` behind the newest event, has passed it by the gap. Events older than the
    watermark are dropped by Spark.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ship(events.sparkSession)

    span, zone = pd.Timedelta(gap), events.sparkSession.conf.get("spark.sql.session.timeZone")
    columns = events.columns
    fields = {f.name: f.dataType for f in events.schema}
    kept = ", ".join(f"`{c}` {'string' if c == 'path' else fields[c].simpleString()}" for c in columns)
    order = [columns.index("ts"), columns.index("event_id")]

    def step(key, frames, state):
        newest = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append(newest)
            state.remove()
        else:
            rows = [r for f in frames for r in f[columns].itertuples(index=False, name=None)]
            for r in sorted(rows, key=lambda r: (r[order[0]], r[order[1]])):
                if newest is not None and pd.Timestamp(r[order[0]]) - pd.Timestamp(newest[order[0]]) > span:
                    out.append(newest)
                    newest = r
                elif newest is None or (pd.Timestamp(r[order[0]]), r[order[1]]) > (pd.Timestamp(newest[order[0]]), newest[order[1]]):
                    newest = r
            state.update(tuple(pd.Timestamp(v).to_pydatetime() if i == order[0] else v for i, v in enumerate(newest)))
            state.setTimeoutTimestamp(int((pd.Timestamp(newest[order[0]]).tz_localize(zone) + span).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=columns)

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(step, kept, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run(events: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Start the stream of file events into a store."""
    store = Store(events.sparkSession, folder)
    writer = events.writeStream.foreachBatch(lambda df, i: store.apply(df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="300 milliseconds")).start(), store


def _as_stream(spark: SparkSession, path: str, folder: str, batches: int) -> DataFrame:
    """A table of events as a stream of ``batches`` triggers, about in order of time; a large one has several files a trigger."""
    table = spark.read.parquet(path)
    each = -(-table.count() // (batches * EVENTS)) or 1
    table.repartitionByRange(batches * each, "ts", "event_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/in")


def replay(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """Replay a table of events as a stream of several files; returns the live (path, hash)."""
    folder = shared_folder(spark, "watch")
    query, store = run(as_file_events(_as_stream(spark, path, folder, batches)), f"{folder}/state", f"{folder}/checkpoint")
    query.awaitTermination()
    return store.read().filter("op = 'update'").select("path", "hash")


def replay_graph(spark: SparkSession, path: str, content: Callable[[DataFrame], DataFrame], batches: int = 4):
    """Replay a table of events into a stored graph; ``content`` makes (path, op, ts, event_id, content) of it."""
    folder = shared_folder(spark, "watch")
    store = GraphStore(spark, f"{folder}/graph")
    sources = lambda last: last.select(F.col("path").alias("file_path"), F.encode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_hash"))
    watch_graph(content(_as_stream(spark, path, folder, batches)), store, sources, f"{folder}/checkpoint").awaitTermination()
    return store.read()
