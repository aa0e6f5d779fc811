"""A stored graph of nearest vectors: built from random partitions, searched greedily, updated in place of a rebuild.

Vectors that are equal once scaled to length one are one node, however many keys carry them, so
copies cannot fill a node's list with one another; keys come back when results are formed.

Build. In a random partition, nodes on one side of the same random planes meet in a leaf of some
``LEAF`` nodes and are compared with one another; leaves of more than twice that are dealt over
blocks. Every node keeps the ``DEGREE`` nearest that it met in ``PARTITIONS`` partitions, so a
vector moves once a partition, however large the table is; up to ``LEAF`` nodes lists are exact.
Rounds of descent, which move a vector once for every list it is in, are for updates only.

Search. Queries start at the nearest of a bounded number of entries and follow the links, both
ways, of the nearest nodes not followed yet, until the ``beam`` nearest are all followed.
All queries go together; a round is a few joins of their frontiers with links and vectors.

Update. Neighbours of a node that goes are compared with one another; a node that comes is searched,
offered to what it finds, and descends with new comparisons only: what is near to one node is
compared with one another, if the comparison is new. A node that is in the lists of many others
has these dealt over blocks, each with its own list, so no group grows with the table and no
reverse neighbour is left out. Rounds end when less than ``SETTLED`` of the lists' places changed.

Defined cases: null keys, and null, empty and zero vectors are neighbours of nothing; NaN counts as
zero; vectors of other length are no neighbours; equal scores go by key; a query's own key is left
out; a repeated key counts once for each of its vectors; an empty table gives an empty graph.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.operators import search
from grapheion.operators.lineage import by_key, shared_folder
from grapheion.shipping import ship
from grapheion.sources.commits import Commits

DEGREE = 24
#: Random partitions at the start, nodes of a leaf at most on average, and of a block of reverse neighbours.
PARTITIONS, LEAF, REVERSE = 6, 16_384, 2 * DEGREE
#: Nodes of a leaf that are compared with all of it at once.
STRIP = 256
ROUNDS, SETTLED = 12, 0.002
#: Entries of a search at most: about the square root of the nodes, below this bound.
ENTRIES = 2_048
BEAM = 160
#: A round follows this part of the beam.
PART = 8
#: Rows compared at once inside a task.
ROWS = 20_000

NODES = "node long, vec array<float>"
EDGES = "key long, other long, score double, fresh boolean"


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _unit(items: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vec): vectors of length one."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, m in search._matrix(b.column(1)).values():
                # zeros of one sign, so that equal vectors are equal values
                flat = pa.array((m.astype(np.float32) + np.float32(0.0)).ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, m.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), vec], names=["key", "vec"])

    held = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec")).filter("key is not null and size(vec) > 0")
    return held.mapInArrow(run, "key long, vec array<float>")


def _flat(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and values of a list column."""
    ends = np.asarray(vectors.offsets)
    return ends[:-1] - ends[0], np.diff(ends), np.asarray(vectors.flatten(), np.float32)


def _bits(count: int) -> int:
    """Planes of a partition of ``count`` nodes."""
    return max(0, int(np.ceil(np.log2(max(1, count) / LEAF))))


def _leaves(nodes: DataFrame, count: int, seed: int) -> DataFrame:
    """(group, block, node, vec, fresh, low): each node in its leaf of one random partition."""
    bits = _bits(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sizes, flat = _flat(b.column(1))
            leaf = np.zeros(len(at), np.int64)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                planes = np.random.default_rng([seed, d]).normal(size=(d, bits))
                side = flat[at[rows][:, None] + np.arange(d)] @ planes > 0
                leaf[rows] = (side @ (1 << np.arange(bits, dtype=np.int64)) if bits else 0) + (d << 40)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column(0), b.column(1)], names=["group", "node", "vec"])

    rows = nodes.mapInArrow(run, "group long, node long, vec array<float>")
    blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("blocks"))
    return rows.join(blocks, "group").select("group", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).alias("block"), "node", "vec", F.lit(True).alias("fresh"), F.lit(-2.0).alias("low"))


def _compare(members: DataFrame) -> DataFrame:
    """(key, other, score): pairs inside each (group, block), one of them fresh, that beat the key's ``low``."""

    def pairs(group: np.ndarray, block: np.ndarray, node: np.ndarray, vectors: pa.Array, fresh: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        at, sizes, flat = _flat(vectors)
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (block[1:] != block[:-1])])
        keys, others, scores = [], [], []
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(group)], strict=True):
            for d in np.unique(sizes[lo:hi]).tolist():
                rows = lo + np.flatnonzero(sizes[lo:hi] == d)
                if len(rows) < 2 or not fresh[rows].any():
                    continue
                m = flat[at[rows][:, None] + np.arange(d)]
                for first in range(0, len(rows), STRIP):
                    some = rows[first : first + STRIP]
                    s = m[first : first + STRIP] @ m.T
                    if not fresh[rows].all():
                        s[~(fresh[some][:, None] | fresh[rows][None, :])] = -3.0
                    s[np.arange(len(some)), first + np.arange(len(some))] = -3.0
                    least = np.maximum(low[some], -2.5)
                    if len(rows) > DEGREE + 1:
                        # just below the last that counts, so that it counts itself
                        edge = np.partition(s, -DEGREE, axis=1)[:, -DEGREE]
                        least = np.maximum(least, np.nextafter(edge, np.float32(-4.0)).astype(np.float64))
                    r, c = np.nonzero(s > least[:, None])
                    keys.append(node[some[r]])
                    others.append(node[rows[c]])
                    scores.append(s[r, c].astype(np.float64))
        join = lambda parts, t: pa.array(np.concatenate(parts) if parts else np.zeros(0), t)
        return pa.RecordBatch.from_arrays([join(keys, pa.int64()), join(others, pa.int64()), join(scores, pa.float64())], names=["key", "other", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.concat_batches([held, b]) if held is not None else b
            if held.num_rows < 2:
                continue
            group, block = (held.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # the last group may go on in the next batch; a group holds some tens of thousands of rows at most
            last = int(np.flatnonzero((group != group[-1]) | (block != block[-1]))[-1]) + 1 if ((group != group[-1]) | (block != block[-1])).any() else 0
            if last:
                yield pairs(*_columns(held.slice(0, last)))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield pairs(*_columns(held))

    def _columns(b: pa.RecordBatch) -> tuple:
        plain = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5)]
        return plain[0], plain[1], plain[2], b.column(3), plain[3], plain[4]

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.select("group", "block", "node", "vec", "fresh", "low").repartition(n, "group", "block").sortWithinPartitions("group", "block")
    return rows.mapInArrow(run, "key long, other long, score double")


def _nearest(found: DataFrame) -> DataFrame:
    """EDGES: the DEGREE best others of each key; an edge held before is not fresh."""
    # dealt once by key, on which both the aggregate and the window go
    once = by_key(found, "key").groupBy("key", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "other")
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= DEGREE).drop("r").select("key", "other", "score", "fresh")


def _around(edges: DataFrame) -> DataFrame:
    """(group, block, node, fresh): each node's list and, dealt over blocks, those that list it."""
    back = edges.groupBy("other").agg(F.ceil(F.count("*") / REVERSE).alias("blocks")).withColumnRenamed("other", "group")
    ahead = edges.select(F.col("key").alias("group"), F.col("other").alias("node"), "fresh").join(back, "group", "left")
    ahead = ahead.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1)).alias("block"), "node", "fresh")
    behind = edges.select(F.col("other").alias("group"), F.col("key").alias("node"), "fresh").join(back, "group")
    behind = behind.select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node", "fresh")
    every = ahead.unionByName(behind).groupBy("group", "block", "node").agg(F.max("fresh").alias("fresh"))
    # blocks without a fresh member have been compared before
    some = every.filter("fresh").select("group", "block").distinct()
    return every.join(some, ["group", "block"], "left_semi")


def _with_vectors(around: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    low = edges.groupBy("key").agg(F.when(F.count("*") >= DEGREE, F.min("score")).otherwise(-2.0).alias("low")).withColumnRenamed("key", "node")
    return around.join(nodes, "node").join(low, "node", "left").withColumn("low", F.coalesce("low", F.lit(-2.0)))


def _descend(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Lists after rounds of descent from ``edges``, whose fresh ones have not been compared yet."""
    places = edges.count()
    for _ in range(rounds):
        found = _compare(_with_vectors(_around(edges), nodes, edges)).withColumn("fresh", F.lit(True))
        edges = _kept(_nearest(edges.withColumn("fresh", F.lit(False)).unionByName(found)), "neighbour-edges")
        if edges.filter("fresh").count() <= SETTLED * places:
            break
    return edges.withColumn("fresh", F.lit(False))


def _grouped(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, vec) and members (node, key); a node's id is a hash of its vector, checked to be its own."""
    rows = keyed.withColumn("node", F.xxhash64("vec"))
    nodes = _kept(rows.select("node", "vec").distinct(), "neighbour-nodes")
    _check(nodes)
    return nodes, _kept(rows.select("node", "key").distinct(), "neighbour-members")


def _check(nodes: DataFrame) -> None:
    clash = nodes.groupBy("node").count().filter("count > 1").first()
    if clash is not None:
        raise ValueError(f"two vectors share the hash {clash.node}")


def build(items: DataFrame, key: str, vector: str) -> NeighbourGraph:
    """The graph of all rows."""
    nodes, members = _grouped(_unit(items, key, vector))
    count = nodes.count()
    found = _partitions(nodes, count).withColumn("fresh", F.lit(False))
    return NeighbourGraph(nodes, members, _kept(_nearest(found), "neighbour-edges"))


def _partitions(nodes: DataFrame, count: int) -> DataFrame:
    """(key, other, score): the nearest that nodes meet in the leaves of random partitions; of one leaf one is enough."""
    leaves = [_leaves(nodes, count, p) for p in range(PARTITIONS if _bits(count) else 1)]
    apart = [df.withColumn("group", F.col("group") * PARTITIONS + i) for i, df in enumerate(leaves)]
    return _compare(reduce(DataFrame.unionByName, apart))


@dataclass(frozen=True)
class NeighbourGraph:
    """``nodes`` (node, vec), ``members`` (node, key) and ``edges`` (key, other, score, fresh) between nodes."""

    nodes: DataFrame
    members: DataFrame
    edges: DataFrame

    def links(self) -> DataFrame:
        """(node, other), both ways."""
        return self.edges.select(F.col("key").alias("node"), "other").unionByName(self.edges.select(F.col("other").alias("node"), F.col("key").alias("other"))).distinct()

    def _entries(self) -> pa.Table:
        share = min(ENTRIES, int(np.ceil(np.sqrt(count)))) / count if (count := self.nodes.count()) else 0
        # a bounded choice by hash; nodes that nothing lists are found from others' lists only
        chosen = self.nodes.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) < int(np.ceil(share * (1 << 30))))
        return chosen.limit(2 * ENTRIES).toArrow().combine_chunks()

    def visited(self, queries: DataFrame, key: str, vector: str, beam: int = BEAM) -> DataFrame:
        """(query_id, node, score): every product made for the queries, a node met twice as an entry counts once.

        A round writes its own products and the ``beam`` best of each query; earlier products stay where they are.
        """
        spark, products = self.nodes.sparkSession, "query_id long, node long, score double"
        asked = _kept(_unit(queries, key, vector).select(F.col("key").alias("query_id"), F.col("vec").alias("asked")), "neighbour-queries")
        links = _kept(self.links(), "neighbour-links")
        rounds = [shared_folder(spark, "neighbour-found")]
        asked.mapInArrow(_start(self._entries(), beam), products).write.parquet(rounds[0])
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
        first = lambda df, n: df.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")
        best = _kept(first(spark.read.schema(products).parquet(rounds[0]), beam).withColumn("done", F.lit(False)), "neighbour-best")
        while True:
            found = spark.read.schema(products).parquet(*rounds)
            todo = _kept(first(best.filter("not done"), max(4, beam // PART)).select("query_id", "node"), "neighbour-todo")
            if todo.limit(1).count() == 0:
                return found
            ahead = todo.join(links, "node").select("query_id", F.col("other").alias("node")).distinct().join(found.select("query_id", "node"), ["query_id", "node"], "left_anti")
            scored = ahead.join(self.nodes, "node").join(asked, "query_id").select("query_id", "node", "vec", "asked").mapInArrow(_score, products)
            rounds.append(shared_folder(spark, "neighbour-found"))
            scored.write.parquet(rounds[-1])
            marked = best.join(todo.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select("query_id", "node", "score", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
            # what left the beam once cannot come back
            fresh = spark.read.schema(products).parquet(rounds[-1]).withColumn("done", F.lit(False))
            best = _kept(first(marked.unionByName(fresh), beam), "neighbour-best")

    def nearest(self, queries: DataFrame, key: str, vector: str, top: int, beam: int = BEAM) -> DataFrame:
        """(query_id, key, score, rank): the ``top`` most similar other keys that a search finds."""
        found = self.visited(queries, key, vector, max(beam, top + 1))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
        best = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top + 1).select("query_id", "node", F.round("score", 4).alias("score"))
        return self._by_key(best, key, top)

    def neighbours(self, key: str, top: int) -> DataFrame:
        """(query_id, key, score, rank): the stored nearest of every key of the graph, up to DEGREE of them; no search."""
        own = self.nodes.select("node", F.col("node").alias("other"), F.lit(1.0).alias("score"))
        ahead = own.unionByName(self.edges.select(F.col("key").alias("node"), "other", F.round("score", 4).alias("score")))
        asked = self.members.select("node", F.col("key").alias("query_id"))
        return self._by_key(asked.join(ahead, "node").select("query_id", F.col("other").alias("node"), "score"), key, top)

    def _by_key(self, best: DataFrame, key: str, top: int) -> DataFrame:
        # of a node's keys the first top + 1 can enter; Spark keeps that many a task before the shuffle
        first = self.members.withColumn("m", F.row_number().over(Window.partitionBy("node").orderBy("key"))).filter(F.col("m") <= top + 1).drop("m")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        rows = best.join(first, "node").filter(F.col("key") != F.col("query_id")).groupBy("query_id", "key").agg(F.max("score").alias("score"))
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", F.col("key").alias(key), "score", "rank")

    def changed(self, added: DataFrame, removed: DataFrame, key: str, vector: str) -> NeighbourGraph:
        """The graph without the keys of ``removed`` and with the rows of ``added``, which replace rows of their keys."""
        fresh = _kept(_unit(added, key, vector), "neighbour-added")
        new_nodes, new_members = _grouped(fresh)
        gone = removed.select(F.col(key).cast("long").alias("key")).unionByName(added.select(F.col(key).cast("long").alias("key"))).distinct()
        members = _kept(self.members.join(gone, "key", "left_anti").select("node", "key").unionByName(new_members).distinct(), "neighbour-members")
        every = _kept(self.nodes.unionByName(new_nodes).distinct().join(members, "node", "left_semi"), "neighbour-nodes")
        _check(every)
        old = every.join(self.nodes.select("node"), "node", "left_semi")
        dropped = self.nodes.select("node").join(members, "node", "left_anti")
        # what lay around a node that goes is compared with one another
        lost = self.edges.join(dropped.withColumnRenamed("node", "key"), "key", "left_semi").unionByName(self.edges.join(dropped.withColumnRenamed("node", "other"), "other", "left_semi").select("key", "other", "score", "fresh")).distinct()
        edges = self.edges.join(dropped.withColumnRenamed("node", "key"), "key", "left_anti").join(dropped.withColumnRenamed("node", "other"), "other", "left_anti").select("key", "other", "score", "fresh")
        around = _around(lost.withColumn("fresh", F.lit(True))).join(dropped.withColumnRenamed("node", "group"), "group", "left_semi")
        mended = _compare(_with_vectors(around, old, edges)).withColumn("fresh", F.lit(True))
        edges = _kept(_nearest(edges.unionByName(mended)), "neighbour-edges")
        come = _kept(every.join(self.nodes.select("node"), "node", "left_anti"), "neighbour-come")
        found = NeighbourGraph(old, members, edges).visited(come, "node", "vec", max(BEAM, DEGREE)).filter("node <> query_id")
        offers = found.select(F.col("query_id").alias("key"), F.col("node").alias("other"), "score", F.lit(True).alias("fresh"))
        offers = offers.unionByName(offers.select(F.col("other").alias("key"), F.col("key").alias("other"), "score", "fresh"))
        # those that come with nothing to find, as into an empty graph, meet one another in leaves
        count = come.count()
        offers = offers.unionByName(_partitions(come, count).withColumn("fresh", F.lit(True)))
        edges = _kept(_nearest(edges.unionByName(offers)), "neighbour-edges")
        return NeighbourGraph(every, members, _descend(every, edges))

    def write(self, folder: str) -> int:
        """Store as the next version under ``folder``; of two writers one gets Conflict. Returns the version."""
        commits, tag = Commits(self.nodes.sparkSession, f"{folder}/commits"), uuid.uuid4().hex
        number = commits.last() + 1
        named = {n: f"{n}-{tag}" for n in ("nodes", "members", "edges")}
        for n, path in named.items():
            getattr(self, n).write.parquet(f"{folder}/{path}")
        commits.commit(number, json.dumps(named))
        return number


def read(spark: SparkSession, folder: str, version: int | None = None) -> NeighbourGraph:
    """A stored graph, the last version if none is named."""
    commits = Commits(spark, f"{folder}/commits")
    named = json.loads(commits.text(commits.last() if version is None else version))
    schemas = {"nodes": NODES, "members": "node long, key long", "edges": EDGES}
    return NeighbourGraph(*[spark.read.schema(schemas[n]).parquet(f"{folder}/{named[n]}") for n in ("nodes", "members", "edges")])


def _start(entries: pa.Table, beam: int) -> Callable:
    """mapInArrow function: each query's nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = entries.column("node").to_numpy() if entries.num_rows else np.zeros(0, np.int64)
        known = search._matrix(entries.column("vec").chunk(0)) if entries.num_rows else {}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for d, (rows, m) in search._matrix(b.column(1)).items():
                if d not in known:
                    continue
                at, e = known[d]
                s = m @ e.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[rows], best.shape[1])), pa.array(ids[at[best]].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())], names=["query_id", "node", "score"])

    return run


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: products of the two vectors of a row, where they are of one length."""
    for b in batches:
        at, sizes, flat = _flat(b.column(2))
        at2, sizes2, flat2 = _flat(b.column(3))
        score = np.full(len(at), np.nan)
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero((sizes == d) & (sizes2 == d))
            for lo in range(0, len(rows), ROWS):
                r = rows[lo : lo + ROWS]
                score[r] = np.einsum("ij,ij->i", flat[at[r][:, None] + np.arange(d)].astype(np.float64), flat2[at2[r][:, None] + np.arange(d)].astype(np.float64))
        keep = np.flatnonzero(~np.isnan(score))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(score[keep])], names=["query_id", "node", "score"])
