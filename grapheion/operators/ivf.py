"""Approximate nearest vectors: lists around centroids, of which a query visits the nearest ones.

Centroids are fitted on a bounded sample, at most twice ``SAMPLE_ROWS`` vectors chosen by hash;
every vector is put into the list of its most similar centroid, by a map. Vectors of another
length than the sample's commonest go to list ``REST``, which every query visits, so they are
compared exactly. How many lists a query visits is measured on the sample. Stored by list (``Index.items`` is a plain table), a scan for few queries reads
the folders of the visited lists alone.

Items are never dealt by list, so a list that holds a third of them is spread as the scan is.
Queries go out in bounded blocks; a task multiplies a list's vectors with the queries that visit
it and keeps the best few a query, and only these are shuffled.

Defined cases: null keys, and vectors that are null, empty or zero are neighbours of nothing;
vectors of different length are no neighbours; equal scores go by key; rows of the query's own
key are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grapheion.operators import search
from grapheion.shipping import ship

#: Expected rows of the sample that centroids are fitted on; twice as many at most.
SAMPLE_ROWS = 20_000
#: Lists; centroids of LISTS x length doubles go to every task.
LISTS = 64
ROUNDS = 10
#: Share of a sampled query's nearest ASKED_TOP sampled vectors that its visits must reach.
RECALL = 0.95
ASKED, ASKED_TOP = 500, 10


def fit(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of length one by spherical k-means, started at rows spread over the sample."""
    lists = max(1, min(lists, len(vectors)))
    centroids = vectors[np.linspace(0, len(vectors) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        home = (vectors @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        norm = np.sqrt((sums * sums).sum(1))
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0][:, None]
    return centroids


def calibrate(vectors: np.ndarray, centroids: np.ndarray) -> int:
    """The least number of lists to visit that reaches RECALL among the sample itself.

    Vectors without structure need many lists, clustered ones few. Neighbours in the whole
    table are nearer than in the sample, so they lie in the visited lists no less often.
    """
    asked = np.unique(np.linspace(0, len(vectors) - 1, min(ASKED, len(vectors))).astype(int))
    home = (vectors @ centroids.T).argmax(1)
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, np.argsort(-(vectors[asked] @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None, :], axis=1)
    needed = []
    for i, q in enumerate(asked.tolist()):
        scores = vectors @ vectors[q]
        scores[q] = -2.0
        near = np.argsort(-scores, kind="stable")[: min(ASKED_TOP, len(vectors) - 1)]
        needed.extend(place[i, home[near]].tolist())
    return int(np.quantile(needed, RECALL, method="higher")) + 1 if needed else 1


def _sample(items: DataFrame, key: str, vector: str) -> np.ndarray:
    """Unit vectors of the sample's commonest length."""
    held = items.filter(F.col(key).isNotNull() & (F.size(vector) > 0))
    share = min(1.0, SAMPLE_ROWS / max(1, held.count()))
    chosen = held.filter(F.pmod(F.xxhash64(key, vector), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = chosen.select(F.col(vector).alias("vec")).limit(2 * SAMPLE_ROWS).toArrow().combine_chunks()
    by_size = search._matrix(table.column("vec").chunk(0)) if table.num_rows else {}
    return max((m for _, m in by_size.values()), key=len, default=np.zeros((0, 0)))


#: The list of vectors that have none, by their length.
REST = -1


def _lists_of(vectors: pa.Array, centroids: np.ndarray) -> np.ndarray:
    out = np.full(len(vectors), REST, np.int32)
    mine = search._matrix(vectors)
    if centroids.size and centroids.shape[1] in mine:
        rows, m = mine[centroids.shape[1]]
        out[rows] = (m @ centroids.T).argmax(1)
    return out


def build(items: DataFrame, key: str, vector: str, lists: int = LISTS) -> Index:
    """Fit centroids and put every row into its list."""
    ship(items.sparkSession)
    sample = _sample(items, key, vector)
    centroids = fit(sample, lists) if len(sample) else sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_lists_of(b.column(1), centroids))], names=["key", "vec", "list"])

    rows = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    return Index(rows.mapInArrow(run, "key long, vec array<double>, list int"), centroids, calibrate(sample, centroids) if len(sample) else 1)


@dataclass(frozen=True)
class Index:
    """``items`` (key, vec, list), the centroids of the lists and how many of them a query visits."""

    items: DataFrame
    centroids: np.ndarray
    probes: int

    def visits(self, vectors: pa.Array, probes: int) -> np.ndarray:
        """Which query visits which list, as a boolean matrix; the last column is REST."""
        lists = len(self.centroids)
        out = np.zeros((len(vectors), lists + 1), bool)
        out[:, REST] = True
        mine = search._matrix(vectors)
        if lists and self.centroids.shape[1] in mine:
            rows, m = mine[self.centroids.shape[1]]
            best = np.argsort(-(m @ self.centroids.T), axis=1, kind="stable")[:, :probes]
            out[rows[:, None], best] = True
        return out

    def nearest(self, queries: DataFrame, key: str, vector: str, top: int, probes: int | None = None) -> DataFrame:
        """(query_id, key, score, rank): the ``top`` most similar other items in the lists a query visits."""
        asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
        blocks = max(1, -(-asked.count() // search.QUERY_BLOCK))
        found = None
        for b in range(blocks):
            # one block, of QUERY_BLOCK rows or little more
            table = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow().combine_chunks()
            seen = self.visits(table.column("vec").chunk(0), probes or self.probes) if table.num_rows else np.zeros((0, len(self.centroids) + 1), bool)
            visited = [*np.flatnonzero(seen[:, :-1].any(0)).tolist(), REST]
            held = self.items.filter(F.col("key").isNotNull() & F.col("list").isin(visited))
            part = held.select("key", "vec", "list").mapInArrow(_visit(table, seen, top), "query_id long, key long, score double")
            found = part if found is None else found.unionByName(part)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", F.col("key").alias(key), "score", "rank")


def _visit(table: pa.Table, seen: np.ndarray, top: int) -> Callable:
    """mapInArrow function: the ``top`` items of a task for each query of ``table``, in the lists it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        ids = table.column("key").to_numpy()
        asked = search._matrix(table.column("vec").chunk(0))
        best_key, best_score = np.zeros((len(ids), top), np.int64), np.full((len(ids), top), -2.0)
        for b in batches:
            keys, home = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for d, (rows, m) in search._matrix(b.column(1)).items():
                if d not in asked:
                    continue
                q_rows, q = asked[d]
                for number in np.unique(home[rows]).tolist():
                    at, on = np.flatnonzero(home[rows] == number), np.flatnonzero(seen[q_rows, number])
                    step = max(1, search.SCORES // len(at))
                    for lo in range(0, len(on), step):
                        some = on[lo : lo + step]
                        scores = np.round(q[some] @ m[at].T, 4) + 0.0
                        scores[ids[q_rows[some], None] == keys[rows[at]][None, :]] = -2.0
                        search._keep(best_key, best_score, q_rows[some], scores, keys[rows[at]])
        yield from search._kept(ids, best_key, best_score)

    return run
