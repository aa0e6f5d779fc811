"""The graph of nearest vectors against the exact join."""

import math

import numpy as np
import pytest

from grapheion.operators import neighbours, search
from grapheion.sources.commits import Conflict


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


def recall(found, exact):
    return len(pairs(found) & pairs(exact)) / max(1, exact.count())


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)


@pytest.fixture(scope="module")
def clustered():
    """Vectors of four free directions in sixteen dimensions: their neighbourhoods have structure."""
    rng = np.random.default_rng(4)
    return rng.normal(size=(4000, 4)) @ rng.normal(size=(4, 16)) + 0.02 * rng.normal(size=(4000, 16))


def test_given_vectors(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    graph = neighbours.build(emb, "vec_id", "embedding")
    assert graph.members.count() == emb.filter("vec_id is not null").count()
    exact = search.vector_join_all(emb, emb, "vec_id", "embedding", 5)
    assert recall(graph.neighbours("vec_id", 5), exact) >= 0.9
    assert recall(graph.nearest(emb, "vec_id", "embedding", 5), exact) >= 0.9


def test_few_products_additions_and_removals(spark, clustered, tmp_path):
    old, come = table(spark, clustered[:3600]), table(spark, clustered[3600:], 3600)
    asked = table(spark, clustered).filter("vec_id % 20 = 1")
    folder = f"file://{tmp_path}/graph"
    graph = neighbours.build(old, "vec_id", "embedding")
    assert graph.write(folder) == 0
    stored = neighbours.read(spark, folder)
    out_of = stored.visited(asked, "vec_id", "embedding", 10)
    assert out_of.count() < 0.1 * asked.count() * old.count()
    assert out_of.groupBy("query_id", "node").count().filter("count > 1").count() == 0
    assert recall(stored.nearest(asked, "vec_id", "embedding", 5, 10), search.vector_join_all(asked, old, "vec_id", "embedding", 5)) >= 0.9
    gone = old.filter("vec_id % 9 = 0")
    after = stored.changed(come, gone, "vec_id", "embedding")
    now = old.join(gone, "vec_id", "left_anti").unionByName(come)
    assert {r.key for r in after.members.select("key").collect()} == {r.vec_id for r in now.collect()}
    exact = search.vector_join_all(now, now, "vec_id", "embedding", 5)
    assert recall(after.neighbours("vec_id", 5), exact) >= 0.9
    assert recall(after.nearest(asked, "vec_id", "embedding", 5, 10), search.vector_join_all(asked, now, "vec_id", "embedding", 5)) >= 0.9
    assert after.write(folder) == 1 and neighbours.read(spark, folder).members.count() == now.count()
    assert neighbours.read(spark, folder, 0).members.count() == old.count()


def test_one_version_has_one_writer(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    graph = neighbours.build(table(spark, np.eye(4)), "vec_id", "embedding")
    graph.write(folder)
    commits = neighbours.Commits(spark, f"{folder}/commits")
    with pytest.raises(Conflict):
        commits.commit(0, "{}")
    assert neighbours.read(spark, folder).nodes.count() == 4


def test_copies_fill_no_list(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 6))
    v[::3] = 2.0 * v[0]
    items = table(spark, v)
    graph = neighbours.build(items, "vec_id", "embedding")
    assert graph.nodes.count() == 601 and graph.members.count() == 900
    found = graph.nearest(items.filter("vec_id in (3, 4)"), "vec_id", "embedding", 4).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == 3] == [(0, 1.0), (6, 1.0), (9, 1.0), (12, 1.0)]
    assert len([r for r in found if r.query_id == 4]) == 4
    assert recall(graph.neighbours("vec_id", 4), search.vector_join_all(items, items, "vec_id", "embedding", 4)) >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "c"), (5, None, "d"), (6, [], "e"), (None, [1.0, 0.0], "f"), (7, [1.0, 2.0, 3.0], "g"), (8, [1.0, 2.0, 3.0], "h"), (9, [math.nan, 1.0], "i")]
    items = spark.createDataFrame(rows, "key long, vec array<double>, list string")
    graph = neighbours.build(items, "key", "vec")
    for rows in (graph.neighbours("key", 3), graph.nearest(items, "key", "vec", 3)):
        got = {(r.query_id, r.key): (r.score, r["rank"]) for r in rows.collect()}
        assert got[(1, 2)] == got[(2, 1)] == (1.0, 1) and got[(7, 8)] == got[(8, 7)] == (1.0, 1) and got[(3, 9)] == (1.0, 1)
        assert not {4, 5, 6, None} & {k for p in got for k in p} and not any(a == b for a, b in got)
    empty = neighbours.build(items.limit(0), "key", "vec")
    assert empty.members.count() == 0 and empty.nearest(items, "key", "vec", 3).count() == 0 and empty.neighbours("key", 3).count() == 0
    assert graph.nearest(items.limit(0), "key", "vec", 3).count() == 0
    assert empty.changed(items, items.limit(0), "key", "vec").members.count() == graph.members.count()


def test_vectors_move_once_a_partition_and_products_are_written_once(spark, tmp_path, monkeypatch):
    """Rounds of descent sent each vector once for every list it was in; each round of a search wrote all earlier products."""
    monkeypatch.setattr(neighbours, "LEAF", 100)
    monkeypatch.setattr(neighbours, "STRIP", 7)
    monkeypatch.setattr(neighbours, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    seen, real = [], neighbours._compare
    monkeypatch.setattr(neighbours, "_compare", lambda members: seen.append(members.count()) or real(members))
    rng = np.random.default_rng(5)
    items = table(spark, rng.normal(size=(600, 3)) @ rng.normal(size=(3, 8)))
    graph = neighbours.build(items, "vec_id", "embedding")
    assert sum(seen) == neighbours.PARTITIONS * 600
    assert recall(graph.neighbours("vec_id", 5), search.vector_join_all(items, items, "vec_id", "embedding", 5)) >= 0.9
    found = graph.visited(items.filter("vec_id % 10 = 1"), "vec_id", "embedding", 10)
    written = [p for p in tmp_path.iterdir() if p.name.startswith("neighbour-found")]
    assert len(written) > 1 and sum(spark.read.parquet(str(p)).count() for p in written) == found.count()
