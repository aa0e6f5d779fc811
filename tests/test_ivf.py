"""The index of lists against the exact join."""

import math

import numpy as np
import pytest

from grapheion.operators import ivf, search


def pairs(df):
    return {(r.query_id, r.vec_id) for r in df.collect()}


@pytest.fixture(scope="module")
def emb(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def test_recall_and_every_row_indexed(emb):
    asked = emb.filter("vec_id % 5 = 0")
    exact = pairs(search.vector_join_all(asked, emb, "vec_id", "embedding", 5))
    index = ivf.build(emb, "vec_id", "embedding")
    assert index.items.count() == emb.count() and index.items.filter("list = -1").count() == 0
    recall = len(exact & pairs(index.nearest(asked, "vec_id", "embedding", 5))) / len(exact)
    print("probes", index.probes, "recall", recall)
    assert recall >= 0.9


def test_clustered_vectors_need_few_lists():
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(64, 16)), 30, axis=0) + 0.05 * rng.normal(size=(64 * 30, 16))
    v /= np.sqrt((v * v).sum(1))[:, None]
    assert ivf.calibrate(v, ivf.fit(v, 64)) <= 8


def test_all_probes_equal_the_exact_join(emb):
    asked = emb.filter("vec_id % 100 = 0")
    key = ["query_id", "vec_id", "score", "rank"]
    exact = search.vector_join_all(asked, emb, "vec_id", "embedding", 5).select(key).collect()
    found = ivf.build(emb, "vec_id", "embedding", lists=8).nearest(asked, "vec_id", "embedding", 5, probes=8).select(key).collect()
    assert sorted(found) == sorted(exact)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 1.0], "b"), (4, [0.0, 0.0], "c"), (5, None, "d"), (6, [], "e"), (None, [1.0, 0.0], "f"), (7, [1.0, 2.0, 3.0], "g"), (8, [1.0, 2.0, 3.0], "h"), (9, [math.nan, 1.0], "i")]
    items = spark.createDataFrame(rows, "key long, vec array<double>, list string")
    index = ivf.build(items, "key", "vec", lists=2)
    assert index.items.count() == len(rows)
    got = {(r.query_id, r.key): (r.score, r["rank"]) for r in index.nearest(items, "key", "vec", 3, probes=1).collect()}
    assert got[(1, 2)] == got[(2, 1)] == (1.0, 1) and got[(7, 8)] == got[(8, 7)] == (1.0, 1) and got[(3, 9)] == (1.0, 1)
    assert not {4, 5, 6, None} & {k for p in got for k in p} and not any(a == b for a, b in got)
    empty = ivf.build(items.limit(0), "key", "vec")
    assert empty.items.count() == 0 and empty.nearest(items, "key", "vec", 3).count() == 0
    assert index.nearest(items.limit(0), "key", "vec", 3).count() == 0


def test_one_list_may_hold_most_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ([1.0, 0.0, 0.0] if i % 3 else rng.normal(size=3).tolist())) for i in range(3000)]
    items = spark.createDataFrame(rows, "key long, vec array<double>").repartition(4)
    found = ivf.build(items, "key", "vec", lists=16).nearest(items.filter("key = 1"), "key", "vec", 4, probes=2).collect()
    assert [(r.key, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 1.0), (4, 1.0), (5, 1.0), (7, 1.0)]
