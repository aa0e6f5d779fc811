"""Every pair of a text and a document that holds it, and the query that counts them."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from grapheion.operators import contained
from grapheion.operators.textindex import first_relevant
from grapheion.plans import catalogue


@pytest.mark.parametrize("window, together", [(1, 1), (7, 3), (1 << 16, 1 << 20)])
def test_equals_a_search_of_each(monkeypatch, window, together):
    monkeypatch.setattr(contained, "WINDOW", window)
    monkeypatch.setattr(contained, "TOGETHER", together)
    rnd = random.Random(window)
    for letters in ("ab", "aé b", "abcdefgh xyzß漢"):
        docs = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 20, 200]))) for _ in range(12)]
        texts = [d[(i := rnd.randrange(len(d) + 1)) : i + rnd.randrange(40)] for d in rnd.choices(docs, k=30)] + ["".join(rnd.choice(letters) for _ in range(n % 9)) for n in range(20)]
        table = pa.table({"query_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
        batch = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(12)]), pa.array(docs)], names=["key", "body"])
        for first in (0, 5):
            got = [(r["query_id"], r["key"]) for b in contained._held(table)(iter([batch.slice(first)])) for r in b.to_pylist()]
            assert sorted(got) == sorted((q, f"k{k}") for k in range(first, 12) for q, t in enumerate(texts) if t in docs[k])


def test_equal_hashes_are_told_apart(monkeypatch):
    """With all hashes alike only bytes decide, at other places of the document too."""
    monkeypatch.setattr(contained, "BASE", 0)
    table = pa.table({"query_id": [1, 2, 3], "text": ["abcd", "zbcd", "xx"]})
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["dd yyyd ...d abcd"])], names=["key", "body"])
    assert [r for b in contained._held(table)(iter([batch])) for r in b.to_pylist()] == [{"query_id": 1, "key": 1}]


def test_blocks_of_texts(spark, monkeypatch):
    monkeypatch.setattr(contained, "TEXTS", 4)
    asked = spark.createDataFrame([(str(i), "abcdefghij"[i:]) for i in range(10)] + [("none", None), ("all", "")], "query_id string, text string")
    docs = spark.createDataFrame([(1, "..cdefghij"), (2, "j"), (3, ""), (4, None)], "key int, body string")
    got = {(r.query_id, r.key) for r in contained.pairs(asked, docs).collect()}
    assert got == {(str(i), 1) for i in range(2, 10)} | {("9", 2)} | {("all", k) for k in (1, 2, 3)}


def test_misses_count_and_twice_the_same_does_not(spark):
    found = spark.createDataFrame([(1, 7, 3), (1, 8, 2), (2, 7, 1)], "query_id int, key int, rank int")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, size string")
    relevant = spark.createDataFrame([(1, 7), (1, 7), (1, 9), (2, 8)], "query_id int, key int")
    assert {tuple(r) for r in first_relevant(found, queries, relevant).select("query_id", "size", "rank").collect()} == {(1, "a", 3), (2, "b", None)}


def test_short_texts_are_held_too(spark, tmp_path):
    """Texts of fewer than nine words, and parts of words, had no document: they were no cases."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    docs = [(i, " ".join(words[i % 5 : i % 5 + 4 + i])) for i in range(9)] + [(90, None), (91, ""), (92, "naïve  café\nend" + " x" * 200)]
    asked = ["beta", "eta", "gamma delta", "mma del", " beta gamma ", "alpha beta gamma delta epsilon zeta eta the", "delta epsilon zeta eta theta iota kappa", " ".join(words[:12]), "ïve  caf", "é\nend", "nowhere", "epsilon", "", None, " x" * 110]
    pq.write_table(pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(len(asked)), pa.int64()), "text": asked}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    rows = lambda found: sorted((str(r["size"]), r["cases"], r["hit5"], r["mrr"]) for r in found)
    want = con.sql(catalogue.oracle_sql()["eval_retrieval"])
    want = rows([dict(zip(want.columns, r)) for r in want.fetchall()])
    assert rows(r.asDict() for r in catalogue.queries()["eval_retrieval"](spark, f"file://{tmp_path}").collect()) == want
    assert want[0][:2] == ("None", 12)
