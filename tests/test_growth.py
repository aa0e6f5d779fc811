"""What queries move and keep grows no faster than what they ask for."""

import pytest
from pyspark.sql import functions as F

from grapheion.operators import algos, context, maintain, search, textindex
from grapheion.operators.lineage import by_key
from grapheion.plans import catalogue, fixture

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def graph(spark):
    spark.catalog.clearCache()
    return fixture.graph(spark, SF)


def test_kinds_that_are_not_asked_for_are_not_read(graph):
    """Tests of functions come from orders; lines are read for calls only, and nothing is kept."""
    tested = plan(graph.edges.filter("kind = 'TESTED_BY'").agg(F.min("src")))
    assert "InMemoryRelation" not in tested
    assert "o_orderkey" in tested
    assert "l_orderkey" not in tested


def test_customers_are_not_broadcast(graph):
    """Names of customers are many times their file; at 60-fold tables they went through the driver."""
    tested = plan(graph.edges.filter("kind = 'TESTED_BY'"))
    assert "o_custkey" in tested and "BroadcastHashJoin [o_custkey" not in tested and "BroadcastHashJoin [ck" not in tested


def test_plans_of_replaced_files_are_not_many_times_the_graphs(spark):
    """Paths went into each part of the graph with all that they are made of: the plan alone filled the driver."""
    scans = lambda name: plan(catalogue.queries()[name](spark, SF)).count("FileScan parquet")
    assert 0 < scans("replaced_files") < scans("graph_stats_edges")


@pytest.mark.parametrize("named, few", [(100, 100), (1, 100), (1, 1)])
def test_rows_of_files_named_sent_or_joined(spark, monkeypatch, named, few):
    monkeypatch.setattr(maintain, "NAMED", named)
    monkeypatch.setattr(maintain, "FEW", few)
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "c"), (5, "a")], "x int, file_path string")
    found = maintain.of_files(spark.createDataFrame([("a",), (None,), ("a",), ("c",), ("d",)], "file_path string"))
    assert found(rows).columns == found(rows, but=True).columns == rows.columns
    assert [sorted(r.x for r in df.collect()) for df in (found(rows), found(rows, but=True))] == [[1, 4, 5], [2, 3]]
    none = maintain.of_files(rows.select("file_path").filter("false"))
    assert (none(rows).count(), none(rows, but=True).count()) == (0, 5)


def test_weights_move_edges_no_more_than_resolution_does(graph):
    assert plan(algos.pair_weights(graph)).count("Exchange hashpartitioning") <= plan(graph.edges).count("Exchange hashpartitioning")


def test_kept_tables_stay_where_they_are(spark):
    kept = by_key(spark.range(1000).select((F.col("id") % 7).alias("node"), "id"), "node").cache()
    front = spark.range(1 << 24).select(F.col("id").alias("node")).hint("merge")
    joined = plan(kept.join(front, "node"))
    kept.unpersist()
    assert joined.split("InMemoryRelation")[0].count("Exchange") == 1


def test_equal_spans_meet_lines_once(spark, monkeypatch):
    rows = [("a.py", "Function", 1, 9, f"a.py::f{i:03d}") for i in range(500)] + [("a.py", "Test", 4, 6, "a.py::t")]
    nodes = spark.createDataFrame(rows, "file_path string, kind string, line_start int, line_end int, qualified_name string")
    seen, real = [], context.overlaps
    monkeypatch.setattr(context, "overlaps", lambda a, b: seen.append(a.count()) or real(a, b))
    lines = spark.createDataFrame([("a.py", 2), ("a.py", 5), ("a.py", 5), ("b.py", 1)], "file string, line int")
    got = {(r.file, r.line, r.enclosing) for r in context.enclosing(nodes, lines).collect()}
    assert seen == [2] and got == {("a.py", 2, "a.py::f000"), ("a.py", 5, "a.py::t"), ("b.py", 1, "b.py")}


def _moved(df):
    """Rows that shuffles of a computed plan wrote."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        found += p.metrics().apply("shuffleRecordsWritten").value() if p.metrics().contains("shuffleRecordsWritten") else 0
        todo += [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_queries_of_one_word_move_its_postings_once(spark, tmp_path, monkeypatch):
    """Forty queries of a word that all of 2000 documents hold: no row a query and document is moved."""
    monkeypatch.setattr(textindex, "GROUP", 500)
    monkeypatch.setattr(textindex, "AT_ONCE", 7)
    monkeypatch.setattr(textindex, "QUERIES", 30)
    docs = spark.createDataFrame([(i, "the " * (i % 9 + 1) + f"w{i % 50} end") for i in range(2000)], "k long, t string").repartition(4)
    index = textindex.TextIndex.build(docs, "k", F.col("t"), f"file://{tmp_path}/i", tables=("blocks",))
    asked = spark.createDataFrame([(q, f"the w{q} end") for q in range(40)], "query_id int, text string")
    found = index.top(asked, 5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.key, round(r.score, 6)))
    assert _moved(found) < 2 * 3 * 2000 + 4000 < 40 * 2000
    for q in (0, 17, 39):
        assert got[q] == [(r.k, round(r.score, 6)) for r in search.bm25(docs, "k", F.col("t"), f"the w{q} end", 5).collect()]


def test_a_dictionary_needs_no_postings(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a a"), (2, "b"), (3, None)], "k int, t string")
    index = textindex.TextIndex.build(df, "k", F.col("t"), f"file://{tmp_path}/i", tables=("prefixes",))
    assert {(r.term, r.df) for r in index.prefixed("").collect()} == {("a", 1), ("b", 2)}
    assert not (tmp_path / "i" / "blocks").exists()


def test_tasks_that_save_an_index_are_cut_by_rows(spark, tmp_path, monkeypatch):
    """Parts of names that are alike shrink to little in the shuffle; a task had all of a bucket by its bytes."""
    monkeypatch.setattr(textindex, "TASK_ROWS", 1000)
    names = spark.range(3000).select(F.concat(F.lit("fn_"), "id").alias("name"), F.concat(F.lit("src/a.py::fn_"), "id").alias("qualified_name"), F.lit("src/a.py").alias("file_path"), F.lit("Function").alias("kind"))
    index = textindex.NameIndex.build(names, f"file://{tmp_path}/n")
    tasks = index._read("parts").groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().agg(F.max("count"), F.sum("count"), F.count("*")).first()
    assert 6 * tasks[0] < tasks[1]
    rows = lambda df: [tuple(r) for r in df.select("qualified_name", "tier").collect()]
    assert rows(index.search_and("fn_29 src", 30)) == rows(search.search_and(names, "fn_29 src", 30)) != []
    docs = spark.createDataFrame([(i, f"w{i} end") for i in range(500)], "k long, t string")
    words = textindex.TextIndex.build(docs, "k", F.col("t"), f"file://{tmp_path}/i", tables=("blocks", "variants"))
    assert {r.term for r in words.near(spark.createDataFrame([("w49",)], "word string")).collect()} == {"w49", "w4", "w9", *(f"w{i}9" for i in range(1, 10)), *(f"w4{i}" for i in range(10)), *(f"w49{i}" for i in range(10)), *(f"w{i}49" for i in range(1, 5)), *(f"w4{i}9" for i in range(10))}
