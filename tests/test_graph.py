import random

import pytest
from pyspark.sql import functions as F

from grapheion.functions import text as tx
from grapheion.operators import algos, context, maintain, search
from grapheion.operators.graph import BUILTINS, EDGE_SCHEMA, EDGE_WEIGHTS, NODE_SCHEMA, CodeGraph, query_graph


def make(spark, nodes, edges):
    """nodes: (file, name[, kind[, start, end]]); edges: (source name, target name, kind)."""
    rows, qn = [], {}
    for i, n in enumerate(nodes):
        file, name, kind, start, end = (*n, *("Function", 1, 10)[len(n) - 2 :])
        qn[name] = f"{file}::{name}"
        rows.append((i, name, qn[name], kind, file, start, end, "python", kind == "Test", "", "", f"hash_{name}", "f"))
    raw = [(qn.get(a, a), qn.get(b, b), k, qn.get(a, a).split("::")[0], 1) for a, b, k in edges]
    return CodeGraph(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame(raw, EDGE_SCHEMA))


def names(df):
    return [r.name for r in df.collect()]


def test_last_definition_answers_for_a_name(spark):
    g = make(spark, [("a.py", "f", "Function", 1, 2), ("a.py", "f", "Function", 5, 9)], [("f", "f", "CALLS"), ("f", "gone", "CALLS")])
    assert g.node("a.py::f").first().line_start == 5 and g.nodes.count() == 2 and g.edges.count() == 1


def test_parallel_edges(spark):
    g = make(spark, [("a.py", "a"), ("a.py", "b")], [("a", "b", "CALLS")] * 2)
    assert g.edges.count() == 2 and g.edges_distinct.count() == 1
    assert maintain.add_edges(g, g.edges_raw).edges_raw.count() == 1


def test_patterns(spark):
    g = make(spark, [("a.py", "run"), ("b.py", "add"), ("b.py", "test_add", "Test"), ("b.py", "Base", "Class"), ("b.py", "Dog", "Class")], [("run", "add", "CALLS"), ("add", "test_add", "TESTED_BY"), ("Dog", "Base", "INHERITS")])
    ask = lambda p, t: [r["name"] for r in query_graph(g, p, t)["results"]]
    assert ask("callers_of", "b.py::add") == ["run"] and ask("callees_of", "a.py::run") == ["add"]
    assert ask("tests_for", "b.py::add") == ["test_add"] and ask("inheritors_of", "b.py::Base") == ["Dog"]
    assert ask("file_summary", "b.py") and query_graph(g, "nothing", "x")["status"] == "error"
    assert query_graph(g, "callers_of", "map")["total_results"] == 0 and "map" in BUILTINS
    assert query_graph(g, "callers_of", "zzz")["status"] == "not_found"
    assert g.tests_of("b.py::add", compat=True).count() == 1  # by name only


def test_callers_fall_back_to_names(spark):
    g = make(spark, [("a.py", "run"), ("x.py", "add"), ("y.py", "other")], [("run", "add", "CALLS")])
    assert names(g.callers("y.py::add")) == ["run"] and names(g.callers("x.py::add")) == ["run"]


def test_search_order(spark):
    g = make(spark, [("m.ts", "process"), ("m.ts", "process_request"), ("m.ts", "pre_process")], [])
    assert names(search.search_and(g.by_name, "process", 10)) == ["process", "process_request", "pre_process"]
    g = make(spark, [("helpers.ts", "validate_config_x"), ("config.ts", "y_validate_config")], [])
    assert names(search.search_and(g.by_name, "config", 1)) == ["y_validate_config"]
    g = make(spark, [("src/a.js", "loader"), ("compiled/a.js", "loader")], [])
    assert search.search_and(g.by_name, "load", 1).first().file_path == "src/a.js"


def test_relaxed_search(spark):
    g = make(spark, [("src/keys.ts", "KeybindingResolver", "Class"), ("t.py", "ssl_verify_context", "Test"), ("s.py", "ssl_verify_context")], [])
    long = "keybinding resolution picks the wrong command whenever several extensions register chords"
    assert search.search_and(g.by_name, long, 5).count() == 0
    assert names(search.search_relaxed(g.by_name, long, 5)) == ["KeybindingResolver"]
    top = search.search_relaxed(g.by_name, "ssl verify context wrong hostname", 5).collect()
    assert [r.kind for r in top][:2] == ["Function", "Test"]


def test_large(spark):
    g = make(spark, [("a.py", "big", "Function", 1, 100), ("a.py", "small", "Function", 1, 5)], [])
    assert names(g.large(50, "NoSuchKind")) == ["big"]


def brute_pagerank(nodes, edges, seeds, rounds):
    indeg, share = {}, {}
    for a, b, k in edges:
        indeg[b] = indeg.get(b, 0) + EDGE_WEIGHTS[k]
        share[a, b] = share.get((a, b), 0) + EDGE_WEIGHTS[k]
    score = dict.fromkeys(seeds, 1 / len(seeds))
    for _ in range(rounds):
        new = dict.fromkeys(seeds, 0.15 / len(seeds))
        for (a, b), w in share.items():
            new[a] = new.get(a, 0) + 0.85 * score.get(b, 0) * w / indeg[b]
        score = {k: v for k, v in new.items() if v > 1e-6}
    return score


def test_pagerank_equals_brute_force(spark):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(25)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice(list(EDGE_WEIGHTS))) for _ in range(70)]
    g = make(spark, [("f.py", n) for n in nodes], edges)
    seeds = spark.createDataFrame([("f.py::n1",), ("f.py::n2",)], "qualified_name string")
    got = {r.qualified_name.split("::")[1]: r.score for r in algos.pagerank(g, seeds, 7).collect()}
    assert got == pytest.approx(brute_pagerank(nodes, edges, ["n1", "n2"], 7))


def test_impact_prefers_heavy_edges(spark):
    g = make(spark, [("c.py", "high"), ("s.py", "seed"), ("l.py", "low")], [("high", "seed", "INHERITS"), ("low", "seed", "CONTAINS")])
    files = spark.createDataFrame([("s.py",)], "file_path string")
    found = algos.impact_radius(g, files)
    assert [r.qualified_name for r in found["impacted"].orderBy(F.desc("score")).collect()] == ["c.py::high", "l.py::low"]
    assert {r.file_path for r in found["files"].collect()} == {"c.py", "l.py"} and found["edges"].count() == 2
    note = context.guidance(found)
    assert "lack tests: seed" in note and "1 inheritance" in note


def test_call_chain(spark):
    g = make(spark, [("f.py", n) for n in "abcdex"], [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("a", "d", "CALLS"), ("d", "c", "CALLS"), ("c", "e", "CALLS"), ("e", "a", "CALLS")])
    path = algos.call_chain(g, "f.py::a", "f.py::e")
    assert path == [f"f.py::{n}" for n in "abce"]
    assert algos.call_chain(g, "f.py::a", "f.py::x") == []
    assert algos.trace(g, "f.py::a", "f.py::x")["status"] == "no_path" and algos.trace(g, "f.py::a", "f.py::c")["hops"] == 2
    assert algos.path_steps(g, path).count() == 3


def test_expansion_is_capped(spark):
    g = make(spark, [("h.py", "hub")] + [("h.py", f"c{i:03}") for i in range(100)], [("hub", f"c{i:03}", "CALLS") for i in range(100)])
    cand = spark.createDataFrame([("h.py::hub", 0.5)], "qualified_name string, score double")
    got = algos.expand_one_hop(g, cand, 10).collect()
    assert len(got) == 20 and all(r.score == pytest.approx(0.15) for r in got)


def pool(spark, rows):
    return spark.createDataFrame(rows, "qualified_name string, score double, sources array<string>")


def test_file_scores(spark):
    g = make(spark, [("A", "a1"), ("B", "b1"), ("B", "b2"), ("B", "b3"), ("t", "t1", "Test"), ("f", "f1")], [])
    files = lambda rows, q="anything": {r.file_path: round(r.score, 6) for r in search.score_files(g, pool(spark, rows), tx.decompose(q), 10).collect()}
    assert files([("A::a1", 0.05, ["keyword_exact"]), ("B::b1", 0.04, ["r"]), ("B::b2", 0.03, ["r"]), ("B::b3", 0.02, ["r"])]) == {"A": 0.1125, "B": 0.075}
    assert files([("A::a1", 0.08, ["r"]), ("B::b1", 0.03, ["r"]), ("B::b2", 0.03, ["r"]), ("B::b3", 0.03, ["r"])]) == {"A": 0.12, "B": 0.063}
    demoted = files([("t::t1", 0.08, ["r"]), ("f::f1", 0.06, ["r"])])
    assert demoted["f"] > demoted["t"] and files([("t::t1", 0.08, ["r"])], "run the test")["t"] == pytest.approx(0.12)


def test_hybrid(spark):
    g = make(spark, [("src/cache.py", "cache_reducer"), ("src/other.py", "handler"), ("src/other.py", "cache_reducer_old")], [("handler", "cache_reducer", "CALLS")])
    out = search.hybrid(g, "cache_reducer")
    assert out["status"] == "ok" and out["route"] == "ExactSymbol" and out["results"][0]["file_path"] == "src/cache.py"
    assert search.hybrid(g, "  ")["status"] == "no_match" and "suggestion" in search.hybrid(g, "zzzz_none")
    nodes = search.hybrid(g, "cache_reducer", budget_name="thorough", scope="src/other")
    assert {r["file_path"] for r in nodes["results"]} == {"src/other.py"}
    assert search.multi_view(g, "why does cache_reducer lose handler entries silently", 5).count() > 0


def test_rrf_and_vectors(spark):
    one = spark.createDataFrame([("n", 1)], "qualified_name string, rank int")
    r = search.fuse([search.channel(one, "a", 1.0, F.col("rank")), search.channel(one, "b", 1.0, F.col("rank"))]).first()
    assert r.score > 1 / 61 and r.sources == ["a", "b"]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [x.c for x in v.select(search.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_embeddings(spark):
    import numpy as np

    texts = spark.createDataFrame([("a", "same words"), ("b", "same words"), ("c", "others")], "key string, text string")
    first = search.embed(texts, None, search.hash_provider(8), "hash").cache()
    by = {r.key: r.vec for r in first.collect()}
    assert by["a"] == by["b"] != by["c"]

    def fail(_):
        raise AssertionError("stored vectors were not used")

    assert {r.key: r.vec for r in search.embed(texts, first, fail, "hash").collect()} == by
    vec = spark.createDataFrame([([0.1, -3.3333, 0.0, 1000.7],)], "v array<double>").select(search.half_precision(F.col("v")).alias("h")).first().h
    assert vec == [float(x) for x in np.array([0.1, -3.3333, 0.0, 1000.7], np.float16)]
    live = spark.createDataFrame([("a",)], "key string")
    assert search.live_only(first, live).count() == 1 and search.upsert(first, first.filter("key = 'a'")).count() == 3


def test_text_functions(spark):
    p = tx.decompose('fix "null deref" in src/app.ts where serverPatchReducer hits a race condition in tests')
    assert p.quoted == ["null deref"] and p.paths == ["src/app.ts"] and p.symbols == ["serverPatchReducer"] and p.compounds == ["race condition"] and p.mentions_tests
    cases = {"parseQuery": ("ExactSymbol", 0.9), 'find "x y"': ("ExactText", 0.85), "TypeError: no": ("ExactText", 0.8), "look in src/a": ("FilePath", 0.85), "why is it slow": ("Causal", 0.8), "config option broken": ("ConfigLookup", 0.75), "enable it": ("ConfigLookup", 0.6), "slow page": ("General", 0.5)}
    got = {r.q: (r.r, r.c) for r in spark.createDataFrame([(q,) for q in cases], "q string").select("q", tx.classified_columns(F.col("q"))[0].alias("r"), tx.classified_columns(F.col("q"))[1].alias("c")).collect()}
    assert got == cases == {q: (tx.classify(q).route, tx.classify(q).confidence) for q in cases}
    paths = spark.createDataFrame([("\\\\?\\C:\\a\\b\\",), ("a\\b::x\\y",)], "p string").select(tx.normalize_qualified(F.col("p")).alias("p")).collect()
    assert [r.p for r in paths] == ["C:/a/b", "a/b::x\\y"]


def test_merge_ranges_and_snippets(spark):
    g = make(spark, [("a.py", "x", "Function", 10, 12), ("a.py", "y", "Function", 14, 15), ("a.py", "z", "Function", 100, 101)], [])
    got = sorted((r.start, r.end) for r in context.merged_ranges(g.nodes, F.lit(300)).collect())
    assert got == [(7, 17), (97, 103)]
    lines = spark.createDataFrame([("a.py", i, f"l{i}") for i in range(1, 301)], "file_path string, line_no int, text string")
    text = context.snippets(lines, g.nodes).first().snippet
    assert text.startswith("8: l8") and "\n...\n98: l98" in text and text.endswith("103: l103")


def test_node_context(spark):
    g = make(spark, [("a.py", "f", "Function", 1, 9), ("a.py", "g", "Function", 10, 12), ("b.py", "h")], [("h", "f", "CALLS"), ("f", "g", "CALLS")])
    out = context.node_context(g, "a.py::f", compact=False)
    assert out["callers_count"] == 1 and out["siblings"] == ["a.py::g"] and out["callees"][0]["name"] == "g"
    assert [x["status"] for x in context.batch_context(g, ["a.py::f", "nope"])] == ["ok", "not_found"]
    review = context.review_context(g, ["a.py"])
    assert review["impacted"] == 1 and len(review["changed_functions"]) == 2


def test_replacing_files_equals_a_rebuild(spark):
    g = make(spark, [("a.py", "foo"), ("a.py", "bar"), ("b.py", "use")], [("use", "foo", "CALLS")])
    again = make(spark, [("a.py", "foo")], [])
    after = maintain.replace_files(g, again.nodes, again.edges_raw)
    assert sorted(names(after.in_file("a.py"))) == ["foo"] and after.edges.count() == 1  # the call from b.py is back by itself
    gone = maintain.remove_files(g, spark.createDataFrame([("a.py",)], "file_path string"))
    assert gone.edges.count() == 0 and names(gone.nodes) == ["use"]


def test_nearest_of_another_label(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 2, [1.0, 0.1]), (2, None, [1.0, 0.2]), (3, 1, [0.0, 1.0])]
    emb = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = search.vector_join_all(emb.filter("vec_id = 0"), emb, "vec_id", "embedding", 2).collect()
    assert [(r.query_id, r.vec_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_vector_join_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "SCORES", 7)
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)], i % 3 if i % 7 else None) for i in range(40)] + [(90, None, 1), (91, [1.0], 1), (92, [], 0), (None, [1.0, 1.0, 0.0], 1)]
    emb = spark.createDataFrame(rows, "vec_id long, v array<float>, label int").repartition(4)
    known = [r for r in rows if r[0] is not None]

    def near(a, b):
        a, b = a or [], b or []
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        norm = (dot(a, a) * dot(b, b)) ** 0.5
        return round(dot(a, b) / norm, 4) + 0.0 if len(a) == len(b) and norm else 0.0

    for bucket in (None, "label"):
        want = []
        for q in known:
            if q[0] % 2 == 0 and (bucket is None or q[2] is not None):
                others = sorted((-near(q[1], i[1]), i[0]) for i in known if i[0] != q[0] and (bucket is None or i[2] == q[2]))
                want += [(q[0], k, -s + 0.0, r) for r, (s, k) in enumerate(others[:4], 1)]
        asked = emb.filter("vec_id % 2 = 0")
        got = search.vector_join_all(asked, emb, "vec_id", "v", 4) if bucket is None else search.vector_join(asked, emb, "vec_id", bucket, "v", 4)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert search.vector_join_all(emb.limit(0), emb, "vec_id", "v", 4).count() == 0


def test_hybrid_with_vectors(spark):
    g = make(spark, [("src/cache.py", "cache_reducer"), ("src/net.py", "socket_pool"), ("src/net.py", "retry")], [])
    stored = spark.createDataFrame([("src/net.py::retry", "node", [1.0, 0.0]), ("src/cache.py::cache_reducer", "node", [0.0, 1.0]), ("src/net.py", "file", [1.0, 0.1]), ("src/cache.py", "file", [0.0, 1.0])], "key string, level string, vec array<double>")
    vectors = search.Vectors(stored, lambda texts: [[1.0, 0.0]] * len(texts))
    asked = "how does the application behave when connections break"
    assert search.hybrid(g, asked)["status"] == "no_match"
    out = search.hybrid(g, asked, vectors=vectors)
    assert out["status"] == "ok" and out["results"][0]["file_path"] == "src/net.py" and set(out["results"][0]["sources"]) == {"semantic", "file_semantic"}
    lines = lambda paths: spark.createDataFrame([(p, i, f"line {i}") for p in paths for i in range(1, 30)], "file_path string, line_no int, text string")
    shown = search.hybrid(g, asked, vectors=vectors, lines=lines)["results"][0]
    start = shown["top_nodes"][0]["line_start"]
    assert shown["preview"] == [f"line {i}" for i in range(start, start + 5)]
    nodes = search.hybrid(g, asked, mode="node", vectors=vectors)
    assert nodes["method"] == "hybrid_rrf" and nodes["results"][0]["qualified_name"] == "src/net.py::retry"
    assert search.hybrid(g, asked, mode="node", vectors=vectors, fusion="cc")["method"] == "hybrid_cc"
    assert search.hybrid(g, "cache_reducer", mode="node", vectors=vectors)["method"] == "keyword_only"
    assert search.hybrid(g, asked, route="odd")["status"] == search.hybrid(g, asked, fusion="odd")["status"] == "error"
    assert [r.file_path for r in search.nearest_files(vectors, "x", 1).collect()] == ["src/net.py"]
    assert search.hybrid(g, asked, vectors=vectors, switches=search.Switches().without("semantic"))["status"] == "no_match"


def test_full_text_tiers_and_fuzzy_fallback(spark):
    g = make(spark, [("a.py", "retry"), ("a.py", "retry policy"), ("b.py", "the retry"), ("b.py", "other")], [])
    assert [(r.name, r.tier) for r in search.indexed(g.by_name, "retry", 10).collect()] == [("retry", 0), ("retry policy", 1), ("the retry", 2)]
    assert {r.name for r in search.indexed(g.by_name, "retri)", 10).collect()} == set() and search.indexed(g.by_name, " ", 5).count() == 0
    assert not search.parses('"open') and not search.parses("a AND") and search.parses("a (b) \"c\"")
