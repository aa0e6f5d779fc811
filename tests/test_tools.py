import subprocess

from grapheion import tools
from grapheion.operators import search

from test_sources import SAMPLE


def test_tools_end_to_end(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    run("init", "-q")
    for name, text in SAMPLE.items():
        (tmp_path / name).write_text(text)
    run("add", "."), run("commit", "-qm", "one")
    repo = tools.Repository(spark, str(tmp_path))
    built = tools.build_or_update_graph(repo, full_rebuild=True)
    assert built["nodes"] == 8 and built["build_type"] == "full"
    assert tools.list_graph_stats(repo)["nodes_by_kind"] == {"File": 3, "Function": 5}
    assert tools.trace_call_chain(repo, "main.py::run", "utils.py::add")["status"] == "no_path"  # calls across files stay unresolved
    assert tools.trace_call_chain(repo, "service.ts::farewell", "service.ts::greet")["hops"] == 1
    children = tools.query_graph(repo, "children_of", "utils.py")
    assert [(r["name"], r["lines"]) for r in children["results"]] == [("add", "1-3"), ("subtract", "5-6")]
    found = tools.semantic_search_nodes(repo, "add")
    assert found["mode"] == "keyword" and found["results"][0]["name"] == "add"
    assert tools.semantic_search_nodes(repo, "add function")["results"] == []
    assert tools.embed_graph(repo)["status"] == "error" and tools.embed_graph(repo, search.hash_provider(8), "hash")["embedded"] == 11
    assert tools.semantic_search_nodes(repo, "greet Function", provider=search.hash_provider(8))["mode"] == "vector"
    (tmp_path / "utils.py").write_text(SAMPLE["utils.py"].replace("a + b", "b + a"))
    impact = tools.get_impact_radius(repo)
    assert impact["changed_files"] == ["utils.py"] and len(impact["changed_nodes"]) == 3
    updated = tools.build_or_update_graph(repo)
    assert updated["build_type"] == "incremental"
    review = tools.get_review_context(repo, ["utils.py"])
    assert "return b + a" in review["snippets"]["utils.py"] and len(review["changed_functions"]) == 2
    node = tools.open_node_context(repo, "utils.py::add")
    assert node["preview"][0].startswith("def add") and node["siblings"] == ["utils.py::subtract"]
    assert tools.find_large_functions(repo, min_lines=3)["results"][0]["line_count"] >= 3
    assert tools.hybrid_query(repo, "greet_x greet")["status"] in ("ok", "no_match") and tools.batch_open_node_context(repo, ["utils.py::add"])[0]["status"] == "ok"
    assert tools.get_docs_section('<section name="a">x</section>', "a")["content"] == "x" and len(tools.listed("all")) == 13 and len(tools.listed("core")) == 5


def test_settings_and_watch(spark, tmp_path, monkeypatch):
    import pytest

    from grapheion import __main__ as cli

    (tmp_path / ".git").mkdir()
    assert cli.config(str(tmp_path), "model", "m1") == {"model": "m1"}
    assert cli.config(str(tmp_path), "api_key", "abcdefghijk") == {"model": "m1", "api_key": "abc***ijk"} and oct((tmp_path / ".grapheion" / "config.json").stat().st_mode)[-3:] == "600"
    with pytest.raises(ValueError):
        cli.config(str(tmp_path), "other", "x")
    updates = []

    class Repo:
        root = str(tmp_path)

        def update(self, changed):
            updates.append(changed)

    (tmp_path / "a.py").write_text("x = 1")
    monkeypatch.setattr(cli.git, "tracked", lambda root: ["a.py", "b.py", "c.txt"])
    steps = iter([lambda: (tmp_path / "b.py").write_text("y"), lambda: None, lambda: (tmp_path / "a.py").unlink()])
    monkeypatch.setattr(cli.time, "sleep", lambda _: next(steps)())
    assert cli.watch(Repo(), rounds=3) == 2 and updates == [["b.py"], ["a.py"]]
