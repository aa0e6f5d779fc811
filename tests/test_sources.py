import json
import os
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grapheion.operators import context, maintain
from grapheion.sources import aliases, extract, files, git, store

SAMPLE = {
    "utils.py": 'def add(a, b):\n    """Sum."""\n    return a + b\n\ndef subtract(a, b):\n    return a - b\n',
    "main.py": "from utils import add, subtract\n\ndef run():\n    return add(1, subtract(3, 2))\n",
    "service.ts": "export function greet(name: string): string {\n  return `hi ${name}`;\n}\nexport const farewell = (name: string) => {\n  return greet(name);\n}\n",
}


@pytest.fixture()
def repo(tmp_path):
    for name, text in SAMPLE.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function no() {}\n")
    (tmp_path / "bin.py").write_bytes(b"x = 1\x00\n")
    (tmp_path / "notes.txt").write_text("def no(): pass\n")
    (tmp_path / "skip.py").write_text("x = 1\n")
    (tmp_path / files.IGNORE_FILE).write_text("# comment\nskip.py\n")
    return tmp_path


def kinds(nodes):
    return sorted((n["kind"], n["name"]) for n in nodes if n["kind"] != "File")


def facts(path, text):
    return extract.extract(path, text.encode())


def targets(edges, kind):
    return {(e["source_qualified"].split("::")[-1], e["target_qualified"]) for e in edges if e["kind"] == kind}


def test_sample_repository(spark, repo):
    found = files.scan(spark, str(repo))
    assert sorted(r.file_path for r in found.select("file_path").collect()) == sorted(SAMPLE)
    g = extract.build(found)
    assert {r.kind: r["n"] for r in g.nodes.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"File": 3, "Function": 5}
    assert sorted((r.name, r.line_start, r.line_end) for r in g.children("utils.py").collect()) == [("add", 1, 3), ("subtract", 5, 6)]
    by_kind = {r.kind: r["n"] for r in g.edges.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert by_kind["CONTAINS"] == 5 and by_kind.get("CALLS") == 1  # within service.ts; calls across files do not resolve
    assert files.lines_of(found).filter("file_path = 'utils.py' and line_no = 3").first().text == "    return a + b"


def test_python_facts():
    nodes, edges = facts("pkg/a.py", "import os\nfrom .b import helper as h\n\nclass Dog(Animal, base.Pet):\n    def bark(self, n: int) -> str:\n        h(n)\n        return os.getcwd()\n\ndef free():\n    Dog()\n\nfree()\n")
    assert kinds(nodes) == [("Class", "Dog"), ("Function", "bark"), ("Function", "free")]
    assert {n["qualified_name"] for n in nodes} >= {"pkg/a.py::Dog.bark"}
    assert next(n for n in nodes if n["name"] == "bark")["signature"] == "(self, n: int) -> str"
    assert targets(edges, "INHERITS") == {("Dog", "Animal"), ("Dog", "base.Pet")}
    assert targets(edges, "CALLS") == {("Dog.bark", ".b::h"), ("Dog.bark", "getcwd"), ("free", "pkg/a.py::Dog")}  # none at module level
    assert {t for _, t in targets(edges, "IMPORTS_FROM")} == {"os", ".b"}


def test_tests_are_linked():
    nodes, edges = facts("test_m.py", "def load(): pass\ndef store(): pass\n\ndef test_it():\n    load()\ndef test_store(load):\n    pass\n")
    assert targets(edges, "TESTED_BY") == {("load", "test_m.py::test_it"), ("load", "test_m.py::test_store"), ("store", "test_m.py::test_store")}
    assert [n["kind"] for n in nodes if n["is_test"]] == ["File", "Test", "Test"]


def test_scanned_languages():
    nodes, edges = facts("a.tsx", "import React, { useX } from 'react';\ninterface Props { a: string }\nclass Box extends Base implements Props {\n  render(x: number) { useX(); return <Panel a={1} />; }\n}\napp.get('/x', handler);\nfunction handler(req) { if (req) { send(req); } }\n// function commented() {}\n")
    assert kinds(nodes) == [("Class", "Box"), ("Function", "handler"), ("Function", "render"), ("Type", "Props")]
    assert targets(edges, "INHERITS") == {("Box", "Base")} and targets(edges, "IMPLEMENTS") == {("Box", "Props")}
    assert {("Box.render", "react::useX"), ("Box.render", "Panel"), ("handler", "send"), ("a.tsx", "a.tsx::handler")} <= targets(edges, "CALLS")
    assert kinds(facts("a.go", 'package a\nimport "fmt"\ntype S struct { x int }\ntype R interface { Do() }\nfunc (s *S) Do(n int) error { fmt.Println(n); return nil }\nfunc main() { run() }\n')[0]) == [("Class", "S"), ("Function", "Do"), ("Function", "main"), ("Type", "R")]
    nodes, edges = facts("a.rs", "use std::fmt;\nstruct P { x: i32 }\ntrait Show { fn show(&self); }\nimpl Show for P {\n    fn show(&self) { print(self.x) }\n}\n#[test]\nfn checks() { assert!(true) }\n")
    assert ("Test", "checks") in kinds(nodes) and ("Type", "Show") in kinds(nodes) and targets(edges, "IMPLEMENTS") == {("P", "Show")}
    assert {n["qualified_name"] for n in nodes} >= {"a.rs::P.show"}
    assert kinds(facts("A.java", "import java.util.List;\npublic class A extends B {\n  public int size(List<String> x) { return x.size(); }\n}\n")[0]) == [("Class", "A"), ("Function", "size")]
    assert kinds(facts("a.h", "typedef int Id;\nenum Color { RED };\nunion U { int a; };\nstruct S { int b; };\n")[0]) == [("Class", "Color"), ("Class", "Id"), ("Class", "S"), ("Class", "U")]
    assert kinds(facts("a.rb", "require 'json'\nclass Cat < Pet\n  def meow(n)\n    puts n\n  end\nend\n")[0]) == [("Class", "Cat"), ("Function", "meow")]
    for path, text in {"a.php": "<?php\nclass C { function go($x) { run($x); } }", "a.kt": "class C { fun go(x: Int) { run(x) } }", "a.swift": "class C { func go(x: Int) { run(x) } }", "a.cs": "class C { public void go(int x) { run(x); } }", "a.cpp": "class C { void go(int x) { run(x); } };"}.items():
        nodes, edges = facts(path, text)
        assert kinds(nodes) == [("Class", "C"), ("Function", "go")] and ("C.go", "run") in targets(edges, "CALLS"), path
    nodes, _ = facts("a.zig", 'const std = @import("std");\nconst P = struct { x: i32 };\nfn go(a: i32) void { run(a); }\ntest "adds" { go(1); }\n')
    assert kinds(nodes) == [("Class", "P"), ("Function", "go"), ("Test", "adds")]


def test_vue():
    nodes, edges = facts("x.vue", '<template><p/></template>\n<script setup lang="ts">\nimport { ref } from "vue";\nfunction setup() {\n  return ref(1);\n}\n</script>\n')
    assert [(n["name"], n["line_start"], n["line_end"]) for n in nodes if n["kind"] == "Function"] == [("setup", 4, 6)] and targets(edges, "IMPORTS_FROM") == {("x.vue", "vue")}


def test_js_test_blocks():
    nodes, edges = facts("a.test.js", "import { sum } from './sum';\ndescribe('sum', () => {\n  it('adds', () => { sum(1, 2); });\n});\n")
    assert ("Test", "it:adds") in kinds(nodes) and targets(edges, "TESTED_BY") == {("./sum::sum", "a.test.js::it:adds")} or ("sum", "a.test.js::it:adds") in targets(edges, "TESTED_BY")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([*files.EXTENSIONS, "txt"]))
def test_any_bytes_are_read(data, ext):
    nodes, _ = extract.extract(f"f.{ext}", data)
    assert bool(nodes) == (ext != "txt")


def test_ignore_globs():
    import re

    hit = lambda p, name: bool(re.match(files.glob_regex(p), name))
    assert hit("dist/**", "dist/a/b.js") and hit("*.min.js", "x/y.min.js") and not hit("dist/**", "src/dist.js") and hit("yarn.lock", "yarn.lock")


def test_git(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.py").write_text("1\n2\n3\n4\n")
    (tmp_path / "b.py").write_text("x\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("1\nB\nB\n3\n4\n5\n")
    (tmp_path / "b.py").unlink()
    run("add", "-A"), run("commit", "-qm", "two")
    root = str(tmp_path)
    assert git.tracked(root) == ["a.py"] and git.changed(root) == ["a.py", "b.py"] and git.run(root, "no-such-command") == ""
    assert sorted(map(tuple, git.diff_ranges(spark, root).collect())) == [("a.py", 2, 3), ("a.py", 6, 6)]
    (tmp_path / "c d.py").write_text("z\n")
    assert git.status(root) == ["c d.py"] and git.parse_status("R  old.py -> new.py\n M x.py\n") == ["new.py", "x.py"]
    assert git.tracked(str(tmp_path / "none")) is None and store.find_root(root) == root


def test_store(spark, repo, monkeypatch):
    monkeypatch.setattr(store, "STALE_SECONDS", 600)
    g = extract.build(files.scan(spark, str(repo)))
    s = store.GraphStore(spark, f"file://{repo}/store")
    assert s.read().nodes.count() == 0 and s.embeddings().count() == 0
    s.write(g, last_build_type="full")
    back = s.read()
    assert back.nodes.count() == 8 and back.edges.count() == g.edges.count() and s.metadata()["last_build_type"] == "full" and s.is_fresh()
    s.compact()
    assert s.read().nodes.count() == 8
    s.write_embeddings(spark.createDataFrame([("k", [1.0])], "key string, vec array<float>"))
    assert s.embeddings().first().key == "k"
    assert "</script>" in store.html(g) and len(json.dumps(store.html(g))) > 500
    assert context.nodes_as_json(g.nodes).count() == 8 and context.edges_as_json(g.edges).count() == g.edges.count()


def test_settings(tmp_path, monkeypatch):
    folder = tmp_path / files.STORE_DIR
    folder.mkdir()
    (folder / "config.json").write_text('{"provider": "a", "model": "m", "other": 1}')
    monkeypatch.setenv("GRAPHEION_MODEL", "from env")
    assert store.settings(str(tmp_path)) == {"provider": "a", "model": "from env"}
    store.store_folder(str(tmp_path))
    assert (folder / ".gitignore").read_text() == "*\n"
    with pytest.raises(ValueError):
        store.find_root(str(tmp_path / "nothing"))


def test_incremental_update_equals_a_full_build(spark, repo):
    before = extract.build(files.scan(spark, str(repo)))
    assert before.nodes.count() == 8 and before.edges_raw.count() > 5  # read before the files change
    (repo / "utils.py").write_text(SAMPLE["utils.py"].replace("a + b", "b + a").replace("subtract", "minus"))
    (repo / "main.py").unlink()
    now = files.scan(spark, str(repo))
    changed = spark.createDataFrame([("utils.py",), ("main.py",), ("service.ts",)], "file_path string")
    after, names = maintain.incremental_update(before, now, changed, extract.parse)
    full = extract.build(now)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(after.nodes.drop("node_id"), full.nodes.drop("node_id")) and same(after.edges, full.edges)
    assert {(r.qualified_name, r.change) for r in names.collect()} == {("utils.py", "modified"), ("utils.py::add", "modified"), ("utils.py::subtract", "removed"), ("utils.py::minus", "added"), ("main.py", "removed"), ("main.py::run", "removed")}
    assert maintain.purge(before, now.select("file_path")).nodes.filter("file_path = 'main.py'").count() == 0


def test_aliases(tmp_path):
    (tmp_path / "base.json").write_text('{"compilerOptions": {"paths": {"@lib/*": ["lib/*"]}}, "extends": "./tsconfig"}')
    (tmp_path / "tsconfig.json").write_text('{ // comment\n "extends": "./base", "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["*"], "@x": ["x/main"],}}, }')
    table = aliases.aliases(str(tmp_path / "tsconfig.json"))
    there = {str(tmp_path / "src/a/b.ts"), str(tmp_path / "src/x/main/index.ts"), str(tmp_path / "lib/u.js")}
    find = lambda m: aliases.resolve(m, table, there.__contains__)
    assert find("~/a/b") == str(tmp_path / "src/a/b.ts") and find("@x") == str(tmp_path / "src/x/main/index.ts") and find("@lib/u") == str(tmp_path / "lib/u.js") and find("zz") is None
    assert os.path.isabs(find("@x"))
