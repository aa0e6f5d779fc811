"""Imports resolved to files: aliases, relative paths and dotted names."""

import json

from pyspark.sql import functions as F

from grapheion.operators import modules
from grapheion.sources import extract

CONFIGS = {
    "base.json": '{"compilerOptions": {"paths": {"@lib/*": ["lib/*"], "@*": ["gone/*", "all/*"], "@lib/x": ["lib/exact"], "@*/end": ["ends/*"]}}, "extends": "./tsconfig"}',
    "tsconfig.json": '{ // see "this, }\n "extends": "./base", /* "paths": 1, */ "compilerOptions": {"strict": true,}, }',
    "app/tsconfig.json": '{"extends": "../base.json", "compilerOptions": {"baseUrl": "src", "paths": {"~/*": ["*"], "url//x": ["a/b"],}}}',
    "app/deep/tsconfig.json": '{"extends": "../tsconfig"}',
    "bad/tsconfig.json": "{ no json",
    "loop/tsconfig.json": '{"extends": "./tsconfig.json"}',
}
FILES = ["lib/u.js", "lib/exact.ts", "lib/x.ts", "all/lib/u.ts", "all/k/index.ts", "all/two.tsx", "ends/q.ts", "app/src/a/b.ts", "app/src/a/b.tsx", "app/m.ts", "app/deep/n.ts", "main.ts", "loop/z.ts", "py/p/__init__.py", "py/p/q.py", "py/q.py", "q.py"]


def found(spark, asked, patterns=True):
    texts = spark.createDataFrame(list(CONFIGS.items()), "file_path string, text string")
    table = modules.alias_patterns(texts) if patterns else None
    imports = spark.createDataFrame(asked, "file_path string, module string").withColumn("target", F.lit("clash"))
    files = spark.createDataFrame([(f, "clash") for f in [*FILES, None, "q.py"]], "file_path string, module string")
    return {(r.file_path, r.module): r.target for r in modules.resolve(imports, files, table).collect()}


def test_aliases_relative_and_dotted(spark):
    want = {
        ("main.ts", "@lib/u"): "lib/u.js",  # the longer head goes first
        ("main.ts", "@lib/x"): "lib/exact.ts",  # exact goes before any star
        ("main.ts", "@k"): "all/k/index.ts",  # the second target
        ("main.ts", "@two"): "all/two.tsx",
        ("main.ts", "@q/end"): "ends/q.ts",
        ("main.ts", "./lib/u"): "lib/u.js",
        ("main.ts", "../main"): None,
        ("main.ts", "react"): None,
        ("app/m.ts", "~/a/b"): "app/src/a/b.ts",  # paths of the nearer file, from its base
        ("app/m.ts", "url//x"): "app/src/a/b.ts",
        ("app/m.ts", "@lib/u"): None,  # the nearer paths replace those above
        ("app/deep/n.ts", "~/a/b"): "app/src/a/b.ts",
        ("app/deep/n.ts", "../m"): "app/m.ts",
        ("loop/z.ts", "@k"): "all/k/index.ts",  # a configuration without paths governs nothing
        ("py/p/q.py", ".q"): "py/p/q.py",
        ("py/p/q.py", "."): "py/p/__init__.py",
        ("py/p/q.py", "..q"): "py/q.py",
        ("py/p/q.py", "q"): "py/p/q.py",
        ("py/q.py", "p.q"): "py/p/q.py",
        ("py/q.py", "p"): "py/p/__init__.py",
        ("q.py", "p.q"): None,
        ("q.py", "os"): None,
    }
    got = found(spark, [*want, ("main.ts", "@k"), (None, "@k"), ("main.ts", None), ("main.ts", "")])
    assert got == {k: v for k, v in want.items() if v}


def test_empty(spark):
    assert found(spark, []) == {} and found(spark, [("main.ts", "@k")], patterns=False) == {}
    assert modules.alias_patterns(spark.createDataFrame([], "file_path string, text string")).count() == 0


def test_plain_json(spark):
    text = '{"a": "x // y, }", /* , */ "b": [1, 2,], // end\n "c": "\\"/*",}'
    assert json.loads(spark.range(1).select(modules.plain_json(F.lit(text))).first()[0]) == {"a": "x // y, }", "b": [1, 2], "c": '"/*'}


def test_edges_reach_files(spark):
    texts = {"pkg/__init__.py": "", "pkg/a.py": "from .b import f\nimport os\ndef g(): return f()\n", "pkg/b.py": "def f(): pass\n", "top.py": "import pkg.a\nfrom pkg import b\n"}
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "file_path string, content binary")
    g = modules.linked(extract.build(files))
    assert {(r.src, r.dst) for r in g.edges.filter("kind = 'IMPORTS_FROM'").collect()} == {("pkg/a.py", "pkg/b.py"), ("top.py", "pkg/a.py"), ("top.py", "pkg/__init__.py")}
    assert [r.target_qualified for r in g.edges_raw.filter("target_qualified = 'os'").collect()] == ["os"]
