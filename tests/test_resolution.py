"""Resolution by joins against resolution file by file."""

import os
import random

import pytest

from grapheion.operators.graph import CodeGraph
from grapheion.operators.resolution import FileFacts
from grapheion.sources import extract

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ODD = {
    "src/a.ts": "import { far, near } from './b';\nimport near from 'c';\ninterface Shape { a(): void }\nclass Box extends lib.Base implements Shape {\n  run() {\n    return far(near(this));\n  }\n}\nfunction go() { Box(); go(); helper(); }\napp.get('/x', go);\n",
    "src/b.vue": "<template/>\n<script lang='ts'>\nexport function far() { return near(); }\n</script>\n",
    "src/c.rs": "trait Area { fn size(&self); }\nstruct Sq;\nimpl Area for Sq { fn size(&self) { helper(); } }\nfn helper() {}\n",
    "tests/test_p.py": "import m\nfrom .k import q as helper\ndef data(): return 1\ndef other(): return data()\ndef add(): pass\ndef test_add(data, other=(1, data)):\n    helper(); data(); test_b()\ndef test_b(self, add): return m.add()\nclass TestAdd:\n    def test_add(self): return add()\n    def add(self): return self.add()\ndef testData_spec(): pass\n",
    "tests/x.spec.js": "function add() {}\nit('adds', () => { add(); });\ndescribe('all', () => { it('adds', () => { add(); far(); }); });\n",
    "broken.py": "def (:\n",
    "none.py": "",
    "no.txt": "x",
}


def sources(spark, texts):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in texts.items()], "file_path string, content binary")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(spark, texts):
    files = sources(spark, texts)
    nodes, edges = extract.parse(files)
    want, got = CodeGraph(nodes, edges), extract.build(files)
    assert rows(got.nodes) == rows(want.nodes)
    assert rows(got.edges_raw) == rows(want.edges_raw)
    extract.release(nodes)
    return got


def test_odd_files(spark):
    got = same(spark, ODD)
    kinds = {r.kind for r in got.edges_raw.select("kind").distinct().collect()}
    assert kinds == {"CONTAINS", "CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "TESTED_BY"}
    edges = {(r.source_qualified, r.target_qualified) for r in got.edges_raw.filter("kind = 'CALLS'").collect()}
    assert ("src/a.ts::Box.run", "./b::far") in edges and ("src/a.ts::Box.run", "c::near") in edges and ("src/a.ts::go", "src/a.ts::Box") in edges


def test_this_repository(spark):
    texts = {}
    for folder in ("grapheion/operators", "grapheion/sources", "grapheion/functions", "tests"):
        for name in sorted(os.listdir(os.path.join(ROOT, folder))):
            if name.endswith(".py"):
                with open(os.path.join(ROOT, folder, name), encoding="utf8") as f:
                    texts[f"{folder}/{name}"] = f.read()
    got = same(spark, texts)
    assert got.edges_raw.filter("kind = 'TESTED_BY'").count() > 20 and got.edges_raw.filter("kind = 'CALLS'").count() > 500


def test_random_python(spark):
    r = random.Random(5)
    texts = {}
    for i in range(40):
        lines = []
        for _ in range(r.randrange(12)):
            name = r.choice(["add", "Add", "test_add", "TestAdd", "x", "x_test", "test_x", "y"])
            what = r.randrange(4)
            if what == 0:
                lines.append(f"from m{r.randrange(3)} import {name}, z")
            elif what == 1:
                lines += [f"class {name}({r.choice(['x', 'm.Add', ''])}):", f"    def {r.choice(['run', 'test_add', 'x'])}(self, x): return {r.choice(['add', 'x', 'z'])}()"]
            else:
                lines += [f"def {name}({r.choice(['', 'x', 'add, y=(1, x)'])}):", f"    {r.choice(['add', 'x', 'z', 'self.run'])}({r.choice(['y()', 'test_x()', ''])})"]
        texts[f"{r.choice(['src/', 'tests/test_'])}{i}.py"] = "\n".join(lines)
    same(spark, texts)


def test_empty_and_null_facts(spark):
    definitions = "file_path string, language string, ordinal long, kind string, name string, owner string, line_start int, line_end int, is_test boolean, signature string, bases array<string>"
    imports, calls = "file_path string, ordinal long, module string, names array<string>, line int", "file_path string, ordinal long, name string, line int, module string"
    none = FileFacts(*[spark.createDataFrame([], s) for s in (definitions, imports, calls)])
    assert none.edges().count() == 0
    one = FileFacts(
        spark.createDataFrame([("f", None, 0, "Function", None, None, None, None, None, None, None), (None,) * 11, ("f", None, 1, "Function", "g", "", 1, 9, False, "()", None)], definitions),
        spark.createDataFrame([("f", 0, None, None, None), (None,) * 5], imports),
        spark.createDataFrame([("f", 0, None, 3), ("f", 1, "h", None), ("f", 2, "h", 2), ("f", 2, "h", 2), (None, 3, "h", 2)], calls.replace(", module string", "")),
    )
    found = [(r.source_qualified, r.target_qualified) for r in one.edges().filter("kind = 'CALLS'").collect()]
    assert found == [("f::g", "h")] * 2


def test_a_file_of_many_rows(spark):
    """One file with all rows: a call in each of 20 000 functions, to the next one."""
    n = 20_000
    i = spark.range(n)
    definitions = i.selectExpr("'big.py' AS file_path", "'python' AS language", "id AS ordinal", "'Function' AS kind", "concat('f', id) AS name", "'' AS owner", "CAST(2 * id + 1 AS INT) AS line_start", "CAST(2 * id + 2 AS INT) AS line_end", "false AS is_test", "'()' AS signature", "CAST(array() AS array<string>) AS bases")
    calls = i.selectExpr("'big.py' AS file_path", "id AS ordinal", "concat('f', id + 1) AS name", "CAST(2 * id + 2 AS INT) AS line")
    imports = spark.createDataFrame([], "file_path string, ordinal long, module string, names array<string>, line int")
    made = FileFacts(definitions, imports, calls).call_edges
    right = made.filter("CAST(substr(source_qualified, 10) AS LONG) + 1 = CAST(regexp_extract(target_qualified, '([0-9]+)$', 1) AS LONG)")
    assert made.count() == n and right.count() == n


@pytest.mark.parametrize("name, short", [("test_add", "add"), ("TestAddSpec", "add"), ("testit_test", "it"), ("plain", "plain"), ("test_", "")])
def test_tested_name(spark, name, short):
    from pyspark.sql import functions as F

    from grapheion.operators.resolution import tested_name

    assert spark.range(1).select(tested_name(F.lit(name))).first()[0] == short
