"""Overlap joins against all pairs, call paths against one search a pair, and the package on executors."""

import os
import random
import subprocess
import sys

from pyspark.sql import functions as F

from grapheion.operators import algos, context
from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, CodeGraph
from grapheion.operators.intervals import overlaps

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_overlaps_equal_all_pairs(spark):
    rnd = random.Random(8)

    def rows(n, longest):
        out = []
        for i in range(n):
            start = rnd.randrange(-50, 3000)
            out.append((rnd.choice(["a", "a", "b", None]), start, start + int(longest ** rnd.random()) - 1, i))
        return out

    a = rows(150, 2000) + [("a", None, 5, 900), ("a", 7, None, 901), ("a", 30, 10, 902), ("a", 1, 2_000_000_000, 903), ("a", 5, 5, 904), ("a", 5, 5, 905)]
    b = rows(150, 300) + [("a", 10, 30, 900), ("a", 20, 20, 901), ("a", -2_000_000_000, 2_000_000_000, 902), ("b", 12, 11, 903)]
    left = spark.createDataFrame(a, "file string, a_start int, a_end int, x int")
    right = spark.createDataFrame(b, "file string, b_start int, b_end int, y int")
    got = sorted((r.x, r.y) for r in overlaps(left, right).collect())
    whole = lambda *v: all(x is not None for x in v)
    want = sorted((p[3], q[3]) for p in a for q in b if p[0] is not None and p[0] == q[0] and whole(p[1], p[2]) and p[1] <= q[2] and p[2] >= q[1])
    assert got == want and len(got) == len(set(got)) > 500
    assert overlaps(left.limit(0), right).count() == overlaps(left, right.limit(0)).count() == 0


def nodes_of(spark, n):
    base = spark.range(n).select(F.lit("big.py").alias("file_path"), (F.col("id") * 10 + 1).cast("int").alias("line_start"), (F.col("id") * 10 + 8 + F.when(F.col("id") % 1000 == 0, 9000).otherwise(0)).cast("int").alias("line_end"), F.format_string("big.py::f%07d", "id").alias("qualified_name"), F.lit("Function").alias("kind"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA if f.name not in base.columns]
    return base.select("*", *rest).select(*NODE_SCHEMA.names)


def test_one_file_of_many_spans_and_lines(spark):
    """A million lines, a hundred thousand spans: all pairs of the file would be 10^11."""
    lines = spark.range(1_000_000).select(F.lit("big.py").alias("file"), F.col("id").cast("int").alias("line"))
    nodes = nodes_of(spark, 100_000)
    got = context.enclosing(nodes, lines)
    want = lines.withColumn("k", F.floor((F.col("line") - 1) / 10)).withColumn("inside", (F.col("line") > 0) & ((F.col("line") - 1) % 10 < 8))
    wide = F.format_string("big.py::f%07d", (F.floor(F.col("k") / 1000) * 1000).cast("long"))
    # behind a narrow function the line may still lie in the wide one that starts at a multiple of 1000
    around = (F.col("line") > 0) & (F.col("line") <= F.floor(F.col("k") / 1000) * 10000 + 9008)
    want = want.select("file", "line", F.when(F.col("inside") & (F.col("k") % 1000 != 0), F.format_string("big.py::f%07d", "k")).when(around, wide).otherwise(F.col("file")).alias("enclosing"))
    assert got.exceptAll(want).count() == 0 and got.count() == 1_000_000
    ranges = lines.filter("line % 1000 = 5").select("file", F.col("line").alias("start"), F.col("line").alias("end"))
    assert context.nodes_in_ranges(nodes, ranges).count() == 1000


def graph_of(spark, calls):
    names = sorted({x for c in calls for x in c})
    nodes = spark.createDataFrame([(i, n, n, "Function", "f.py", 1, 2, "", False, "", "", "", "") for i, n in enumerate(names)], NODE_SCHEMA)
    edges = spark.createDataFrame([(a, b, "CALLS", "f.py", 0) for a, b in calls], EDGE_SCHEMA)
    return CodeGraph(nodes, edges)


def test_paths_of_many_pairs_equal_one_by_one(spark):
    rnd = random.Random(3)
    calls = [(f"n{rnd.randrange(25):02d}", f"n{rnd.randrange(25):02d}") for _ in range(40)] + [("n01", "n01"), ("n00", "n01"), ("n01", "n00")]
    graph = graph_of(spark, calls)
    graph.edges = graph.edges.cache()
    names = sorted({x for c in calls for x in c})
    pairs = [(i, rnd.choice(names), rnd.choice(names)) for i in range(4)] + [(90, names[0], names[0]), (91, "n00", "absent")]
    df = spark.createDataFrame(pairs, "pair_id int, source string, target string")
    for depth in (4,):
        got = {r.pair_id: r.path for r in algos.call_paths(graph, df, depth).collect()}
        want = {i: p for i, s, t in pairs if (p := algos.call_chain(graph, s, t, depth))}
        assert got == want and 90 in want


def test_the_package_reaches_executors(tmp_path):
    """With the package on the driver's path alone."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from grapheion.operators import search
from grapheion.sources import extract
files = spark.createDataFrame([("a.py", bytearray(b"def f(): pass"))], "file_path string, content binary")
assert extract.parse(files)[0].count() == 2
items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "k long, v array<double>")
assert search.vector_join_all(items, items, "k", "v", 2).count() == 10
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("done"), out.stderr[-2000:]
