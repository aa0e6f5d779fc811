"""The code graph: nodes, unresolved edges, and everything that looks them up."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["File", "Class", "Function", "Type", "Test"]
#: What an edge passes on when its target changes.
EDGE_WEIGHTS = {"CALLS": 1.0, "INHERITS": 1.2, "IMPLEMENTS": 1.0, "IMPORTS_FROM": 0.5, "TESTED_BY": 0.8, "CONTAINS": 0.1}
DEPENDENCIES = ["CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS"]
RESULT_CAP = 25

NODE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("node_id", T.LongType()), ("name", T.StringType()), ("qualified_name", T.StringType()), ("kind", T.StringType()), ("file_path", T.StringType()), ("line_start", T.IntegerType()), ("line_end", T.IntegerType()), ("language", T.StringType()), ("is_test", T.BooleanType()), ("docstring", T.StringType()), ("signature", T.StringType()), ("body_hash", T.StringType()), ("file_hash", T.StringType())]])
EDGE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [("source_qualified", T.StringType()), ("target_qualified", T.StringType()), ("kind", T.StringType()), ("file_path", T.StringType()), ("line", T.IntegerType())]])

# Names whose callers are never looked up.
BUILTINS = """
map filter reduce reduceRight forEach find findIndex some every includes indexOf lastIndexOf push pop shift unshift splice slice
concat join flat flatMap sort reverse fill keys values entries from isArray of at trim trimStart trimEnd split replace replaceAll
match matchAll search substring substr toLowerCase toUpperCase startsWith endsWith padStart padEnd repeat charAt charCodeAt
assign freeze defineProperty getOwnPropertyNames hasOwnProperty create is fromEntries log warn error info debug trace dir table
time timeEnd assert clear count then catch finally resolve reject all allSettled race any parse stringify floor ceil round random
max min abs pow sqrt addEventListener removeEventListener querySelector querySelectorAll getElementById createElement appendChild
removeChild setAttribute getAttribute preventDefault stopPropagation setTimeout clearTimeout setInterval clearInterval toString
valueOf toJSON toISOString getTime getFullYear now isNaN parseInt parseFloat toFixed encodeURIComponent decodeURIComponent call
apply bind next emit on off once pipe write read end close destroy send status json redirect set get delete has findUnique
findFirst findMany createMany update updateMany deleteMany upsert aggregate groupBy transaction describe it test expect beforeEach
afterEach beforeAll afterAll mock spyOn require fetch
""".split()
# End of fixed values.


def weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for k, w in EDGE_WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def ranked(df: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows; every order ends in qualified_name, so ties are settled."""
    return df.orderBy(*order, "qualified_name").limit(limit)


class CodeGraph:
    """Nodes and raw edges; resolution is a join, so every state equals a full rebuild.

    Several nodes may share a qualified name (overloads); the one with the highest
    node_id answers for the name, all of them count in statistics and listings.
    """

    def __init__(self, nodes: DataFrame, edges_raw: DataFrame):
        self.nodes, self.edges_raw = nodes, edges_raw

    @cached_property
    def by_name(self) -> DataFrame:
        """One node a qualified name: the last defined. An aggregate, so it combines before the shuffle."""
        rest = [c for c in self.nodes.columns if c != "qualified_name"]
        last = self.nodes.groupBy("qualified_name").agg(F.max_by(F.struct(*rest), "node_id").alias("n"))
        return last.select("qualified_name", *[F.col(f"n.{c}").alias(c) for c in rest])

    @cached_property
    def edges(self) -> DataFrame:
        """Edges with both ends in the graph, one row a call site: src, dst, kind, src_file, dst_file."""
        ends = self.nodes.groupBy("qualified_name").agg(F.max_by("file_path", "node_id").alias("file_path"))
        src = ends.select(F.col("qualified_name").alias("source_qualified"), F.col("file_path").alias("src_file"))
        dst = ends.select(F.col("qualified_name").alias("target_qualified"), F.col("file_path").alias("dst_file"))
        raw = self.edges_raw.select("source_qualified", "target_qualified", "kind")
        return raw.join(src, "source_qualified").join(dst, "target_qualified").select(F.col("source_qualified").alias("src"), F.col("target_qualified").alias("dst"), "kind", "src_file", "dst_file")

    @cached_property
    def edges_distinct(self) -> DataFrame:
        """Parallel edges are removed before the joins, where they are fewest."""
        return CodeGraph(self.nodes, self.edges_raw.select("source_qualified", "target_qualified", "kind").distinct()).edges

    # lookups ---------------------------------------------------------------
    def node(self, name: str) -> DataFrame:
        return self.by_name.filter(F.col("qualified_name") == name)

    def in_file(self, path: str) -> DataFrame:
        return self.nodes.filter(F.col("file_path") == path)

    def files(self) -> DataFrame:
        return self.nodes.select("file_path").distinct()

    def edges_from(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("src") == name)

    def edges_to(self, name: str) -> DataFrame:
        return self.edges.filter(F.col("dst") == name)

    def calls_by_name(self, name: str) -> DataFrame:
        """CALLS whose raw target is the name or ends in ``::name`` (methods do not match)."""
        hit = (F.col("dst") == name) | F.col("dst").endswith(f"::{name}")
        return self.edges.filter((F.col("kind") == "CALLS") & hit)

    def file_hashes(self) -> DataFrame:
        return self.nodes.select("file_path", "file_hash").distinct()

    def body_hashes(self) -> DataFrame:
        return self.nodes.select("qualified_name", "body_hash")

    def large(self, min_lines: int = 50, kind: str | None = None, path_part: str = "", limit: int = 50, root: str = "") -> DataFrame:
        from grapheion.functions.text import relative_path

        size = F.col("line_end") - F.col("line_start") + 1
        out = self.nodes.withColumn("line_count", size).filter(F.col("line_count") >= min_lines)
        if kind in KINDS:  # a kind that does not exist restricts nothing
            out = out.filter(F.col("kind") == kind)
        if path_part:
            out = out.filter(F.lower("file_path").contains(path_part.lower()))
        return ranked(out.withColumn("relative_path", relative_path(F.col("file_path"), root)), F.desc("line_count"), limit=limit)

    def resolve_target(self, target: str, root: str = "") -> tuple[str, DataFrame]:
        """('found' | 'ambiguous' | 'not_found', candidates): exact name, then below root, then the best five by search."""
        from grapheion.operators.search import search_and

        for name in dict.fromkeys([target, f"{root.rstrip('/')}/{target}"]):
            hit = self.node(name)
            if hit.limit(1).count():
                return "found", hit
        found = search_and(self.by_name, target, 5)
        n = found.count()
        return ("not_found", "found")[n] if n < 2 else "ambiguous", found

    # joins -----------------------------------------------------------------
    def callers(self, name: str) -> DataFrame:
        """Nodes that call ``name``; without any, those whose target matches it by name."""
        by = self.by_name
        direct = self.edges.filter((F.col("kind") == "CALLS") & (F.col("dst") == name)).select("src", F.lit(0).alias("tier"))
        short = name.rsplit("::", 1)[-1]
        loose = self.calls_by_name(short).select("src", F.lit(1).alias("tier"))
        both = direct.unionByName(loose)
        # the fallback counts only where there is no direct caller: keep the lowest tier present
        lowest = both.agg(F.min("tier").alias("best"))
        kept = both.join(F.broadcast(lowest), F.col("tier") == F.col("best")).select(F.col("src").alias("qualified_name")).distinct()
        return by.join(kept, "qualified_name", "left_semi")

    def callees(self, name: str) -> DataFrame:
        return self._ends(self.edges.filter((F.col("kind") == "CALLS") & (F.col("src") == name)), "dst")

    def children(self, name: str) -> DataFrame:
        return self._ends(self.edges.filter((F.col("kind") == "CONTAINS") & (F.col("src") == name)), "dst")

    def inheritors(self, name: str) -> DataFrame:
        return self._ends(self.edges.filter(F.col("kind").isin("INHERITS", "IMPLEMENTS") & (F.col("dst") == name)), "src")

    def imports(self, name: str) -> DataFrame:
        return self.edges.filter((F.col("kind") == "IMPORTS_FROM") & (F.col("src") == name)).select(F.col("dst").alias("import_target"))

    def importers(self, name: str) -> DataFrame:
        """By the file of the resolved node."""
        file = self.node(name).select(F.col("file_path").alias("dst"))
        return self.edges.filter(F.col("kind") == "IMPORTS_FROM").join(file, "dst", "left_semi").select(F.col("src").alias("importer"), F.col("src_file").alias("file"))

    def tests_of(self, name: str, compat: bool = False) -> DataFrame:
        """Tests linked by TESTED_BY (production -> test) and tests named after the node, ten a pattern.

        ``compat`` follows the edges the other way round.
        """
        from grapheion.operators.search import search_and

        near, far = ("dst", "src") if compat else ("src", "dst")
        linked = self._ends(self.edges.filter((F.col("kind") == "TESTED_BY") & (F.col(near) == name)), far)
        short = name.rsplit("::", 1)[-1].rsplit(".", 1)[-1]
        out = linked.select(*self.by_name.columns)
        for pattern in (f"test_{short}", f"Test{short}"):
            named = search_and(self.by_name, pattern, 10).filter("is_test")
            out = out.unionByName(named.select(*out.columns))
        return out.dropDuplicates(["qualified_name"])

    def _ends(self, edges: DataFrame, end: str) -> DataFrame:
        return self.by_name.join(edges.select(F.col(end).alias("qualified_name")), "qualified_name", "left_semi")

    def dependents(self, path: str) -> DataFrame:
        """Files with a dependency on anything in ``path``."""
        return self.edges.filter(F.col("kind").isin(DEPENDENCIES) & (F.col("dst_file") == path) & (F.col("src_file") != path)).select(F.col("src_file").alias("file_path")).distinct()

    def incoming(self, path: str) -> DataFrame:
        return self.edges.filter(F.col("dst_file") == path)

    def among(self, names: DataFrame) -> DataFrame:
        """Edges with both ends in ``names`` (qualified_name)."""
        one = names.select("qualified_name").distinct()
        return self.edges.join(one.withColumnRenamed("qualified_name", "src"), "src", "left_semi").join(one.withColumnRenamed("qualified_name", "dst"), "dst", "left_semi")

    # aggregates --------------------------------------------------------------
    def stats(self) -> DataFrame:
        """One row: totals, counts by kind, languages, files. Counts by kind combine before any shuffle."""
        n = self.nodes.groupBy("kind").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("nodes_by_kind"))
        e = self.edges.groupBy("kind").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("edges_by_kind"))
        rest = self.nodes.agg(F.array_sort(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages"), F.count_if(F.col("kind") == "File").alias("files_count"))
        return n.join(e).join(rest)

    def degrees(self) -> DataFrame:
        """Fan-in, fan-out of CALLS and whether a test covers the node; edges are read once."""
        ends = self.edges.filter(F.col("kind").isin("CALLS", "TESTED_BY")).select(F.explode(F.array(F.struct(F.col("src").alias("qualified_name"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("qualified_name"), F.lit("in").alias("way")))).alias("x"), "kind").select("x.*", "kind")
        calls = F.col("kind") == "CALLS"
        agg = ends.groupBy("qualified_name").agg(F.count_if(calls & (F.col("way") == "in")).alias("fan_in"), F.count_if(calls & (F.col("way") == "out")).alias("fan_out"), F.max(~calls & (F.col("way") == "out")).alias("tested"))
        return self.by_name.select("qualified_name", "kind", "file_path").join(agg, "qualified_name", "left").fillna({"fan_in": 0, "fan_out": 0, "tested": False})


PATTERNS = {
    "callers_of": "Functions that call the target",
    "callees_of": "Functions the target calls",
    "imports_of": "What a file or module imports",
    "importers_of": "Files that import a file or module",
    "children_of": "Nodes contained in a file or class",
    "tests_for": "Tests of a function or class",
    "inheritors_of": "Classes that inherit from a class",
    "file_summary": "All nodes of a file",
}


def query_graph(graph: CodeGraph, pattern: str, target: str, root: str = "", compact: bool = True) -> dict:
    """One of the eight patterns over a target: status, capped results, total before the cap."""
    from grapheion.operators.context import node_json

    if pattern not in PATTERNS:
        return {"status": "error", "error": f"Unknown pattern '{pattern}'. Available: {', '.join(PATTERNS)}"}
    if pattern == "callers_of" and target in BUILTINS and "::" not in target:
        return {"status": "ok", "pattern": pattern, "target": target, "results": [], "total_results": 0}
    status, found = graph.resolve_target(target, root)
    if status != "found":
        if pattern == "file_summary" and graph.in_file(target).limit(1).count():
            name = target
        else:
            return {"status": status, "candidates": [r.qualified_name for r in found.select("qualified_name").limit(5).collect()]}
    else:
        name = found.first().qualified_name
    run = {"callers_of": graph.callers, "callees_of": graph.callees, "imports_of": graph.imports, "importers_of": graph.importers, "children_of": graph.children, "tests_for": graph.tests_of, "inheritors_of": graph.inheritors, "file_summary": lambda n: graph.in_file(graph.node(n).first().file_path if status == "found" else n)}
    df = run[pattern](name)
    order = df.columns[0] if "qualified_name" not in df.columns else "qualified_name"
    rows = df.orderBy(order).limit(RESULT_CAP).collect()
    results = [node_json(r.asDict(), compact) if "qualified_name" in df.columns else r.asDict() for r in rows]
    return {"status": "ok", "pattern": pattern, "target": name, "description": PATTERNS[pattern], "results": results, "total_results": df.count()}
