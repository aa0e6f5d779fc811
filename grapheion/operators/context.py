"""Context assembly: ranges, previews, review guidance, node context, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grapheion.operators import algos
from grapheion.operators.intervals import overlaps
from grapheion.operators.graph import CodeGraph, ranked

SNIPPET = 120
EDGE_KEYS = {"kind": "kind", "source": "src", "target": "dst", "file": "src_file", "line": "line"}


def node_json(n: dict, compact: bool = True) -> dict:
    """A node for display: six short keys, or everything."""
    if compact:
        return {"name": n["name"], "qn": n["qualified_name"], "kind": n["kind"], "file": n["file_path"], "lines": f"{n['line_start']}-{n['line_end']}", "sig": n.get("signature", "")}
    return {k: n.get(k) for k in ("name", "qualified_name", "kind", "file_path", "line_start", "line_end", "language", "is_test", "docstring", "signature", "body_hash")}


def nodes_as_json(nodes: DataFrame, compact: bool = True) -> DataFrame:
    """(qualified_name, json), made by the engine."""
    if compact:
        body = F.struct("name", F.col("qualified_name").alias("qn"), "kind", F.col("file_path").alias("file"), F.concat_ws("-", "line_start", "line_end").alias("lines"), F.col("signature").alias("sig"))
    else:
        body = F.struct("name", "qualified_name", "kind", "file_path", "line_start", "line_end", "language", "is_test", "docstring", "signature", "body_hash")
    return nodes.select("qualified_name", F.to_json(body).alias("json"))


def edges_as_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct("kind", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("src_file").alias("file"), F.lit(0).alias("line"))).alias("json"))


# ranges ------------------------------------------------------------------------
def nodes_in_ranges(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes that overlap a changed range (file, start, end) of their file, each once."""
    spans = nodes.select(F.col("file_path").alias("file"), F.col("line_start").alias("a_start"), F.col("line_end").alias("a_end")).distinct()
    changed = ranges.select("file", F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    hit = overlaps(spans, changed).select(F.col("file").alias("file_path"), F.col("a_start").alias("line_start"), F.col("a_end").alias("line_end"))
    return nodes.join(hit, ["file_path", "line_start", "line_end"], "left_semi").select(*nodes.columns)


def enclosing(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, line, enclosing): the narrowest function or test around a line, else the file."""
    spans = nodes.filter(F.col("kind").isin("Function", "Test")).select(F.col("file_path").alias("file"), F.col("line_start").alias("a_start"), F.col("line_end").alias("a_end"), "qualified_name")
    # of equal spans only the least name can answer, so a file has no more of them than pairs of lines
    spans = spans.groupBy("file", "a_start", "a_end").agg(F.min("qualified_name").alias("qualified_name"))
    asked = lines.select("file", "line").distinct()
    pairs = overlaps(spans, asked.select("file", F.col("line").alias("b_start"), F.col("line").alias("b_end")))
    size = (F.col("a_end") - F.col("a_start")).alias("size")
    best = pairs.groupBy("file", F.col("b_start").alias("line")).agg(F.min(F.struct(size, "qualified_name")).alias("b"))
    return asked.join(best, ["file", "line"], "left").select("file", "line", F.coalesce("b.qualified_name", "file").alias("enclosing"))


def merged_ranges(nodes: DataFrame, n_lines: Column) -> DataFrame:
    """(file_path, start, end): nodes widened by three lines before and two after, joined where they touch.

    Start is 0-based, end exclusive, cut at the file's number of lines.
    """
    s = nodes.select("file_path", F.greatest(F.col("line_start") - 3, F.lit(0)).alias("start"), F.least(F.col("line_end") + 2, n_lines).alias("end"))
    by = Window.partitionBy("file_path").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("fresh", F.coalesce((F.col("start") > reach + 1), F.lit(True)).cast("int"))
    s = s.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("file_path", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def snippets(lines: DataFrame, nodes: DataFrame, max_lines: int = 200) -> DataFrame:
    """(file_path, snippet) of (file_path, line_no, text): whole short files, else merged ranges, else fifty lines."""
    size = lines.groupBy("file_path").agg(F.max("line_no").cast("int").alias("n"))
    ranges = merged_ranges(nodes.join(size, "file_path"), F.col("n")) if "n" in nodes.columns else merged_ranges(nodes.join(size.withColumnRenamed("n", "n_lines"), "file_path").select("*"), F.col("n_lines"))
    ranges = ranges.join(size, "file_path", "right").select("file_path", F.when(F.col("n") <= max_lines, 0).otherwise(F.coalesce("start", F.lit(0))).alias("start"), F.when(F.col("n") <= max_lines, F.col("n")).otherwise(F.coalesce("end", F.lit(50))).alias("end")).distinct()
    hit = lines.join(ranges, "file_path").filter((F.col("line_no") > F.col("start")) & (F.col("line_no") <= F.col("end")))
    part = hit.groupBy("file_path", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: F.concat_ws(": ", x["line_no"], x["text"])), "\n").alias("body"))
    return part.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "body"))), lambda x: x["body"]), "\n...\n").alias("snippet"))


# reviews -------------------------------------------------------------------------
def guidance(found: dict[str, DataFrame]) -> str:
    """What a reviewer should look at; four small aggregates."""
    tested = found["edges"].filter("kind = 'TESTED_BY'").select(F.col("src").alias("qualified_name")).distinct()
    untested = found["changed"].filter("kind = 'Function' and not is_test").join(tested, "qualified_name", "left_anti")
    n, names = untested.count(), [r.name for r in untested.orderBy("qualified_name").limit(5).select("name").collect()]
    impacted, files = found["impacted"].count(), found["files"].count()
    heirs = found["edges"].filter("kind in ('INHERITS', 'IMPLEMENTS')").count()
    notes = [
        (n > 0, f"- {n} changed function(s) lack tests: {', '.join(names)}"),
        (impacted > 20, f"- Wide blast radius: {impacted} nodes impacted; look at callers and dependents."),
        (heirs > 0, f"- {heirs} inheritance or implementation relationship(s) affected; check substitutability."),
        (files > 3, f"- {files} other files impacted; consider smaller changes."),
    ]
    return "\n".join(m for holds, m in notes if holds) or "- The change is well contained."


def review_context(graph: CodeGraph, files: list[str], lines: DataFrame | None = None, max_nodes: int = 500, max_lines: int = 200) -> dict:
    """Impact, snippets of the changed files, guidance and up to twenty changed functions."""
    if not files:
        return {"status": "ok", "summary": "No changed files", "changed_functions": [], "guidance": ""}
    spark = graph.nodes.sparkSession
    found = algos.impact_radius(graph, spark.createDataFrame([(f,) for f in files], "file_path string"), max_nodes)
    changed = [node_json(r.asDict()) for r in found["changed"].filter("kind = 'Function'").orderBy("qualified_name").limit(20).collect()]
    out = {"status": "ok", "changed_functions": changed, "guidance": guidance(found), "impacted": found["impacted"].count()}
    if lines is not None:
        mine = lines.filter(F.col("file_path").isin(files))
        out["snippets"] = {r.file_path: r.snippet for r in snippets(mine, found["changed"].filter("kind <> 'File'"), max_lines).collect()}
    return out


def changed_by_diff(graph: CodeGraph, ranges: DataFrame) -> DataFrame:
    """Nodes that a diff touches."""
    return nodes_in_ranges(graph.by_name.filter("kind <> 'File'"), ranges)


def siblings(graph: CodeGraph, name: str, limit: int = 10) -> DataFrame:
    """Neighbours in the file: the same kind first, then the nearest lines."""
    me = graph.node(name).select(F.col("file_path").alias("f"), F.col("kind").alias("k"), F.col("line_start").alias("l"))
    near = graph.by_name.filter((F.col("qualified_name") != name) & (F.col("kind") != "File")).join(F.broadcast(me), F.col("file_path") == F.col("f"))
    return ranked(near, F.col("kind") != F.col("k"), F.abs(F.col("line_start") - F.col("l")), limit=limit)


def node_context(graph: CodeGraph, target: str, compact: bool = True, lines: DataFrame | None = None) -> dict:
    """Callers, callees, tests, siblings, members and a preview of one node."""
    status, found = graph.resolve_target(target)
    if status != "found":
        return {"status": status, "target": target, "candidates": [r.qualified_name for r in found.limit(5).collect()]}
    node = found.first().asDict()
    name = node["qualified_name"]
    few = lambda df: [node_json(r.asDict(), compact) for r in df.orderBy("qualified_name").limit(5).collect()]
    callers, callees = graph.callers(name), graph.callees(name)
    out = {"status": "ok", "node": node_json(node, compact), "tests": few(graph.tests_of(name)), "siblings": [r.qualified_name for r in siblings(graph, name).collect()], "callers_count": callers.count(), "callees_count": callees.count()}
    if not (compact and target == name):
        out |= {"callers": few(callers), "callees": few(callees)}
    if node["kind"] in ("Class", "Type") and not out["callees_count"]:
        out["members"] = few(graph.children(name).filter("kind = 'Function'"))
    if lines is not None:
        n = 5 if compact else 15 if graph.nodes.count() > 50_000 else 30
        here = lines.filter((F.col("file_path") == node["file_path"]) & F.col("line_no").between(node["line_start"], min(node["line_end"], node["line_start"] + n - 1)))
        out["preview"] = [r.text[:SNIPPET] + "..." * (len(r.text) > SNIPPET) for r in here.orderBy("line_no").collect()]
    return out


def batch_context(graph: CodeGraph, targets: list[str], compact: bool = True) -> list[dict]:
    """Up to five targets; failures keep their status only."""
    found = [node_context(graph, t, compact) for t in targets[:5]]
    return [f if f["status"] == "ok" else {"status": f["status"], "target": f["target"]} for f in found]


def section(document: Column, name: str) -> Column:
    return F.regexp_extract(document, rf'(?is)<section name="{name}">(.*?)</section>', 1)


def token_reduction(files: DataFrame, key: str) -> DataFrame:
    """Bytes of everything against the changed files and a quarter of the file for each impacted node.

    ``files``: (key, size, changed, impacted).
    """
    quarter = F.floor(F.col("size") / 4).cast("long") * F.col("impacted")
    sums = files.groupBy(key).agg(F.sum("size").alias("naive"), F.sum(F.when(F.col("changed"), F.col("size")).otherwise(0) + quarter).cast("long").alias("context"))
    return sums.withColumn("reduction", F.round(1 - F.col("context") / F.col("naive"), 4))


def retrieval_metrics(ranks: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Hit@k and mean reciprocal rank, with subtotals; rank is null for a miss."""
    hit = F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    return ranks.rollup(*by).agg(F.count("*").alias("cases"), F.round(F.avg(hit), 6).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
