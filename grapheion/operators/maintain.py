"""Keeping the graph equal to a full rebuild: replacing and removing files, hash skips, differences.

Raw edges keep unresolved targets, and edges are a join, so an edge into a replaced file comes
back by itself: no state depends on the order of updates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapheion.operators.graph import CodeGraph
from grapheion.operators.lineage import cut

#: Paths up to which they are named in the plan, and up to which they are sent to all tasks.
NAMED, FEW = 100, 100_000


def of_files(files: DataFrame) -> Callable[..., DataFrame]:
    """A function that keeps those rows of a table whose path is one of ``files`` (file_path), or with ``but=True`` all others.

    Paths are found first and stored: joins with them go below the unions that a graph is made of, where a plan
    would repeat for each part all that the paths are made of. A few paths need no join.
    """
    paths = cut(files.select("file_path").filter("file_path is not null").distinct())
    named = [r.file_path for r in paths.limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        known = F.coalesce(F.col("file_path").isin(named), F.lit(False))
        return lambda df, but=False: df.filter(~known if but else known)
    met = F.broadcast(paths) if paths.limit(FEW + 1).count() <= FEW else paths
    return lambda df, but=False: df.join(met, "file_path", "left_anti" if but else "left_semi").select(*df.columns)


def without_files(graph: CodeGraph, files: DataFrame) -> CodeGraph:
    """The graph without the nodes and outgoing edges of ``files`` (file_path)."""
    gone = of_files(files)
    return CodeGraph(gone(graph.nodes, but=True), gone(graph.edges_raw, but=True))


def replace_files(graph: CodeGraph, nodes: DataFrame, edges_raw: DataFrame, files: DataFrame | None = None) -> CodeGraph:
    """Files parsed anew take the place of what was stored; ``files`` adds files that now hold nothing."""
    touched = nodes.select("file_path").unionByName(edges_raw.select("file_path"))
    if files is not None:
        touched = touched.unionByName(files.select("file_path"))
    kept = without_files(graph, touched)
    return CodeGraph(kept.nodes.unionByName(nodes.select(*kept.nodes.columns)), kept.edges_raw.unionByName(edges_raw.select(*kept.edges_raw.columns)))


def replace_nodes(graph: CodeGraph, nodes: DataFrame) -> CodeGraph:
    """Nodes only: the first of the two phases of a build."""
    kept = of_files(nodes)(graph.nodes, but=True)
    return CodeGraph(kept.unionByName(nodes.select(*kept.columns)), graph.edges_raw)


def add_edges(graph: CodeGraph, edges_raw: DataFrame, distinct: bool = True) -> CodeGraph:
    both = graph.edges_raw.unionByName(edges_raw.select(*graph.edges_raw.columns))
    return CodeGraph(graph.nodes, both.dropDuplicates(["source_qualified", "target_qualified", "kind"]) if distinct else both)


def remove_files(graph: CodeGraph, files: DataFrame) -> CodeGraph:
    return without_files(graph, files)


def purge(graph: CodeGraph, on_disk: DataFrame) -> CodeGraph:
    """Drop files that are stored but gone from disk."""
    return without_files(graph, graph.files().join(on_disk.select("file_path"), "file_path", "left_anti"))


def changed_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``found`` (path, hash) whose hash is not the stored one."""
    return found.join(stored, ["path", "hash"], "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed and modified keys."""
    o = old.select(key, F.col(value).alias("_old"))
    n = new.select(key, F.col(value).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    return o.join(n, key, "full_outer").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, change.alias("change"))


def changed_parts(graph: CodeGraph, sources: DataFrame, changed: DataFrame, parse, dependents: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, nodes, edges_raw, changed names): what takes the place of all that ``files`` held.

    ``sources``: (file_path, content, file_hash) on disk; ``changed``: (file_path), removed ones included;
    ``parse``: sources -> (nodes, edges_raw). Files whose hash is stored are left. ``dependents`` looks at
    files with an edge into the changed ones too, which takes all edges; without it only nodes of the
    changed files are read.
    """
    names = wanted = changed.select("file_path").distinct()
    if dependents:
        into = graph.edges.filter(F.col("kind").isin("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS"))
        near = into.join(names.withColumnRenamed("file_path", "dst_file"), "dst_file", "left_semi").select(F.col("src_file").alias("file_path"))
        wanted = names.unionByName(near).distinct()
    stored = graph.nodes.join(wanted, "file_path", "left_semi")
    todo = sources.join(wanted, "file_path", "left_semi").join(stored.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti")
    files = names.join(sources.select("file_path"), "file_path", "left_anti").unionByName(todo.select("file_path")).distinct()
    nodes, edges = parse(todo)
    hashed = lambda df: df.groupBy("qualified_name").agg(F.max("body_hash").alias("body_hash"))
    return files, nodes, edges, diff(hashed(stored.join(files, "file_path", "left_semi")), hashed(nodes), "qualified_name", "body_hash")


def incremental_update(graph: CodeGraph, sources: DataFrame, changed: DataFrame, parse) -> tuple[CodeGraph, DataFrame]:
    """The new graph and the names that changed: changed files and what depends on them, unless their hash is stored."""
    files, nodes, edges, names = changed_parts(graph, sources, changed, parse, dependents=True)
    return replace_files(graph, nodes, edges, files), names
