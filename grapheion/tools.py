"""The graph's tools as functions: each opens the store of a repository, brings it up to date and answers as a dict."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.functions import text as tx
from grapheion.operators import algos, context, maintain, search
from grapheion.operators.graph import CodeGraph, query_graph as run_pattern
from grapheion.sources import extract, files, git, store

#: Rows of a list that travel to the driver; totals tell the rest.
SHOWN = 500
CORE = ["hybrid_query", "query_graph", "open_node_context", "get_impact_radius", "build_or_update_graph"]


class Repository:
    """A repository with its stored graph."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.root = spark, store.find_root(path)
        self.store = store.GraphStore(spark, store.store_folder(self.root))

    def scan(self) -> DataFrame:
        return files.scan(self.spark, self.root, git.tracked(self.root))

    def lines(self, paths: list[str]) -> DataFrame:
        return files.lines_of(self.scan().filter(F.col("file_path").isin(paths)))

    def graph(self) -> CodeGraph:
        """The stored graph, updated first if files changed and the last update is no moment ago."""
        if not self.store.is_fresh():
            changed = [p for p in git.status(self.root) if extract.language_of_path(p)]
            if changed:
                self.update(changed)
        return self.store.read()

    def update(self, changed: list[str]) -> dict:
        names = self.spark.createDataFrame([(p,) for p in changed], "file_path string")
        since = self.store.version()
        files, nodes, edges, diff = maintain.changed_parts(self.store.read(since), self.scan(), names, extract.parse, dependents=True)
        files, diff = files.cache(), diff.cache()
        total, found = diff.count(), [r.asDict() for r in diff.orderBy("qualified_name").limit(SHOWN).collect()]
        self.store.update(files, nodes, edges, since=since, last_build_type="incremental")
        extract.release(nodes)
        for df in (files, diff):
            df.unpersist()
        self.store.collect_garbage(self.store.read(), total)
        self.store.tidy()
        return {"status": "ok", "build_type": "incremental", "changed_files": len(changed), "changed_qualified_names": found, "total_changed": total}


def build_or_update_graph(repo: Repository, full_rebuild: bool = False, base: str = "HEAD~1") -> dict:
    if not full_rebuild and repo.store.metadata():
        changed = [p for p in git.changed_or_status(repo.root, None, base) if extract.language_of_path(p)]
        return repo.update(changed) if changed else {"status": "ok", "build_type": "incremental", "changed_files": 0, "changed_qualified_names": []}
    began = time.time()
    graph = extract.build(repo.scan())
    repo.store.write(graph, last_build_type="full")
    return {"status": "ok", "build_type": "full", "nodes": graph.nodes.count(), "edges": graph.edges.count(), "seconds": round(time.time() - began, 2)}


def get_impact_radius(repo: Repository, changed_files: list[str] | None = None, max_results: int = 500, base: str = "HEAD~1", compact: bool = True) -> dict:
    changed = git.changed_or_status(repo.root, changed_files, base)
    if not changed:
        return {"status": "ok", "summary": "No changed files", "changed_nodes": [], "impacted_nodes": [], "impacted_files": []}
    found = algos.impact_radius(repo.graph(), repo.spark.createDataFrame([(p,) for p in changed], "file_path string"), min(max_results, 500))
    show = lambda df, *order: [context.node_json(r.asDict(), compact) | ({"score": round(r.score, 6)} if "score" in df.columns else {}) for r in df.orderBy(*order, "qualified_name").limit(SHOWN).collect()]
    out = {"status": "ok", "changed_files": changed, "total_changed": found["changed"].count(), "changed_nodes": show(found["changed"]), "impacted_nodes": show(found["impacted"], F.desc("score")), "impacted_files": sorted(r.file_path for r in found["files"].collect()), "edges": found["edges"].count()}
    return out | {"summary": f"{out['total_changed']} changed, {len(out['impacted_nodes'])} impacted in {len(out['impacted_files'])} files"}


def query_graph(repo: Repository, pattern: str, target: str, compact: bool = True) -> dict:
    return run_pattern(repo.graph(), pattern, target, compact=compact)


def get_review_context(repo: Repository, changed_files: list[str] | None = None, base: str = "HEAD~1", max_lines_per_file: int = 200, include_source: bool = True) -> dict:
    changed = git.changed_or_status(repo.root, changed_files, base)
    return context.review_context(repo.graph(), changed, repo.lines(changed) if include_source and changed else None, max_lines=max_lines_per_file)


def _vectors(repo: Repository, provider: Callable | None) -> search.Vectors | None:
    """Stored vectors with what embeds a query; none without a provider or without vectors."""
    stored = repo.store.embeddings()
    return search.Vectors(stored, provider) if provider is not None and stored.limit(1).count() else None


def semantic_search_nodes(repo: Repository, query: str, kind: str | None = None, limit: int = 10, compact: bool = True, provider: Callable | None = None) -> dict:
    """By vectors where a provider and vectors exist, else by words; kinds are filtered after twice the limit.

    Unless ``compact``, the best three come with their first ten lines.
    """
    graph, vectors = repo.graph(), _vectors(repo, provider)
    if vectors is not None:
        hits = vectors.nearest(query, "node", 2 * limit).select(F.col("key").alias("qualified_name"), "score").join(graph.by_name, "qualified_name").orderBy(F.desc("score"), "qualified_name")
    else:
        hits = search.search_and(graph.by_name, query, 2 * limit)
    rows = [r.asDict() for r in hits.collect()]
    rows = [r for r in rows if kind is None or r["kind"] == kind][:limit]
    results = [context.node_json(r, compact) | ({"score": r["score"]} if "score" in r else {}) for r in rows]
    if not compact and rows:
        best = {(r["file_path"], r["line_start"]): r for r in rows[:3]}
        text = {(r.file_path, r.line_no): r.text for r in repo.lines(sorted({p for p, _ in best})).filter(tx.any_of([(F.col("file_path") == p) & F.col("line_no").between(n, n + 9) for p, n in best])).collect()}
        for r, shown in zip(rows[:3], results, strict=False):
            shown["preview"] = [text[r["file_path"], n] for n in range(r["line_start"], r["line_start"] + 10) if (r["file_path"], n) in text]
    return {"status": "ok", "mode": "keyword" if vectors is None else "vector", "results": results}


def semantic_search_files(repo: Repository, query: str, limit: int = 10, provider: Callable | None = None) -> dict:
    """The files whose vectors are nearest to the query."""
    vectors = _vectors(repo, provider)
    rows = search.nearest_files(vectors, query, limit).orderBy(F.desc("score"), "file_path").collect() if vectors is not None else []
    return {"status": "ok", "results": [r.asDict() for r in rows]}


def list_graph_stats(repo: Repository) -> dict:
    return {"status": "ok"} | repo.graph().stats().first().asDict() | {"embeddings": repo.store.embeddings().count(), "metadata": repo.store.metadata()}


def embed_graph(repo: Repository, provider: Callable | None = None, name: str = "custom", dims: int | None = None) -> dict:
    """Vectors of nodes and files; stored ones are reused by text, those of vanished nodes go."""
    if provider is None:
        return {"status": "error", "error": "No embedding provider is set"}
    graph, stored = repo.graph(), repo.store.embeddings()
    nodes = graph.by_name.select(F.col("qualified_name").alias("key"), tx.node_text(F.col("name"), F.col("kind"), F.col("signature"), F.col("language")).alias("text"))
    parts = []
    for level, texts in (("node", nodes), ("file", search.file_texts(graph.nodes))):
        old = stored.filter(F.col("level") == level)
        parts.append(search.embed(texts, old, provider, name).withColumn("level", F.lit(level)).withColumn("dims", F.size("vec")))
    repo.store.write_embeddings(parts[0].unionByName(parts[1]))
    return {"status": "ok", "embedded": repo.store.embeddings().count()}


def get_docs_section(document: str, name: str) -> dict:
    import re

    m = re.search(rf'(?is)<section name="{re.escape(name)}">(.*?)</section>', document)
    return {"status": "ok", "content": m[1].strip()} if m else {"status": "not_found", "available": re.findall(r'(?i)<section name="([^"]*)">', document)}


def find_large_functions(repo: Repository, min_lines: int = 50, kind: str | None = None, file_path_pattern: str = "", limit: int = 50) -> dict:
    rows = repo.graph().large(min_lines, kind, file_path_pattern, limit, repo.root).collect()
    return {"status": "ok", "results": [context.node_json(r.asDict()) | {"line_count": r.line_count, "relative_path": r.relative_path} for r in rows]}


def trace_call_chain(repo: Repository, source: str, target: str, max_depth: int = 10) -> dict:
    return algos.trace(repo.graph(), source, target, max_depth)


def hybrid_query(repo: Repository, query: str, limit: int = 10, budget: str = "auto", scope: str = "", result_mode: str | None = None, provider: Callable | None = None, route: str = "auto", fusion: str = "rrf") -> dict:
    return search.hybrid(repo.graph(), query, limit, budget, scope, repo.root, mode=result_mode, vectors=_vectors(repo, provider), route=route, fusion=fusion, lines=repo.lines)


def open_node_context(repo: Repository, target: str, compact: bool = True) -> dict:
    graph = repo.graph()
    status, found = graph.resolve_target(target)
    return context.node_context(graph, target, compact, repo.lines([found.first().file_path]) if status == "found" else None)


def batch_open_node_context(repo: Repository, targets: list[str], compact: bool = True) -> list[dict]:
    return context.batch_context(repo.graph(), targets, compact)


TOOLS = {f.__name__: f for f in (build_or_update_graph, get_impact_radius, query_graph, get_review_context, semantic_search_nodes, list_graph_stats, embed_graph, get_docs_section, find_large_functions, trace_call_chain, hybrid_query, open_node_context, batch_open_node_context)}


def listed(which: str = "all") -> list[str]:
    return [t for t in TOOLS if which == "all" or t in CORE]
