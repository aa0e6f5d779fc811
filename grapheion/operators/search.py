"""Ranked retrieval over nodes: keyword, full text, vectors, fusion, files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grapheion.functions import text as tx
from grapheion.operators.graph import CodeGraph, ranked
from grapheion.shipping import ship

RRF_K = 60.0
# Demoted folders, and weights of (exact, relaxed, semantic, path) channels by route.
SEARCH_DEMOTED = ["compiled/", "node_modules/", ".next/"]
FILE_DEMOTED = ["/compiled/", "/node_modules/", "/.next/", "/dist/", "/vendor/"]
ROUTE_WEIGHTS = {"ExactSymbol": (1.5, 1.0, 0.7, 1.0), "ExactText": (1.5, 1.0, 0.7, 1.0), "FilePath": (1.0, 1.0, 0.7, 1.5), "Causal": (1.0, 0.8, 1.3, 1.0), "General": (1.0, 0.8, 1.3, 1.0), "ConfigLookup": (1.0, 1.0, 1.0, 1.0)}
# End of fixed values.


@dataclass(frozen=True)
class Switches:
    """Parts of hybrid retrieval that can be turned off."""

    fanout: bool = True
    exact_channels: bool = True
    semantic: bool = True
    expansion: bool = True
    scorer: bool = True
    priors: bool = True
    decompose: bool = True

    @classmethod
    def fast(cls) -> Switches:
        return cls(fanout=False, expansion=False)

    def without(self, name: str) -> Switches:
        return replace(self, **{name: False})


def _lower(nodes: DataFrame) -> tuple[Column, Column, Column]:
    return F.lower("name"), F.lower("qualified_name"), F.lower("file_path")


def demoted(path: Column) -> Column:
    return tx.any_of([path.startswith(p) | path.contains("/" + p) for p in SEARCH_DEMOTED])


def search_and(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Nodes that hold every word in name, qualified name or path; by tier, then name."""
    words, whole = query.lower().split(), query.lower()
    if not words:
        return nodes.limit(0)
    name, qn, path = _lower(nodes)
    hits = nodes
    for w in words:
        hits = hits.filter(name.contains(w) | qn.contains(w) | path.contains(w))
    in_path = tx.any_of([path.contains(w) for w in words])
    tier = F.when((name == whole) | (qn == whole), 0).when(name.startswith(whole), 1).when(in_path, 1).otherwise(2) + demoted(path).cast("int")
    return ranked(hits.withColumn("tier", tier), F.col("tier"), F.col("name"), limit=limit)


def relaxed_score(words: list[str]) -> tuple[Column, Column]:
    """(matching words, score) of nodes for a list of words."""
    name, qn, path = F.lower("name"), F.lower("qualified_name"), F.lower("file_path")
    count = lambda tests: sum((t.cast("int") for t in tests), F.lit(0))
    named = count([name.contains(w) | qn.contains(w) for w in words])
    matched = count([name.contains(w) | qn.contains(w) | path.contains(w) for w in words])
    n = float(len(words))
    score = (0.6 * (matched / n) + 0.4 * (named / n)) * F.when(demoted(path), 0.5).otherwise(1.0) * F.when(F.col("kind") == "Test", 0.8).otherwise(1.0)
    return matched, score


def search_relaxed(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Any word matches; up to three words without stop words it is the strict search of the query as it stands."""
    words = tx.relaxed_words(query)
    if len(words) <= 3:
        return search_and(nodes, query, limit)
    matched, score = relaxed_score(words)
    hits = nodes.withColumn("matched", matched).filter("matched > 0").withColumn("score", score)
    return ranked(hits, F.desc(F.round("score", 12)), F.col("name"), limit=limit)


def bm25(docs: DataFrame, key: str, text: Column, query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 over words; statistics of the query's words only leave the scan."""
    terms = sorted(set(query.lower().split()))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    sized = docs.select(F.col(key).alias("key"), F.size(words).alias("len"), words.alias("w"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    listed = F.array(*[F.lit(t) for t in terms])
    tf = sized.select("key", "len", F.explode(F.filter("w", lambda w: F.array_contains(listed, w))).alias("term")).groupBy("key", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # df has a row a query term, corpus one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(corpus)).groupBy("key").agg(F.sum(part).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "key").limit(limit).withColumnRenamed("key", key)


def fuzzy(nodes: DataFrame, word: str, limit: int) -> DataFrame:
    """Nodes with a word whose prefix is within one edit of ``word``."""
    w = word.lower()
    near = F.exists(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda t: F.levenshtein(F.substring(t, 1, len(w)), F.lit(w)) <= 1)
    return ranked(nodes.filter(near), F.levenshtein(F.lower("name"), F.lit(w)), limit=limit)


def parses(query: str) -> bool:
    """Whether a full-text query is well formed: balanced quotes and brackets, no operator left alone."""
    depth = 0
    for c in query:
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(c, 0)
        if depth < 0:
            return False
    last = query.split()[-1:]
    return depth == 0 and query.count('"') % 2 == 0 and last not in (["AND"], ["OR"], ["NOT"])


def indexed(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """The ``limit`` best full-text hits over names and docstrings, in tiers: the name itself, its beginning, others.

    A query that does not parse is looked up as one word, within an edit.
    """
    whole = query.lower()
    if not query.strip():
        return nodes.limit(0).withColumn("tier", F.lit(0))
    if parses(query):
        hits = bm25(nodes, "qualified_name", F.concat_ws(" ", "name", "docstring"), re.sub(r"[^\w]+", " ", query), limit)
        hits = nodes.join(hits.select("qualified_name"), "qualified_name")
    else:
        hits = fuzzy(nodes, query, limit)
    name, qn, _ = _lower(nodes)
    tier = F.when((name == whole) | (qn == whole), 0).when(name.startswith(whole), 1).otherwise(2)
    return ranked(hits.withColumn("tier", tier), F.col("tier"), F.col("name"), limit=limit)


# vectors ---------------------------------------------------------------------
def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or unlike lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_search(embeddings: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """(key, ..., score): exact scan; the query vector is a literal, only ``limit`` rows a task travel."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return embeddings.withColumn("score", F.round(cosine(F.col(vector), q), 4)).orderBy(F.desc("score"), key).limit(limit)


@dataclass(frozen=True)
class Vectors:
    """Stored vectors (key, level, vec) of nodes and files, and the provider that embeds a query."""

    stored: DataFrame
    provider: Callable[[list[str]], list[list[float]]]

    def nearest(self, query: str, level: str, limit: int) -> DataFrame:
        """(key, score, rank) of the ``limit`` keys of a level nearest to a text."""
        found = vector_search(self.stored.filter(F.col("level") == level), "key", "vec", self.provider([query])[0], limit)
        # at most limit rows
        return found.select("key", "score", F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank"))

    def nodes(self, query: str, limit: int) -> DataFrame:
        """(qualified_name, rank)"""
        return self.nearest(query, "node", limit).select(F.col("key").alias("qualified_name"), "rank")

    def nodes_of_files(self, graph: CodeGraph, query: str, limit: int) -> DataFrame:
        """(qualified_name, rank): nodes of the nearest files, ranked by line within their file."""
        files = self.nearest(query, "file", limit).select(F.col("key").alias("file_path"))
        inside = Window.partitionBy("file_path").orderBy("line_start", "qualified_name")
        return graph.by_name.join(files, "file_path").select("qualified_name", F.row_number().over(inside).alias("rank"))


#: Queries whose vectors travel to every task at once, and scores computed at once in a task.
QUERY_BLOCK, SCORES = 8_192, 4_000_000


def _matrix(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, vectors of length one). Null, empty and zero vectors are left out."""
    column = vectors.cast(pa.list_(pa.float64()))
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False))
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        m = flat[starts[rows][:, None] + np.arange(d)]
        norm = np.sqrt((m * m).sum(1))
        out[d] = rows[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
    return out


def vector_join_all(queries: DataFrame, items: DataFrame, key: str, vector: str, top: int, bucket: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): for each query the ``top`` most similar of all other items, or of its bucket.

    Queries go out in blocks of about QUERY_BLOCK vectors, whose bound holds at any size; for each
    block one pass over the items multiplies it with batches of them, and a task keeps ``top``
    items a query, so only these are shuffled. ``key`` is a long. A vector without length or of
    another length has similarity 0, as any to it.
    """
    ship(items.sparkSession)
    columns = [F.col(key).cast("long").alias("key"), F.col(vector).alias("vec"), (F.col(bucket) if bucket else F.lit(0)).cast("long").alias("bucket")]
    asked, held = (df.filter(F.col(key).isNotNull()).select(*columns) for df in (queries, items))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    spread = F.pmod(F.xxhash64("key"), F.lit(blocks))
    found = None
    for b in range(blocks):
        # one block, of QUERY_BLOCK rows or little more
        table = asked.filter(spread == b).toArrow().combine_chunks()
        part = held.mapInArrow(_nearest_in_task(table, top, bucket is not None), "query_id long, key long, score double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", F.col("key").alias(key), "score", "rank")


def vector_join(queries: DataFrame, items: DataFrame, key: str, bucket: str, vector: str, top: int) -> DataFrame:
    """The same among the items of the query's bucket; null buckets hold nothing."""
    return vector_join_all(queries.filter(F.col(bucket).isNotNull()), items.filter(F.col(bucket).isNotNull()), key, vector, top, bucket)


def _keep(best_key: np.ndarray, best_score: np.ndarray, rows: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
    """Enter the scores of some rows' queries with ``keys`` into the kept ones; -2 stands for no pair."""
    top = best_score.shape[1]
    # a score can enter only if it reaches the last kept; equal ones enter by key
    for q in np.flatnonzero((scores >= best_score[rows, -1:]).any(1) & (scores.max(1) > -2.0)).tolist():
        r = rows[q]
        at = np.flatnonzero((scores[q] >= best_score[r, -1]) & (scores[q] > -2.0))
        k, s = np.concatenate([best_key[r], keys[at]]), np.concatenate([best_score[r], scores[q, at]])
        by = np.lexsort((k, -s))[:top]
        best_key[r], best_score[r] = k[by], s[by]


def _kept(ids: np.ndarray, best_key: np.ndarray, best_score: np.ndarray) -> Iterator[pa.RecordBatch]:
    q, r = np.nonzero(best_score > -2.0)
    for lo in range(0, len(q), 10_000):
        part = slice(lo, lo + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q[part]]), pa.array(best_key[q[part], r[part]]), pa.array(best_score[q[part], r[part]])], names=["query_id", "key", "score"])


def _nearest_in_task(table: pa.Table, top: int, by_bucket: bool) -> Callable:
    """mapInArrow function: the ``top`` items of a task for each query of ``table``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        ids, home = table.column("key").to_numpy(), table.column("bucket").to_numpy()
        by_size = _matrix(table.column("vec").chunk(0))
        n = len(ids)
        # kept rows: best first by (score, key); empty places have score -2
        best_key, best_score = np.zeros((n, top), np.int64), np.full((n, top), -2.0)
        for b in batches:
            keys, buckets = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            mine = _matrix(b.column(1))
            step = max(1, SCORES // len(keys))
            for lo in range(0, n, step):
                hi = min(n, lo + step)
                scores = np.zeros((hi - lo, len(keys)))
                for d, (rows, m) in by_size.items():
                    a, z = np.searchsorted(rows, lo), np.searchsorted(rows, hi)
                    if d in mine and a < z:
                        scores[np.ix_(rows[a:z] - lo, mine[d][0])] = m[a:z] @ mine[d][1].T
                scores = np.round(scores, 4) + 0.0
                scores[ids[lo:hi, None] == keys[None, :]] = -2.0
                if by_bucket:
                    scores[home[lo:hi, None] != buckets[None, :]] = -2.0
                _keep(best_key, best_score, np.arange(lo, hi), scores, keys)
        yield from _kept(ids, best_key, best_score)

    return run


# fusion ----------------------------------------------------------------------
def channel(ranking: DataFrame, source: str, weight: float, *order: Column) -> DataFrame:
    """(qualified_name, source, rrf) of a ranked list cut to a limit; ranks start at 1."""
    w = Window.orderBy(*order, "qualified_name")
    return ranking.select("qualified_name", F.lit(source).alias("source"), (F.lit(weight) / (RRF_K + F.row_number().over(w))).alias("rrf"))


def ranked_channel(ranking: DataFrame, source: str, weight: float) -> DataFrame:
    """The same of a list that has its ranks already."""
    return ranking.select("qualified_name", F.lit(source).alias("source"), (F.lit(weight) / (RRF_K + F.col("rank"))).alias("rrf"))


def fuse(channels: list[DataFrame]) -> DataFrame:
    """(qualified_name, score, sources): scores add up, sources unite."""
    pool = channels[0]
    for c in channels[1:]:
        pool = pool.unionByName(c)
    return pool.groupBy("qualified_name").agg(F.sum("rrf").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def convex(a: DataFrame, b: DataFrame, share: float = 0.5) -> DataFrame:
    """Convex combination of two (qualified_name, rank) lists by min-max of 1/rank; equal values count as 1."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        raw = 1.0 / F.col("rank")
        bounds = df.agg(F.min(raw).alias("lo"), F.max(raw).alias("hi"))
        return df.join(F.broadcast(bounds)).select("qualified_name", F.when(F.col("hi") > F.col("lo"), (raw - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias(name))

    both = scaled(a, "a").join(scaled(b, "b"), "qualified_name", "full_outer")
    return both.select("qualified_name", (share * F.coalesce("a", F.lit(0.0)) + (1 - share) * F.coalesce("b", F.lit(0.0))).alias("score"))


def fanout(graph: CodeGraph, parts: tx.Parts, route: str, limit: int, switches: Switches = Switches(), vectors: Vectors | None = None, index: bool = False) -> DataFrame:
    """Candidates of all channels that apply, fused. ``index``: the full-text index takes part."""
    exact_w, relaxed_w, semantic_w, path_w = ROUTE_WEIGHTS[route]
    pool, nodes = limit * 5, graph.by_name
    by_tier = lambda df: [F.col("tier"), F.col("name")] if "tier" in df.columns else [F.desc(F.round("score", 12)), F.col("name")]
    relaxed = search_relaxed(nodes, parts.raw, pool)
    order = by_tier(relaxed)
    out = [channel(relaxed, "keyword_relaxed", relaxed_w, *order)]
    exact = [" ".join(parts.symbols)] * (switches.fanout and bool(parts.symbols)) + ([" ".join(parts.compounds)] * bool(parts.compounds) + parts.quoted) * switches.exact_channels
    for q in exact:
        out.append(channel(search_and(nodes, q, pool), "keyword_exact", exact_w, F.col("tier"), F.col("name")))
    if switches.fanout and parts.paths:
        out.append(channel(relaxed, "path_boosted", path_w, ~F.col("qualified_name").rlike("[/.]"), *order))
    if switches.fanout and {"config", "settings", "options", "env"} & set(parts.terms):
        out.append(channel(relaxed, "config_boosted", 1.0, F.col("kind") != "Type", *order))
    if switches.semantic and vectors is not None:
        out.append(ranked_channel(vectors.nodes(parts.raw, pool), "semantic", semantic_w))
        out.append(ranked_channel(vectors.nodes_of_files(graph, parts.raw, limit), "file_semantic", semantic_w))
    if switches.fanout and index:
        out.append(channel(indexed(nodes, parts.raw, pool), "full_text", 1.0, F.col("tier"), F.col("name")))
    return fuse(out)


def score_files(graph: CodeGraph, candidates: DataFrame, parts: tx.Parts, limit: int, switches: Switches = Switches()) -> DataFrame:
    """(file_path, score, top_nodes, sources): the best three nodes of a file with priors.

    A node counts as tested if an edge to a test leaves it.
    """
    risk = graph.degrees().select("qualified_name", "fan_in", "tested")
    rows = candidates.join(graph.by_name.select("qualified_name", "name", "file_path", "kind", "is_test", "line_start", "line_end"), "qualified_name").join(risk, "qualified_name", "left")
    w = Window.partitionBy("file_path").orderBy(F.desc(F.round("score", 12)), "qualified_name")
    rows = rows.withColumn("r", F.row_number().over(w))
    top3 = F.col("r") <= 3
    symbols = tx.any_of([F.lower("file_path").contains(s.lower()) for s in parts.symbols])
    evidence = F.struct("r", "name", "qualified_name", "kind", "line_start", "line_end", "score", "sources", tx.matched_terms(parts.symbols, parts.terms, F.col("name"), F.col("qualified_name"), F.col("file_path")).alias("matched_terms"), "is_test")
    files = rows.groupBy("file_path").agg(
        F.sum(F.when(F.col("r") == 1, 1.5 * F.col("score")).when(top3, 0.3 * F.col("score")).otherwise(0.0)).alias("capped"),
        F.sum("score").alias("total"),
        F.max((F.col("r") == 1) & F.array_contains("sources", "keyword_exact")).alias("exact"),
        F.min((F.col("kind") == "Test") | F.col("is_test")).alias("all_tests"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("n_sources"),
        F.max(F.when(top3, F.coalesce("fan_in", F.lit(0)))).alias("fan_in"),
        F.max(top3 & ~F.coalesce("tested", F.lit(False))).alias("untested"),
        F.array_sort(F.collect_list(F.when(top3, evidence))).alias("top_nodes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )
    factor = lambda test, x: F.when(test, x).otherwise(1.0)
    score = F.col("capped") if switches.scorer else F.col("total")
    if switches.priors:
        score = score * factor(F.col("exact"), 1.5) * factor(F.col("all_tests") & F.lit(not parts.mentions_tests), 0.5)
        score = score * factor(tx.any_of([F.col("file_path").contains(p) for p in FILE_DEMOTED]), 0.5) * (1 + 0.15 * (F.col("n_sources") - 1)) * factor(symbols, 1.3)
        score = score * factor(F.col("fan_in") > 5, 1.1) * factor(F.col("untested") & (F.col("fan_in") > 3), 1.15)
    return files.withColumn("score", score).orderBy(F.desc(F.round("score", 12)), "file_path").limit(limit).select("file_path", "score", "top_nodes", "sources")


def merge_views(views: list[tuple[DataFrame, float]]) -> DataFrame:
    """Candidates of several views: full weight at first sight, 0.7 of it again for each later one."""
    rows = None
    for i, (v, w) in enumerate(views):
        one = v.select("qualified_name", "sources", (F.col("score") * w).alias("score"), F.lit(i).alias("view"))
        rows = one if rows is None else rows.unionByName(one)
    first = F.min("view").over(Window.partitionBy("qualified_name"))
    rows = rows.withColumn("first", first)
    return rows.groupBy("qualified_name").agg(F.sum(F.when(F.col("view") == F.col("first"), F.col("score")).otherwise(0.7 * F.col("score"))).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))


def nearest_files(vectors: Vectors, query: str, limit: int) -> DataFrame:
    """(file_path, score) of the files nearest to a text."""
    return vectors.nearest(query, "file", limit).select(F.col("key").alias("file_path"), "score")


def new_files(graph: CodeGraph, view: DataFrame, seen: DataFrame) -> int:
    files = lambda v: graph.by_name.join(v.select("qualified_name"), "qualified_name", "left_semi").select("file_path").distinct()
    return files(view).join(files(seen), "file_path", "left_anti").count()


def multi_view(graph: CodeGraph, query: str, limit: int, switches: Switches = Switches(), vectors: Vectors | None = None, index: bool = False) -> DataFrame:
    """Views of the query, its symbols, its terms; stops after two that bring fewer than two new files."""
    parts = tx.decompose(query)
    views = [(fanout(graph, parts, tx.classify(query).route, limit, switches, vectors, index), 1.0)]
    empty = views[0][0].limit(0)
    stalls = int(new_files(graph, views[0][0], empty) < 2)
    for words, weight, least in ((parts.symbols, 0.8, 1), (parts.terms, 0.7, 2)):
        again = " ".join(words)
        if len(words) < least or stalls >= 2 or again == query:
            continue
        view = fanout(graph, tx.decompose(again), tx.classify(again).route, limit, switches, vectors, index)
        stalls = stalls + 1 if new_files(graph, view, merge_views(views)) < 2 else 0
        views.append((view, weight))
    return merge_views(views)


def budget(name: str, nodes: int, limit: int) -> tuple[int, str, bool, bool]:
    """(limit, mode, preview, expansion) for 'thorough', 'auto' by the number of nodes, or 'fast'."""
    if name == "thorough":
        return limit, "node", True, True
    if name == "auto":
        return (min(limit, 3), "file", nodes <= 50_000, nodes <= 50_000) if nodes > 5_000 else (min(limit, 5), "file", True, True)
    return min(limit, 3), "file", True, True


def by_nodes(graph: CodeGraph, query: str, kind: tx.Classified, limit: int, vectors: Vectors | None = None, fusion: str = "rrf") -> tuple[str, DataFrame]:
    """(method, (qualified_name, score)): nodes by the route of the query.

    Symbols, texts, paths and settings go by words alone, with nodes of the kind asked for
    raised; what remains, or finds nothing there, joins words and vectors by ranks.
    """
    route = kind.route if kind.confidence >= 0.6 else "General"
    found = search_relaxed(graph.by_name, query, 2 * limit)
    order = [F.col("tier"), F.col("name")] if "tier" in found.columns else [F.desc(F.round("score", 12)), F.col("name")]
    words = found.select("qualified_name", "kind", F.row_number().over(Window.orderBy(*order, "qualified_name")).alias("rank"))
    raised = {"FilePath": F.col("qualified_name").rlike("[/.]"), "ConfigLookup": F.col("kind") == "Type"}
    methods = {"ExactSymbol": "keyword_only", "ExactText": "keyword_exact_text", "FilePath": "keyword_path_boosted", "ConfigLookup": "keyword_config_boosted"}
    top = lambda df: ranked(df, F.desc(F.round("score", 12)), limit=limit)
    if route in methods and words.limit(1).count():
        factor = F.when(raised.get(route, F.lit(False)), 1.5).otherwise(1.0)
        return methods[route], top(words.select("qualified_name", (factor / (RRF_K + F.col("rank"))).alias("score")))
    if vectors is not None and fusion == "cc":
        return "hybrid_cc", top(convex(words.select("qualified_name", "rank"), vectors.nodes(query, 2 * limit)))
    _, relaxed_w, semantic_w, _ = ROUTE_WEIGHTS[kind.route]
    keyword_w = 1.5 if kind.route in ("ExactSymbol", "ExactText") else relaxed_w
    lists = [ranked_channel(words, "keyword", keyword_w)]
    if vectors is not None:
        lists.append(ranked_channel(vectors.nodes(query, 2 * limit), "semantic", semantic_w))
    return "hybrid_rrf" if vectors is not None else "keyword_only", top(fuse(lists).select("qualified_name", "score"))


ROUTE_NAMES = {"exact": "ExactSymbol", "semantic": "Causal", "path": "FilePath", "legacy": "General"}
PREVIEW_LINES = 5


def hybrid(graph: CodeGraph, query: str, limit: int = 10, budget_name: str = "auto", scope: str = "", root: str = "", switches: Switches | None = None, mode: str | None = None, vectors: Vectors | None = None, route: str = "auto", fusion: str = "rrf", lines: Callable | None = None) -> dict:
    """The retrieval pipeline: classify, decompose, fan out, expand, filter by scope, rank files or nodes.

    ``vectors`` feed the semantic channels; ``lines``, from paths to (file_path, line_no, text), the previews.
    """
    if not query.strip():
        return {"status": "no_match", "results": []}
    if route != "auto" and route not in ROUTE_NAMES:
        return {"status": "error", "error": f"Unknown route {route}: auto, {', '.join(ROUTE_NAMES)}"}
    if fusion not in ("rrf", "cc"):
        return {"status": "error", "error": f"Unknown fusion {fusion}: rrf, cc"}
    n = graph.nodes.count()
    top, default_mode, preview, expand = budget(budget_name, n, limit)
    switches = switches or (Switches() if budget_name == "thorough" else Switches.fast())
    kind = tx.classify(query) if route == "auto" else tx.Classified(ROUTE_NAMES[route], 1.0, [])
    vectors = vectors if switches.semantic else None
    inside = tx.relative_path(F.col("file_path"), root).startswith(scope)
    hint = "read_file" if kind.confidence >= 0.85 else "structural_query" if kind.confidence >= 0.6 else "explore"
    out = {"route": kind.route, "confidence": kind.confidence, "match_type": tx.ROUTES[kind.route], "action_hint": hint, "budget": budget_name}
    if (mode or default_mode) == "file":
        parts = tx.decompose(query) if switches.decompose else tx.passthrough(query)
        pool = multi_view(graph, query, top, switches, vectors, True) if budget_name == "auto" and n > 1000 else fanout(graph, parts, kind.route, top, switches, vectors, True)
        if expand and switches.expansion:
            pool = pool.unionByName(expand_with_source(graph, pool, top))
        if scope:
            keep = graph.by_name.filter(inside).select("qualified_name")
            pool = pool.join(keep, "qualified_name", "left_semi")
        results = [r.asDict(recursive=True) for r in score_files(graph, pool, parts, top, switches).collect()]
        if preview and lines is not None and results:
            _with_previews(graph, results, lines)
    else:
        # the limit comes before the scope here
        method, best = by_nodes(graph, query, kind, top, vectors, fusion)
        rows = best.join(graph.by_name, "qualified_name").filter(inside).orderBy(F.desc("score"), "qualified_name").collect()
        results = [r.asDict(recursive=True) for r in rows]
        out["method"] = method
    out = {"status": "ok" if results else "no_match"} | out | {"results": results}
    if not results:
        out["suggestion"] = "No results. Try a function or class name, a file path, or a structural query."
    return out


def _with_previews(graph: CodeGraph, results: list[dict], lines: Callable) -> None:
    """The first lines of each result's best node; as many files as there are results."""
    wanted = [(r["file_path"], r["top_nodes"][0]["line_start"]) for r in results if r["top_nodes"]]
    starts = graph.nodes.sparkSession.createDataFrame(wanted, "file_path string, start int")
    near = lines([p for p, _ in wanted]).join(F.broadcast(starts), "file_path").filter((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("start") + PREVIEW_LINES))
    by_file: dict[str, list] = {}
    for r in near.orderBy("file_path", "line_no").collect():
        by_file.setdefault(r.file_path, []).append(r.text)
    for r in results:
        r["preview"] = by_file.get(r["file_path"], [])


def expand_with_source(graph: CodeGraph, pool: DataFrame, limit: int) -> DataFrame:
    from grapheion.operators.algos import expand_one_hop

    return expand_one_hop(graph, pool.select("qualified_name", "score"), limit).withColumn("sources", F.array(F.lit("expansion")))


# embeddings ------------------------------------------------------------------
def embed(texts: DataFrame, stored: DataFrame | None, provider, name: str, batch: int = 100) -> DataFrame:
    """(key, text_hash, provider, vec) for (key, text): stored vectors are reused by hash, each new text is embedded once.

    ``provider``: list of texts -> list of vectors; it runs in batches on the workers. Vectors of another
    provider are not reused.
    """
    hashed = texts.withColumn("text_hash", F.substring(F.sha2("text", 256), 1, 16))
    old = stored.filter(F.col("provider") == name).groupBy("text_hash").agg(F.any_value("vec").alias("vec")) if stored is not None else None
    todo = hashed.groupBy("text_hash").agg(F.min("text").alias("text"))
    if old is not None:
        todo = todo.join(old, "text_hash", "left_anti")

    def run(frames):
        import pandas as pd

        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"text_hash": part["text_hash"], "vec": [list(map(float, v)) for v in provider(part["text"].tolist())]})

    new = todo.mapInPandas(run, "text_hash string, vec array<float>")
    vectors = new if old is None else new.unionByName(old.select("text_hash", F.col("vec").cast("array<float>")))
    return hashed.join(vectors, "text_hash").select("key", "text_hash", F.lit(name).alias("provider"), "vec")


def hash_provider(dims: int = 32):
    """A deterministic embedder without a model: signed counts of hashed words."""

    def embed_texts(texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().replace("_", " ").split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v[h % dims] += 1.0 if h >> 32 & 1 else -1.0
            out.append(v)
        return out

    return embed_texts


def half_precision(vec: Column) -> Column:
    """Components rounded to 11 significant bits, as a 16-bit store keeps them (normal range)."""
    from pyspark.sql.functions import transform

    def r(x: Column) -> Column:
        e = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - 10)
        return F.when(x == 0, x.cast("double")).otherwise(F.bround(x / e, 0) * e)

    return transform(vec, lambda x: r(x.cast("double")).cast("float"))


def live_only(embeddings: DataFrame, live: DataFrame) -> DataFrame:
    """Vectors whose key still exists."""
    return embeddings.join(live.select("key").distinct(), "key", "left_semi")


def upsert(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors in the place of stored ones of the same key and, where both have one, level: a file's path is its node's key too."""
    on = ["key", "level"] if {"level"} <= set(embeddings.columns) & set(new.columns) else ["key"]
    return embeddings.join(new.select(*on).distinct(), on, "left_anti").unionByName(new.select(*embeddings.columns))


def file_texts(nodes: DataFrame) -> DataFrame:
    """(key, text) of files: path, first language, up to fifty distinct names in order of lines."""
    names = F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "File", F.struct("line_start", "qualified_name", "name")))), lambda s: s["name"])), 1, 50)
    return nodes.groupBy("file_path").agg(F.min(F.when(F.col("language") != "", F.col("language"))).alias("language"), names.alias("names")).select(F.col("file_path").alias("key"), F.concat_ws(" ", "file_path", "language", F.array_join("names", " ")).alias("text"))
