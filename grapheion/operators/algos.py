"""Iterative graph algorithms: impact by personalised PageRank, shortest call paths, weighted reach, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from grapheion.operators.graph import CodeGraph, ranked, weight
from grapheion.operators.lineage import by_key, cut

ALPHA, EPSILON, ROUNDS = 0.85, 1e-6, 20
DECAY, FLOOR = 0.7, 0.01
CUT_EVERY = 5


def pair_weights(graph: CodeGraph, compat: bool = False) -> DataFrame:
    """(src, dst, share): what a point of score at dst passes to src; made once for all rounds.

    Parallel edges add up; with ``compat`` m of them count m times their sum.
    """
    # edges come by target from their resolution, so neither the sums nor the totals move them again
    pairs = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("m"), F.sum(weight(F.col("kind"))).alias("sw"))
    indeg = F.sum("sw").over(Window.partitionBy("dst"))
    times = F.col("m") if compat else F.lit(1)
    return pairs.select("src", "dst", (times * F.col("sw") / indeg).alias("share"))


def pagerank(graph: CodeGraph, seeds: DataFrame, rounds: int = ROUNDS, compat: bool = False) -> DataFrame:
    """(qualified_name, score) with score above EPSILON; only the frontier takes part in a round.

    From round CUT_EVERY on each round is written and ends the walk if no score moved by EPSILON.
    """
    seeds = seeds.select("qualified_name").distinct().cache()
    n = max(1, seeds.count())
    share = by_key(pair_weights(graph, compat), "dst").cache()
    known = graph.by_name.select("qualified_name").join(seeds, "qualified_name", "left_semi")
    base = known.select("qualified_name", F.lit((1 - ALPHA) / n).alias("score")).cache()
    score = known.select("qualified_name", F.lit(1.0 / n).alias("score"))
    for k in range(rounds):
        moved = share.join(score.withColumnRenamed("qualified_name", "dst"), "dst").groupBy(F.col("src").alias("qualified_name")).agg((ALPHA * F.sum(F.col("score") * F.col("share"))).alias("score"))
        if k + 1 < CUT_EVERY or k + 1 == rounds:
            score = moved.unionByName(base).groupBy("qualified_name").agg(F.sum("score").alias("score")).filter(F.col("score") > EPSILON)
            # the checked rounds read their score twice
            score = cut(score) if k + 2 == CUT_EVERY and k + 1 < rounds else score
            continue
        parts = moved.unionByName(base).withColumn("old", F.lit(0.0)).unionByName(score.select("qualified_name", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        new = parts.groupBy("qualified_name").agg(F.sum("score").alias("score"), F.sum("old").alias("old"))
        new = new.withColumn("score", F.when(F.col("score") > EPSILON, F.col("score")).otherwise(0.0))
        # how far scores moved is observed while the round is written
        seen = Observation()
        score = cut(new.observe(seen, F.max(F.abs(F.col("score") - F.col("old"))).alias("gap")).filter("score > 0").drop("old"))
        gap = seen.get["gap"]
        if gap is None or gap < EPSILON:
            break
    score = cut(score)
    for kept in (seeds, share, base):
        kept.unpersist()
    return score


def impact(graph: CodeGraph, seeds: DataFrame, max_nodes: int = 500, rounds: int = ROUNDS, compat: bool = False) -> DataFrame:
    """The ``max_nodes`` nodes most affected by a change of ``seeds``, without the seeds."""
    found = pagerank(graph, seeds, rounds, compat).join(seeds.select("qualified_name").distinct(), "qualified_name", "left_anti")
    return ranked(found, F.desc(F.round("score", 12)), limit=max_nodes)


def file_seeds(graph: CodeGraph, files: DataFrame) -> DataFrame:
    return graph.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name").distinct()


def impact_radius(graph: CodeGraph, files: DataFrame, max_nodes: int = 500, rounds: int = ROUNDS, seeds: DataFrame | None = None) -> dict[str, DataFrame]:
    """changed, impacted (with score), files and edges among both, for changed files or given nodes."""
    seeds = seeds if seeds is not None else file_seeds(graph, files)
    # lineage of the ranking ends here: the frames below all start from at most max_nodes rows
    top = cut(impact(graph, seeds, max_nodes, rounds))
    impacted = graph.by_name.join(top, "qualified_name")
    both = seeds.select("qualified_name").unionByName(top.select("qualified_name"))
    return {"changed": graph.by_name.join(seeds.select("qualified_name").distinct(), "qualified_name", "left_semi"), "impacted": impacted, "files": impacted.select("file_path").distinct(), "edges": graph.among(both)}


def call_distances(graph: CodeGraph, start: str, max_depth: int = 10, backwards: bool = False) -> DataFrame:
    """(qualified_name, hops, parent): breadth-first over CALLS, parent the least name of the level before."""
    near, far = ("dst", "src") if backwards else ("src", "dst")
    calls = graph.edges.filter(F.col("kind") == "CALLS").select(F.col(near).alias("parent"), F.col(far).alias("qualified_name"))
    calls = by_key(calls.distinct(), "parent").cache()
    seen = cut(graph.node(start).select("qualified_name", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("parent")))
    front = seen
    for depth in range(1, max_depth + 1):
        step = calls.join(front.select(F.col("qualified_name").alias("parent")), "parent").groupBy("qualified_name").agg(F.min("parent").alias("parent"))
        front = cut(step.join(seen, "qualified_name", "left_anti").select("qualified_name", F.lit(depth).alias("hops"), "parent"))
        if front.limit(1).count() == 0:
            break
        seen = cut(seen.unionByName(front)) if depth % CUT_EVERY == 0 else seen.unionByName(front)
    calls.unpersist()  # seen is made of checkpoints
    return seen


def call_chain(graph: CodeGraph, start: str, end: str, max_depth: int = 10) -> list[str]:
    """Names on a shortest call path, outgoing calls first, else incoming; empty if there is none."""
    for backwards in (False, True):
        reach = call_distances(graph, start, max_depth, backwards).cache()
        path, at = [], reach.filter(F.col("qualified_name") == end).first()
        while at is not None:  # as many look-ups as the path is long, at most max_depth
            path.append(at.qualified_name)
            at = reach.filter(F.col("qualified_name") == at.parent).first() if at.parent else None
        reach.unpersist()
        if path:
            return path[::-1]
    return []


def call_paths(graph: CodeGraph, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """(pair_id, path) of all (pair_id, source, target) with a shortest call path, outgoing calls first, else incoming.

    The paths are those of ``call_chain``. Pairs are searched together, from both ends in turn, with
    frontiers keyed by (pair, name); a pair that has met leaves the search. Nodes reached from the
    source carry their path. From the nodes where both ends meet the path is carried on through the
    layers around the target. The driver sees counts only.
    """
    pairs = cut(pairs.select("pair_id", "source", "target").distinct())
    edges = graph.edges.filter("kind = 'CALLS'")
    out = None
    for near, far in (("src", "dst"), ("dst", "src")):
        calls = edges.select(F.col(near).alias("node"), F.col(far).alias("next")).distinct()
        found = _paths(calls, pairs, max_depth)
        out = found if out is None else out.unionByName(found)
        pairs = cut(pairs.join(found.select("pair_id"), "pair_id", "left_anti"))
        if pairs.limit(1).count() == 0:
            break
    return out


def _carried(rows: DataFrame) -> DataFrame:
    """(pair_id, node, path) from (pair_id, next, node, path): by the least node before."""
    best = rows.groupBy("pair_id", "next").agg(F.min(F.struct("node", "path")).alias("b"))
    return best.select("pair_id", F.col("next").alias("node"), F.concat("b.path", F.array("next")).alias("path"))


def _paths(calls: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    # kept in the cache, which knows how they are dealt: a checkpoint would move all calls again at each step
    calls = by_key(calls, "node").cache()
    back = by_key(calls.select(F.col("next").alias("node"), F.col("node").alias("next")), "node").cache()
    front = seen = cut(pairs.select("pair_id", F.col("source").alias("node"), F.array("source").alias("path")))
    layers = [cut(pairs.select("pair_id", F.col("target").alias("node")))]
    known, still, met = layers[0], pairs.select("pair_id"), None
    for depth in range(max_depth + 1):
        if depth % 2:  # one step from the sources
            step = _carried(front.join(still, "pair_id", "left_semi").join(calls, "node"))
            front = cut(step.join(seen, ["pair_id", "node"], "left_anti").select("pair_id", "node", "path"))
            seen = seen.unionByName(front)
        elif depth:  # one from the targets
            step = layers[-1].join(still, "pair_id", "left_semi").join(back, "node").select("pair_id", F.col("next").alias("node")).distinct()
            layers.append(cut(step.join(known, ["pair_id", "node"], "left_anti").select("pair_id", "node")))
            known = known.unionByName(layers[-1])
        here = front.join(still, "pair_id", "left_semi").join(layers[-1], ["pair_id", "node"], "left_semi").withColumn("left", F.lit(len(layers) - 1))
        here = cut(here.select("pair_id", "node", "path", "left"))
        met = here if met is None else met.unionByName(here)
        still = cut(still.join(here, "pair_id", "left_anti"))
        # a side that is nowhere any more, or no pair left
        if still.join(front, "pair_id", "left_semi").join(layers[-1], "pair_id", "left_semi").limit(1).count() == 0:
            break
    for left in range(len(layers) - 1, 0, -1):
        rest, on = met.filter(F.col("left") < left), met.filter(F.col("left") == left)
        on = _carried(on.select("pair_id", "node", "path").join(calls, "node").join(layers[left - 1].select("pair_id", F.col("node").alias("next")), ["pair_id", "next"], "left_semi"))
        met = cut(rest.unionByName(on.withColumn("left", F.lit(left - 1))))
    for kept in (calls, back):
        kept.unpersist()  # met is a checkpoint
    return met.select("pair_id", "path")


def path_steps(graph: CodeGraph, path: list[str]) -> DataFrame:
    """The path as rows: step, caller, callee, files."""
    spark = graph.nodes.sparkSession
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "step int, src string, dst string")
    files = graph.by_name.select("qualified_name", "file_path")
    return steps.join(files.toDF("src", "src_file"), "src", "left").join(files.toDF("dst", "dst_file"), "dst", "left").select("step", "src", "dst", "src_file", "dst_file")


def trace(graph: CodeGraph, start: str, end: str, max_depth: int = 10) -> dict:
    names = []
    for target in (start, end):
        status, found = graph.resolve_target(target)
        if status != "found":
            return {"status": "error" if status == "not_found" else status, "target": target, "candidates": [r.qualified_name for r in found.limit(5).collect()]}
        names.append(found.first().qualified_name)
    path = call_chain(graph, *names, max_depth)
    return {"status": "ok" if path else "no_path", "path": path, "hops": max(0, len(path) - 1)}


def weighted_reach(graph: CodeGraph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """(qualified_name, score): best product of weight * DECAY along dependants and tests, seeds excluded."""
    way = lambda at, to: F.struct(F.col(at).alias("at"), F.col(to).alias("qualified_name"))
    ways = F.when(F.col("kind") == "TESTED_BY", F.array(way("dst", "src"), way("src", "dst"))).otherwise(F.array(way("dst", "src")))
    both = graph.edges.select(F.explode(ways).alias("x"), (weight(F.col("kind")) * DECAY).alias("w")).select("x.*", "w")
    steps = by_key(both, "at").groupBy("at", "qualified_name").agg(F.max("w").alias("w")).cache()
    best = seeds.select("qualified_name").distinct().select("qualified_name", F.lit(1.0).alias("score"))
    front = best
    for _ in range(max_depth):
        found = steps.join(front.withColumnRenamed("qualified_name", "at"), "at").select("qualified_name", (F.col("score") * F.col("w")).alias("score")).filter(F.col("score") >= FLOOR)
        merged = best.withColumn("old", F.col("score")).unionByName(found.withColumn("old", F.lit(None).cast("double"))).groupBy("qualified_name").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        merged = cut(merged)
        best = merged.select("qualified_name", "score")
        front = merged.filter(F.col("old").isNull() | (F.col("score") > F.col("old"))).select("qualified_name", "score")
    steps.unpersist()  # best is a checkpoint
    return best.join(seeds.select("qualified_name").distinct(), "qualified_name", "left_anti")


def expand_one_hop(graph: CodeGraph, candidates: DataFrame, limit: int) -> DataFrame:
    """New candidates next to the best fifth (five at least): callees, contained nodes, callers at 0.3 of the parent.

    ``candidates``: (qualified_name, score). At most 2 * limit are added, best parents first.
    """
    candidates = cut(candidates.select("qualified_name", "score"))
    n = candidates.count()
    seeds = cut(ranked(candidates, F.desc("score"), limit=min(n, max(-(-n // 5), 5))))

    def at_seeds(kinds: list[str], near: str, far: str) -> DataFrame:
        """Edges at the seeds: a semi join, which Spark makes before names are resolved."""
        some = graph.edges.filter(F.col("kind").isin(kinds)).join(seeds.select(F.col("qualified_name").alias(near)), near, "left_semi")
        return some.select(F.col(near).alias("seed"), F.col(far).alias("qualified_name"))

    near = at_seeds(["CALLS", "CONTAINS"], "src", "dst").unionByName(at_seeds(["CALLS"], "dst", "src")).join(seeds.select(F.col("qualified_name").alias("seed"), F.col("score").alias("parent")), "seed")
    new = near.join(candidates.select("qualified_name"), "qualified_name", "left_anti").groupBy("qualified_name").agg((0.3 * F.max("parent")).alias("score"))
    return ranked(new, F.desc("score"), limit=2 * limit)
