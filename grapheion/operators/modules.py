"""Modules of import statements resolved to files of the graph.

A module is looked for, in this order, as a path from the importing file, as a dotted name (Python
files), and by the alias patterns of the nearest configuration above the file. Of the patterns
that lead to a file an exact one goes first, then the longest part before the star, then the
longest after it; of a pattern's targets and of the endings probed, the first. All of it is
equi-joins: prefixes of a module are cut only to lengths that patterns of its configuration
have, candidates meet files by path, and an aggregate picks the best. Imports are asked once a
(folder, module), however many files say them. Null paths and modules resolve to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapheion.operators.graph import CodeGraph

#: Endings probed for a path, and for a Python module.
PROBES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
PYTHON_PROBES = [".py", "/__init__.py"]
CONFIG_NAMES = ["tsconfig.json", "jsconfig.json"]
# End of fixed values.

_STRING = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
_CONFIG = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def folder_of(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def joined_path(folder: Column, path: Column) -> Column:
    """A relative path taken from a folder, without ``.`` and ``..``; those above the top stay and meet no file."""
    parts = F.split(F.concat_ws("/", folder, path), "/")
    top = F.array().cast("array<string>")
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(parts, top, step), "/")


def folders_above(path: Column) -> Column:
    """All folders that hold a path, the top (empty) included, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def plain_json(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    bare = F.regexp_replace(text, _STRING + r"|//[^\n]*|/\*[\s\S]*?\*/", "$1")
    return F.regexp_replace(bare, _STRING + r"|,(?=\s*[}\]])", "$1")


def alias_patterns(configs: DataFrame) -> DataFrame:
    """(config, folder, pattern, position, target) of configuration texts (file_path, text).

    ``paths`` and ``baseUrl`` are each taken from the first file of the ``extends`` chain that
    states them, relative to that file; without a base, targets start at the file of the paths.
    Chains end where a file is missing or was seen before. A text that is no JSON says nothing.
    """
    raw = configs.select(F.col("file_path").alias("config"), F.from_json(plain_json(F.col("text")), _CONFIG).alias("c")).filter("config is not null and c is not null")
    folder = folder_of(F.col("config"))
    parent = joined_path(folder, F.when(F.col("c.extends").endswith(".json"), F.col("c.extends")).otherwise(F.concat("c.extends", F.lit(".json"))))
    base = F.when(F.col("c.compilerOptions.baseUrl").isNotNull(), joined_path(folder, F.col("c.compilerOptions.baseUrl")))
    each = raw.select("config", folder.alias("own"), F.when(F.col("c.extends").startswith("."), parent).alias("parent"), base.alias("base"), F.col("c.compilerOptions.paths").alias("paths")).dropDuplicates(["config"]).cache()
    level = each.withColumns({"depth": F.lit(0), "seen": F.array("config")})
    chain, depth = level, 0
    said = each.select(F.col("config").alias("next"), F.col("own").alias("o"), F.col("parent").alias("p"), F.col("base").alias("b"), F.col("paths").alias("m"))
    while True:  # one round a step of the longest chain
        depth += 1
        up = level.filter("parent is not null and not array_contains(seen, parent)").join(said, F.col("parent") == F.col("next"))
        level = up.select("config", F.col("o").alias("own"), F.col("p").alias("parent"), F.col("b").alias("base"), F.col("m").alias("paths"), F.lit(depth).alias("depth"), F.concat("seen", F.array("next")).alias("seen"))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    first = lambda value: F.min(F.when(value.isNotNull(), F.col("depth")))
    at = chain.groupBy("config").agg(first(F.col("paths")).alias("paths_at"), first(F.col("base")).alias("base_at"))
    paths = at.join(chain, "config").filter("depth = paths_at").select("config", "own", F.map_entries("paths").alias("entries"))
    bases = at.join(chain, "config").filter("depth = base_at").select("config", "base")
    entry = paths.join(bases, "config", "left").select("config", F.coalesce("base", "own").alias("base"), F.explode("entries").alias("e"))
    targets = entry.select("config", "base", F.col("e.key").alias("pattern"), F.posexplode("e.value").alias("position", "t"))
    return targets.filter("t is not null").select("config", folder.alias("folder"), "pattern", "position", joined_path(F.col("base"), F.col("t")).alias("target"))


def _by_alias(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """Candidates of (folder, module) by the patterns of the nearest configuration above the folder."""
    head, star = F.substring_index("pattern", "*", 1), F.col("pattern").contains("*")
    tail = F.when(star, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise("")
    table = patterns.select(F.col("folder").alias("at"), "pattern", "position", "target", head.alias("head"), tail.alias("tail"), star.alias("star"))
    lengths = table.groupBy("at").agg(F.collect_set(F.length("head")).alias("lengths"))
    above = asked.select("folder").distinct().select("folder", F.explode(folders_above(F.concat("folder", F.lit("/")))).alias("at"))
    nearest = above.filter("folder <> '' or at = ''").join(lengths, "at").groupBy("folder").agg(F.max_by(F.struct("at", "lengths"), F.length("at")).alias("n")).select("folder", "n.*")
    cut = asked.join(nearest, "folder").withColumn("size", F.explode("lengths")).filter("size <= length(module)")
    met = cut.withColumn("head", F.expr("substring(module, 1, size)")).join(table, ["at", "head"])
    room = F.length("module") - F.length("head") - F.length("tail")
    fits = F.when(F.col("star"), (room >= 0) & F.col("module").endswith(F.col("tail"))).otherwise(F.col("module") == F.col("pattern"))
    middle = F.substring("module", F.length("head") + 1, room)
    path = F.when(F.col("star"), F.expr("concat(substring_index(target, '*', 1), '\\0', if(contains(target, '*'), substring(target, instr(target, '*') + 1), ''))")).otherwise(F.col("target"))
    mapped = F.when(F.col("star") & F.col("target").contains("*"), F.replace(path, F.lit("\0"), middle)).otherwise(F.col("target"))
    rank = F.struct(F.lit(2).alias("kind"), F.when(F.col("star"), -F.length("head")).otherwise(-(1 << 30)).alias("a"), (-F.length("tail")).alias("b"), F.col("pattern").alias("c"), F.col("position").alias("d"))
    return met.filter(fits).select("folder", "module", "python", joined_path(F.lit(""), mapped).alias("path"), rank.alias("rank"))


def resolve(imports: DataFrame, files: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(file_path, module, target): the file of ``files`` (file_path) each import means; those that mean none are left out."""
    said = imports.select("file_path", "module").filter("file_path is not null and module is not null").distinct().withColumns({"folder": folder_of(F.col("file_path")), "python": F.col("file_path").endswith(".py")})
    asked = said.select("folder", "module", "python").distinct()
    rank = lambda kind, a: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c"), F.lit(0).alias("d"))
    near = asked.filter(r"not python and module rlike '^\\.\\.?(/|$)'").select("folder", "module", "python", joined_path(F.col("folder"), F.col("module")).alias("path"), rank(0, F.lit(0)).alias("rank"))
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    names = F.replace(F.expr("substring(module, length(regexp_extract(module, '^(\\\\.*)', 1)) + 1)"), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", F.array_repeat(F.lit(".."), dots - 1), F.when(names != "", names))
    dotted = asked.filter("python").withColumns({"dots": dots, "names": names, "up": up})
    own = dotted.filter("dots > 0").select("folder", "module", "python", joined_path(F.col("folder"), F.col("up")).alias("path"), rank(1, F.lit(0)).alias("rank"))
    far = dotted.filter("dots = 0").withColumn("root", F.explode(folders_above(F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit("x")))))
    far = far.select("folder", "module", "python", joined_path(F.col("root"), F.col("names")).alias("path"), rank(1, -F.length("root")).alias("rank"))
    found = near.unionByName(own).unionByName(far)
    if patterns is not None:
        found = found.unionByName(_by_alias(asked.filter("not python"), patterns))
    probes = lambda endings: F.array(*map(F.lit, endings))
    probed = found.select("folder", "module", "python", "path", "rank", F.posexplode(F.when(F.col("python"), probes(PYTHON_PROBES)).otherwise(probes(PROBES))).alias("probe", "ending"))
    probed = probed.select("folder", "module", "python", F.ltrim(F.concat("path", "ending"), F.lit("/")).alias("target"), "rank", "probe")
    best = probed.join(files.select(F.col("file_path").alias("target")).distinct(), "target").groupBy("folder", "module", "python").agg(F.min_by("target", F.struct("rank", "probe")).alias("target"))
    return said.join(best, ["folder", "module", "python"]).select("file_path", "module", "target")


def linked(graph: CodeGraph, patterns: DataFrame | None = None) -> CodeGraph:
    """The graph with IMPORTS_FROM edges that reach files; others keep their module. Made on reading, so nothing stored needs repair."""
    imports = graph.edges_raw.filter("kind = 'IMPORTS_FROM'")
    files = graph.nodes.filter("kind = 'File'").select("file_path")
    meant = resolve(imports.select("file_path", F.col("target_qualified").alias("module")), files, patterns).select("file_path", F.col("module").alias("target_qualified"), "target")
    reached = imports.join(meant, ["file_path", "target_qualified"], "left").withColumn("target_qualified", F.coalesce("target", "target_qualified"))
    rest = graph.edges_raw.filter("kind <> 'IMPORTS_FROM' or kind is null")
    return CodeGraph(graph.nodes, rest.unionByName(reached.select(*graph.edges_raw.columns)))
