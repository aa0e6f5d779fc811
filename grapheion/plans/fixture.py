"""A deterministic code graph over the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, CodeGraph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _qualified(file: str, name: str):
    return F.concat(F.col(file), F.lit("::"), F.col(name))


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """nation -> File, supplier -> Class, customer -> Function, part -> Type, every tenth order -> Test."""
    t = {n: read(spark, sf_dir, n) for n in TABLES[:7]}
    language = F.element_at(F.array(*map(F.lit, ("python", "typescript", "go", "rust", "java"))), F.least(F.col("n_regionkey"), F.lit(4)) + 1)
    folder = F.when(F.col("n_nationkey") % 8 == 7, "compiled/").otherwise("src/")
    files = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nk"),
        F.concat(folder, F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.lower("n_name"), F.lit(".py")).alias("fp"),
        F.concat(F.lit("tests/test_"), F.lower("n_name"), F.lit(".py")).alias("tfp"),
        language.alias("lang"),
    )
    fn = t["customer"].join(files, F.col("c_nationkey") == F.col("nk")).select(F.col("c_custkey").alias("k"), "fp", "tfp", "lang", F.concat(F.lit("fn_"), F.lower("c_mktsegment"), F.lit("_"), "c_custkey").alias("nm"))
    # customers and parts grow with the tables: their files look smaller than their names are, so they are not to be broadcast
    fn = fn.hint("merge")
    cl = t["supplier"].join(files, F.col("s_nationkey") == F.col("nk")).select(F.col("s_suppkey").alias("k"), "fp", "lang", F.concat(F.lit("Supplier"), "s_suppkey").alias("nm"))
    ty = t["part"].join(files, F.col("p_partkey") % 25 == F.col("nk")).select(F.col("p_partkey").alias("k"), "fp", "lang", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_partkey").alias("nm")).hint("merge")
    te = t["orders"].filter("o_orderkey % 10 = 0").join(fn, F.col("o_custkey") == F.col("k")).select(F.col("o_orderkey").alias("tk"), F.col("k").alias("ck"), F.col("tfp").alias("fp"), "lang", F.concat(F.lit("test_order_"), "o_orderkey").alias("nm"))

    def nodes_of(df: DataFrame, kind: str, start, end, test: bool = False) -> DataFrame:
        qn = F.col("fp") if kind == "File" else _qualified("fp", "nm")
        name = F.col("fp") if kind == "File" else F.col("nm")
        empty = F.lit("")
        return df.select(F.xxhash64(qn).alias("node_id"), name.alias("name"), qn.alias("qualified_name"), F.lit(kind).alias("kind"), F.col("fp").alias("file_path"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), F.col("lang").alias("language"), F.lit(test).alias("is_test"), empty.alias("docstring"), empty.alias("signature"), F.concat(F.lit("hash_"), name).alias("body_hash"), empty.alias("file_hash"))

    line = F.lit(1) + F.col("k") % 300
    parts = [
        nodes_of(files, "File", F.lit(1), F.lit(420)),
        nodes_of(files.select(F.col("tfp").alias("fp"), "lang"), "File", F.lit(1), F.lit(420), True),
        nodes_of(fn, "Function", line, line + F.col("k") * 7 % 120),
        nodes_of(cl, "Class", F.lit(1), F.lit(60)),
        nodes_of(ty, "Type", F.lit(5), F.lit(9)),
        nodes_of(te, "Test", F.lit(1), F.lit(8), True),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)

    def edge(df: DataFrame, src, dst, kind) -> DataFrame:
        return df.select(src.alias("source_qualified"), dst.alias("target_qualified"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))

    # names meet the orders, which are fewer than their lines
    asked = t["orders"].join(fn.select(F.col("k").alias("o_custkey"), F.col("fp").alias("ffp"), F.col("nm").alias("fnm")), "o_custkey")
    calls = t["lineitem"].join(asked.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).join(cl.select(F.col("k").alias("l_suppkey"), F.col("fp").alias("cfp"), F.col("nm").alias("cnm")), "l_suppkey")
    total = t["customer"].agg((F.count("*") + 10).alias("total"))
    chain = fn.join(F.broadcast(total)).withColumn("to", (F.col("k") * 7 + 3) % F.col("total"))
    chain = chain.join(fn.select(F.col("k").alias("to"), F.col("fp").alias("tofp"), F.col("nm").alias("tonm")), "to", "left")
    heirs = t["lineitem"].filter("l_linenumber in (1, 2)").join(ty.select(F.col("k").alias("l_partkey"), F.col("fp").alias("yfp"), F.col("nm").alias("ynm")), "l_partkey").join(cl.select(F.col("k").alias("l_suppkey"), F.col("fp").alias("cfp"), F.col("nm").alias("cnm")), "l_suppkey")
    tested = te.join(fn.select(F.col("k").alias("ck"), F.col("fp").alias("pfp"), F.col("nm").alias("pnm")), "ck")
    edges = [
        edge(nodes.filter("kind <> 'File'"), F.col("file_path"), F.col("qualified_name"), "CONTAINS"),
        edge(calls, _qualified("ffp", "fnm"), _qualified("cfp", "cnm"), "CALLS"),
        edge(chain, _qualified("fp", "nm"), F.coalesce(_qualified("tofp", "tonm"), F.concat(F.lit("missing::fn_"), "k")), "CALLS"),
        edge(calls.filter("ffp <> cfp"), F.col("ffp"), F.col("cfp"), "IMPORTS_FROM").distinct(),
        edge(heirs, _qualified("yfp", "ynm"), _qualified("cfp", "cnm"), F.when(F.col("l_linenumber") == 1, "INHERITS").otherwise("IMPLEMENTS")).distinct(),
        edge(tested, _qualified("pfp", "pnm"), _qualified("fp", "nm"), "TESTED_BY"),
    ]
    raw = edges[0]
    for e in edges[1:]:
        raw = raw.unionByName(e)
    raw = raw.withColumn("file_path", F.split_part("source_qualified", F.lit("::"), F.lit(1))).withColumn("line", F.lit(0))
    # nothing is kept: a kept table has all kinds and columns, a plan of its own only those that a query asks for
    return CodeGraph(nodes.select(*NODE_SCHEMA.names), raw.select(*EDGE_SCHEMA.names))


#: The same graph for DuckDB: CTEs that end in nodes, edges_raw and (resolved) e.
SQL = """WITH RECURSIVE f AS (
  SELECT n_nationkey AS nk,
         concat(CASE WHEN n_nationkey % 8 = 7 THEN 'compiled/' ELSE 'src/' END,
                lower(replace(r_name, ' ', '_')), '/', lower(n_name), '.py') AS fp,
         concat('tests/test_', lower(n_name), '.py') AS tfp,
         CASE n_regionkey WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'go'
                          WHEN 3 THEN 'rust' ELSE 'java' END AS lang
  FROM nation JOIN region ON n_regionkey = r_regionkey),
fn AS (
  SELECT c_custkey AS k, fp, lang, concat('fn_', lower(c_mktsegment), '_', c_custkey) AS nm,
         CAST(1 + c_custkey % 300 AS INT) AS ls, CAST(1 + c_custkey % 300 + c_custkey * 7 % 120 AS INT) AS le
  FROM customer JOIN f ON c_nationkey = nk),
cl AS (
  SELECT s_suppkey AS k, fp, lang, concat('Supplier', s_suppkey) AS nm
  FROM supplier JOIN f ON s_nationkey = nk),
ty AS (
  SELECT p_partkey AS k, fp, lang, concat(replace(p_name, ' ', '_'), '_', p_partkey) AS nm
  FROM part JOIN f ON p_partkey % 25 = nk),
te AS (
  SELECT o_orderkey AS k, o_custkey AS ck, tfp AS fp, f.lang, concat('test_order_', o_orderkey) AS nm
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN f ON c_nationkey = nk WHERE o_orderkey % 10 = 0),
nodes AS (
  SELECT 'File' AS kind, fp AS name, fp AS qualified_name, fp AS file_path, 1 AS line_start, 420 AS line_end, lang AS language, false AS is_test FROM f
  UNION ALL SELECT 'File', tfp, tfp, tfp, 1, 420, lang, true FROM f
  UNION ALL SELECT 'Function', nm, concat(fp, '::', nm), fp, ls, le, lang, false FROM fn
  UNION ALL SELECT 'Class', nm, concat(fp, '::', nm), fp, 1, 60, lang, false FROM cl
  UNION ALL SELECT 'Type', nm, concat(fp, '::', nm), fp, 5, 9, lang, false FROM ty
  UNION ALL SELECT 'Test', nm, concat(fp, '::', nm), fp, 1, 8, lang, true FROM te),
edges_raw AS (
  SELECT file_path AS source_qualified, qualified_name AS target_qualified, 'CONTAINS' AS kind FROM nodes WHERE kind <> 'File'
  UNION ALL
  SELECT concat(fn.fp, '::', fn.nm), concat(cl.fp, '::', cl.nm), 'CALLS'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN fn ON o_custkey = fn.k JOIN cl ON l_suppkey = cl.k
  UNION ALL
  SELECT concat(a.fp, '::', a.nm), coalesce(concat(b.fp, '::', b.nm), concat('missing::fn_', a.k)), 'CALLS'
  FROM (SELECT fn.*, (fn.k * 7 + 3) % (SELECT count(*) + 10 FROM customer) AS tk FROM fn) a LEFT JOIN fn b ON a.tk = b.k
  UNION ALL
  SELECT DISTINCT fn.fp, cl.fp, 'IMPORTS_FROM'
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN fn ON o_custkey = fn.k JOIN cl ON l_suppkey = cl.k WHERE fn.fp <> cl.fp
  UNION ALL
  SELECT DISTINCT concat(ty.fp, '::', ty.nm), concat(cl.fp, '::', cl.nm), CASE l_linenumber WHEN 1 THEN 'INHERITS' ELSE 'IMPLEMENTS' END
  FROM lineitem JOIN ty ON l_partkey = ty.k JOIN cl ON l_suppkey = cl.k WHERE l_linenumber IN (1, 2)
  UNION ALL
  SELECT concat(fn.fp, '::', fn.nm), concat(te.fp, '::', te.nm), 'TESTED_BY' FROM te JOIN fn ON te.ck = fn.k),
e AS MATERIALIZED (
  SELECT r.source_qualified AS src, r.target_qualified AS dst, r.kind AS kind, s.file_path AS src_file, d.file_path AS dst_file
  FROM edges_raw r JOIN nodes s ON r.source_qualified = s.qualified_name JOIN nodes d ON r.target_qualified = d.qualified_name),
t AS (
  SELECT min(CASE WHEN kind = 'Function' THEN qualified_name END) AS fn, min(CASE WHEN kind = 'Class' THEN qualified_name END) AS cl,
         min(CASE WHEN kind = 'File' AND NOT is_test THEN qualified_name END) AS fl FROM nodes)
"""
