"""Fact tables of source files made of the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.operators.resolution import FileFacts
from grapheion.plans.fixture import read

TABLES = ["nation", "customer", "supplier", "part", "orders", "lineitem"]

_FILES = "nf AS (SELECT n_nationkey AS nk, concat('src/', lower(n_name), '.py') AS fp, concat('tests/test_', lower(n_name), '.py') AS tfp FROM nation)"

#: customer -> functions and, every fifth, helpers of the test file; supplier -> classes; part -> types; every tenth order -> tests.
_DEFINITIONS = """
SELECT fp AS file_path, 'python' AS language, c_custkey * 4 AS ordinal, 'Function' AS kind, concat('fn_', lower(c_mktsegment), '_', c_custkey % 40) AS name,
       CASE WHEN c_custkey % 3 = 0 THEN concat('Supplier', c_custkey % 10) ELSE '' END AS owner, CAST(1 + c_custkey % 300 AS INT) AS line_start,
       CAST(1 + c_custkey % 300 + c_custkey * 7 % 120 AS INT) AS line_end, false AS is_test, '()' AS signature, CAST(NULL AS {text}) AS base
FROM customer JOIN nf ON c_nationkey = nk
UNION ALL SELECT tfp, 'python', c_custkey * 4, 'Function', concat('fn_', lower(c_mktsegment), '_', c_custkey % 40), '', CAST(1 + c_custkey % 90 AS INT),
       CAST(3 + c_custkey % 90 AS INT), false, '()', CAST(NULL AS {text}) FROM customer JOIN nf ON c_nationkey = nk WHERE c_custkey % 5 = 0
UNION ALL SELECT fp, 'python', s_suppkey * 4 + 1, 'Class', concat('Supplier', s_suppkey % 10), '', 1, 60, false, '', concat('lib.Part', s_suppkey % 60)
FROM supplier JOIN nf ON s_nationkey = nk
UNION ALL SELECT fp, 'python', p_partkey * 4 + 2, 'Type', concat('Part', p_partkey % 30), '', 5, 9, false, '', concat('Supplier', p_partkey % 10)
FROM part JOIN nf ON p_partkey % 25 = nk
UNION ALL SELECT tfp, CASE WHEN o_orderkey % 70 = 0 THEN 'go' ELSE 'python' END, o_orderkey * 4 + 3, 'Test',
       CASE WHEN o_orderkey % 3 = 0 THEN concat('test_order_', o_orderkey % 500) ELSE concat('test_FN_', lower(c_mktsegment), '_', c_custkey % 40, CASE WHEN o_orderkey % 3 = 1 THEN '_spec' ELSE '' END) END,
       '', CAST(1 + o_orderkey % 400 AS INT), CAST(1 + o_orderkey % 400 + o_orderkey % 60 AS INT), true,
       concat('(self, fn_', lower(c_mktsegment), '_', o_orderkey % 40, ': int, b=(1, other)) -> x(a, fn_building_0)'), CAST(NULL AS {text})
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nf ON c_nationkey = nk WHERE o_orderkey % 10 = 0"""

_IMPORTS = """
SELECT fp AS file_path, s_suppkey AS ordinal, concat('pkg', s_suppkey % 9) AS module, concat('brought_', s_suppkey % 20) AS name, CAST(1 + s_suppkey % 50 AS INT) AS line
FROM supplier JOIN nf ON s_nationkey = nk
UNION ALL SELECT tfp, s_suppkey, concat('pkg', s_suppkey % 7), concat('brought_', s_suppkey % 20), CAST(1 + s_suppkey % 50 AS INT) FROM supplier JOIN nf ON s_nationkey = nk"""

#: Every line of an order is a call, in the file of its customer's nation or in its test file.
_CALLS = """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN fp ELSE tfp END AS file_path, l_orderkey * 8 + l_linenumber AS ordinal,
       CASE l_partkey % 4 WHEN 0 THEN concat('fn_', lower(c_mktsegment), '_', l_suppkey % 60) WHEN 1 THEN concat('Supplier', l_suppkey % 12)
                          WHEN 2 THEN concat('brought_', l_suppkey % 20) ELSE concat('far_', l_partkey % 7) END AS name, CAST(1 + l_orderkey % 450 AS INT) AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nf ON c_nationkey = nk"""


def facts(spark: SparkSession, sf_dir: str) -> FileFacts:
    # customers grow with the tables and are not to be broadcast, however small their file looks; nations are few
    tables = {t: read(spark, sf_dir, t) for t in TABLES}
    tables |= {"customer": tables["customer"].hint("merge"), "nation": F.broadcast(tables["nation"])}

    def made(sql: str) -> DataFrame:
        text = f"WITH {_FILES} {sql.replace('{text}', 'STRING')}"
        for t in TABLES:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})

    definitions = made(_DEFINITIONS).withColumn("bases", F.when(F.col("base").isNotNull(), F.array("base")))
    return FileFacts(definitions, made(_IMPORTS).withColumn("names", F.array("name")), made(_CALLS))


#: The facts and what each rule makes of them, for DuckDB.
SQL = f"""WITH {_FILES},
d AS (SELECT *, concat(file_path, '::', CASE WHEN owner <> '' AND kind IN ('Function', 'Test', 'Type') THEN concat(owner, '.') ELSE '' END, name) AS qn FROM ({_DEFINITIONS.replace("{text}", "VARCHAR")})),
i AS ({_IMPORTS}),
c AS ({_CALLS}),
sym AS (SELECT file_path, name, arg_min(qn, ordinal) AS q FROM d GROUP BY ALL),
br AS (SELECT file_path, name, arg_max(module, ordinal) AS module FROM i GROUP BY ALL),
enc AS (SELECT file_path, line, q FROM (
  SELECT a.file_path, a.line, d.qn AS q, row_number() OVER (PARTITION BY a.file_path, a.line ORDER BY d.line_end - d.line_start, d.qn) AS r
  FROM (SELECT DISTINCT file_path, line FROM c) a JOIN d ON d.file_path = a.file_path AND a.line BETWEEN d.line_start AND d.line_end
  WHERE d.kind IN ('Function', 'Test')) WHERE r = 1),
ce AS MATERIALIZED (SELECT * FROM (
  SELECT coalesce(enc.q, c.file_path) AS src, coalesce(sym.q, concat_ws('::', br.module, c.name)) AS dst, c.file_path, c.line, c.ordinal
  FROM c LEFT JOIN enc ON enc.file_path = c.file_path AND enc.line = c.line LEFT JOIN sym ON sym.file_path = c.file_path AND sym.name = c.name
  LEFT JOIN br ON br.file_path = c.file_path AND br.name = c.name) WHERE src <> dst),
t AS (SELECT file_path, qn, arg_max(name, ordinal) AS name, arg_max(signature, ordinal) AS signature, arg_max(language, ordinal) AS language, arg_max(line_start, ordinal) AS line
      FROM d WHERE kind = 'Test' GROUP BY ALL),
fx AS MATERIALIZED (
  SELECT p.qn AS src, f.q AS dst, p.file_path, p.line
  FROM (SELECT *, unnest(regexp_extract_all(split_part(signature, '->', 1), '[(,]\\s*(\\w+)', 1)) AS name FROM (SELECT file_path, qn, signature, line FROM t WHERE language = 'python')) p
  JOIN (SELECT file_path, name, arg_max(qn, ordinal) AS q FROM d WHERE kind = 'Function' GROUP BY ALL) f ON f.file_path = p.file_path AND f.name = p.name),
tc AS (SELECT file_path, dst AS target, src AS test, 0 AS phase, ordinal, line FROM ce UNION ALL SELECT file_path, dst, src, 1, 0, line FROM fx),
tn AS (
  SELECT t.file_path, n.q AS target, t.qn AS test, 2 AS phase, 0 AS ordinal, t.line
  FROM t JOIN (SELECT file_path, lower(name) AS short, arg_max(qn, ordinal) AS q FROM d WHERE NOT is_test GROUP BY ALL) n
  ON n.file_path = t.file_path AND n.short = lower(regexp_replace(regexp_replace(t.name, '^(?:test_|Test|test)', ''), '(?:_test|_spec|Test|Spec)$', ''))),
tb AS (
  SELECT file_path, target, test, arg_min(line, phase * 1000000000000 + ordinal) AS line, min(phase) AS phase FROM (
    SELECT * FROM tc WHERE (file_path, test) IN (SELECT (file_path, qn) FROM t) AND (file_path, target) NOT IN (SELECT (file_path, qn) FROM t)
    UNION ALL SELECT * FROM tn) GROUP BY ALL)
"""
