"""Project files, configurations and imports made of the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.plans.fixture import read

#: nation -> a file or a folder of its region, and for even ones a file of the library; customer -> a part of its nation.
_FILES = """
SELECT concat('src/', r, '/', n, CASE nk % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.ts' ELSE '.tsx' END) AS file_path FROM nr
UNION ALL SELECT concat('lib/', n, '.ts') FROM nr WHERE nk % 2 = 0
UNION ALL SELECT concat('src/', r, '/', n, '_parts/c', c_custkey, '.ts') FROM customer JOIN nr ON c_nationkey = nk"""
_NR = "nr AS (SELECT n_nationkey AS nk, n_regionkey AS rk, lower(replace(n_name, ' ', '_')) AS n, lower(replace(r_name, ' ', '_')) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"
#: Every order is an import in a part of its customer's nation.
_IMPORTS = """
SELECT concat('src/', a.r, '/', a.n, '_parts/c', c_custkey, '.ts') AS file_path,
       CASE o_orderkey % 5 WHEN 0 THEN concat('@', b.r, '/', b.n) WHEN 1 THEN concat('@lib/', b.n) WHEN 2 THEN concat('../', b.n) WHEN 3 THEN concat('@n/', b.n) ELSE 'react' END AS module
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nr a ON c_nationkey = a.nk JOIN nr b ON o_orderkey * 7 % 25 = b.nk"""
ROOT_CONFIG = """{ // every region
  "compilerOptions": { "baseUrl": ".", "paths": { "@*": ["missing/*", "src/*"], "@lib/*": ["lib/*",], } } }"""


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = f"WITH {_NR} {sql}"
    tables = ["nation", "region", "customer", "orders"]
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **{t: read(spark, sf_dir, t) for t in tables if f"{{{t}}}" in text})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _FILES)


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _IMPORTS)


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One at the top, one a region: odd regions state paths of their own, even ones extend the top's."""
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"), F.concat(F.lit("src/"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))), F.lit("/tsconfig.json")).alias("file_path"))
    own = F.lit('{"extends": "../../tsconfig", "compilerOptions": {"paths": {"@n/*": ["./*", "../lib/*"]}, "baseUrl": "./"}}')
    text = F.when(F.col("rk") % 2 == 1, own).otherwise('{"extends": "../../tsconfig.json"}')
    top = read(spark, sf_dir, "region").agg(F.lit("tsconfig.json").alias("file_path"), F.lit(ROOT_CONFIG).alias("text"))
    return region.select("file_path", text.alias("text")).unionByName(top)


#: The same files and imports for DuckDB, the patterns as the configurations mean them, and every import with its best file.
SQL = f"""WITH {_NR}, fs AS ({_FILES}), im AS (SELECT DISTINCT file_path, module, split_part(file_path, '/', 2) AS r FROM ({_IMPORTS})),
asked AS (SELECT DISTINCT regexp_extract(file_path, '^(.*)/', 1) AS folder, r, module FROM im),
regions AS (SELECT DISTINCT r, rk FROM nr),
pt AS (
  SELECT r, '@' AS head, 1 AS pos, 'missing/' AS to_ FROM regions WHERE rk % 2 = 0
  UNION ALL SELECT r, '@', 2, 'src/' FROM regions WHERE rk % 2 = 0
  UNION ALL SELECT r, '@lib/', 1, 'lib/' FROM regions WHERE rk % 2 = 0
  UNION ALL SELECT r, '@n/', 1, concat('src/', r, '/') FROM regions WHERE rk % 2 = 1
  UNION ALL SELECT r, '@n/', 2, 'src/lib/' FROM regions WHERE rk % 2 = 1),
ca AS (
  SELECT folder, module, concat('src/', r, '/', substr(module, 4)) AS path, 0 AS rank FROM asked WHERE starts_with(module, '../')
  UNION ALL SELECT folder, module, concat(to_, substr(module, length(head) + 1)), 1000 - 10 * length(head) + pos FROM asked JOIN pt USING (r) WHERE starts_with(module, head)),
pr AS (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '/index.ts', '/index.tsx', '/index.js']) AS ending, unnest(range(9)) AS probe),
best AS (
  SELECT folder, module, arg_min(target, rank * 10 + probe) AS target
  FROM (SELECT folder, module, concat(path, ending) AS target, rank, probe FROM ca, pr) JOIN fs ON fs.file_path = target GROUP BY ALL),
rs AS (SELECT im.file_path, im.module, best.target FROM im JOIN best ON best.module = im.module AND best.folder = regexp_extract(im.file_path, '^(.*)/', 1))
"""
