"""Registered queries over the fixture graph and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.functions import text as tx
from grapheion.operators import algos, contained, context, ivf, maintain, modules, neighbours, search
from grapheion.operators.graph import EDGE_WEIGHTS, CodeGraph
from grapheion.operators.lineage import shared_folder, stored
from grapheion.operators.textindex import NameIndex, TextIndex, first_relevant
from grapheion.plans import facts, fixture, projects
from grapheion.plans.facts import SQL as FACTS
from grapheion.plans.fixture import SQL as G
from grapheion.plans.fixture import read

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NODE = ["qualified_name", "name", "kind", "file_path", "line_start", "line_end"]
WEIGHT_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN CAST({w} AS DOUBLE)" for k, w in EDGE_WEIGHTS.items()) + " ELSE CAST(0 AS DOUBLE) END"
LONG = "the building machinery handler in asia for automobile orders is broken"


def query(sql: str | None) -> Callable[[Callable], Callable]:
    """Register a function under its name, with its twin."""

    def register(fn: Callable) -> Callable:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return register


def graph_query(sql: str | None) -> Callable[[Callable], Callable]:
    """The same for a function of the fixture graph; the twin follows the graph's CTEs."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(fixture.graph(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        query(G + sql if sql else None)(run)
        return fn

    return register


def targets(g: CodeGraph) -> dict[str, str]:
    """The least function, class and source file; one row."""
    pick = lambda test: F.min(F.when(test, F.col("qualified_name")))
    r = g.nodes.filter(F.col("kind").isin("Function", "Class", "File")).agg(pick(F.col("kind") == "Function").alias("fn"), pick(F.col("kind") == "Class").alias("cl"), pick((F.col("kind") == "File") & ~F.col("is_test")).alias("fl")).first()
    return r.asDict()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["impact_files"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# statistics and edges ------------------------------------------------------------
@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT language) AS BIGINT) AS languages FROM nodes GROUP BY kind")
def graph_stats_nodes(g):
    return g.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("language").alias("languages"))


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY kind")
def graph_stats_edges(g):
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))


@graph_query("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM nodes) AS languages, (SELECT count(*) FROM nodes WHERE kind = 'File') AS files_count")
def graph_stats(g):
    return g.stats().select("total_nodes", "total_edges", F.array_join("languages", ",").alias("languages"), "files_count")


@graph_query("SELECT src, dst, kind, src_file, dst_file FROM e")
def resolve_edges(g):
    return g.edges


@graph_query("SELECT DISTINCT src, dst, kind, src_file, dst_file FROM e")
def edges_distinct(g):
    return g.edges_distinct


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE target_qualified NOT IN (SELECT qualified_name FROM nodes)) AS BIGINT) AS unresolved FROM edges_raw GROUP BY kind")
def raw_edge_counts(g):
    known = g.by_name.select(F.col("qualified_name").alias("target_qualified"), F.lit(True).alias("known"))
    return g.edges_raw.join(known, "target_qualified", "left").groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.col("known").isNull()).alias("unresolved"))


# patterns --------------------------------------------------------------------------
NODE_SQL = ", ".join(f"n.{c}" for c in NODE)


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT src FROM e, t WHERE e.kind = 'CALLS' AND e.dst = t.cl)")
def callers_of(g):
    return g.callers(targets(g)["cl"]).select(*NODE)


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT dst FROM e, t WHERE e.kind = 'CALLS' AND e.src = t.fn)")
def callees_of(g):
    return g.callees(targets(g)["fn"]).select(*NODE)


@graph_query("SELECT dst AS import_target FROM e, t WHERE kind = 'IMPORTS_FROM' AND src = t.fl")
def imports_of(g):
    return g.imports(targets(g)["fl"])


@graph_query("SELECT src AS importer, src_file AS file FROM e, t WHERE e.kind = 'IMPORTS_FROM' AND dst = (SELECT file_path FROM nodes n, t WHERE n.qualified_name = t.cl)")
def importers_of(g):
    return g.importers(targets(g)["cl"])


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT dst FROM e, t WHERE e.kind = 'CONTAINS' AND e.src = t.fl)")
def children_of(g):
    return g.children(targets(g)["fl"]).select(*NODE)


@graph_query(f"SELECT {NODE_SQL} FROM nodes n, t WHERE n.file_path = t.fl")
def file_summary(g):
    return g.in_file(targets(g)["fl"]).select(*NODE)


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT dst FROM e WHERE kind = 'TESTED_BY' AND src = (SELECT min(src) FROM e WHERE kind = 'TESTED_BY'))")
def tests_for(g):
    """Tests of the least function that has one."""
    name = g.edges.filter("kind = 'TESTED_BY'").agg(F.min("src").alias("src")).first().src
    return g.tests_of(name).select(*NODE)


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT src FROM e, t WHERE e.kind IN ('INHERITS', 'IMPLEMENTS') AND e.dst = t.cl)")
def inheritors_of(g):
    return g.inheritors(targets(g)["cl"]).select(*NODE)


@graph_query("SELECT DISTINCT src_file AS file_path FROM e, t WHERE kind IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS') AND dst_file = t.fl AND src_file <> t.fl")
def dependents_of_file(g):
    return g.dependents(targets(g)["fl"])


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM e, t WHERE dst_file = t.fl GROUP BY kind")
def incoming_edges_of_file(g):
    return g.incoming(targets(g)["fl"]).groupBy("kind").agg(F.count("*").alias("n"))


@graph_query("SELECT e.src, e.dst, e.kind FROM e, t WHERE e.src_file = t.fl AND e.dst_file = t.fl")
def edges_among(g):
    return g.among(g.in_file(targets(g)["fl"])).select("src", "dst", "kind")


@graph_query("SELECT src, dst FROM e WHERE kind = 'CALLS' AND (dst = 'Supplier1' OR ends_with(dst, '::Supplier1'))")
def target_name_calls(g):
    return g.calls_by_name("Supplier1").select("src", "dst")


@graph_query("SELECT qualified_name, line_end - line_start + 1 AS line_count FROM nodes WHERE kind = 'Function' AND line_end - line_start + 1 >= 50 AND contains(lower(file_path), 'asia') ORDER BY line_count DESC, qualified_name LIMIT 50")
def large_functions(g):
    return g.large(50, "Function", "ASIA").select("qualified_name", "line_count")


@graph_query("SELECT n.qualified_name, n.kind, CAST(count(*) FILTER (WHERE x.kind = 'CALLS' AND x.way = 'in') AS BIGINT) AS fan_in, CAST(count(*) FILTER (WHERE x.kind = 'CALLS' AND x.way = 'out') AS BIGINT) AS fan_out, coalesce(bool_or(x.kind = 'TESTED_BY' AND x.way = 'out'), false) AS tested FROM nodes n LEFT JOIN (SELECT src AS q, kind, 'out' AS way FROM e WHERE kind IN ('CALLS', 'TESTED_BY') UNION ALL SELECT dst, kind, 'in' FROM e WHERE kind IN ('CALLS', 'TESTED_BY')) x ON x.q = n.qualified_name GROUP BY n.qualified_name, n.kind")
def degree_table(g):
    return g.degrees().drop("file_path")


@graph_query("SELECT n.qualified_name, CAST(count(e.src) AS BIGINT) AS fan_in FROM nodes n JOIN e ON e.dst = n.qualified_name AND e.kind = 'CALLS' WHERE n.qualified_name NOT IN (SELECT src FROM e WHERE kind = 'TESTED_BY') GROUP BY n.qualified_name HAVING count(*) > 3")
def risk_flags(g):
    return g.degrees().filter("fan_in > 3 and not tested").select("qualified_name", "fan_in")


# search -----------------------------------------------------------------------------
DEMOTED_SQL = "CASE WHEN regexp_matches(lower(file_path), '(^|/)(compiled|node_modules|\\.next)/') THEN {a} ELSE {b} END"


def and_sql(words: str, limit: int) -> str:
    whole, each = words.lower(), words.lower().split()
    holds = " AND ".join(f"(contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') OR contains(lower(file_path), '{w}'))" for w in each)
    path = " OR ".join(f"contains(lower(file_path), '{w}')" for w in each)
    return f"SELECT qualified_name, name, kind, CASE WHEN lower(name) = '{whole}' OR lower(qualified_name) = '{whole}' THEN 0 WHEN starts_with(lower(name), '{whole}') THEN 1 WHEN {path} THEN 1 ELSE 2 END + {DEMOTED_SQL.format(a=1, b=0)} AS tier FROM nodes WHERE {holds} ORDER BY tier, name, qualified_name LIMIT {limit}"


def relaxed_sql(words: list[str], limit: int) -> str:
    named = " + ".join(f"CAST(contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') AS INT)" for w in words)
    any_ = " + ".join(f"CAST(contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') OR contains(lower(file_path), '{w}') AS INT)" for w in words)
    score = f"(CAST(0.6 AS DOUBLE) * (({any_}) / CAST({len(words)} AS DOUBLE)) + CAST(0.4 AS DOUBLE) * (({named}) / CAST({len(words)} AS DOUBLE))) * CAST({DEMOTED_SQL.format(a=0.5, b=1.0)} AS DOUBLE) * CAST(CASE WHEN kind = 'Test' THEN 0.8 ELSE 1.0 END AS DOUBLE)"
    return f"SELECT qualified_name, name, kind, file_path, score FROM (SELECT *, {any_} AS matched, {score} AS score FROM nodes) WHERE matched > 0 ORDER BY round(score, 12) DESC, name, qualified_name LIMIT {limit}"


@graph_query(and_sql("fn_building asia", 40))
def search_and(g):
    return search.search_and(g.by_name, "fn_building asia", 40).select("qualified_name", "name", "kind", "tier")


@graph_query(f"SELECT qualified_name, kind, round(score, 6) AS score FROM ({relaxed_sql(tx.relaxed_words(LONG), 60)})")
def search_relaxed(g):
    return search.search_relaxed(g.by_name, LONG, 60).select("qualified_name", "kind", F.round("score", 6).alias("score"))


@query("SELECT doc_id, matched FROM (SELECT doc_id, CAST(contains(lower(text), 'ation') AS INT) + CAST(contains(lower(text), 'ment') AS INT) + CAST(contains(lower(text), 'heit') AS INT) + CAST(contains(lower(text), 'tion') AS INT) AS matched FROM documents) WHERE matched > 0")
def search_documents(spark, sf_dir):
    lower = F.lower("text")
    matched = sum((lower.contains(w).cast("int") for w in ("ation", "ment", "heit", "tion")), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", matched.alias("matched")).filter("matched > 0")


BM25_TERMS = ["the", "queaux", "erthe"]


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(ws) AS DOUBLE)) AS a FROM w),
tf AS (SELECT doc_id, len(ws) AS l, term, CAST(len(list_filter(ws, lambda x: x = term)) AS DOUBLE) AS tf FROM w, (SELECT unnest(['erthe', 'queaux', 'the']) AS term) WHERE list_contains(ws, term)),
d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term)
SELECT doc_id, round(score, 6) AS score FROM (
  SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l / a))) AS score FROM tf JOIN d USING (term), c GROUP BY doc_id)
ORDER BY round(score, 9) DESC, doc_id LIMIT 50""")
def full_text_bm25(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return search.bm25(docs, "doc_id", F.coalesce("text", F.lit("")), " ".join(BM25_TERMS), 50).withColumn("score", F.round("score", 6))


def _document_index(spark: SparkSession, sf_dir: str, table: str = "blocks") -> TextIndex:
    return TextIndex.build(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), shared_folder(spark, "index"), tables=(table,))


@query(_SQL["full_text_bm25"])
def bm25_indexed(spark, sf_dir):
    """The same from stored postings: only blocks of the query's terms that can reach the fifty best are read."""
    return _document_index(spark, sf_dir).search(" ".join(BM25_TERMS), 50).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


WORDS_SQL = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
BENCHMARK_SQL = f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(ws) AS DOUBLE)) AS a FROM w),
q AS (SELECT item_id, unnest(list_distinct({WORDS_SQL})) AS term FROM benchmark),
tf AS (SELECT doc_id, l, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, l, term),
d AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY term),
s AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * l / a))) AS score
  FROM q JOIN tf USING (term) JOIN d USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
"""


def _benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"{BENCHMARK_SQL} SELECT item_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_benchmark(spark, sf_dir):
    """All benchmark texts as queries, answered together."""
    found = _document_index(spark, sf_dir).top(_benchmark_queries(spark, sf_dir), 10)
    return found.select(F.col("query_id").alias("item_id"), F.col("key").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"""{BENCHMARK_SQL}, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, min(rank) AS rank FROM r JOIN rel USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id),
e AS (SELECT CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS size, rank FROM benchmark JOIN (SELECT DISTINCT item_id FROM rel) USING (item_id) LEFT JOIN h USING (item_id))
SELECT size, CAST(count(*) AS BIGINT) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM e GROUP BY ROLLUP (size)""")
def eval_retrieval(spark, sf_dir):
    """Hit@5 and mean reciprocal rank of what full text finds for each benchmark text that some document holds."""
    queries = _benchmark_queries(spark, sf_dir)
    found = _document_index(spark, sf_dir).top(queries, 10).select("query_id", "key", "rank")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("body"))
    relevant = contained.pairs(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), docs)
    ranks = first_relevant(found, queries.withColumn("size", F.when(F.length("text") > 200, "long").otherwise("short")), relevant)
    return context.retrieval_metrics(ranks, ["size"])


FUZZY = ["erthe", "theand", "onenin", "the", "schung"]


# the twin compares letter by letter: its levenshtein counts bytes
@query(f"""WITH t AS (SELECT DISTINCT unnest({WORDS_SQL}) AS term FROM documents)
SELECT word, term FROM t, (SELECT unnest({FUZZY!r}) AS word) WHERE word = term OR abs(length(word) - length(term)) <= 1 AND len(list_filter(range(1, 1 + greatest(length(word), length(term))), lambda i:
  length(word) = length(term) AND concat(substr(word, 1, i - 1), substr(word, i + 1)) = concat(substr(term, 1, i - 1), substr(term, i + 1))
  OR length(word) = length(term) + 1 AND concat(substr(word, 1, i - 1), substr(word, i + 1)) = term OR length(word) + 1 = length(term) AND concat(substr(term, 1, i - 1), substr(term, i + 1)) = word)) > 0""")
def fuzzy_terms(spark, sf_dir):
    """Terms of the dictionary within one edit of some words, by what they have in common with a letter left out."""
    return _document_index(spark, sf_dir, "variants").near(spark.createDataFrame([(w,) for w in FUZZY], "word string"))


@query("WITH t AS (SELECT doc_id, unnest(list_distinct(" + WORDS_SQL + ")) AS term FROM documents) SELECT term, count(*) AS df FROM t WHERE starts_with(term, 'erth') GROUP BY term")
def prefix_terms(spark, sf_dir):
    return _document_index(spark, sf_dir, "prefixes").prefixed("erth")


@query(_SQL["search_and"])
def search_and_indexed(spark, sf_dir):
    """The same rows from the three-letter parts of its words."""
    index = NameIndex.build(fixture.graph(spark, sf_dir).by_name, shared_folder(spark, "names"))
    return index.search_and("fn_building asia", 40).select("qualified_name", "name", "kind", "tier")


@query(_SQL["search_relaxed"])
def search_relaxed_indexed(spark, sf_dir):
    index = NameIndex.build(fixture.graph(spark, sf_dir).by_name, shared_folder(spark, "names"))
    return index.search_relaxed(LONG, 60).select("qualified_name", "kind", F.round("score", 6).alias("score"))


def _queries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to classify: conversation openings and benchmark items, some dressed as other kinds of query."""
    conv = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("conv_id").alias("k"), F.coalesce("text", F.lit("")).alias("x"))
    bench = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), F.col("item_id").alias("k"), F.coalesce("text", F.lit("")).alias("x"))
    rows = conv.unionByName(bench)
    word = F.split_part(F.trim("x"), F.lit(" "), F.lit(1))
    kinds = [F.col("x"), F.concat(word, F.lit("_id")), F.concat(F.lit('find "'), word, F.lit('" now')), F.concat(F.lit("TypeError: "), "x"), F.concat(F.lit("src/"), word), F.concat(F.lit("why is "), word), F.concat(F.lit("config option "), word), F.concat(F.lit("race condition and off by one in "), word)]
    return rows.select("id", F.element_at(F.array(*kinds), (F.col("k") % 8 + 1).cast("int")).alias("q"))


QUERIES_SQL = """WITH raw AS (
  SELECT concat('c', conv_id, '-', turn) AS id, conv_id AS k, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT concat('b', item_id), item_id, coalesce(text, '') FROM benchmark),
qs AS (SELECT id, CASE k % 8 WHEN 0 THEN x WHEN 1 THEN concat(w, '_id') WHEN 2 THEN concat('find "', w, '" now') WHEN 3 THEN concat('TypeError: ', x)
  WHEN 4 THEN concat('src/', w) WHEN 5 THEN concat('why is ', w) WHEN 6 THEN concat('config option ', w) ELSE concat('race condition and off by one in ', w) END AS q
  FROM (SELECT *, split_part(trim(x), ' ', 1) AS w FROM raw))
"""


def _sql_any(column: str, needles: list[str], test: str = "contains") -> str:
    return "(" + " OR ".join("{}({}, '{}')".format(test, column, n.replace("'", "''")) for n in needles) + ")"


CLASSIFY_SQL = f"""{QUERIES_SQL}, s AS (SELECT id, trim(q) AS q, lower(trim(q)) AS l, len(list_filter(string_split_regex(trim(q), '\\s+'), lambda w: w <> '')) AS n FROM qs),
c AS (SELECT *, {" + ".join(f"CAST(contains(l, '{t}') AS INT)" for t in tx.CONFIG_TERMS)} AS hits FROM s)
SELECT id, CASE WHEN n = 1 AND (regexp_matches(q, '[A-Z]') AND regexp_matches(q, '[a-z]') OR contains(q, '_')) THEN 'ExactSymbol'
  WHEN regexp_matches(q, '"[^"]*[^" ][^"]*"|`[^`]*[^` ][^`]*`') OR {_sql_any('l', tx.ERROR_PREFIXES, 'starts_with')} OR {_sql_any('l', tx.TRACE_INDICATORS)} THEN 'ExactText'
  WHEN {_sql_any('q', [*tx.SOURCE_EXTENSIONS, '/'])} THEN 'FilePath'
  WHEN {_sql_any('l', tx.CAUSAL_STARTS, 'starts_with')} OR {_sql_any('l', tx.CAUSAL_PARTS)} THEN 'Causal'
  WHEN hits >= 2 OR hits = 1 AND n <= 4 THEN 'ConfigLookup' ELSE 'General' END AS route FROM c"""


@query(CLASSIFY_SQL)
def classify_queries(spark, sf_dir):
    route, _ = tx.classified_columns(F.col("q"))
    return _queries_table(spark, sf_dir).select("id", route.alias("route"))


@query(f"""{QUERIES_SQL} SELECT id, CAST(len(regexp_extract_all(q, '"([^"]*)"', 1)) AS BIGINT) AS quoted, {_sql_any("lower(q)", tx.TEST_WORDS)} AS mentions_tests FROM qs""")
def decompose_flags(spark, sf_dir):
    quoted = F.size(F.regexp_extract_all("q", F.lit('"([^"]*)"'), 1)).cast("long")
    tests = tx.any_of([F.lower("q").contains(w) for w in tx.TEST_WORDS])
    return _queries_table(spark, sf_dir).select("id", quoted.alias("quoted"), tests.alias("mentions_tests"))


@query(f"""{QUERIES_SQL} SELECT id, span FROM (SELECT id, trim(unnest(regexp_extract_all(q, '"([^"]*)"', 1))) AS span FROM qs) WHERE span <> ''""")
def quoted_spans(spark, sf_dir):
    spans = F.explode(F.transform(F.regexp_extract_all("q", F.lit('"([^"]*)"'), 1), F.trim))
    return _queries_table(spark, sf_dir).select("id", spans.alias("span")).filter("span <> ''")


@query(f"{QUERIES_SQL} SELECT id, term FROM qs, (SELECT unnest([{', '.join(repr(t) for t in tx.COMPOUND_TERMS)}]) AS term) WHERE contains(concat(' ', lower(q), ' '), concat(' ', term, ' '))")
def compound_terms(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.lower("q"), F.lit(" "))
    found = F.filter(F.array(*map(F.lit, tx.COMPOUND_TERMS)), lambda t: F.contains(padded, F.concat(F.lit(" "), t, F.lit(" "))))
    return _queries_table(spark, sf_dir).select("id", F.explode(found).alias("term"))


def _resolved_sql(target: str) -> str:
    exact = f"EXISTS (SELECT 1 FROM nodes WHERE qualified_name = '{target}')"
    return f"CASE WHEN {exact} THEN 'found' ELSE (SELECT CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END FROM ({and_sql(target, 5)})) END"


RESOLVED = ["src/asia/nation_2.py", "no such name anywhere", "Supplier", "fn_building_ src/asia"]


@graph_query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {_resolved_sql(t)})" for t in RESOLVED) + ") AS v(target, status)")
def target_resolution(g):
    return g.nodes.sparkSession.createDataFrame([(t, g.resolve_target(t)[0]) for t in RESOLVED], "target string, status string")


@graph_query(f"SELECT {NODE_SQL} FROM nodes n WHERE n.qualified_name IN (SELECT src FROM e WHERE kind = 'CALLS' AND (dst = 'Supplier1' OR ends_with(dst, '::Supplier1')))")
def callers_fallback(g):
    """A name that no edge leads to: those whose target matches its last part answer."""
    return g.callers("gone.py::Supplier1").select(*NODE)


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(CASE WHEN file_path LIKE '%nation_1%' THEN 1 ELSE 0 END) AS BIGINT) AS in_some FROM nodes WHERE file_path NOT LIKE 'compiled/%' GROUP BY kind")
def purged_nodes(g):
    left = maintain.purge(g, g.files().filter("file_path not like 'compiled/%'"))
    return left.nodes.groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("file_path").contains("nation_1")).alias("in_some"))


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM e WHERE src_file NOT LIKE 'src/a%' AND dst_file NOT LIKE 'src/a%' GROUP BY kind")
def edges_without_files(g):
    """Edges that are left when files are removed: those into them go unresolved, none is repaired."""
    left = maintain.remove_files(g, g.files().filter("file_path like 'src/a%'"))
    return left.edges.groupBy("kind").agg(F.count("*").alias("n"))


@graph_query("SELECT kind, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY kind")
def replaced_files(g):
    """Files taken out and put back in another order: the edges are those of the whole graph."""
    # the graph is stored, as one that is updated is: the plan would make it anew for all that it is taken apart into
    g = CodeGraph(stored(g.nodes.select("node_id", "qualified_name", "file_path"), "nodes"), stored(g.edges_raw.drop("line"), "edges"))
    some = g.files().filter("file_path like 'src/a%'")
    nodes, edges = map(maintain.of_files(some), (g.nodes, g.edges_raw))
    back = maintain.replace_files(maintain.remove_files(g, some), nodes, edges)
    return back.edges.groupBy("kind").agg(F.count("*").alias("n"))


# iterative algorithms ------------------------------------------------------------------
SEEDS_SQL = "sd AS (SELECT qualified_name FROM nodes n, t WHERE n.file_path = t.fl)"


def ppr_sql(k: int, compat: bool) -> str:
    """k rounds as chained CTEs."""
    share = ("m * " if compat else "") + "sw / indeg"
    out = f""", {SEEDS_SQL}, ns AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM sd),
pw AS MATERIALIZED (SELECT src, dst, {share} AS share FROM (SELECT src, dst, count(*) AS m, sum({WEIGHT_SQL}) AS sw FROM e GROUP BY src, dst) JOIN (SELECT dst AS d, sum({WEIGHT_SQL}) AS indeg FROM e GROUP BY dst) ON d = dst),
r0 AS MATERIALIZED (SELECT qualified_name AS q, 1 / n AS score FROM sd, ns)"""
    for i in range(1, k + 1):
        out += f""",
r{i} AS MATERIALIZED (SELECT q, sum(score) AS score FROM (SELECT src AS q, CAST(0.85 AS DOUBLE) * score * share AS score FROM pw JOIN r{i - 1} ON q = dst UNION ALL SELECT qualified_name, (1 - CAST(0.85 AS DOUBLE)) / n FROM sd, ns) GROUP BY q HAVING sum(score) > 1e-6)"""
    return out


def _ppr(g: CodeGraph, k: int, compat: bool = False) -> DataFrame:
    seeds = g.in_file(targets(g)["fl"]).select("qualified_name")
    found = algos.pagerank(g, seeds, k, compat).join(seeds, "qualified_name", "left_anti")
    return found.select("qualified_name", F.round("score", 6).alias("score"))


PPR_TAIL = " SELECT q AS qualified_name, round(score, 6) AS score FROM r{k} WHERE q NOT IN (SELECT qualified_name FROM sd)"


@graph_query(ppr_sql(3, False) + PPR_TAIL.format(k=3))
def impact_ppr_k3(g):
    return _ppr(g, 3)


@graph_query(ppr_sql(5, False) + PPR_TAIL.format(k=5))
def impact_ppr_k5(g):
    return _ppr(g, 5)


def _stopped_sql(first: int, rounds: int) -> str:
    """Scores of the first round from ``first`` on that moves no score by 1e-6, else of the last."""
    gaps = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT max(abs(coalesce(a.score, 0) - coalesce(b.score, 0))) FROM r{k} a FULL OUTER JOIN r{k - 1} b ON a.q = b.q) AS gap" for k in range(first, rounds + 1))
    scores = " UNION ALL ".join(f"SELECT q, score FROM r{k} WHERE (SELECT k FROM stop) = {k}" for k in range(first, rounds + 1))
    return f", gaps AS ({gaps}), stop AS (SELECT coalesce(min(k) FILTER (WHERE gap < 1e-6), {rounds}) AS k FROM gaps), done AS ({scores}) SELECT q AS qualified_name, round(score, 6) AS score FROM done WHERE q NOT IN (SELECT qualified_name FROM sd)"


@graph_query(ppr_sql(algos.ROUNDS, False) + _stopped_sql(algos.CUT_EVERY, algos.ROUNDS))
def impact_ppr_default(g):
    """As many rounds as the default allows, with its stop rule."""
    return _ppr(g, algos.ROUNDS)


@graph_query(ppr_sql(3, True) + PPR_TAIL.format(k=3))
def impact_ppr_compat_k3(g):
    return _ppr(g, 3, True)


@graph_query(ppr_sql(3, False) + ", top AS (SELECT q, score FROM r3 WHERE q NOT IN (SELECT qualified_name FROM sd) ORDER BY round(score, 12) DESC, q LIMIT 100) SELECT n.file_path, CAST(count(*) AS BIGINT) AS nodes, round(max(score), 6) AS best FROM top JOIN nodes n ON n.qualified_name = q GROUP BY n.file_path")
def impact_files(g):
    files = g.nodes.sparkSession.createDataFrame([(targets(g)["fl"],)], "file_path string")
    impacted = algos.impact_radius(g, files, 100, rounds=3)["impacted"]
    return impacted.groupBy("file_path").agg(F.count("*").alias("nodes"), F.round(F.max("score"), 6).alias("best"))


@graph_query(ppr_sql(3, False) + ", best AS MATERIALIZED (SELECT q, score FROM r3 ANTI JOIN sd ON q = qualified_name ORDER BY round(score, 12) DESC, q LIMIT 100), top AS MATERIALIZED (SELECT q FROM best UNION ALL SELECT qualified_name FROM sd) SELECT kind, CAST(count(*) AS BIGINT) AS n FROM edges_raw JOIN top a ON source_qualified = a.q JOIN top b ON target_qualified = b.q GROUP BY kind")
def impact_edges(g):
    files = g.nodes.sparkSession.createDataFrame([(targets(g)["fl"],)], "file_path string")
    return algos.impact_radius(g, files, 100, rounds=3)["edges"].groupBy("kind").agg(F.count("*").alias("n"))


def reach_sql(k: int) -> str:
    step = f"st AS MATERIALIZED (SELECT pt, q, max(w) AS w FROM (SELECT dst AS pt, src AS q, {WEIGHT_SQL} * CAST(0.7 AS DOUBLE) AS w FROM e UNION ALL SELECT src, dst, CAST(0.8 AS DOUBLE) * CAST(0.7 AS DOUBLE) FROM e WHERE kind = 'TESTED_BY') GROUP BY pt, q)"
    out = ", b0 AS (SELECT t.cl AS q, CAST(1 AS DOUBLE) AS s FROM t), " + step
    for i in range(1, k + 1):
        out += f", b{i} AS MATERIALIZED (SELECT q, max(s) AS s FROM (SELECT q, s FROM b{i - 1} UNION ALL SELECT st.q, b.s * w FROM st JOIN b{i - 1} b ON b.q = pt WHERE b.s * w >= 0.01) GROUP BY q)"
    return out + f" SELECT q AS qualified_name, round(s, 6) AS score FROM b{k}, t WHERE q <> t.cl"


@graph_query(reach_sql(3))
def weighted_bfs_k3(g):
    seeds = g.node(targets(g)["cl"]).select("qualified_name")
    return algos.weighted_reach(g, seeds, 3).select("qualified_name", F.round("score", 6).alias("score"))


@graph_query(", ce AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'CALLS'), walk AS (SELECT t.fn AS q, 0 AS h FROM t UNION SELECT ce.dst, h + 1 FROM walk JOIN ce ON ce.src = q WHERE h < 6) SELECT q AS qualified_name, min(h) AS hops FROM walk GROUP BY q")
def call_chain_hops(g):
    return algos.call_distances(g, targets(g)["fn"], 6).select("qualified_name", "hops")


@graph_query(", walk AS (SELECT t.cl AS q, 0 AS h FROM t UNION SELECT e.src, h + 1 FROM walk JOIN e ON e.dst = q AND e.kind = 'CALLS' WHERE h < 2) SELECT q AS qualified_name, min(h) AS hops FROM walk GROUP BY q")
def call_chain_incoming(g):
    return algos.call_distances(g, targets(g)["cl"], 2, backwards=True).select("qualified_name", "hops")


PAIRS_SQL = """, pr AS (SELECT a.r AS pair_id, a.q AS s, b.q AS z FROM (SELECT qualified_name AS q, row_number() OVER (ORDER BY qualified_name) AS r FROM nodes WHERE kind = 'Function') a
  JOIN (SELECT qualified_name AS q, row_number() OVER (ORDER BY qualified_name DESC) AS r FROM nodes WHERE kind IN ('Function', 'Class')) b ON a.r * 3 = b.r WHERE a.r <= 40),
ce AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'CALLS'),
wk AS (SELECT pair_id, s AS q, 0 AS h FROM pr UNION SELECT pair_id, ce.dst, h + 1 FROM wk JOIN ce ON ce.src = q WHERE h < 6),
dd AS (SELECT pair_id, q, min(h) AS h FROM wk GROUP BY pair_id, q),
pa AS (SELECT v.pair_id, v.q, min(u.q) AS parent FROM dd v JOIN ce ON ce.dst = v.q JOIN dd u ON u.pair_id = v.pair_id AND u.q = ce.src AND u.h = v.h - 1 GROUP BY v.pair_id, v.q),
ch AS (SELECT pr.pair_id, z AS q, h AS step FROM pr JOIN dd ON dd.pair_id = pr.pair_id AND dd.q = z UNION SELECT ch.pair_id, parent, step - 1 FROM ch JOIN pa ON pa.pair_id = ch.pair_id AND pa.q = ch.q)
SELECT CAST(pair_id AS BIGINT) AS pair_id, CAST(step AS BIGINT) AS step, q AS qualified_name FROM ch"""


@graph_query(PAIRS_SQL)
def call_paths(g):
    """Shortest outgoing call paths of forty pairs, searched together, as rows of steps."""
    ends = lambda kinds, order, n: g.by_name.filter(F.col("kind").isin(kinds)).orderBy(order).limit(n).select("qualified_name", F.row_number().over(Window.orderBy(order)).alias("r"))
    near, far = ends(["Function"], F.col("qualified_name"), 40), ends(["Function", "Class"], F.desc("qualified_name"), 120)
    pairs = near.select((F.col("r") * 3).alias("r"), F.col("r").cast("long").alias("pair_id"), F.col("qualified_name").alias("source")).join(far.select("r", F.col("qualified_name").alias("target")), "r")
    calls = g.edges.filter("kind = 'CALLS'").select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    found = algos._paths(calls, algos.cut(pairs.select("pair_id", "source", "target")), 6)
    return found.select("pair_id", F.posexplode("path").alias("step", "qualified_name")).withColumn("step", F.col("step").cast("long"))


@graph_query(f""", cand AS (SELECT qualified_name AS q, CAST(1 AS DOUBLE) / (60 + row_number() OVER (ORDER BY tier, name, qualified_name)) AS score FROM ({and_sql("fn_household", 30)})),
sd AS (SELECT q AS seed, score FROM cand ORDER BY score DESC, q LIMIT 6)
SELECT q AS qualified_name, round(score, 6) AS score FROM (
  SELECT q, 0.3 * max(score) AS score FROM (SELECT seed, score, dst AS q FROM sd JOIN e ON src = seed AND kind IN ('CALLS', 'CONTAINS') UNION ALL SELECT seed, score, src FROM sd JOIN e ON dst = seed AND kind = 'CALLS')
  WHERE q NOT IN (SELECT q FROM cand) GROUP BY q) ORDER BY score DESC, q LIMIT 20""")
def expand_one_hop(g):
    hits = search.search_and(g.by_name, "fn_household", 30)
    cand = hits.select("qualified_name", (1.0 / (60 + F.row_number().over(Window.orderBy("tier", "name", "qualified_name")))).alias("score"))
    return algos.expand_one_hop(g, cand, 10).select("qualified_name", F.round("score", 6).alias("score"))


# vectors and fusion ----------------------------------------------------------------------
COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"SELECT vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    emb = read(spark, sf_dir, "embeddings")
    q = emb.filter("vec_id = 0").first().embedding
    return search.vector_search(emb, "vec_id", "embedding", q, 20).select("vec_id", "score")


@query(f"SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 4) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5")
def cosine_topk_by_label(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all of their label."""
    emb = read(spark, sf_dir, "embeddings")
    return search.vector_join(emb.filter("vec_id % 100 = 0"), emb, "vec_id", "label", "embedding", 5)


@query(f"SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round({COS.format(a='e.embedding', b='q.embedding')}, 4) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5")
def cosine_topk_all(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, against all others of any label."""
    emb = read(spark, sf_dir, "embeddings")
    return search.vector_join_all(emb.filter("vec_id % 100 = 0"), emb, "vec_id", "embedding", 5)


@query(None)
def cosine_topk_approx(spark, sf_dir):
    """The same queries and items by an index of lists; recall against the exact join is tested."""
    emb = read(spark, sf_dir, "embeddings")
    index = ivf.build(emb, "vec_id", "embedding")
    return index.nearest(emb.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query(None)
def cosine_topk_graph(spark, sf_dir):
    """The same queries and items by a graph of nearest vectors, stored, read and searched; recall is tested."""
    emb, folder = read(spark, sf_dir, "embeddings"), shared_folder(spark, "vector-graph")
    neighbours.build(emb, "vec_id", "embedding").write(folder)
    return neighbours.read(spark, folder).nearest(emb.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5)


def _two_lists(g: CodeGraph) -> tuple[DataFrame, DataFrame]:
    a = search.search_and(g.by_name, "fn_building", 50)
    b = g.large(60, "Function", limit=80)
    return a.select("qualified_name", F.row_number().over(Window.orderBy("tier", "name", "qualified_name")).alias("rank")), b.select("qualified_name", F.row_number().over(Window.orderBy(F.desc("line_count"), "qualified_name")).alias("rank"))


LISTS_SQL = f""", la AS (SELECT qualified_name AS q, row_number() OVER (ORDER BY tier, name, qualified_name) AS rank FROM ({and_sql("fn_building", 50)})),
lb AS (SELECT q, row_number() OVER (ORDER BY lc DESC, q) AS rank FROM (SELECT qualified_name AS q, line_end - line_start + 1 AS lc FROM nodes WHERE kind = 'Function' AND line_end - line_start + 1 >= 60 ORDER BY lc DESC, q LIMIT 80))"""


@graph_query(LISTS_SQL + " SELECT q AS qualified_name, round(sum(s), 6) AS score, CAST(count(*) AS BIGINT) AS n_sources FROM (SELECT q, CAST(1.5 AS DOUBLE) / (60 + rank) AS s FROM la UNION ALL SELECT q, CAST(0.7 AS DOUBLE) / (60 + rank) FROM lb) GROUP BY q")
def rrf_fuse(g):
    a, b = _two_lists(g)
    fused = search.fuse([search.channel(a, "keyword", 1.5, F.col("rank")), search.channel(b, "size", 0.7, F.col("rank"))])
    return fused.select("qualified_name", F.round("score", 6).alias("score"), F.size("sources").cast("long").alias("n_sources"))


@graph_query(LISTS_SQL + """, na AS (SELECT q, CASE WHEN max(1.0/rank) OVER () > min(1.0/rank) OVER () THEN (CAST(1 AS DOUBLE)/rank - min(CAST(1 AS DOUBLE)/rank) OVER ()) / (max(CAST(1 AS DOUBLE)/rank) OVER () - min(CAST(1 AS DOUBLE)/rank) OVER ()) ELSE 1 END AS s FROM la),
nb AS (SELECT q, CASE WHEN max(1.0/rank) OVER () > min(1.0/rank) OVER () THEN (CAST(1 AS DOUBLE)/rank - min(CAST(1 AS DOUBLE)/rank) OVER ()) / (max(CAST(1 AS DOUBLE)/rank) OVER () - min(CAST(1 AS DOUBLE)/rank) OVER ()) ELSE 1 END AS s FROM lb)
SELECT coalesce(na.q, nb.q) AS qualified_name, round(0.5 * coalesce(na.s, 0) + 0.5 * coalesce(nb.s, 0), 6) AS score FROM na FULL OUTER JOIN nb ON na.q = nb.q""")
def cc_fuse(g):
    return search.convex(*_two_lists(g)).select("qualified_name", F.round("score", 6).alias("score"))


FANOUT = "Supplier1 building machinery handler asia automobile orders"
FANOUT_SQL = f""", rel AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, name, qualified_name) AS rank FROM ({relaxed_sql(tx.relaxed_words(FANOUT), 50)})),
ex AS (SELECT *, row_number() OVER (ORDER BY tier, name, qualified_name) AS rank FROM ({and_sql("Supplier1", 50)})),
pool AS (SELECT q, sum(s) AS score, count(DISTINCT src) AS ns, bool_or(src = 'x') AS ex FROM (SELECT qualified_name AS q, 'r' AS src, CAST(0.8 AS DOUBLE) / (60 + rank) AS s FROM rel UNION ALL SELECT qualified_name, 'x', CAST(1 AS DOUBLE) / (60 + rank) FROM ex) GROUP BY q)"""


def _fanout(g: CodeGraph) -> tuple[tx.Parts, DataFrame]:
    parts = tx.decompose(FANOUT)
    return parts, search.fanout(g, parts, tx.classify(FANOUT).route, 10)


@graph_query(FANOUT_SQL + " SELECT q AS qualified_name, round(score, 6) AS score, CAST(ns AS BIGINT) AS n_sources FROM pool")
def fanout_candidates(g):
    return _fanout(g)[1].select("qualified_name", F.round("score", 6).alias("score"), F.size("sources").cast("long").alias("n_sources"))


@graph_query(FANOUT_SQL + """, dg AS (SELECT qualified_name AS q, (SELECT count(*) FROM e WHERE e.dst = qualified_name AND e.kind = 'CALLS') AS fi, EXISTS (SELECT 1 FROM e WHERE e.src = qualified_name AND e.kind = 'TESTED_BY') AS tested FROM nodes WHERE qualified_name IN (SELECT q FROM pool)),
rk AS (SELECT p.q, p.score, p.ex, n.file_path, n.kind, n.is_test, d.fi, d.tested, row_number() OVER (PARTITION BY n.file_path ORDER BY round(p.score, 12) DESC, p.q) AS r FROM pool p JOIN nodes n ON n.qualified_name = p.q JOIN dg d ON d.q = p.q),
src AS (SELECT n.file_path, count(DISTINCT s) AS ns FROM (SELECT qualified_name AS q, 'r' AS s FROM rel UNION ALL SELECT qualified_name, 'x' FROM ex) JOIN nodes n ON n.qualified_name = q GROUP BY 1),
fs AS (SELECT file_path, sum(CASE WHEN r = 1 THEN 1.5 * score WHEN r <= 3 THEN 0.3 * score ELSE 0 END) AS base, bool_or(r = 1 AND ex) AS ex, bool_and(kind = 'Test' OR is_test) AS alltest, max(CASE WHEN r <= 3 THEN fi END) AS fi, bool_or(r <= 3 AND NOT tested) AS unt FROM rk GROUP BY file_path)
SELECT f.file_path, round(base * CASE WHEN f.ex THEN 1.5 ELSE 1 END * CASE WHEN alltest THEN 0.5 ELSE 1 END * CASE WHEN regexp_matches(f.file_path, '/(compiled|node_modules|\\.next|dist|vendor)/') THEN 0.5 ELSE 1 END * (1 + 0.15 * (ns - 1)) * CASE WHEN contains(lower(f.file_path), 'supplier1') THEN 1.3 ELSE 1 END * CASE WHEN fi > 5 THEN 1.1 ELSE 1 END * CASE WHEN unt AND fi > 3 THEN 1.15 ELSE 1 END, 6) AS score
FROM fs f JOIN src USING (file_path) ORDER BY score DESC, f.file_path LIMIT 1000""")
def fanout_files(g):
    parts, pool = _fanout(g)
    return search.score_files(g, pool, parts, 1000).select("file_path", F.round("score", 6).alias("score"))


@graph_query(LISTS_SQL + " SELECT q AS qualified_name, round(sum(CASE WHEN v = f THEN s ELSE 0.7 * s END), 6) AS score FROM (SELECT *, min(v) OVER (PARTITION BY q) AS f FROM (SELECT q, 0 AS v, CAST(1 AS DOUBLE) / (60 + rank) AS s FROM la UNION ALL SELECT q, 1, CAST(0.8 AS DOUBLE) / (60 + rank) FROM lb)) GROUP BY q")
def multi_view_merge(g):
    a, b = (search.fuse([search.channel(x, "c", 1.0, F.col("rank"))]) for x in _two_lists(g))
    return search.merge_views([(a, 1.0), (b, 0.8)]).select("qualified_name", F.round("score", 6).alias("score"))


@graph_query("SELECT qualified_name, sha256(concat_ws(' ', name, kind, language)) AS text_hash FROM nodes")
def node_text_hash(g):
    text = tx.node_text(F.col("name"), F.col("kind"), F.col("signature"), F.col("language"))
    return g.nodes.select("qualified_name", F.sha2(text, 256).alias("text_hash"))


@graph_query("SELECT file_path AS key, concat_ws(' ', file_path, language, coalesce(names, '')) AS text FROM (SELECT file_path, min(language) AS language FROM nodes GROUP BY file_path) JOIN (SELECT file_path AS fp, string_agg(name, ' ' ORDER BY r) AS names FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_start, qualified_name) AS r FROM nodes WHERE kind <> 'File') WHERE r <= 50 GROUP BY file_path) ON fp = file_path")
def file_text(g):
    return search.file_texts(g.nodes).filter(F.size(F.split("text", " ")) > 2)


@graph_query("SELECT CAST(count(*) FILTER (WHERE o.h IS NOT NULL) AS BIGINT) AS reused, CAST(count(*) FILTER (WHERE o.h IS NULL) AS BIGINT) AS embedded FROM (SELECT DISTINCT sha256(concat_ws(' ', kind, language)) AS h FROM nodes) n LEFT JOIN (SELECT DISTINCT sha256(concat_ws(' ', kind, language)) AS h FROM nodes WHERE kind IN ('File', 'Test')) o ON n.h = o.h")
def embed_reuse(g):
    text = F.concat_ws(" ", "kind", "language")
    old = search.embed(g.nodes.filter("kind in ('File', 'Test')").select(F.col("qualified_name").alias("key"), text.alias("text")), None, search.hash_provider(8), "hash")
    new = g.nodes.select(F.sha2(text, 256).alias("h")).distinct().withColumn("text_hash", F.substring("h", 1, 16))
    known = old.select("text_hash").distinct().withColumn("known", F.lit(True))
    return new.join(known, "text_hash", "left").agg(F.count_if(F.col("known").isNotNull()).alias("reused"), F.count_if(F.col("known").isNull()).alias("embedded"))


@graph_query("SELECT qualified_name AS key FROM nodes WHERE kind = 'Class' AND file_path NOT LIKE 'compiled/%'")
def stale_gc(g):
    stored = g.nodes.filter("kind = 'Class'").select(F.col("qualified_name").alias("key"))
    return search.live_only(stored, g.nodes.filter("file_path not like 'compiled/%'").select(F.col("qualified_name").alias("key")))


# retrieval with vectors --------------------------------------------------------------------
VECTORS_SQL = f""", q0 AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
nv AS (SELECT n.qualified_name AS key, v.embedding AS v FROM nodes n JOIN embeddings v ON n.kind = 'Function' AND CAST(string_split(n.name, '_')[-1] AS BIGINT) = v.vec_id),
fv AS (SELECT f.fp AS key, v.embedding AS v FROM f JOIN embeddings v ON f.nk + 1 = v.vec_id)"""


def _near_sql(table: str, limit: int) -> str:
    return f"SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT key, round({COS.format(a='v', b='(SELECT v FROM q0)')}, 4) AS score FROM {table} ORDER BY score DESC, key LIMIT {limit})"


def _vectors(spark: SparkSession, sf_dir: str, g: CodeGraph) -> search.Vectors:
    """Functions carry the vector of their customer, files that of their nation; the query that of id 0."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    fn = g.nodes.filter("kind = 'Function'").select(F.col("qualified_name").alias("key"), F.element_at(F.split("name", "_"), -1).cast("long").alias("vec_id"), F.lit("node").alias("level"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(".py")).alias("named"), (F.col("n_nationkey") + 1).cast("long").alias("vec_id"))
    files = g.nodes.filter("kind = 'File' and not is_test").select(F.col("file_path").alias("key"), F.split_part("file_path", F.lit("/"), F.lit(3)).alias("named"))
    stored = fn.unionByName(files.join(nations, "named").select("key", "vec_id", F.lit("file").alias("level"))).join(emb, "vec_id").select("key", "level", "vec")
    asked = [float(x) for x in emb.filter("vec_id = 0").first().vec]
    return search.Vectors(stored, lambda texts: [asked] * len(texts))


@query(G + VECTORS_SQL + f" SELECT key AS file_path, score FROM ({_near_sql('fv', 7)})")
def semantic_files(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return search.nearest_files(_vectors(spark, sf_dir, g), "anything", 7)


KEYWORDS_SQL = f"SELECT qualified_name AS key, row_number() OVER (ORDER BY round(score, 12) DESC, name, qualified_name) AS rank FROM ({relaxed_sql(tx.relaxed_words(LONG), 40)})"


@query(G + VECTORS_SQL + f", kw AS ({KEYWORDS_SQL}), sm AS ({_near_sql('nv', 40)}) SELECT key AS qualified_name, round(sum(s), 6) AS score FROM (SELECT key, CAST(0.8 AS DOUBLE) / (60 + rank) AS s FROM kw UNION ALL SELECT key, CAST(1.3 AS DOUBLE) / (60 + rank) FROM sm) GROUP BY key ORDER BY round(sum(s), 12) DESC, key LIMIT 20")
def hybrid_nodes(spark, sf_dir):
    """Node mode of a general question: words and vectors joined by ranks."""
    g = fixture.graph(spark, sf_dir)
    method, best = search.by_nodes(g, LONG, tx.classify(LONG), 20, _vectors(spark, sf_dir, g))
    assert method == "hybrid_rrf"
    return best.select("qualified_name", F.round("score", 6).alias("score"))


def _scaled_sql(table: str) -> str:
    return f"SELECT key, CASE WHEN hi > lo THEN (r - lo) / (hi - lo) ELSE 1 END AS s FROM (SELECT key, CAST(1 AS DOUBLE) / rank AS r, max(CAST(1 AS DOUBLE) / rank) OVER () AS hi, min(CAST(1 AS DOUBLE) / rank) OVER () AS lo FROM {table})"


@query(G + VECTORS_SQL + f", kw AS ({KEYWORDS_SQL}), sm AS ({_near_sql('nv', 40)}), a AS ({_scaled_sql('kw')}), b AS ({_scaled_sql('sm')}) SELECT coalesce(a.key, b.key) AS qualified_name, round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM a FULL OUTER JOIN b ON a.key = b.key ORDER BY round(0.5 * coalesce(a.s, 0) + 0.5 * coalesce(b.s, 0), 12) DESC, qualified_name LIMIT 20")
def hybrid_nodes_convex(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    _, best = search.by_nodes(g, LONG, tx.classify(LONG), 20, _vectors(spark, sf_dir, g), "cc")
    return best.select("qualified_name", F.round("score", 6).alias("score"))


@graph_query(f"SELECT qualified_name, round((CASE WHEN regexp_matches(qualified_name, '[/.]') THEN CAST(1.5 AS DOUBLE) ELSE 1 END) / (60 + rank), 6) AS score FROM (SELECT qualified_name, row_number() OVER (ORDER BY tier, name, qualified_name) AS rank FROM ({and_sql('src/asia', 30)})) ORDER BY 2 DESC, 1 LIMIT 15")
def hybrid_nodes_path(g):
    """Node mode of a path: words alone, names that look like paths raised."""
    method, best = search.by_nodes(g, "src/asia", tx.classify("src/asia"), 15)
    assert method == "keyword_path_boosted"
    return best.select("qualified_name", F.round("score", 6).alias("score"))


@query(G + VECTORS_SQL + FANOUT_SQL + f""", sm AS ({_near_sql('nv', 50)}), top AS ({_near_sql('fv', 10)}),
fm AS (SELECT n.qualified_name AS key, row_number() OVER (PARTITION BY n.file_path ORDER BY n.line_start, n.qualified_name) AS rank FROM nodes n JOIN top ON n.file_path = top.key)
SELECT q AS qualified_name, round(sum(s), 6) AS score, CAST(count(DISTINCT src) AS BIGINT) AS n_sources FROM (
  SELECT qualified_name AS q, 'r' AS src, CAST(0.8 AS DOUBLE) / (60 + rank) AS s FROM rel UNION ALL SELECT qualified_name, 'x', CAST(1 AS DOUBLE) / (60 + rank) FROM ex
  UNION ALL SELECT key, 's', CAST(1.3 AS DOUBLE) / (60 + rank) FROM sm UNION ALL SELECT key, 'f', CAST(1.3 AS DOUBLE) / (60 + rank) FROM fm) GROUP BY q""")
def fanout_with_vectors(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    found = search.fanout(g, tx.decompose(FANOUT), tx.classify(FANOUT).route, 10, vectors=_vectors(spark, sf_dir, g))
    return found.select("qualified_name", F.round("score", 6).alias("score"), F.size("sources").cast("long").alias("n_sources"))


# ranges -----------------------------------------------------------------------------------
RANGES_SQL = ", rg AS (SELECT fp AS file, CAST(nk * 10 + 1 AS INT) AS s, CAST(nk * 10 + 25 AS INT) AS z FROM f UNION ALL SELECT fp, CAST(nk * 3 + 200 AS INT), CAST(nk * 3 + 200 AS INT) FROM f)"


def _ranges(spark: SparkSession, sf_dir: str, g: CodeGraph) -> DataFrame:
    """Changed line ranges of source files, made of the number of the nation whose file it is."""
    files = g.nodes.filter("kind = 'File' and not is_test").select(F.col("file_path").alias("file"))
    named = F.split_part(F.col("file"), F.lit("/"), F.lit(3))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lower("n_name"), F.lit(".py")).alias("named"), F.col("n_nationkey").cast("int").alias("nk"))
    rows = files.join(nations, named == F.col("named"))
    one = rows.select("file", (F.col("nk") * 10 + 1).alias("start"), (F.col("nk") * 10 + 25).alias("end"))
    return one.unionByName(rows.select("file", (F.col("nk") * 3 + 200).alias("start"), (F.col("nk") * 3 + 200).alias("end")))


@query(G + RANGES_SQL + " SELECT DISTINCT n.qualified_name FROM nodes n JOIN rg ON n.file_path = rg.file AND n.line_start <= rg.z AND n.line_end >= rg.s WHERE n.kind <> 'File'")
def overlap_ranges(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    return context.nodes_in_ranges(g.nodes.filter("kind <> 'File'"), _ranges(spark, sf_dir, g)).select("qualified_name")


@query(G + RANGES_SQL + " SELECT file, s AS line, coalesce(q, file) AS enclosing FROM (SELECT rg.file, rg.s, arg_min(n.qualified_name, (n.line_end - n.line_start) * 1000000 + CAST(n.rn AS BIGINT)) AS q FROM rg LEFT JOIN (SELECT *, row_number() OVER (ORDER BY qualified_name) AS rn FROM nodes WHERE kind IN ('Function', 'Test')) n ON n.file_path = rg.file AND rg.s BETWEEN n.line_start AND n.line_end GROUP BY rg.file, rg.s)")
def enclosing_function(spark, sf_dir):
    g = fixture.graph(spark, sf_dir)
    lines = _ranges(spark, sf_dir, g).select("file", F.col("start").alias("line"))
    return context.enclosing(g.nodes, lines)


# names resolved inside files ----------------------------------------------------------------
@query(FACTS + " SELECT src AS source_qualified, dst AS target_qualified, file_path, line FROM ce")
def resolved_calls(spark, sf_dir):
    return facts.facts(spark, sf_dir).call_edges.select("source_qualified", "target_qualified", "file_path", "line")


@query(FACTS + " SELECT qn AS source_qualified, base AS target_qualified, CASE WHEN EXISTS (SELECT 1 FROM d y WHERE y.kind = 'Type' AND y.file_path = d.file_path AND y.name = string_split(d.base, '.')[-1]) THEN 'IMPLEMENTS' ELSE 'INHERITS' END AS kind, line_start AS line FROM d WHERE base IS NOT NULL")
def resolved_bases(spark, sf_dir):
    return facts.facts(spark, sf_dir).inheritance().select("source_qualified", "target_qualified", "kind", "line")


@query(FACTS + " SELECT src AS source_qualified, dst AS target_qualified, file_path, line FROM fx")
def fixture_calls(spark, sf_dir):
    return facts.facts(spark, sf_dir).fixtures().select("source_qualified", "target_qualified", "file_path", "line")


@query(FACTS + " SELECT target AS source_qualified, test AS target_qualified, line, phase FROM tb")
def tested_by_rules(spark, sf_dir):
    """By calls, by parameters and by names; phase tells which."""
    return facts.facts(spark, sf_dir).tested_by().select("source_qualified", "target_qualified", "line", "phase")


def _resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.resolve(projects.imports(spark, sf_dir), projects.files(spark, sf_dir), modules.alias_patterns(projects.configs(spark, sf_dir)))


@query(projects.SQL + " SELECT file_path, module, target FROM rs")
def resolved_imports(spark, sf_dir):
    """Imports of a project with configurations that extend others, and the files they mean."""
    return _resolved_imports(spark, sf_dir)


@query(projects.SQL + " SELECT target AS file_path, count(DISTINCT file_path) AS importers, count(DISTINCT module) AS spellings FROM rs GROUP BY target")
def importers_by_file(spark, sf_dir):
    """How many files import each file, by whatever module they name it."""
    return _resolved_imports(spark, sf_dir).groupBy(F.col("target").alias("file_path")).agg(F.countDistinct("file_path").alias("importers"), F.countDistinct("module").alias("spellings"))


@graph_query(""", s AS (SELECT file_path, greatest(line_start - 3, 0) AS a, least(line_end + 2, 420) AS z FROM nodes WHERE kind IN ('Function', 'Class', 'Type')),
m AS (SELECT *, max(z) OVER (PARTITION BY file_path ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT file_path, min(a) AS start_line, max(z) AS end_line FROM i GROUP BY file_path, g""")
def merge_ranges(g):
    return context.merged_ranges(g.nodes.filter("kind in ('Function', 'Class', 'Type')"), F.lit(420)).select("file_path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


# documents and pages ------------------------------------------------------------------------
@query("SELECT page_id, regexp_extract(html, '(?si)<script[^>]*>(.*?)</script>', 1) AS script FROM pages")
def script_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?si)<script[^>]*>(.*?)</script>", 1).alias("script"))


@query("SELECT page_id, regexp_extract(concat('<section name=\"intro\">', url, '</section>', html), '(?is)<section name=\"intro\">(.*?)</section>', 1) AS section FROM pages")
def docs_section(spark, sf_dir):
    doc = F.concat(F.lit('<section name="intro">'), "url", F.lit("</section>"), "html")
    return read(spark, sf_dir, "pages").select("page_id", context.section(doc, "intro").alias("section"))


def _page_paths(spark, sf_dir):
    from grapheion.sources.files import EXTENSIONS

    exts = sorted(EXTENSIONS)
    ext = F.element_at(F.array(*map(F.lit, [*exts, "xyz", "PY"])), (F.col("page_id") % (len(exts) + 2) + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/file."), ext).alias("path"))


def _ext_sql() -> str:
    from grapheion.sources.files import EXTENSIONS

    exts = [*sorted(EXTENSIONS), "xyz", "PY"]
    case = " ".join(f"WHEN '{x}' THEN '{lang}'" for x, lang in EXTENSIONS.items())
    return f"SELECT page_id, CASE lower(ext) {case} ELSE '' END AS language FROM (SELECT page_id, [{', '.join(repr(x) for x in exts)}][page_id % {len(exts)} + 1] AS ext FROM pages)"


@query(_ext_sql())
def language_by_ext(spark, sf_dir):
    from grapheion.sources.files import language_of

    return _page_paths(spark, sf_dir).select("page_id", F.coalesce(language_of(F.col("path")), F.lit("")).alias("language"))


@query(r"SELECT page_id, regexp_replace(replace(regexp_replace(concat('\\?\', replace(url, '/', '\'), '\'), '^(\\\\\?\\|//\?/)', ''), '\', '/'), '/+$', '') AS path FROM pages")
def path_normalize(spark, sf_dir):
    raw = F.concat(F.lit("\\\\?\\"), F.replace("url", F.lit("/"), F.lit("\\")), F.lit("\\"))
    return read(spark, sf_dir, "pages").select("page_id", tx.normalize_path(raw).alias("path"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def _versions(spark, sf_dir):
    """Two states of the documents as files: the new one drops some, adds some and edits some."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    old = docs.filter("doc_id % 7 <> 3").select("path", F.sha2("text", 256).alias("hash"))
    new = docs.filter("doc_id % 11 <> 5").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


VERSIONS_SQL = "WITH d AS (SELECT concat('doc_', doc_id) AS path, doc_id, coalesce(text, '') AS text FROM documents), o AS (SELECT path, sha256(text) AS hash FROM d WHERE doc_id % 7 <> 3), n AS (SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS hash FROM d WHERE doc_id % 11 <> 5)"


@query(VERSIONS_SQL + " SELECT path FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = n.path AND o.hash = n.hash)")
def hash_skip(spark, sf_dir):
    return maintain.changed_files(*_versions(spark, sf_dir)).select("path")


@query(VERSIONS_SQL + " SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash")
def body_hash_diff(spark, sf_dir):
    return maintain.diff(*_versions(spark, sf_dir), "path", "hash")


@query("WITH d AS (SELECT source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS naive, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN octet_length(encode(coalesce(text, ''))) WHEN doc_id % 10 = 1 THEN octet_length(encode(coalesce(text, ''))) // 4 ELSE 0 END) AS BIGINT) AS context FROM documents GROUP BY source) SELECT source, naive, context, round(1 - context / CAST(naive AS DOUBLE), 4) AS reduction FROM d")
def token_reduction(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (F.col("doc_id") % 10 == 0).alias("changed"), (F.col("doc_id") % 10 == 1).cast("int").alias("impacted"))
    return context.token_reduction(docs, "source")


# events --------------------------------------------------------------------------------------
@query("SELECT path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'update' END AS op, hash FROM (SELECT CAST(user_id AS VARCHAR) AS path, event_type, sha256(props) AS hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_event_per_path(spark, sf_dir):
    from grapheion.streaming import watch

    return watch.last_per_path(watch.as_file_events(read(spark, sf_dir, "events"))).select("path", "op", "hash")


@query("SELECT path, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT CAST(user_id AS VARCHAR) AS path, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY path, session")
def debounce_sessions(spark, sf_dir):
    from grapheion.streaming import watch

    return watch.debounced(watch.as_file_events(read(spark, sf_dir, "events")), 3600)


@query("SELECT path, hash FROM (SELECT CAST(user_id AS VARCHAR) AS path, event_type, sha256(props) AS hash, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def stream_replay_state(spark, sf_dir):
    """The events replayed as a stream in several batches; the state equals the batch result."""
    from grapheion.streaming import watch

    return watch.replay(spark, f"{sf_dir}/events.parquet", batches=4)


@query("WITH l AS (SELECT concat('u', user_id, '.py') AS p, event_type AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error') SELECT p AS file_path, 'File' AS kind, p AS qualified_name FROM l UNION ALL SELECT p, 'Function', concat(p, '::on_', t) FROM l")
def stream_graph_nodes(spark, sf_dir):
    """Events replayed as edits of one source file a user: parsed in the stream, the graph equals that of the last contents."""
    from grapheion.streaming import watch

    def content(events: DataFrame) -> DataFrame:
        code = F.concat(F.lit("def on_"), "event_type", F.lit("():\n    return 0\n"))
        return events.select(F.concat(F.lit("u"), "user_id", F.lit(".py")).alias("path"), F.when(F.col("event_type") == "error", "remove").otherwise("update").alias("op"), "ts", "event_id", code.alias("content"))

    return watch.replay_graph(spark, f"{sf_dir}/events.parquet", content, batches=3).nodes.select("file_path", "kind", "qualified_name")


@query("WITH r AS (SELECT doc_id, quality, toxic, doc_id % 9 + 1 AS rank FROM labels) SELECT quality, toxic, CAST(count(*) AS BIGINT) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5, round(avg(1.0 / rank), 6) AS mrr FROM r GROUP BY ROLLUP (quality, toxic)")
def eval_metrics(spark, sf_dir):
    ranks = read(spark, sf_dir, "labels").withColumn("rank", F.col("doc_id") % 9 + 1)
    return context.retrieval_metrics(ranks, ["quality", "toxic"])
