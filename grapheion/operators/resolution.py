"""Names resolved inside files, as joins of what the files say.

Three fact tables come from a reader, one row a statement:

* definitions: file_path, language, ordinal, kind, name, owner, line_start, line_end, is_test, signature, bases (array)
* imports: file_path, ordinal, module, names (array), line
* calls: file_path, ordinal, name, line

``ordinal`` is the place of a row among its file's rows of that table. A name means its first
definition of the file; an imported name means the last import that brings it. Every join is on
(file, name) or (file, cell), and what answers for a name is an aggregate, so a file that holds
a third of all rows is spread over all tasks. A null name resolves to nothing; rows without a
file are dropped; extra columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grapheion.operators import context
from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, CodeGraph
from grapheion.operators.lineage import cut

#: Parts of a path that make it a test file; affixes of test names.
TEST_PATHS = ["test_", "_test.", ".test.", ".spec.", "_spec.", "/tests/", "/test/"]
TEST_PREFIX, TEST_SUFFIX = "^(?:test_|Test|test)", "(?:_test|_spec|Test|Spec)$"
# End of fixed values.


def is_test_path(path: Column) -> Column:
    found = F.lit(False)
    for part in TEST_PATHS:
        found = found | F.replace(path, F.lit("\\"), F.lit("/")).contains(part)
    return found


def tested_name(name: Column) -> Column:
    """The name that a test's name speaks of, in small letters."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, TEST_PREFIX, ""), TEST_SUFFIX, ""))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"[.:\\]+"), -1)


def _edge(df: DataFrame, source: Column, target: Column, kind: Column | str, line: str = "line", *more: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(source.alias("source_qualified"), target.alias("target_qualified"), kind.alias("kind"), "file_path", F.col(line).cast("int").alias("line"), *more)


@dataclass
class FileFacts:
    """The fact tables, and the edges that follow from them."""

    definitions: DataFrame
    imports: DataFrame
    calls: DataFrame

    def __post_init__(self):
        more = [c for c in ("docstring", "body_hash") if c in self.definitions.columns]
        self.definitions = self.definitions.select("file_path", "language", "ordinal", "kind", "name", "owner", "line_start", "line_end", "is_test", "signature", "bases", *more)
        self.imports = self.imports.select("file_path", "ordinal", "module", "names", "line")
        self.calls = self.calls.select("file_path", "ordinal", "name", "line")

    @cached_property
    def named(self) -> DataFrame:
        """Definitions with their qualified names; members are named below their owner, classes are not."""
        member = (F.col("owner") != "") & F.col("kind").isin("Function", "Test", "Type")
        name = F.when(member, F.concat("owner", F.lit("."), "name")).otherwise(F.col("name"))
        return self.definitions.filter("file_path is not null").withColumn("qualified_name", F.concat("file_path", F.lit("::"), name))

    @cached_property
    def symbols(self) -> DataFrame:
        """(file_path, name, symbol): the first definition of a name."""
        return self.named.groupBy("file_path", "name").agg(F.min_by("qualified_name", "ordinal").alias("symbol"))

    @cached_property
    def brought(self) -> DataFrame:
        """(file_path, name, module): the last import that brings a name."""
        each = self.imports.select("file_path", "ordinal", "module", F.explode("names").alias("name"))
        return each.groupBy("file_path", "name").agg(F.max_by("module", "ordinal").alias("module"))

    @cached_property
    def tests(self) -> DataFrame:
        """(file_path, qualified_name, name, signature, language, line): one row a test, the last of its name."""
        one = self.named.filter("is_test and kind = 'Test'").groupBy("file_path", "qualified_name")
        last = one.agg(F.max_by(F.struct("name", "signature", "language", F.col("line_start").alias("line")), "ordinal").alias("t"))
        return last.select("file_path", "qualified_name", "t.*")

    def contains(self) -> DataFrame:
        owner = F.when((F.col("owner") != "") & (F.col("kind") != "Class"), F.concat("file_path", F.lit("::"), "owner")).otherwise(F.col("file_path"))
        return _edge(self.named, owner, F.col("qualified_name"), "CONTAINS", "line_start")

    def inheritance(self) -> DataFrame:
        """A base whose last part names a type of the same file is implemented, any other is inherited."""
        bases = self.named.select("file_path", "qualified_name", F.col("line_start").alias("line"), F.explode("bases").alias("base"))
        types = self.named.filter("kind = 'Type'").select("file_path", F.col("name").alias("last"), F.lit(True).alias("is_type")).distinct()
        joined = bases.withColumn("last", last_segment(F.col("base"))).join(types, ["file_path", "last"], "left")
        return _edge(joined, F.col("qualified_name"), F.col("base"), F.when(F.col("is_type"), "IMPLEMENTS").otherwise("INHERITS"))

    def imported(self) -> DataFrame:
        return _edge(self.imports.filter("file_path is not null"), F.col("file_path"), F.col("module"), "IMPORTS_FROM")

    @cached_property
    def call_edges(self) -> DataFrame:
        """Calls from the narrowest function around them to the symbol, the imported name or the bare name.

        A symbol's call of itself at its own place is left out. ``ordinal`` is kept beside the columns of edges.
        """
        calls = self.calls.filter("file_path is not null")
        around = context.enclosing(self.named, calls.select(F.col("file_path").alias("file"), "line")).select(F.col("file").alias("file_path"), "line", "enclosing")
        joined = calls.join(around, ["file_path", "line"]).join(self.symbols, ["file_path", "name"], "left").join(self.brought, ["file_path", "name"], "left")
        target = F.coalesce("symbol", F.concat("module", F.lit("::"), "name"), "name")
        return _edge(joined, F.col("enclosing"), target, "CALLS", "line", F.col("ordinal")).filter("source_qualified <> target_qualified")

    def fixtures(self) -> DataFrame:
        """Python tests call the functions of their file that their parameters name; the last of a name counts."""
        head = F.element_at(F.split("signature", "->"), 1)
        asked = self.tests.filter("language = 'python'").select("file_path", "qualified_name", "line", F.explode(F.regexp_extract_all(head, F.lit(r"(?U)[(,]\s*(\w+)"), F.lit(1))).alias("name"))
        plain = self.named.filter("kind = 'Function'").groupBy("file_path", "name").agg(F.max_by("qualified_name", "ordinal").alias("function"))
        return _edge(asked.join(plain, ["file_path", "name"]), F.col("qualified_name"), F.col("function"), "CALLS")

    def _by_calls(self) -> DataFrame:
        calls = self.call_edges.withColumn("phase", F.lit(0)).unionByName(self.fixtures().withColumns({"phase": F.lit(1), "ordinal": F.lit(0)}))
        tests = self.tests.filter(is_test_path(F.col("file_path"))).select("file_path", F.col("qualified_name").alias("source_qualified"))
        mine = calls.join(tests, ["file_path", "source_qualified"], "left_semi")
        mine = mine.join(tests.withColumnRenamed("source_qualified", "target_qualified"), ["file_path", "target_qualified"], "left_anti")
        return mine.select("file_path", F.col("target_qualified").alias("target"), F.col("source_qualified").alias("test"), "phase", "ordinal", "line")

    def _by_names(self) -> DataFrame:
        plain = self.named.filter("not is_test").withColumn("short", F.lower("name")).groupBy("file_path", "short").agg(F.max_by("qualified_name", "ordinal").alias("target"))
        tests = self.tests.filter(is_test_path(F.col("file_path"))).withColumn("short", tested_name(F.col("name")))
        return tests.join(plain, ["file_path", "short"]).select("file_path", "target", F.col("qualified_name").alias("test"), F.lit(2).alias("phase"), F.lit(0).cast("long").alias("ordinal"), "line")

    def tested_by(self) -> DataFrame:
        """In test files, what a test calls and what its name speaks of is tested by it, each pair once.

        ``phase`` tells whether calls (0), parameters (1) or the name alone (2) say so; the line is that of the first call.
        """
        pair = self._by_calls().unionByName(self._by_names()).groupBy("file_path", "target", "test")
        first = pair.agg(F.min(F.struct("phase", "ordinal", "line")).alias("f"))
        return _edge(first.select("*", F.col("f.line").alias("line"), F.col("f.phase").alias("phase")), F.col("target"), F.col("test"), "TESTED_BY", "line", F.col("phase"))

    def edges(self, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """All edges of the files, with names resolved inside them; ``keep`` stores the calls, which are used twice."""
        self.call_edges = keep(self.call_edges)
        parts = [self.contains(), self.inheritance(), self.imported(), self.call_edges, self.fixtures(), self.tested_by()]
        out = parts[0].select(*EDGE_SCHEMA.names)
        for p in parts[1:]:
            out = out.unionByName(p.select(*EDGE_SCHEMA.names))
        return out


def graph_of(files: DataFrame, facts: FileFacts) -> CodeGraph:
    """Nodes and edges of read files (file_path, language, n_lines, file_hash) and their facts.

    node_id is a hash of the path above and the place in the file below; definitions need
    docstring and body_hash besides the columns of the module's head. Edges are computed at once and kept.
    """
    high = F.shiftleft(F.conv(F.substring(F.sha2(F.encode("file_path", "UTF-8"), 256), 1, 10), 16, 10).cast("long"), 23)
    whole = files.select(high.alias("node_id"), F.col("file_path").alias("name"), F.col("file_path").alias("qualified_name"), F.lit("File").alias("kind"), "file_path", F.lit(1).alias("line_start"), F.col("n_lines").cast("int").alias("line_end"), "language", is_test_path(F.col("file_path")).alias("is_test"), F.lit("").alias("docstring"), F.lit("").alias("signature"), F.col("file_hash").alias("body_hash"), "file_hash")
    parts = facts.named.join(files.select("file_path", "file_hash"), "file_path").withColumn("node_id", high + F.col("ordinal") + 1)
    return CodeGraph(whole.select(*NODE_SCHEMA.names).unionByName(parts.select(*NODE_SCHEMA.names)), cut(facts.edges(cut)))
