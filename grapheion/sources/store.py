"""Stored graphs and vectors: base files and segments under numbered commits, settings, exports."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapheion.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, CodeGraph
from grapheion.sources.commits import Commits, Conflict, filesystem, path_of
from grapheion.sources.files import STORE_DIR

EMBEDDING_SCHEMA = "key string, level string, provider string, model string, dims int, text_hash string, vec array<float>"
#: The last event of each path that a stream has applied.
STATE_SCHEMA = "file_path string, ts timestamp, event_id long, op string"
SETTINGS = ["provider", "api_key", "model", "git_timeout", "watch_debounce_ms"]
STALE_SECONDS = 2
#: A compacted table has files of about so many bytes.
FILE_BYTES = 128 << 20
#: Changed names after which vectors of vanished nodes and files go.
GARBAGE_AFTER = 500
#: Commits whose folders stay, so that readers of the last ones can finish.
VERSIONS = 2
#: The base is cut by file_path into so many buckets at least.
BUCKETS = 16
#: Segments are merged into the base when they are so many, or hold so large a share of the base's bytes and this much.
SEGMENTS, SHARE, LEAST_BYTES = 16, 0.25, 8 << 20
#: A base in more folders than this is rewritten whole when it is compacted.
BASES = 8


class GraphStore:
    """A graph as base files and the changes since, log-structured.

        <folder>/commits/<n>                             JSON: what version n consists of
        <folder>/b-<id>/{nodes,edges_raw,state}/bucket=  base, cut by a hash of file_path
        <folder>/s-<id>/{files,nodes,edges_raw,state}    one change: files replaced or removed, and what stands there now
        <folder>/e-<id>                                  vectors

    An update writes a segment, whose bytes are those of the changed files, and a commit. Readers
    take each file's rows from the last segment that names it, else from the base. Compaction
    merges segments into the buckets they touch and leaves all other buckets where they are.
    Commits are numbered and created once (``Commits``): readers always find a whole version, and
    of two writers of one number the second notices. It goes on top of the first if the first
    touched none of its files, else it gets ``Conflict`` and leaves nothing. A writer that dies
    leaves folders that no commit names; ``vacuum`` deletes them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda name: path_of(spark, f"{self.folder}/{name}")
        self._fs, self._commits = filesystem(spark, self.folder), Commits(spark, f"{self.folder}/commits")

    # versions ----------------------------------------------------------------
    def version(self) -> int:
        return self._commits.last()

    def head(self, version: int | None = None) -> dict:
        """What a version consists of; the last one by default."""
        version = self.version() if version is None else version
        empty = {"base": [], "buckets": BUCKETS, "segments": [], "metadata": {}, "streams": {}, "embeddings": None, "did": ["nothing"]}
        return empty if version < 0 else json.loads(self._commits.text(version))

    def _commit(self, since: int, change: Callable[[dict], dict], own: list[str], files: DataFrame | None = None, rebase: bool = True) -> None:
        """Make the version after ``since``, or after those that others made meanwhile where that changes nothing for us."""
        try:
            while True:
                last = self.version()
                if last > since and not (rebase and self._apart(since, last, files)):
                    raise Conflict(f"{self.folder}: version {since} was changed by another writer")
                since = last
                try:
                    self._commits.commit(last + 1, json.dumps(change(self.head(last))))
                    break
                except Conflict:
                    continue
        except Exception:
            for folder in own:
                self._fs.delete(self._path(folder), True)
            raise
        self._forget()

    def _apart(self, since: int, last: int, files: DataFrame | None) -> bool:
        """Whether none of the versions after ``since`` replaced the graph or touched ``files``."""
        for v in range(since + 1, last + 1):
            did, *folders = self.head(v)["did"]
            if did == "write":
                return False
            if did == "update" and files is not None and self._files(folders[0]).join(files, "file_path", "left_semi").limit(1).count():
                return False
        return True

    @staticmethod
    def _folders(head: dict) -> set[str]:
        return {b for b, _ in head["base"]} | set(head["segments"]) | ({head["embeddings"]} - {None})

    def _forget(self) -> None:
        """Delete what only old versions name. Folders that no version names yet are another writer's."""
        numbers = self._commits.numbers()
        old, kept = numbers[:-VERSIONS], numbers[-VERSIONS:]
        named = set().union(*(self._folders(self.head(v)) for v in kept))
        for v in old:
            for folder in self._folders(self.head(v)) - named:
                self._fs.delete(self._path(folder), True)
        self._commits.forget(kept[0])

    def vacuum(self) -> list[str]:
        """Delete folders that no version names; only while nobody else writes."""
        named = set().union(*(self._folders(self.head(v)) for v in self._commits.numbers()))
        found = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        gone = sorted(f for f in found if re.match("[bse]-", f) and f not in named)
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        return gone

    # reading -----------------------------------------------------------------
    def _files(self, segment: str) -> DataFrame:
        return self.spark.read.schema("file_path string").parquet(f"{self.folder}/{segment}/files")

    def _touched(self, head: dict) -> DataFrame:
        """(file_path, seq): the last segment that names a file."""
        parts = [self._files(s).withColumn("seq", F.lit(i)) for i, s in enumerate(head["segments"])]
        return reduce(DataFrame.unionByName, parts).groupBy("file_path").agg(F.max("seq").alias("seq"))

    def _base(self, head: dict, name: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the base with their bucket; only the folders of ``buckets`` are read."""
        out = None
        for folder, mine in head["base"]:
            mine = mine if buckets is None else sorted(set(mine) & set(buckets))
            if not mine or not self._fs.exists(self._path(f"{folder}/{name}")):
                continue
            df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.folder}/{folder}/{name}").filter(F.col("bucket").isin(mine))
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])) if out is None else out

    def _segments(self, head: dict, name: str, schema: T.StructType) -> DataFrame | None:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{s}/{name}").withColumn("seq", F.lit(i)) for i, s in enumerate(head["segments"])]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _table(self, head: dict, name: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """Live rows: of each file those of the last segment that names it, else those of the base."""
        base, changes = self._base(head, name, schema, buckets).select(*schema.names), self._segments(head, name, schema)
        if changes is None:
            return base
        touched = self._touched(head)
        if buckets is not None:
            touched = touched.filter(self._bucket(head["buckets"]).isin(buckets))
        live = changes.join(touched, ["file_path", "seq"], "left_semi")
        return base.join(touched.select("file_path"), "file_path", "left_anti").select(*schema.names).unionByName(live.select(*schema.names))

    def _state(self, head: dict, buckets: list[int] | None = None) -> DataFrame:
        """The last event of each file, from base and segments; the newest counts, in whatever order they came."""
        schema = T._parse_datatype_string(STATE_SCHEMA)
        base, changes = self._base(head, "state", schema, buckets).select(*schema.names), self._segments(head, "state", schema)
        if changes is None:
            return base
        if buckets is not None:
            changes = changes.filter(self._bucket(head["buckets"]).isin(buckets))
        newest = F.max(F.struct("ts", "event_id", "op")).alias("e")
        return base.unionByName(changes.select(*schema.names)).groupBy("file_path").agg(newest).select("file_path", "e.*")

    @staticmethod
    def _bucket(n: int) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(n)).cast("int")

    def read(self, version: int | None = None) -> CodeGraph:
        """The stored graph; an empty one where nothing is stored."""
        head = self.head(version)
        return CodeGraph(self._table(head, "nodes", NODE_SCHEMA), self._table(head, "edges_raw", EDGE_SCHEMA))

    def read_files(self, paths: list[str]) -> CodeGraph:
        """The graph of a few files: only their buckets of the base are opened."""
        head = self.head()
        rows = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        buckets = sorted({r.b for r in rows.select(self._bucket(head["buckets"]).alias("b")).distinct().collect()})
        named = F.col("file_path").isin(paths)
        return CodeGraph(self._table(head, "nodes", NODE_SCHEMA, buckets).filter(named), self._table(head, "edges_raw", EDGE_SCHEMA, buckets).filter(named))

    def state(self) -> DataFrame:
        """file_path, ts, event_id, op of the last event applied to each file."""
        return self._state(self.head())

    def metadata(self) -> dict[str, str]:
        return self.head()["metadata"]

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is part of the graph."""
        return self.head()["streams"].get(stream, -1)

    # writing -----------------------------------------------------------------
    def _save(self, df: DataFrame, path: str, buckets: int | None = None) -> None:
        """Buckets are dealt by hash and split where one is large."""
        if buckets is not None:
            df = df.withColumn("bucket", self._bucket(buckets)).hint("rebalance", "bucket")
        out = df.write.option("compression", "zstd")
        (out if buckets is None else out.partitionBy("bucket")).parquet(f"{self.folder}/{path}")

    @staticmethod
    def _stamped(head: dict, metadata: dict[str, str]) -> dict[str, str]:
        return head["metadata"] | {"last_updated": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())} | metadata

    def write(self, graph: CodeGraph, files: dict[str, int] | None = None, **metadata: str) -> None:
        """Replace the whole graph; ``files``: how many buckets the base gets. What streams applied before is kept as it was."""
        since, base = self.version(), f"b-{uuid.uuid4().hex[:12]}"
        head = self.head(since)
        n = max([BUCKETS, *(files or {}).values()])
        for name, df in (("nodes", graph.nodes), ("edges_raw", graph.edges_raw), ("state", self._state(head))):
            self._save(df, f"{base}/{name}", n)
        whole = lambda h: h | {"base": [[base, list(range(n))]], "buckets": n, "segments": [], "metadata": self._stamped(h, metadata), "did": ["write"]}
        self._commit(since, whole, [base], rebase=False)

    def update(self, files: DataFrame, nodes: DataFrame, edges_raw: DataFrame, state: DataFrame | None = None, stream: str | None = None, batch: int = -1, since: int | None = None, **metadata: str) -> None:
        """Put nodes and edges in the place of all that ``files`` (file_path) held; files without either are removed.

        ``state`` (file_path, ts, event_id, op) and the stream's batch number become part of the same version.
        """
        since, segment = self.version() if since is None else since, f"s-{uuid.uuid4().hex[:12]}"
        state = self.spark.createDataFrame([], STATE_SCHEMA) if state is None else state
        for name, df in (("files", files.select("file_path").distinct()), ("nodes", nodes.select(*NODE_SCHEMA.names)), ("edges_raw", edges_raw.select(*EDGE_SCHEMA.names)), ("state", state)):
            self._save(df, f"{segment}/{name}")
        streams = {} if stream is None else {stream: batch}
        more = lambda h: h | {"segments": [*h["segments"], segment], "streams": h["streams"] | streams, "metadata": self._stamped(h, metadata), "did": ["update", segment]}
        touched = self._files(segment).unionByName(self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.folder}/{segment}/state").select("file_path"))
        self._commit(since, more, [segment], touched)

    def _bytes(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(f)).getLength() for f in folders)

    def tidy(self) -> bool:
        """Compact if segments have become many or large."""
        head = self.head()
        due = len(head["segments"]) > SEGMENTS or self._bytes(head["segments"]) > max(LEAST_BYTES, SHARE * self._bytes([b for b, _ in head["base"]]))
        if due:
            self.compact()
        return due

    def compact(self) -> None:
        """Merge segments into the buckets they touch; a base in many folders, or too large for its buckets, is rewritten."""
        since = self.version()
        head = self.head(since)
        wanted = max(BUCKETS, 1 << (self._bytes([b for b, _ in head["base"]]) // FILE_BYTES).bit_length())
        if not head["base"] or len(head["base"]) > BASES or wanted > 2 * head["buckets"]:
            n, buckets = max(wanted, head["buckets"]), None
        elif not head["segments"]:
            return
        else:
            n = head["buckets"]
            touched = self._touched(head).select("file_path").unionByName(self._segments(head, "state", T._parse_datatype_string(STATE_SCHEMA)).select("file_path"))
            buckets = sorted(r.b for r in touched.select(self._bucket(n).alias("b")).distinct().collect())
        base = f"b-{uuid.uuid4().hex[:12]}"
        for name, schema in (("nodes", NODE_SCHEMA), ("edges_raw", EDGE_SCHEMA)):
            self._save(self._table(head, name, schema, buckets), f"{base}/{name}", n)
        self._save(self._state(head, buckets), f"{base}/state", n)
        merged = set(head["segments"])
        stay = [] if buckets is None else [[b, left] for b, mine in head["base"] if (left := sorted(set(mine) - set(buckets)))]

        def change(h: dict) -> dict:
            # segments that others added meanwhile stay on top
            return h | {"base": [*stay, [base, list(range(n)) if buckets is None else buckets]], "buckets": n, "segments": [s for s in h["segments"] if s not in merged], "did": ["compact"]}

        if any(self.head(v)["did"][0] == "compact" for v in range(since + 1, self.version() + 1)):
            self._fs.delete(self._path(base), True)
            return
        self._commit(since, change, [base])

    def collect_garbage(self, graph: CodeGraph, changes: int) -> bool:
        """Count changed names; from GARBAGE_AFTER on drop the vectors of what the graph no longer holds."""
        head = self.head()
        pending = int(head["metadata"].get("changes_since_gc", "0")) + changes
        due = pending >= GARBAGE_AFTER and head["embeddings"] is not None
        if due:
            keys = graph.nodes.select(F.col("qualified_name").alias("key"), F.lit("node").alias("level")).unionByName(graph.nodes.select(F.col("file_path").alias("key"), F.lit("file").alias("level"))).distinct()
            self.write_embeddings(self.embeddings().join(keys, ["key", "level"], "left_semi"))
        self.note(changes_since_gc=str(0 if due else pending))
        return due

    def note(self, **values: str) -> None:
        """Set metadata."""
        if self.version() >= 0:
            self._commit(self.version(), lambda h: h | {"metadata": h["metadata"] | values, "did": ["note"]}, [])

    def reset_embeddings(self, provider: str) -> int:
        """Drop the vectors of other providers; returns how many stay."""
        if self.head()["embeddings"] is not None:
            self.write_embeddings(self.embeddings().filter(F.col("provider") == provider))
        return self.embeddings().count()

    def is_fresh(self) -> bool:
        """Updated less than two seconds ago."""
        stamp = self.metadata().get("last_updated")
        return stamp is not None and time.time() - _seconds(stamp) < STALE_SECONDS

    def embeddings(self) -> DataFrame:
        """Vectors of all stored layouts; columns that older files lack are null."""
        folder = self.head()["embeddings"]
        if folder is None:
            return self.spark.createDataFrame([], EMBEDDING_SCHEMA)
        return self.spark.read.schema(EMBEDDING_SCHEMA).option("mergeSchema", "true").parquet(f"{self.folder}/{folder}")

    def write_embeddings(self, df: DataFrame) -> None:
        """Replace the vectors; of two writers at a time the second gets Conflict."""
        columns = [c.split() for c in EMBEDDING_SCHEMA.split(", ")]
        before, fresh = self.head()["embeddings"], f"e-{uuid.uuid4().hex[:12]}"
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns]).write.parquet(f"{self.folder}/{fresh}")

        def change(h: dict) -> dict:
            if h["embeddings"] != before:
                raise Conflict(f"the vectors of {self.folder} were changed by another writer")
            return h | {"embeddings": fresh, "did": ["vectors"]}

        self._commit(self.version(), change, [fresh])


def _seconds(stamp: str) -> float:
    import calendar

    return calendar.timegm(time.strptime(stamp, "%Y-%m-%dT%H:%M:%S"))


def find_root(path: str | None = None) -> str:
    """An explicit folder must hold a repository or a store; else the nearest folder above with .git, else here."""
    marks = (".git", STORE_DIR)
    if path is not None:
        if not os.path.isdir(path) or not any(os.path.exists(os.path.join(path, m)) for m in marks):
            raise ValueError(f"{path} is no repository and holds no store")
        return os.path.abspath(path)
    at = os.path.abspath(os.getcwd())
    while not os.path.exists(os.path.join(at, ".git")):
        up = os.path.dirname(at)
        if up == at:
            return os.path.abspath(os.getcwd())
        at = up
    return at


def store_folder(root: str) -> str:
    """The store below root; it ignores itself in version control."""
    folder = os.path.join(root, STORE_DIR)
    os.makedirs(folder, exist_ok=True)
    ignore = os.path.join(folder, ".gitignore")
    if not os.path.exists(ignore):
        with open(ignore, "w", encoding="utf8") as f:
            f.write("*\n")
    return f"file://{folder}/graph"


def settings(root: str) -> dict[str, str]:
    """Known settings of <store>/config.json; the environment (GRAPHEION_<NAME>) goes before the file."""
    path, found = os.path.join(root, STORE_DIR, "config.json"), {}
    if os.path.exists(path):
        with open(path, encoding="utf8") as f:
            found = {k: str(v) for k, v in json.load(f).items() if k in SETTINGS}
    return found | {k: v for k in SETTINGS if (v := os.environ.get(f"GRAPHEION_{k.upper()}")) is not None}


def set_setting(root: str, name: str, value: str) -> None:
    """Write one setting to <store>/config.json, readable by its owner alone; unknown entries stay."""
    store_folder(root)
    path, found = os.path.join(root, STORE_DIR, "config.json"), {}
    if os.path.exists(path):
        with open(path, encoding="utf8") as f:
            found = json.load(f)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf8") as f:
        json.dump(found | {name: value}, f, indent=2)


def export(graph: CodeGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes distinct by name and edges distinct by ends and kind."""
    return graph.by_name, graph.edges_distinct.select("src", "dst", "kind")


def html(graph: CodeGraph, limit: int | None = None) -> str:
    """A page that draws the graph: all of it, or the first ``limit`` nodes and every link among them.

    The page is one string, so nodes and links pass the driver row by row.
    """
    nodes, edges = export(graph)
    if limit is not None:
        nodes = nodes.orderBy("qualified_name").limit(limit).cache()
        shown = nodes.select("qualified_name")
        edges = edges.join(shown.toDF("src"), "src", "left_semi").join(shown.toDF("dst"), "dst", "left_semi")
    one = [{"id": r.qualified_name, "name": r.name, "kind": r.kind} for r in nodes.orderBy("qualified_name").toLocalIterator()]
    links = [{"source": r.src, "target": r.dst, "kind": r.kind} for r in edges.orderBy("src", "dst", "kind").toLocalIterator()]
    data = json.dumps({"nodes": one, "links": links})
    if limit is not None:
        nodes.unpersist()
    return _PAGE.replace("@DATA@", data.replace("</", "<\\/"))


_PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>Code graph</title>
<style>body{margin:0;font:13px sans-serif}canvas{display:block}</style><canvas id="c"></canvas>
<script>
const g=@DATA@,c=document.getElementById("c"),x=c.getContext("2d");
c.width=innerWidth;c.height=innerHeight;
const hue={File:210,Class:20,Function:120,Type:280,Test:50},at={};
g.nodes.forEach((n,i)=>{const a=i*2.39996,r=6*Math.sqrt(i);at[n.id]=[c.width/2+r*Math.cos(a),c.height/2+r*Math.sin(a)]});
x.strokeStyle="rgba(120,120,120,.25)";
g.links.forEach(l=>{const a=at[l.source],b=at[l.target];if(a&&b){x.beginPath();x.moveTo(...a);x.lineTo(...b);x.stroke()}});
g.nodes.forEach(n=>{x.fillStyle=`hsl(${hue[n.kind]||0},70%,45%)`;x.beginPath();x.arc(...at[n.id],3,0,7);x.fill()});
c.onmousemove=e=>{const n=g.nodes.find(n=>Math.hypot(at[n.id][0]-e.x,at[n.id][1]-e.y)<4);c.title=n?n.kind+" "+n.id:""};
</script>"""
