"""Late arrivals overwrite whole days: new files of a new generation, a new manifest, then the old files go.

A ``DatedTable`` holds the latest-arrived row of each key, one folder a day and generation:

    <folder>/data/layout_day=<day>/layout_gen=<generation>-<writer>/<number>.parquet
    <folder>/manifests/<generation>-<writer>/  the files that generation consists of (Parquet)
    <folder>/commits/<generation>              created if absent; names the writer

``overwrite`` takes rows that arrived late. Days in which a late row comes to stand, or from which
its key moves away, are written anew by executors under the new generation's name; the manifest
lists them beside the files of all other days, which nobody opens for writing; the commit makes it
the table. Only then the driver deletes the superseded files, path by path from the manifest before.
Whoever reads by the manifest sees the old or the new table. Of two writers of one generation the
second fails at the commit and removes what it wrote. A writer that dies before the commit leaves
files that no manifest lists and no reader sees; ``vacuum`` deletes them.

A day is sorted by time and key and cut into files of ``file_rows`` rows. Days may be of any size:
rows are dealt by range over all tasks, row numbers in a day come from prefix sums over (task, day),
and each file is written by one task, in row groups of bounded size. Task attempts write to names
of their own and rename when a file is whole, so attempts that fail or run twice do no harm.

Ties of arrival are settled by the other columns, in order, nulls least. Rows without a key count
as one key; rows without a time stand on day -1, first in order; rows without an arrival are older
than all others. Repeated rows collapse to one; an empty table has no files; a day left empty has
no folder entry. Extra columns are kept, clashing ones too. Columns must be comparable (no maps).
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grapheion.llm.binary_ids import _create, _local
from grapheion.llm.common import shared_dir, ship, table, written
from grapheion.sources.commits import Commits, Conflict, filesystem, path_of

#: A row group is closed at so many rows or bytes.
GROUP_ROWS, GROUP_BYTES = 1 << 17, 32 << 20
MANIFEST = "layout_day long, layout_gen string, file_no long, n_rows long, path string"
#: Early rows of the query arrived before this.
EARLY = "2024-03-20 00:00:00"
#: The query cuts files of 1 + rows / FILES rows.
FILES = 1100


def day_of(time: Column, kind: T.DataType) -> Column:
    """Whole days since 1970; -1 without a time. Times without a zone are taken as they are."""
    if isinstance(kind, T.TimestampType):
        days = F.floor(F.unix_micros(time) / F.lit(86_400_000_000))
    else:
        days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date"))
    return F.coalesce(days.cast("long"), F.lit(-1).cast("long"))


def _renamed(src: str, dst: str) -> None:
    """Move a finished file to its name."""
    if (at := _local(src)) is not None:
        os.makedirs(os.path.dirname(_local(dst)), exist_ok=True)
        os.replace(at, _local(dst))
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(src)
    _, target = fs.FileSystem.from_uri(dst)
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    store.move(inner, target)


class _File:
    """One Parquet file, written in row groups of bounded size and renamed when whole."""

    def __init__(self, folder: str, generation: str, name: str, schema: pa.Schema):
        self.path, self._temp = f"{folder}/data/{name}", f"{folder}/unfinished/{generation}/{uuid.uuid4().hex}"
        self._out = _create(self._temp)
        self._writer = pq.ParquetWriter(self._out, schema, compression="zstd")
        self._parts, self._rows, self._bytes, self.n_rows = [], 0, 0, 0

    def add(self, part: pa.RecordBatch) -> None:
        self._parts.append(part)
        self._rows += part.num_rows
        self._bytes += part.nbytes
        self.n_rows += part.num_rows
        if self._rows >= GROUP_ROWS or self._bytes >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._parts:
            self._writer.write_table(pa.Table.from_batches(self._parts), row_group_size=GROUP_ROWS)
        self._parts, self._rows, self._bytes = [], 0, 0

    def close(self) -> None:
        self._flush()
        self._writer.close()
        self._out.close()
        _renamed(self._temp, self.path)


class DatedTable:
    """Rows by key and day in files of fixed size; see above."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, time: str, arrived: str, file_rows: int):
        ship(spark)
        self.spark, self.folder, self.schema, self.file_rows = spark, folder.rstrip("/"), schema, file_rows
        self.key, self.time, self.arrived = key, time, arrived
        self._path = lambda name: path_of(spark, f"{self.folder}/{name}")
        self._fs, self._commits = filesystem(spark, self.folder), Commits(spark, f"{self.folder}/commits")

    # manifests -------------------------------------------------------------
    def generation(self) -> int:
        """The last generation that was committed; -1 where there is none."""
        return self._commits.last()

    def name(self) -> str:
        """<generation>-<writer> of the last generation."""
        return self._commits.text(self.generation())

    def manifest(self) -> DataFrame:
        """layout_day, layout_gen, file_no, n_rows, path of every file of the table."""
        if self.generation() < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{self.name()}")

    def _commit(self, generation: int, name: str) -> None:
        """Make ``name`` the table, or remove all its files if another writer was first."""
        self._fs.delete(self._path(f"unfinished/{name}"), True)
        try:
            self._commits.commit(generation, name)
        except Conflict:
            _, gen_name = self._layout_columns()
            for day in self._fs.globStatus(self._path(f"data/*/{gen_name}={name}")) or []:
                self._fs.delete(day.getPath(), True)
            self._fs.delete(self._path(f"manifests/{name}"), True)
            raise

    # rows --------------------------------------------------------------------
    def read(self) -> DataFrame:
        """The table's rows with layout_day and layout_gen, by the manifest."""
        return self._read()[0].select(*self.schema.names)

    def _read(self) -> tuple[DataFrame, str, str]:
        """Rows and the names of the day and generation columns, which differ from all of the table's."""
        names = self._layout_columns()
        inner = T.StructType([*self.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.StringType())])
        if not self._fs.exists(self._path("data")):
            return self.spark.createDataFrame([], inner), *names
        live = self.manifest().select(F.col("layout_day").alias(names[0]), F.col("layout_gen").alias(names[1])).distinct()
        return self.spark.read.schema(inner).parquet(f"{self.folder}/data").join(live, names, "left_semi"), *names

    def _layout_columns(self) -> list[str]:
        """Folder names cannot clash with columns: they get underscores until they differ."""
        taken = {n.lower() for n in self.schema.names}
        out = []
        for n in ("layout_day", "layout_gen"):
            while n in taken:
                n += "_"
            out.append(n)
        return out

    def latest(self, rows: DataFrame) -> DataFrame:
        """The latest-arrived row of each key: (k, row); an aggregate, so hot keys combine before the shuffle."""
        first = [self.arrived, *[c for c in self.schema.names if c != self.arrived]]
        return rows.select(F.col(self.key).alias("k"), F.struct(*[F.col(c) for c in first]).alias("row")).groupBy("k").agg(F.max("row").alias("row"))

    def _day(self, row: str) -> Column:
        return day_of(F.col(f"{row}.{self.time}"), self.schema[self.time].dataType)

    # writing -----------------------------------------------------------------
    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        """Files of (day, row): numbered in each day, dealt by file; returns their manifest rows."""
        order = [F.col("day"), F.col(f"row.{self.time}").asc_nulls_first(), F.col(f"row.{self.key}").asc_nulls_first()]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        dealt = written(dealt.select("day", "row", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
        # one row a task and a day that it holds: at most as many as tasks and days together
        heads = dealt.groupBy("day", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
        before = Window.partitionBy("day").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        heads = heads.select("day", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
        file_no = F.floor((F.col("at") + F.col("shift")) / F.lit(self.file_rows)).cast("long")
        numbered = dealt.join(heads, ["day", "task"]).select("day", file_no.alias("file_no"), "row")
        placed = numbered.repartition(n, "day", "file_no").sortWithinPartitions("day", "file_no", *order[1:])
        flat = placed.select(F.col("day").alias("_0"), F.col("file_no").alias("_1"), *[F.col(f"row.{c}").alias(f"c{i}") for i, c in enumerate(self.schema.names)])
        folder, names, (day_name, gen_name) = self.folder, self.schema.names, self._layout_columns()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, at, done = None, None, []

            def finish() -> None:
                if file is not None:
                    file.close()
                    done.append({"layout_day": at[0], "layout_gen": name, "file_no": at[1], "n_rows": file.n_rows, "path": file.path})

            schema = pa.schema([("layout_day", pa.int64()), ("layout_gen", pa.string()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("path", pa.string())])
            for b in batches:
                if not b.num_rows:
                    continue
                days, files = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                data = pa.RecordBatch.from_arrays(b.columns[2:], names=names)
                cuts = np.flatnonzero((np.diff(days) != 0) | (np.diff(files) != 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                    here = (int(days[lo]), int(files[lo]))
                    if here != at:
                        finish()
                        at = here
                        file = _File(folder, name, f"{day_name}={at[0]}/{gen_name}={name}/{at[1]:06d}.parquet", data.schema)
                    file.add(data.slice(lo, hi - lo))
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done.clear()
            finish()
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)

        return written(flat.mapInArrow(run, MANIFEST))

    def _next(self) -> tuple[int, str]:
        generation = self.generation() + 1
        return generation, f"{generation:09d}-{uuid.uuid4().hex[:12]}"

    def _list(self, name: str, *parts: DataFrame) -> None:
        out = parts[0].select(*[c.split()[0] for c in MANIFEST.split(", ")])
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.parquet(f"{self.folder}/manifests/{name}")

    def create(self, rows: DataFrame) -> None:
        """The table's first generation: the latest row of each key."""
        if self.generation() >= 0:
            raise ValueError(f"{self.folder} holds a table")
        generation, name = self._next()
        latest = self.latest(rows).select(self._day("row").alias("day"), "row")
        self._list(name, self._write(latest, name))
        self._commit(generation, name)

    def overwrite(self, late: DataFrame) -> None:
        """Merge rows that arrived late; only the days that they touch are written anew."""
        generation, name = self._next()
        before = self.manifest()
        stored, day_name, _ = self._read()
        ordered = [self.arrived, *[c for c in self.schema.names if c != self.arrived]]
        stored = stored.select(F.col(day_name).alias("old_day"), F.col(self.key).alias("k"), F.struct(*ordered).alias("old"))
        fresh = self.latest(late)
        # keys are unique on both sides; a late row wins where nothing stands or what stands arrived earlier
        won = fresh.join(stored.withColumnRenamed("k", "stored_k"), F.col("k").eqNullSafe(F.col("stored_k")), "left")
        won = written(won.filter("old is null or row > old").select("k", "row", self._day("row").alias("day"), "old_day"))
        dirty = written(won.select(F.explode(F.array("day", "old_day")).alias("day")).filter("day is not null").distinct())
        stay = stored.join(dirty.withColumnRenamed("day", "old_day"), "old_day", "left_semi")
        stay = stay.join(won.select(F.col("k").alias("won_k")), F.col("k").eqNullSafe(F.col("won_k")), "left_anti")
        files = self._write(stay.select(F.col("old_day").alias("day"), F.col("old").alias("row")).unionByName(won.select("day", "row")), name)
        gone = dirty.withColumnRenamed("day", "layout_day")
        self._list(name, before.join(gone, "layout_day", "left_anti"), files)
        self._commit(generation, name)
        for r in before.join(gone, "layout_day", "left_semi").select("path").toLocalIterator():
            path = path_of(self.spark, r.path)
            self._fs.delete(path, False)
            if not self._fs.listFiles(path.getParent(), False).hasNext():
                self._fs.delete(path.getParent(), True)

    def vacuum(self) -> int:
        """Delete data files that the manifest does not list (of writers that died); returns how many."""
        self._fs.delete(self._path("unfinished"), True)
        if not self._fs.exists(self._path("data")):
            return 0
        tail = lambda c: F.substring_index(c, "/", -3).alias("tail")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.folder}/data").select("path", tail(F.col("path")))
        n = 0
        for r in found.join(self.manifest().select(tail(F.col("path"))), "tail", "left_anti").select("path").toLocalIterator():
            n += bool(self._fs.delete(path_of(self.spark, r.path), False))
        return n


def with_copies(sales: DataFrame) -> DataFrame:
    """The rows and, for a third of the sales of every fourth day, a changed copy that arrives 1 to 97 days later."""
    h = F.crc32(F.col("sale_id").cast("string"))
    day = day_of(F.col("sold_at"), sales.schema["sold_at"].dataType)
    later = lambda c, days: (F.col(c) + F.make_dt_interval(days.cast("int"))).cast(sales.schema[c].dataType)
    change = {"total": F.col("total") + 1, "sold_at": later("sold_at", h % 2), "arrived_at": later("arrived_at", 1 + h % 97)}
    same = F.struct(*sales.columns)
    copy = F.struct(*[change[c].alias(c) if c in change else F.col(c) for c in sales.columns])
    both = F.when((h % 3 == 0) & (day % 4 == 0), F.array(same, copy)).otherwise(F.array(same))
    return sales.select(F.explode(both).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in sales.columns])


def file_digests(files: DataFrame, last_name: str) -> DataFrame:
    """What the query returns of each listed file, read batch by batch."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("path", pa.string()), ("columns", pa.string()), ("ids_sha256", pa.string()), ("rewritten", pa.bool_())])

    def opened(path: str):
        if (at := _local(path)) is not None:
            return pq.ParquetFile(at)
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return pq.ParquetFile(store.open_input_file(inner))

    def one(r: dict) -> dict:
        file = opened(r["path"])
        rows = cents = crc = 0
        ids = hashlib.sha256()
        for b in file.iter_batches(1 << 14, columns=["sale_id", "sold_at", "arrived_at", "total"]):
            text = ["" if x is None else str(x) for x in b["sale_id"].to_pylist()]
            micros = [["" if x is None else x for x in b[c].cast(pa.timestamp("us", b[c].type.tz)).cast(pa.int64()).to_pylist()] for c in ("sold_at", "arrived_at")]
            ids.update(("," * (rows > 0) + ",".join(text)).encode())
            rows += b.num_rows
            crc += sum(zlib.crc32(f"{i}:{s}:{a}".encode()) for i, s, a in zip(text, *micros, strict=True))
            cents += sum(math.floor(100 * t + 0.5) for t in b["total"].to_pylist() if t is not None and math.isfinite(t))
        return {"day": r["layout_day"], "file_no": r["file_no"], "n_rows": rows, "cents": cents, "rows_crc": crc, "path": r["path"], "columns": ",".join(file.schema_arrow.names), "ids_sha256": ids.hexdigest(), "rewritten": r["layout_gen"] == last_name}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pylist([one(r) for r in b.to_pylist()], schema=schema)

    return files.repartition(n, "path").mapInArrow(run, "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean")


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    rows = with_copies(sales)
    early = F.col("arrived_at") < F.lit(EARLY).cast(sales.schema["arrived_at"].dataType)
    stored = DatedTable(spark, shared_dir(spark, keep=True), sales.schema, "sale_id", "sold_at", "arrived_at", 1 + sales.count() // FILES)
    stored.create(rows.filter(early))
    stored.overwrite(rows.filter(~F.coalesce(early, F.lit(False))))
    return file_digests(stored.manifest(), stored.name())
