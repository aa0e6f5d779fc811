"""Shared plumbing of the corpus operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a worker; bounds Python memory whatever the Arrow batch holds.
CHUNK_CHARS = 1_000_000
#: Most rows Spark hands to a worker at once; whole documents make wide rows.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once a session."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if getattr(sc, "_grapheion_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.basename(root)
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{top}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join(top, os.path.relpath(full, root)))
    sc.addPyFile(path)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._grapheion_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, keep: bool = False) -> str:
    """A fresh path below the folder the cluster names in spark.checkpoint.dir.

    It is removed when the driver ends, unless ``keep`` says that its files are a result. Only
    where that setting is absent (tests, local runs) a folder of our own is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='grapheion-')}"
        atexit.register(shutil.rmtree, base[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/grapheion-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        if path.startswith("file:"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts become empty; every other column is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of ``texts`` of about ``limit`` characters each, at least one text."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with a function from a record batch to tables or batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def binary_column(values: list) -> pa.Array:
    return pa.array(values, type=pa.binary())


def ragged(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row number of each element, given each row's first element."""
    out = np.zeros(len(rows) + 1, np.int64)
    np.add.at(out, starts, 1)
    return np.cumsum(out[:-1]) - 1
