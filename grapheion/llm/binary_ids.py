"""Token ids in flat binary files.

Format, below one folder:

* ``ids-NNNNN-*.bin``: the ids of one partition's documents, flat little-endian
  unsigned integers (16 bits where the vocabulary allows, else 32);
* ``docs-NNNNN-*.idx``: little-endian int64 doc ids, then as many + 1 unsigned
  64-bit offsets (in ids) into the file of the same number;
* the manifest (a DataFrame, one row a file): number, paths, width, documents,
  documents without id, ids, and ``base``, the ids in all files before it, from
  a prefix sum over the manifest.

Partitions are ranges of doc_id, sorted, so files in order hold the documents
in ascending doc_id order. A task writes under a name of its own attempt and
reports it in the manifest; what a lost or speculative attempt leaves is not in
the manifest and is never read. Readers memory-map local folders; for other
stores a worker copies one pair of files at a time and unlinks it once mapped.

Defined cases: null text counts as empty (only the end id); a null doc_id sorts
first and stays null; repeated rows are kept, ordered by text; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.llm import wordtokens
from grapheion.llm.common import chunks, shared_dir, ship, table, texts_of, written

END_ID = 1

MANIFEST = "number int, ids_path string, idx_path string, width int, n_docs long, n_null long, n_ids long"


def _local(path: str) -> str | None:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else None


def _create(path: str):
    """A binary file for writing, on a local path or any store pyarrow knows."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def _mapped(path: str, dtype: str) -> np.ndarray:
    """The file as a memory-mapped array."""
    local, own = _local(path), None
    if local is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        handle, own = tempfile.mkstemp()
        with store.open_input_stream(inner) as src, os.fdopen(handle, "wb") as dst:
            while block := src.read(1 << 24):
                dst.write(block)
        local = own
    try:
        return np.memmap(local, dtype, "r") if os.path.getsize(local) else np.empty(0, dtype)
    finally:
        if own:
            os.unlink(own)


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the files; returns the manifest with ``base``."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer_path or wordtokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordtokens.encoder(path)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        number = TaskContext.get().partitionId()
        name = f"{number:05d}-{uuid.uuid4().hex}"
        out, doc_ids, counts, nulls = None, [], [], 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            if not ids:
                continue
            out = out or _create(f"{folder}/ids-{name}.bin")
            for lo, hi in chunks(texts):
                for doc, text in zip(ids[lo:hi], texts[lo:hi], strict=True):
                    data = enc.ids(text)
                    if width == 2:
                        data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
                    out.write(data)
                    out.write(end)
                    counts.append(len(data) // width + 1)
                    nulls += doc is None
                    doc_ids.append(doc or 0)
        if out is None:
            return
        out.close()
        offsets = np.zeros(len(counts) + 1, "<u8")
        np.cumsum(counts, out=offsets[1:])
        with _create(f"{folder}/docs-{name}.idx") as f:
            f.write(np.array(doc_ids, "<i8").tobytes())
            f.write(offsets.tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"number": number, "ids_path": f"{folder}/ids-{name}.bin", "idx_path": f"{folder}/docs-{name}.idx", "width": width, "n_docs": len(counts), "n_null": nulls, "n_ids": int(offsets[-1])}],
            schema=pa.schema([("number", pa.int32()), ("ids_path", pa.string()), ("idx_path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]),
        )

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts_of(docs).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = written(rows.mapInArrow(run, MANIFEST))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (binary)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = r["n_docs"]
                idx = _mapped(r["idx_path"], "<u8")
                docs, offsets = idx[:n].view("<i8"), idx[n:]
                ids = _mapped(r["ids_path"], f"<u{r['width']}")
                for lo in range(0, n, 4096):
                    hi = min(n, lo + 4096)
                    parts = [ids[a:z].astype("<u4").tobytes() for a, z in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
                    cols = [
                        pa.array(docs[lo:hi].tolist(), pa.int64(), mask=np.arange(lo, hi) < r["n_null"]),
                        pa.array(offsets[lo:hi].astype(np.int64) + r["base"]),
                        pa.array(np.diff(offsets[lo : hi + 1]).astype(np.int64)),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array(parts, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    spread = manifest.select("number", "ids_path", "idx_path", "width", "n_docs", "n_null", "base")
    return spread.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "number").mapInArrow(run, schema)


def op7_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, shared_dir(spark)))
