"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) is cut into pieces whose
lengths are powers of two: as many full sequences of ``max_len`` as fit, then
one piece for each set bit of the rest, longest first. Every piece is a
sequence of its own, so no sequence crosses documents and none needs padding;
sequences of equal length share a bucket, from which batches of even shape can
be drawn.

One map over the documents does all the work: no shuffle, no state beyond a
batch, and a lost executor only repeats its own partitions. Sequence ids are
``bucket * 2**55 + partition * 2**34 + running number``: unique, and sorted by
them equal lengths lie together.

Defined cases: null or empty text gives one piece that holds the end id;
repeated rows are packed each for itself; a null doc_id stays null; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm import wordtokens
from grapheion.llm.common import binary_column, chunks, ship, table, texts_of

MAX_LEN = 2048
END_ID = 1

_SCHEMA = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"


def decompose(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of ``n`` tokens, in order."""
    full, rest = divmod(n, max_len)
    return [max_len] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids (binary: little-endian unsigned 32-bit), one row each."""
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")
    ship(docs.sparkSession)
    path = tokenizer_path or wordtokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = wordtokens.encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 34, 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                cols: list[list] = [[] for _ in range(7)]
                for doc, text in zip(ids[lo:hi], texts[lo:hi], strict=True):
                    data = enc.ids(text) + end
                    at, n = 0, len(data) // 4
                    for length in decompose(n, max_len):
                        bucket = length.bit_length() - 1
                        for c, v in zip(cols, (doc, at, length, n, bucket, (bucket << 55) + base + made, data[4 * at : 4 * (at + length)]), strict=True):
                            c.append(v)
                        at += length
                        made += 1
                d, s, ln, n_, bk, sq, data_ = cols
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, long), pa.array(s, long), pa.array(ln, long), pa.array(n_, long), pa.array(bk, pa.int32()), pa.array(sq, long), pa.array(np.zeros(len(d), np.int64)), binary_column(data_)],
                    names=["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"],
                )

    return texts_of(docs).mapInArrow(run, _SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
