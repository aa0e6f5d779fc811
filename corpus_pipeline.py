"""Training-corpus pipeline: quality rules, near-duplicate removal, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a
stage returns as Parquet and reads it again for the next. All but the last return
the columns of documents.

* quality_rules: documents that the base rules or the boosted trees reject go.
* near_dup: of every component of near copies the document with the least id
  stays (rows that repeat its id and text count as one and stay one; rows without an
  id are documents of their own, judged each by its text).
* suffix_dedup: strings of 100 bytes that occur earlier are cut from the texts;
  every document stays, n_chars is made anew.
* packing: pieces of power-of-two length, as digests.

Null or empty texts fail the base rules. No SQL expresses these stages, so
ORACLE_SQL is None and tests compare with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm import near_dup, packing, quality, suffix_dedup
from grapheion.llm.common import table, written

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.keep(docs, quality.fit(docs, labels))


def near_dup_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    digest, kept_id, kept_digest = map(free, ("text_digest", "kept_id", "kept_digest"))
    judged = near_dup.judged(docs).select("doc_id", "digest", "kept")
    repeats = judged.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").limit(1).count()
    stay = judged.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    left = docs.withColumn(digest, near_dup.text_digest()).join(stay, same, "left_semi")
    if repeats:
        once = left.filter("doc_id is not null").dropDuplicates(["doc_id", digest])
        left = once.unionByName(left.filter("doc_id is null"))
    return left.drop(digest)


def suffix_dedup_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dup", near_dup_removal),
    ("suffix_dedup", suffix_dedup_removal),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
