"""Quality rules: document statistics and gradient-boosted trees over them.

Statistics of a batch come from numpy passes over its bytes: words are maximal
runs outside space and \\t..\\r, repeated three-word windows are found by sorting
64-bit window hashes (a chance collision inside one document has odds below
1e-9 at a million words). The trees are fitted on the driver on a bounded,
hash-ordered sample of labelled documents (``SAMPLE_ROWS``); counts and
statistics always cover whole texts of all documents. More symbols, repeated
lines, repeated words or capitals can never raise a score (monotone
constraints).

A document is kept if it passes the base rules and the trees give it at least
``threshold``. Defined cases: null or empty text has no words and fails the
base rules; without labels of both classes only the base rules decide; repeated
rows are judged alike; null doc_ids pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm import boosted
from grapheion.llm.common import arrow_map, chunks, ship, table, texts_of

#: Most labelled documents the trees are fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: name -> direction in which the score may move as the feature grows.
FEATURES = {
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 0,
    "capital_share": -1,
    "digit_share": 0,
    "exclamation_share": -1,
    "words_per_line": 0,
    "log_words": 0,
}

_KIND = np.zeros(256, np.uint8)  # 1 space, 2 symbol, 4 capital, 8 digit, 16 exclamation, 32 continuation byte
for _b in b" \t\n\x0b\x0c\r":
    _KIND[_b] |= 1
for _b in SYMBOLS:
    _KIND[_b] |= 2
_KIND[ord("A") : ord("Z") + 1] |= 4
_KIND[ord("0") : ord("9") + 1] |= 8
_KIND[ord("!")] |= 16
_KIND[0x80:0xC0] |= 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text: the base counts and what the features need, as int64 arrays."""
    n = len(texts)
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    kind = _KIND[raw]
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def total(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return s[ends] - s[starts]

    space = (kind & 1).astype(bool)
    begins = ~space
    begins[1:] &= space[:-1]
    words = buffer.split()
    count = total(begins)
    doc = np.repeat(np.arange(n, dtype=np.uint64), count)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    repeat = np.zeros(len(words) + 2, bool)
    if len(words) >= 3:
        with np.errstate(over="ignore"):
            key = _mix(_mix(_mix(h[:-2] + doc[:-2] * _MIX) + h[1:-1]) + h[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        key = key[inside]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for d in range(3):
            repeat[at + d] = True
    with np.errstate(over="ignore"):
        own = np.sort(_mix(h + doc * _MIX) >> np.uint64(24) | doc << np.uint64(40)) if n < 1 << 24 else None
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    dup = np.empty(n, np.int64)
    lines = np.empty(n, np.int64)
    for i, t in enumerate(texts):
        ls = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines[i] = len(ls)
        dup[i] = len(ls) - len(set(ls))
    d64 = doc.astype(np.int64)
    return {
        "n_words": count,
        "word_chars": total(~space & (kind & 32 == 0)),
        "n_symbols": total((kind & 2).astype(bool)),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(d64[repeat[:-2]], minlength=n).astype(np.int64),
        "n_lines": lines,
        "n_distinct": np.bincount((own[fresh] >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.int64),
        "n_capitals": total((kind & 4).astype(bool)),
        "n_digits": total((kind & 8).astype(bool)),
        "n_exclamations": total((kind & 16).astype(bool)),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    w, c, ln = (np.maximum(s[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    cols = {
        "mean_word_chars": s["word_chars"] / w,
        "symbols_per_word": s["n_symbols"] / w,
        "dup_line_share": s["n_dup_lines"] / ln,
        "repeat_word_share": s["n_repeat_words"] / w,
        "distinct_word_share": s["n_distinct"] / w,
        "capital_share": s["n_capitals"] / c,
        "digit_share": s["n_digits"] / c,
        "exclamation_share": s["n_exclamations"] / c,
        "words_per_line": s["n_words"] / ln,
        "log_words": np.log1p(s["n_words"]),
    }
    return np.stack([cols[f] for f in FEATURES], axis=1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> boosted.Forest | None:
    """Trees from the labelled documents whose ids hash lowest; None without both classes."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("label")).filter("label_id is not null and label in (0, 1)")
    # at most sample_rows rows of two numbers: safe to broadcast
    known = F.broadcast(known.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows))
    rows = texts_of(docs).join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")

    def run(b: pa.RecordBatch):
        texts = _bytes_of(b.column(1))
        for lo, hi in chunks(texts):
            x = features(statistics(texts[lo:hi]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    # one row a labelled document; a repeated document id adds nothing but its first row
    seen = arrow_map(rows, run, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("r")).orderBy("doc_id").limit(sample_rows).collect()
    y = np.array([r.r.label for r in seen], float)
    if len(set(y.tolist())) < 2:
        return None
    return boosted.train(np.array([r.r.x for r in seen]), y, np.array(list(FEATURES.values())))


_VERDICT = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("score", "double"), ("kept", "boolean")]


def _judged(texts: list[bytes], forest: boosted.Forest | None, threshold: float) -> list[pa.Array]:
    s = statistics(texts)
    failed = base_failed(s)
    score = forest.probability(features(s)) if forest is not None else np.ones(len(texts))
    return [*(pa.array(s[k]) for k, _ in _VERDICT[:5]), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]


def judge(docs: DataFrame, forest: boosted.Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every document."""
    ship(docs.sparkSession)
    names = ["doc_id", *(k for k, _ in _VERDICT)]

    def run(b: pa.RecordBatch):
        texts = _bytes_of(b.column(1))
        for lo, hi in chunks(texts):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *_judged(texts[lo:hi], forest, threshold)], names=names)

    return arrow_map(texts_of(docs), run, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in _VERDICT))


def keep(docs: DataFrame, forest: boosted.Forest | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The kept documents with all their columns, in one pass."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch):
        texts = _bytes_of(b.column(at))
        for lo, hi in chunks(texts):
            yield b.slice(lo, hi - lo).filter(_judged(texts[lo:hi], forest, threshold)[-1])

    return arrow_map(docs, run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
