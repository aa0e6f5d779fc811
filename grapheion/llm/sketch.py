"""Threshold-scaled sketches of five-word shingles, in DataFrame functions only.

A sketch keeps every distinct 64-bit shingle hash below a fixed fraction
(``1 / SCALE``) of the hash range, so its size follows the document, sketches of
parts merge by union, and the containment of a small document in a large one is
estimated without bias from what both kept. A text whose shingles all lie above
the threshold keeps its smallest hash instead, so that only texts without words
have an empty sketch; such a stand-in is told by lying above the threshold, gives
way to real hashes on merging, and can be found only in another stand-in. At the
scale of 4 a text of ten shingles has none but a stand-in once in 18 cases, one of 25
shingles once in 1300.

Words are runs outside space and \\t..\\r, as they stand. A text of fewer words
than a shingle is one shingle of all its words.

``likeness`` is max-containment: hashes in both sketches over the size of the
smaller; 1 for two empty sketches, 0 if only one is empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.llm.common import table, texts_of

SHINGLE_WORDS = 5
SCALE = 4
#: Ranges of doc_id for each shuffle partition; their bounds are one array literal.
RANGES_PER_PARTITION = 4


def _words(text: Column) -> Column:
    # plain replacements and a one-character split avoid the regular-expression engine
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def shingle_hashes(text: Column, width: int = SHINGLE_WORDS) -> Column:
    """64-bit hash of every shingle, with repetition; an empty array without words.

    Words are hashed once; a shingle hashes the hashes of its words.
    """
    hashed = F.transform(_words(text), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.aggregate(h, F.lit(width).cast("long"), lambda a, x: F.xxhash64(a, x)))
        slid = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[h[i + d] for d in range(width)]))
        return F.when(n >= width, slid).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    # a one-element transform binds the word hashes to a variable, so they are made once
    return F.transform(F.array(hashed), windows)[0]


def _top(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale - 1


def sketch(text: Column, width: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below the threshold, or the least hash if none is."""
    top = _top(scale)

    def cut(h: Column) -> Column:
        low = F.filter(h, lambda x: x <= F.lit(top))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(shingle_hashes(text, width)), cut)[0]


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    low = F.filter(both, lambda x: x <= F.lit(_top(scale)))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(smaller > 0, both / smaller).otherwise(F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0))


def as_text(s: Column) -> Column:
    """A sketch as one string, equal for equal sketches: 16 hex digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _constant(values: list[int]) -> Column:
    """An array that the optimizer folds into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def with_next(docs: DataFrame, carried: list[str], ranges: int | None = None) -> DataFrame:
    """Each row with ``next_<c>`` of the next document in descending doc_id; the last one's next is the first.

    Bounds are doc_ids that exist (approximate quantiles and the largest), in one array
    literal of as many values as there are ranges; a row finds its range in steps of the
    square root of their number. A range holds the ids above the bound before it up
    to its own bound, so the largest id of a range is its bound; rows at a bound
    are copied to the range above, where they follow the last row (the largest id
    of all goes to the lowest range). One shuffle of the rows, no global sort.
    Null ids come last; equal ids are ordered by ``carried``.
    """
    ranges = ranges or RANGES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10000).alias("q"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(stats.q or []), *([stats.top] if stats.top is not None else [])})
    last = max(0, len(bounds) - 1)
    place, at_bound = F.lit(0), F.lit(stats.top is None)  # no id at all: one range, whose first row follows its last
    if bounds:
        # found in two steps: among every step-th bound, then among the bounds from there
        step = math.isqrt(len(bounds)) + 1
        below = lambda part: F.size(F.filter(part, lambda b: b < F.col("doc_id")))
        coarse = below(_constant(bounds[step - 1 : -1 : step])) * step if len(bounds) > step else F.lit(0)
        fine = F.transform(F.array(coarse), lambda c: c + below(F.slice(_constant(bounds), c + 1, F.lit(step))))[0]
        place = F.coalesce(F.least(fine, F.lit(last)), F.lit(0)).cast("int")
        at_bound = F.coalesce(F.element_at(_constant(bounds), F.col("_range") + 1) == F.col("doc_id"), F.lit(False))
    own = F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))
    after = F.struct(F.when(F.col("_range") == last, 0).otherwise(F.col("_range") + 1).alias("range"), F.lit(1).alias("copy"))
    dealt = docs.withColumn("_range", place).withColumn("_at", F.explode(F.when(at_bound, F.array(own, after)).otherwise(F.array(own))))
    w = Window.partitionBy("_at.range").orderBy(F.col("_at.copy"), F.col("doc_id").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in carried])
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("_at.copy = 0").drop("_at", "_range")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's. Null text counts as empty.
    """
    own = texts_of(docs).withColumn("sk", sketch(F.col("text")))
    rows = with_next(own, ["text", "sk"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", 1, n - half), F.substring(F.coalesce("next_text", F.lit("")), 1, half)))
    rows = rows.withColumn("edited_sk", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )


def op8_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
