import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from grapheion.llm import sketch


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def contained(a, b):
    a, b = shingles(a), shingles(b)
    small = min(len(a), len(b))
    return len(a & b) / small if small else float(len(a) == len(b))


def make(n, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["Ab", "cé", "d", "e\x0b", "fG", "h\x85i", "ö"]) for _ in range(rng.randrange(0, 60))) for _ in range(8)]
    return [(rng.randrange(-50, 50) * 3, rng.choice([*pool, None, "", "one two", "🙂 \n x"]), "c", 1) for _ in range(n)]


@pytest.mark.parametrize("n,ranges", [(0, 4), (1, 4), (2, 1), (40, 7), (60, 64)])
def test_next_text_and_edits(spark, n, ranges):
    rows = make(n, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, next_text string, copy int")
    got = sketch.with_next(sketch.texts_of(docs), ["text"], ranges).collect()
    want = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (-r[0], r[1].encode()))
    chain = [(*r, want[(i + 1) % len(want)][1]) for i, r in enumerate(want)]
    assert sorted(map(tuple, got)) == sorted(chain)


def test_full_sketch_gives_exact_containment(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(make(40, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sk", sketch.sketch(F.coalesce("text", F.lit("")), scale=1))
    pairs = docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    for r in pairs.select("a.text", F.col("b.text").alias("other"), sketch.likeness(F.col("a.sk"), F.col("b.sk")).alias("near")).collect():
        assert r.near == pytest.approx(contained(r.text or "", r.other or ""))


def test_query_columns(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(make(30, 4))] + [(100, "w%d " * 1 % 1 + " ".join(f"w{i}" for i in range(20000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sketch.fingerprint_edits(docs).collect()}
    order = sorted(rows, reverse=True)
    by_text = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (not shingles(t))
    assert len(got[100].fingerprint) / 16 == pytest.approx(20000 / sketch.SCALE, rel=0.15)


def test_estimates_are_close(spark):
    words = [f"w{i}" for i in range(12000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[3000:6000])), (3, " ".join(words[3000:4500] + [f"z{i}" for i in range(1500)]))], "doc_id long, text string")
    s = {r.doc_id: r.s for r in docs.select("doc_id", sketch.sketch(F.col("text")).alias("s")).collect()}
    near = lambda a, b: len(set(s[a]) & set(s[b])) / min(len(s[a]), len(s[b]))
    assert near(1, 2) == 1 and near(1, 3) == pytest.approx(0.5, abs=0.12)


def test_query_columns_are_close_to_exact(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    order = sorted(rows, reverse=True)
    off = []
    for r in sketch.op8_sketch(spark, "/root/testdata/sf0.01").collect():
        text = rows[r.doc_id]
        following = rows[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        off += [abs(r.near_edited - contained(text, edited)), abs(r.near_next - contained(text, following))]
    off.sort()
    assert sum(off) / len(off) < 0.03 and off[int(len(off) * 0.95)] < 0.15


def test_merged_sketches_are_those_of_the_union(spark):
    texts = [f"a{i} b c d e f g h" for i in range(40)]
    docs = spark.createDataFrame([(x, y) for x in texts for y in texts[:8]], "x string, y string")
    hashes = F.concat(sketch.shingle_hashes(F.col("x")), sketch.shingle_hashes(F.col("y")))
    low = F.filter(hashes, lambda h: h <= F.lit(sketch._top(sketch.SCALE)))
    want = F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).otherwise(F.array(F.array_min(hashes)))
    assert docs.filter(sketch.merge(sketch.sketch(F.col("x")), sketch.sketch(F.col("y"))) != want).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", "x"), (3, None, "y"), (3, None, "y"), (5, "", None), (7, "g h i j k l m", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sketch.fingerprint_edits(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 11), (3, 0), (3, 0), (5, 0), (7, 13)]
    by = {r.doc_id: r for r in got}
    # ids descend, null last: 7, 5, 3, 3, null, and then 7 again
    assert by[None].edited_sha256 == hashlib.sha256(b"a b c g h i").hexdigest() and by[3].near_next in (0.0, 1.0)
    alone = sketch.fingerprint_edits(docs.filter("doc_id is null")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()
    assert sketch.fingerprint_edits(docs.limit(0)).count() == 0
