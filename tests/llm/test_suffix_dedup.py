import hashlib
import random

import numpy as np
import pytest

from grapheion.llm import suffix_dedup as sd


def brute(rows, length):
    """rows: (doc_id, text) of distinct ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[doc] = (len(t), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "c", "dé", "efg", "hi j", "ö", "xyz\n", "k"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(30) for _ in range(4)] + ["ab" * 60, "z" * 150]
    out = []
    for i in range(n):
        parts = [say(rng.randrange(12)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared)[rng.randrange(10) :])
        out.append((rng.randrange(-500, 500) * 10 + i % 10, " ".join(parts)))
    out += [(9001, None), (9003, ""), (9005, "short"), (9007, out[0][1]), (9009, "q" * 400)]
    return list(dict(out).items())


def got(spark, rows, **k):
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, ord string, at int").repartition(3)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup(docs, **k).collect()}


@pytest.mark.parametrize("length,gram,hot", [(20, 8, 1000), (40, 12, 1000), (50, 40, 1000), (24, 8, 1), (100, 40, 2)])
def test_equals_brute_force(spark, length, gram, hot):
    rows = corpus(length)
    assert got(spark, rows, length=length, gram=gram, hot=hot) == brute(rows, length)


def test_blocks_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 3)
    rows = corpus(5)
    assert got(spark, rows, length=30, gram=10) == brute(rows, 30)


def test_fixture_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 100)
    out = sd.op2_suffix_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == {d: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in want.items()}


def test_repeated_ids_nulls_empty_and_columns(spark):
    a, b = "first text of one " * 12, "other words stand here " * 12
    rows = [(1, a, "x", 9), (1, a, "x", 9), (1, b, "y", 9), (None, a, "z", 9), (2, a + "é" * 3, None, 9), (3, None, "w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string, n_chars long")
    out = sd.deduplicated(docs, length=20, gram=8)
    assert out.schema == docs.schema
    texts = sorted(((r.doc_id or 0), r.at or "", len(r.text), r.n_chars) for r in out.collect())
    first, other = len(texts and a.encode()), len(b)
    assert [t[:2] for t in texts] == [(0, "z"), (1, "x"), (1, "x"), (1, "y"), (2, ""), (3, "w")]
    assert texts[0][2] == 0 and texts[5][2:] == (0, 0) and all(t[2] == t[3] for t in texts)
    assert texts[1] == texts[2] and 0 < texts[1][2] < first and 0 < texts[3][2] < other
    assert sd.dedup(docs.limit(0)).count() == 0 and sd.deduplicated(docs.limit(0)).count() == 0


def test_long_texts_are_cut_with_overlap(monkeypatch):
    rng = np.random.default_rng(3)
    t = bytes(rng.integers(97, 101, 5000, dtype=np.uint8))
    whole = sd.runs([t], 30, 10)
    parts = sd._long_runs([t], 30, 10)
    cover = lambda r: sorted((int(r["start"][i]) + k, int(r["anchor"][i])) for i in range(len(r["start"])) for k in range(int(r["more"][i]) + 1))
    assert cover(whole) == cover(parts) and [w for w, _ in cover(whole)] == list(range(5000 - 29))


def test_cover_is_a_difference_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_equal_strings_of_any_length():
    rng = random.Random(6)
    pool = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(16, 400))) for _ in range(40)]
    pool += [p[:-1] + b"c" for p in pool[:10]] + [p[:40] + b"c" + p[41:] for p in pool if len(p) > 60]
    rows = [(rng.randrange(3), rng.choice(pool)) for _ in range(300)]
    rows.sort(key=lambda r: r[0])
    again = sd.equal_strings(np.array([b for b, _ in rows]), np.frombuffer(b"".join(s for _, s in rows), np.uint8), np.array([len(s) for _, s in rows]), np.array([b * 5 for b, _ in rows]))
    seen, want = set(), []
    for r in rows:
        want.append(r in seen)
        seen.add(r)
    assert again.tolist() == want


@pytest.mark.parametrize("block,group", [(2, 3), (50, 10)])
def test_buckets_larger_than_a_block(spark, monkeypatch, block, group):
    # long strings too: LEAST and MEAN below the texts' length; hot groups go by single windows
    for name, value in (("BLOCK", block), ("BLOCK_BYTES", 300), ("HOT_GROUP", group), ("MEAN", 16), ("LEAST", 8), ("MOST", 64), ("SEND", 50), ("SEEN_BYTES", 500)):
        monkeypatch.setattr(sd, name, value)
    rows = corpus(17, 80)
    assert got(spark, rows, length=24, gram=8, hot=2) == brute(rows, 24)


def test_skipped_windows_are_left_out(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (700, 10, 2500)]
    gone = (np.array([0, 2, 2]), np.array([100, 0, 900]), np.array([50, 10, 700]))
    out = {(t, s + k) for t, s, m in zip(*gone) for k in range(m + 1)}
    for chunk in (10_000, 300):
        monkeypatch.setattr(sd, "CHUNK", chunk)
        r = sd._long_runs(texts, 30, 10, gone)
        got_ = sorted((int(d), int(s) + k) for d, s, m in zip(r["doc"], r["start"], r["more"]) for k in range(int(m) + 1))
        assert got_ == [(t, w) for t in range(3) for w in range(len(texts[t]) - 29) if (t, w) not in out]
