"""Phrases against a plain count, and the hashes, filters and sums they rest on."""

import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from grapheion.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= 100}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * c[p[i : i + k]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df, **more):
    return sorted(tuple(r) for r in phrases.mine(df, **more).collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_count(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("lang", "text").collect()
    rows = sorted(tuple(r) for r in phrases.op12_phrases(spark, f"/root/testdata/{sf}").collect())
    assert rows == brute(docs) and rows


def test_odd_texts(spark):
    """Null languages and texts, runs of one word, all kinds of ends and spaces, case, scripts, a hot language, long texts."""
    texts = ["A b\tC d e f. a B c; d" for _ in range(120)] + ["x x x x x x x x"] * 60 + ["É é é É\x0bno\x0cno\rno\x1cno"] * 150
    texts += ["p q\nr s" * 3, "", None, "   ", ".,;", "one two three" + " two three" * 400, "new york. " * 250_000, "tick tock " * 150_000]
    rows = [("xx" if i % 3 else None, t, i, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "lang string, text string, key long, phrase string").repartition(5)
    want = brute([r[:2] for r in rows])
    assert got(df) == want and any(r[0] == "und" for r in want)
    assert got(df, top=3) == [r for r in want if r[1] <= 3]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert got(empty) == [] and got(spark.createDataFrame([("a", "b c")], "lang string, text string")) == []


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        h = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        p = phrases.Perfect.build(h)
        assert sorted(p.slots(h).tolist()) == list(range(len(h)))
        strange = p.slots(rnd.integers(0, 1 << 63, 100, np.uint64))
        assert ((strange >= -1) & (strange <= max(0, len(h)))).all()
        assert len(p.bits) * 8 < 5 * n + 4000


def test_equal_hashes_get_another_seed():
    seeds = []

    def hashes(seed):
        seeds.append(seed)
        return np.array([5, 5 if seed < 3 else 6], np.uint64)

    seed, _, slots = phrases._perfect_of(hashes)
    assert seed == 3 and sorted(slots.tolist()) == [0, 1] and seeds == [1, 2, 3]


@pytest.mark.parametrize("whole", [1 << 20, 50])
def test_sums_of_bins(monkeypatch, whole):
    """All bins in one array, or those met, handed on in parts: the same sums."""
    monkeypatch.setattr(phrases, "WHOLE_BINS", whole)
    monkeypatch.setattr(phrases, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    rnd = np.random.default_rng(2)
    starts = np.array([0, 40, 40, 1000, 5000])
    want, bins, out = np.zeros(5000, np.int64), phrases._Bins(starts), []
    for big in (0, 1, 300):
        at = rnd.integers(0, 5000, 60)
        counts = None if not big else rnd.integers(1, 2 + big, 60)
        np.add.at(want, at, 1 if counts is None else counts)
        out += bins.add(at, counts)
    out += bins.rows()
    sums = [np.zeros(n, np.int64) for n in np.diff(starts)]
    for b in out:
        for block, task, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert task == 7
            phrases._add(sums[block], packed)
    assert np.concatenate(sums).tolist() == want.tolist()


def test_tree_of_sums(spark):
    """More tasks than one sum takes."""
    import pyarrow as pa

    starts = np.array([0, 3, 10])
    rows = [(b, t, bytearray(phrases._pack(np.array([b]), np.array([t + 1]), int(starts[b + 1] - starts[b])))) for t in range(70) for b in (0, 1)]
    done = lambda block, total: iter([pa.RecordBatch.from_pydict({"block": [block], "sum": [total.tolist()]})])
    out = phrases._tree_sum(spark.createDataFrame(rows, "block long, task long, counts binary").repartition(6), starts, 70, done, "block long, sum array<long>").collect()
    assert {r.block: r["sum"] for r in out} == {0: [2485, 0, 0], 1: [0, 2485, 0, 0, 0, 0, 0]}


def test_long_texts_are_cut_between_pieces():
    text = "a b c, " * 700_000
    parts = list(phrases._slices(text))
    assert len(parts) > 2 and "".join(parts) == text and all(p.rstrip().endswith(",") for p in parts[:-1])
