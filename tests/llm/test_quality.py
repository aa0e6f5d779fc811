import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from grapheion.llm import boosted, quality


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), len(set(words))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x85\xa0#|<漢\x1c", max_size=60), max_size=8))
def test_statistics_equal_brute_force(texts):
    s = quality.statistics([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(s[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")) == brute(t)


def test_monotone_constraints_hold():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < 0.2 + 0.6 * np.abs(x[:, 0] - 0.5) + 0.2 * x[:, 1]).astype(float)
    f = boosted.train(x, y, np.array([-1, 1, 0]), trees=30)
    for j, sign in ((0, -1), (1, 1)):
        for row in rng.random((50, 3)):
            line = np.repeat(row[None], 60, 0)
            line[:, j] = np.linspace(0, 1, 60)
            assert (np.diff(f.margin(line)) * sign >= -1e-9).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    scored = quality.judge(docs, forest).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert len(scored) > 500
    clean = [r.kept for r in scored if r.quality == 1]
    junk = [r.kept for r in scored if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.05


def test_nulls_empty_repeats_and_clashes(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30000))
    rows = [(1, None, "x", 1), (2, "", None, 2), (3, long, "y", 3), (3, long, "y", 3), (None, "a b c " * 40, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels) is None
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs, None).collect())
    assert got == [(0, 120, 120, True, False), (1, 0, 0, True, False), (2, 0, 0, True, False), (3, 30000, 0, False, True), (3, 30000, 0, False, True)]
    kept = quality.keep(docs, None)
    assert kept.columns == docs.columns and [r.n_words for r in kept.collect()] == [3, 3]
    assert quality.judge(docs.limit(0), None).count() == 0
