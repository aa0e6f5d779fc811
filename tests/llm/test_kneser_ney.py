import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grapheion.llm import kneser_ney as kn


def toks(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(train):
    """p(word, before) and the base score of a token, by the formulas."""
    pairs = Counter()
    for t in train:
        before = "<s>"
        for w in toks(t):
            pairs[before, w] += 1
            before = (w,)
    count = Counter()
    for (_, w), c in pairs.items():
        count[w] += c
    cont = Counter(w for _, w in pairs)
    v, n = len(count), sum(count.values())

    def cut(counts):
        ns = Counter(counts.values())
        d = kn.discounts(*(ns[k] for k in (1, 2, 3, 4)))
        return d, lambda c: max(c - (0, *d)[min(c, 3)], 0)

    (d2, less2), (d1, less1) = cut(pairs), cut(cont)
    types = sum(cont.values())
    free1 = sum(d1[min(c, 3) - 1] for c in cont.values()) / types
    total, free = Counter(), defaultdict(float)
    for (b, _), c in pairs.items():
        total[b] += c
        free[b] += d2[min(c, 3) - 1]

    def p(w, b):
        low = less1(cont[w]) / types + free1 / (v + 1)
        return low if b not in total else less2(pairs[b, w]) / total[b] + free[b] / total[b] * low

    return p, lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))), count, n


def corpus(n=120):
    rng = random.Random(2)
    words = ["the", "A", "of", "é", "É", "zz", "it's", "b\x85c", *[f"w{i}" for i in range(60)]]
    out = []
    for i in range(n):
        out.append((i, " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(rng.randrange(30)))))
    return out + [(1000, None), (1001, ""), (1002, "the " * 700), (1003, "the never seen\tThe\x0bof"), (1004, "word " * 20000)]


@pytest.mark.parametrize("gather", [50, 10**6])
def test_equals_the_formulas(spark, monkeypatch, tmp_path, gather):
    monkeypatch.setattr(kn, "GATHER", gather)
    rows = corpus()
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    p, base, count, n = brute([t for d, t in rows if not held(d)])
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    docs = kn.texts_of(docs)
    model = kn.train(docs.filter(~kn.held_out(kn.F.col("doc_id"))), f"file://{tmp_path}/m", parts=5)
    got = {r.doc_id: r for r in kn.score(docs, model).collect()}
    for d, t in rows:
        words, before, log = toks(t), "<s>", 0.0
        for w in words:
            log += math.log10(p(w, before))
            before = (w,)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(map(base, words))) and r.score == pytest.approx(log)


def brute3(train):
    """p(word, two words before) at order 3, by the formulas."""
    raw = Counter()
    for t in train:
        one, two = "<s>", "<s>"
        for w in toks(t):
            raw[two, one, w] += 1
            two, one = one, (w,)
    pairs = Counter()
    for (a, b, w), c in raw.items():
        pairs[b, w] += c if b == "<s>" else 1
    cont = Counter(w for _, w in pairs)
    v = len(cont)

    def level(counts, context):
        ns = Counter(counts.values())
        d = kn.discounts(*(ns[k] for k in (1, 2, 3, 4)))
        total, free = Counter(), defaultdict(float)
        for k, c in counts.items():
            total[context(k)] += c
            free[context(k)] += d[min(c, 3) - 1]
        return lambda k, low: low if context(k) not in total else (max(counts[k] - (0, *d)[min(counts[k], 3)], 0) + free[context(k)] * low) / total[context(k)]

    three, two_, one_ = level(raw, lambda k: k[:2]), level(pairs, lambda k: k[0]), level(cont, lambda k: 0)
    return lambda w, b, a: three((a, b, w), two_((b, w), one_(w, 1 / (v + 1))))


@pytest.mark.parametrize("gather", [50, 10**6])
def test_order_three_equals_the_formulas(spark, monkeypatch, tmp_path, gather):
    monkeypatch.setattr(kn, "GATHER", gather)
    rows = corpus()
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    p = brute3([t for d, t in rows if not held(d)])
    _, base, count, n = brute([t for d, t in rows if not held(d)])
    docs = kn.texts_of(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3))
    model = kn.train(docs.filter(~kn.held_out(kn.F.col("doc_id"))), f"file://{tmp_path}/m", parts=5, order=3)
    got = {r.doc_id: r for r in kn.score(docs, model).collect()}
    for d, t in rows:
        words, one, two, log = toks(t), "<s>", "<s>", 0.0
        for w in words:
            log += math.log10(p(w, one, two))
            two, one = one, (w,)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(map(base, words))) and r.score == pytest.approx(log)


def test_order_three_sums_to_one(spark, tmp_path):
    texts = ["a b c a b", "b a d", "c c c a", "a b"] * 3
    docs = kn.texts_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = kn.train(docs, f"file://{tmp_path}/m", parts=2, order=3)
    vocabulary = ["a", "b", "c", "d", "never", None]
    for context in ("", "a", "a b", "c never", "b a d"):
        log = lambda t: model.score([t.encode()])[3][0]
        # p(w | context) as a quotient of texts: the first end differs, so it is left out of both
        steps = [_log_last(model, context.split(), w) for w in vocabulary]
        assert sum(10**x for x in steps) == pytest.approx(1.0) and log(context) < 0


def _log_last(model, context, word):
    """log10 p(word | context) at order 3, the last token of a text that goes on."""
    import unittest.mock

    ids = [kn.START, kn.START, *(kn.word_hashes([w.encode()])[1][0] & kn._LOW48 for w in context)]
    now = kn.END if word is None else kn.word_hashes([word.encode()])[1][0] & kn._LOW48
    line = np.array([*ids[1:], now], np.uint64)
    # tokens of the context, then the word: scores of both texts differ by the last step
    n = len(line) - 1
    scores = []
    for k in (n, n - 1):
        if k == 0:
            scores.append(0.0)
            continue
        with unittest.mock.patch.object(kn, "tokens", lambda _, k=k: (np.array([k]), line[:k], line[1 : k + 1])):
            scores.append(model.score([b""])[3][0])
    return scores[0] - scores[1]


def test_probabilities_sum_to_one(spark, tmp_path):
    texts = ["a b c a b", "b a d", "c c c a", "a b"] * 3
    docs = kn.texts_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    model = kn.train(docs, f"file://{tmp_path}/m", parts=2)
    vocabulary = ["a", "b", "c", "d", "never"]
    for context in ["a", "c", "unknown"]:
        own = kn.word_hashes([context.encode()])[1] & kn._LOW48
        words = np.concatenate([kn.word_hashes([w.encode() for w in vocabulary])[1] & kn._LOW48, [kn.END]])
        total = sum(10 ** float(_log_pair(model, own[0], w)) for w in words)
        assert total == pytest.approx(1.0)


def _log_pair(model, before, now):
    """log10 p(now | before), through the model's own lookup."""
    import unittest.mock

    with unittest.mock.patch.object(kn, "tokens", lambda _: (np.array([1]), np.array([before], np.uint64), np.array([now], np.uint64))):
        return model.score([b""])[3][0]


def test_beats_the_base_on_held_out_documents(spark):
    rows = kn.op4_kneser_ney(spark, "/root/testdata/sf0.1").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert rows.n > 500 and rows.s > rows.b


def test_nothing_to_learn_from(spark, tmp_path):
    docs = kn.texts_of(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"))
    model = kn.train(docs.filter(~kn.held_out(kn.F.col("doc_id"))), f"file://{tmp_path}/m")
    got = kn.score(docs, model).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert kn.score(docs.limit(0), model).count() == 0
