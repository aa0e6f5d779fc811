import itertools
import random
import re

import numpy as np
import pytest

from grapheion.llm import near_dup, shingles


def sets_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing every pair."""
    sets = [sets_of(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def corpus(seed):
    rng = random.Random(seed)
    texts = [*family(rng, 60, 120, 2), *family(rng, 25, 200, 6), *family(rng, 20, 40, 1), *family(rng, 10, 400, 12), None, "", " \n", "One two", "one TWO", "one two three", "a b c d", "A b c d", "é b c d", "É b c d"]
    texts += [texts[0]] * 5
    rng.shuffle(texts)
    return [(3 * i - 60, t) for i, t in enumerate(texts)]


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, label int").repartition(4)
    return sorted(map(tuple, near_dup.near_duplicates(docs).collect()))


def test_equals_all_pairs(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [4, 12])
def test_branching_and_dealing(spark, monkeypatch, limit):
    # nodes far over the limit: large near-copy groups are dealt over blocks, whose pivots meet again
    monkeypatch.setattr(near_dup, "NODE_CLASSES", limit)
    rng = random.Random(8)
    rows = list(enumerate([*family(rng, 70, 150, 1), *family(rng, 30, 100, 1), "lone text of some words here"]))
    assert got(spark, rows) == brute(rows)


def hot_source(rng, n, common, own, twins):
    """Documents that share a long passage and nothing else, some with a linked twin."""
    passage = [f"p{i}" for i in range(common)]
    for k in range(n):
        text = passage + [f"d{k}_{i}" for i in range(own)]
        yield " ".join(text)
        if k < twins:
            yield " ".join([*text[:-6], *(f"t{k}_{i}" for i in range(6))])


@pytest.mark.parametrize("few", [0, 8])
def test_links_within_a_hot_source(spark, monkeypatch, few):
    # one dealt node of all documents, which no component ties: its blocks must meet in pairs until each link is found
    monkeypatch.setattr(near_dup, "DEPTH", 0)
    monkeypatch.setattr(near_dup, "DENSE", 0)
    monkeypatch.setattr(near_dup, "NODE_CLASSES", 10)
    monkeypatch.setattr(near_dup, "FEW_BLOCKS", few)
    rng = random.Random(3)
    texts = list(hot_source(rng, 60, 80, 30, 40))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert sum(not r[3] for r in want) == 40
    assert got(spark, rows) == want


def test_visits_follow_rare_tokens(spark):
    # 200 unlinked documents of one node share a long passage; 10 have a twin: only these visit, and only the twin's block
    texts = list(hot_source(random.Random(5), 200, 60, 40, 10))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {r.doc_id: r.cls for r in near_dup.signatures(docs).collect()}
    block = {d: d % 20 for d in classes}
    rows = [(d, c, 1, block[d], c, -1) for d, c in classes.items()]
    dealt = spark.createDataFrame(rows, "doc_id long, cls long, path long, block int, root long, main long")
    got = {(r.cls, r.block) for r in near_dup._visits(docs, dealt, 4, 80).collect()}
    sets = [sets_of(t) for t in texts]
    linked = {(a, b) for a, b in itertools.permutations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    want = {(classes[a], block[b]) for a, b in linked if block[a] != block[b]}
    assert len(linked) == 20 and want <= got and len(got) <= 2 * len(linked)


def test_branches_by_unused_tokens(spark, monkeypatch):
    # a quarter of a node agrees on each token: two levels of unused ones make it fit, none is dense
    monkeypatch.setattr(near_dup, "NODE_CLASSES", 60)
    rows = [(k, [1], [int(v) for v in np.random.Generator(np.random.PCG64(k)).integers(0, 4, 8)]) for k in range(400)]
    found = near_dup.nodes(spark.createDataFrame(rows, "cls long, paths array<long>, extra array<int>")).collect()
    assert {r.blocks for r in found} == {1} and len({r.cls for r in found}) == 400


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (9, "A B c d e"), (None, "a b c d e"), (None, "q r s t"), (7, None), (7, None)]
    out = got(spark, [r for r in rows if r[0] is not None])
    assert out == [(5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (7, 0, 7, True), (9, 2, 5, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    null = [tuple(r) for r in near_dup.near_duplicates(docs).collect() if r.doc_id is None]
    assert sorted(null, key=str) == sorted([(None, 2, 5, False), (None, 1, None, True)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_same_id_with_other_text(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "a b c d e f"), (3, "q r s t u v")]
    assert [r[2] for r in got(spark, rows)] == [1, 1, 1, 1]


def test_border_members_are_compared_with_what_left():
    # chain: each links to the next only
    base = [np.uint64(i) for i in range(100)]
    members = [(k, np.array(sorted([*base[k * 10 :], *range(1000, 1000 + k * 10)]), np.uint64)) for k in range(5)]
    links, _ = near_dup._Group(members).components()
    assert len({frozenset(x) for x in links}) >= 4


def test_shingle_sets_equal_brute_force():
    texts = ["", "a", "a b c", "a b c d a b c d a b", "É é  x\ty\x0bz\x85w", "x " * 50] + [r[1] or "" for r in corpus(2)][:20]
    sizes, hashes = shingles.shingle_sets([t.encode() for t in texts], 4)
    assert sizes.tolist() == [len(sets_of(t)) for t in texts]
    parts = np.split(hashes, np.cumsum(sizes)[:-1])
    for (s, p), (t, q) in itertools.combinations(zip([sets_of(t) for t in texts], parts), 2):
        assert len(s & t) == len(np.intersect1d(p, q))


def star(rng, n, words=100, off=9):
    """A centre and members that each replace their own words of it: linked to it, hardly to one another."""
    base = [f"c{i}" for i in range(words)]
    yield " ".join(base)
    for k in range(n):
        at = rng.randrange(words - off)
        yield " ".join([*base[:at], *(f"m{k}_{i}" for i in range(off)), *base[at + off :]])


@pytest.mark.parametrize(("dense", "few"), [(0.0, 8), (0.6, 8), (0.0, 0)])
def test_large_stars_chains_and_two_sided_groups(spark, monkeypatch, dense, few):
    # groups of 12 times a node's bound, dealt over blocks or branched
    monkeypatch.setattr(near_dup, "NODE_CLASSES", 16)
    monkeypatch.setattr(near_dup, "DENSE", dense)
    monkeypatch.setattr(near_dup, "FEW_BLOCKS", few)
    rng = random.Random(11)
    texts = list(star(rng, 200))
    step = [f"s{i}" for i in range(700)]
    texts += [" ".join(step[5 * k : 5 * k + 100]) for k in range(100)]
    left, right = list(star(rng, 40, 80, 6))[1:], list(star(rng, 40, 80, 6))[1:]
    texts += [*left, *(t.replace("m", "r") for t in right)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want, have = brute(rows), got(spark, rows)
    missed = sum(a[2] != b[2] for a, b in zip(want, have, strict=True))
    assert missed == 0 if dense == 0 else missed <= 0.01 * len(rows)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_SHINGLES", 400)
    rng = random.Random(8)
    rows = list(enumerate([*family(rng, 40, 150, 1), "lone text of some words here"]))
    assert got(spark, rows) == brute(rows)
