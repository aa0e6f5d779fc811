"""Interpolated modified Kneser-Ney model of order 2 or 3 over the corpus, for scoring texts.

Counting (Spark): batches reduce their training documents to distinct n-grams of the
highest order with counts and send them, packed, to ranges of the context's hash; each
range merges its share and writes one file of sorted arrays. Below the highest
order an n-gram counts by how many different words stand before it: each range hands
its distinct n-grams, less their first word and pre-aggregated, to the next lower
order, which is merged in the same way, down to files of words by range of the word's
hash. n-grams at a text's start, which no word can stand before, keep their counts.
Every context's follower statistics are made in its range; discounts come from sums
over all ranges.

Scoring: workers memory-map the files (64-bit n-gram keys, counts, context and
word tables, all sorted), take a batch's distinct n-grams in key order, and find
them by binary search that moves through the arrays in one direction. What a
worker holds is a batch; the arrays belong to the page cache.

p(w|v) = max(c(vw) - D(c), 0) / c(v) + g(v) p(w|v less its first word), g(v) the mass the
discounts free; at the end the rest is spread evenly over the V known tokens and
the unknown one. The start of a text is a context of its own, its end a token.
Nothing is pruned at either order. The query takes ``ORDER`` = 2: at order 3 the
distinct trigrams (71 % of all tokens here) alone take several times the disk that
the check grants (README, with figures).

Words are runs outside space and \\t..\\r with A-Z lower-cased. Keys are 64-bit
hashes of a context and a word, contexts and words 48-bit hashes: two of three million
words share one with odds of 2 %, and would then share counts.

Defined cases: null text is empty (only the end); a null doc_id is held out;
repeated rows count each time; without training documents every token is
unknown, the model is uniform over it, and the base score divides by 0.1.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm.binary_ids import _create, _mapped
from grapheion.llm.common import arrow_map, chunks, shared_dir, ship, table, texts_of, written
from grapheion.llm.shingles import mix, word_hashes

#: Order of the query's model.
ORDER = 2
#: Tokens a worker gathers before it sends or scores them.
GATHER = 3_000_000

_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
START, END = _U(0x5EED_0001_0000), _U(0x5EED_0002_0000)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens per text, context of each token, token): 48-bit hashes; the last token of a text is END."""
    count, words = word_hashes(texts)
    words &= _LOW48
    n = count + 1
    ends = np.cumsum(n)
    now = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inner = np.ones(len(now), bool)
    inner[ends - 1] = False
    now[inner] = words
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - n] = START
    return n, before, now


def longer(n: np.ndarray, context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Contexts one word longer than ``context``; ``n`` tokens per text, ``before`` the word before each token."""
    older = np.empty_like(context)
    older[1:] = context[:-1]
    older[np.cumsum(n) - n] = START
    return mix(mix(older) + before) & _LOW48


def _spread(word: np.ndarray) -> np.ndarray:
    """A word's place in the hash range, which decides its file."""
    return mix(word)


def pair_keys(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Keys of bigrams: the top 16 bits from the context, the rest from both."""
    place = _spread(before)
    return place & ~_LOW48 | mix(place + now) & _LOW48


def _part(place: np.ndarray, parts: int) -> np.ndarray:
    return ((place >> _U(48)) * _U(parts) >> _U(16)).astype(np.int64)


def _distinct(before: np.ndarray, now: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in key order: key, context, token, count."""
    key = pair_keys(before, now)
    by = np.argsort(key)
    key = key[by]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.diff(np.append(head, len(key))) if count is None else np.add.reduceat(count[by], head) if len(head) else np.empty(0, np.int64)
    return key[head], before[by][head], now[by][head], total.astype(np.int64)


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)


def _eight(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(x) or x.max() <= np.iinfo(t).max))


def _packed(part: int, **arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps(arrays, 5)], pa.binary())], names=["part", "blob"])


def _save(path: str, **arrays: np.ndarray) -> str:
    """Write arrays one after the other, each at a multiple of 8 bytes; returns the layout."""
    layout, at = [], 0
    with _create(path) as f:
        for name, a in arrays.items():
            data = np.ascontiguousarray(a).tobytes()
            layout.append((name, a.dtype.str, at, len(a)))
            pad = -len(data) % 8
            f.write(data + b"\0" * pad)
            at += len(data) + pad
    return repr(layout)


_FILES: dict[str, dict[str, np.ndarray]] = {}


def _open(path: str, layout: str) -> dict[str, np.ndarray]:
    import ast

    if path not in _FILES:
        raw = _mapped(path, "u1")
        _FILES[path] = {n: raw[at : at + size * np.dtype(t).itemsize].view(t) for n, t, at, size in ast.literal_eval(layout)}
    return _FILES[path]


_WROTE = "number int, path string, layout string, blobs array<binary>, lower array<binary>, tally array<long>"
_WROTE_ARROW = pa.schema([("number", pa.int32()), ("path", pa.string()), ("layout", pa.string()), ("blobs", pa.list_(pa.binary())), ("lower", pa.list_(pa.binary())), ("tally", pa.list_(pa.int64()))])


def _tallies(count: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4, and all."""
    return [*(int((count == k).sum()) for k in (1, 2, 3, 4)), len(count)]


def _parcels(before: np.ndarray, now: np.ndarray, count: np.ndarray, parts: int, mid: np.ndarray | None = None) -> Iterator[tuple[int, dict]]:
    """Distinct n-grams in key order, packed by the range of their context; ``mid``: the context less its first word."""
    part = _part(_spread(before), parts)
    edges = np.searchsorted(part, np.arange(parts + 1))
    for p in np.unique(part).tolist():
        lo, hi = edges[p], edges[p + 1]
        b = before[lo:hi]
        head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        more = {} if mid is None else {"mid": _six(mid[lo:hi][head])}
        yield p, {"context": _six(b[head]), "runs": _small(np.diff(np.append(head, hi - lo))), "now": _six(now[lo:hi]), "count": _small(count[lo:hi]), **more}


def _send_texts(train: DataFrame, parts: int, order: int) -> DataFrame:
    """(part, blob): distinct n-grams of the highest order of each batch."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            context, now, mid = (np.concatenate(x) for x in zip(*held, strict=True))
            if order > 2:
                words, at = np.unique(context, return_index=True)
                mids = mid[at]
            _, context, now, count = _distinct(context, now)
            mid = mids[np.searchsorted(words, context)] if order > 2 else None
            for p, blob in _parcels(context, now, count, parts, mid):
                yield _packed(p, **blob)
            held.clear()

        for b in batches:
            texts = [t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()]
            for lo, hi in chunks(texts):
                n, before, now = tokens(texts[lo:hi])
                held.append((longer(n, before, before) if order > 2 else before, now, before))
                size += len(now)
                if size >= GATHER:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return train.select("text").mapInArrow(send, "part int, blob binary")


def _send_lower(above: DataFrame) -> DataFrame:
    """(part, blob): what the files of an order hand to the next lower one."""

    def send(b: pa.RecordBatch):
        for blobs in b.column(0).to_pylist():
            for blob in blobs:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.loads(blob)["part"]], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    return arrow_map(above.select("lower"), send, "part int, blob binary")


def _count_pairs(sent: DataFrame, folder: str, parts: int, level: int, order: int) -> DataFrame:
    """Files of n-grams and contexts of an order; blobs hold continuation counts and totals of words, lower those of n-grams."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        part = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            before = np.concatenate([np.repeat(_eight(h["context"]), h["runs"]) for h in held])
            now = np.concatenate([_eight(h["now"]) for h in held])
            count = np.concatenate([h["count"].astype(np.int64) for h in held])
            if level > 2:
                contexts, at = np.unique(np.concatenate([_eight(h["context"]) for h in held]), return_index=True)
                mids = np.concatenate([_eight(h["mid"]) for h in held])[at]
            held.clear()
            key, before, now, count = _distinct(before, now, count)
            context, index = np.unique(before, return_inverse=True)
            followers = [np.bincount(index, m, len(context)).astype(np.uint32) for m in (count == 1, count == 2, count > 2)]
            total = np.bincount(index, count, len(context)).astype(np.uint64)
            big = np.flatnonzero(count > 254)
            path = f"{folder}/grams{level}-{part:05d}-{uuid.uuid4().hex}.bin"
            layout = _save(path, key=key, count=np.minimum(count, 255).astype(np.uint8), big=big, big_count=count[big], context=context, total=total, one=followers[0], two=followers[1], more=followers[2])
            lower = []
            if level > 2:
                mid = mids[index]
                # a text's start has nothing before it: its n-grams keep their counts
                _, m, w, c = _distinct(mid, now, np.where(mid == START, count, 1))
                lower = [pickle.dumps({"part": p, **blob}, 5) for p, blob in _parcels(m, w, c, parts)]
            else:
                mids = context
            words, conts = np.unique(now, return_counts=True) if level == 2 else (np.empty(0, np.uint64), np.empty(0, np.int64))
            counts = np.zeros(len(words), np.int64)
            if level == order:
                # a word's count is its total as the last word of contexts; END is one a document and no context
                seen, back = np.unique(mids, return_inverse=True)
                sums = np.bincount(back, total.astype(float), len(seen)).astype(np.int64)
                words = np.concatenate([words, np.where(seen == START, END, seen)])
                conts = np.concatenate([conts, np.zeros(len(seen), np.int64)])
                counts = np.concatenate([counts, sums])
            at = _part(_spread(words), parts)
            blobs = [pickle.dumps({"part": p, "word": _six(words[at == p]), "cont": _small(conts[at == p]), "count": _small(counts[at == p])}, 5) for p in np.unique(at).tolist()]
            yield pa.RecordBatch.from_pylist([{"number": part, "path": path, "layout": layout, "blobs": blobs, "lower": lower, "tally": [*_tallies(count), int(count.sum())]}], schema=_WROTE_ARROW)

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from close()
                    part = p
                held.append({k: v for k, v in pickle.loads(blob).items() if k != "part"})
        yield from close()

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, _WROTE)


def _count_words(pairs: DataFrame, folder: str, parts: int) -> DataFrame:
    """Files of words: continuation count and count."""

    def send(b: pa.RecordBatch):
        for blobs in b.column(0).to_pylist():
            for blob in blobs:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.loads(blob)["part"]], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        part = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            word, index = np.unique(np.concatenate([_eight(h["word"]) for h in held]), return_inverse=True)
            cont, count = (np.bincount(index, np.concatenate([h[k].astype(float) for h in held]), len(word)).astype(np.uint64) for k in ("cont", "count"))
            held.clear()
            path = f"{folder}/words-{part:05d}-{uuid.uuid4().hex}.bin"
            layout = _save(path, word=word, cont=cont, count=count)
            yield pa.RecordBatch.from_pylist([{"number": part, "path": path, "layout": layout, "blobs": [], "lower": [], "tally": [*_tallies(cont), int(cont.sum())]}], schema=_WROTE_ARROW)

        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from close()
                    part = p
                held.append(pickle.loads(blob))
        yield from close()

    sent = arrow_map(pairs.select("blobs"), send, "part int, blob binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, _WROTE)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and above; fixed ones where a class is empty."""
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k + 1.0) for k, d in enumerate(raw))


class Model:
    """What a scoring worker needs besides the mapped files; a few numbers and the files' names."""

    def __init__(self, grams: list[tuple[list[tuple], list[int]]], words: list[tuple], word_tally: list[int], parts: int):
        """``grams``: (files, tally) of orders 2 and up; files are (number, path, layout)."""
        self.parts = parts
        self.grams = [{n: (p, lay) for n, p, lay in files} for files, _ in grams]
        self.words = {n: (p, lay) for n, p, lay in words}
        self.gram_discounts, self.word_discount = [discounts(*tally[:4]) for _, tally in grams], discounts(*word_tally[:4])
        self.vocabulary, self.tokens, self.types = word_tally[4], grams[-1][1][5], word_tally[5]
        n1, n2 = word_tally[0], word_tally[1]
        d = self.word_discount
        freed = d[0] * n1 + d[1] * n2 + d[2] * (self.vocabulary - n1 - n2)
        self.even = (freed / self.types if self.types else 1.0) / (self.vocabulary + 1)

    @staticmethod
    def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3).astype(int)], 0.0)

    def _each(self, files: dict, place: np.ndarray):
        """(file, from, to) for sorted places."""
        part = _part(place, self.parts)
        edges = np.searchsorted(part, np.arange(self.parts + 1))
        for p in range(self.parts):
            if edges[p] < edges[p + 1] and p in files:
                yield _open(*files[p]), edges[p], edges[p + 1]

    def _words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, probability below any context) of words."""
        count, cont = np.zeros(len(word)), np.zeros(len(word))
        by = np.argsort(_spread(word))
        for f, lo, hi in self._each(self.words, _spread(word)[by]):
            w = word[by[lo:hi]]
            at = np.minimum(np.searchsorted(f["word"], w), len(f["word"]) - 1)
            hit = f["word"][at] == w
            count[by[lo:hi]] = np.where(hit, f["count"][at], 0)
            cont[by[lo:hi]] = np.where(hit, f["cont"][at], 0)
        return count, (self._less(cont, self.word_discount) / max(1, self.types)) + self.even

    def _step(self, level: int, context: np.ndarray, now: np.ndarray, low: np.ndarray) -> np.ndarray:
        """p(token | context) of every token, ``low`` being that below the context."""
        key = pair_keys(context, now)
        by = np.argsort(key)
        s = key[by]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(head) - 1
        first = by[head]
        key, context = key[first], context[first]
        d = self.gram_discounts[level - 2]
        count, total, free = np.zeros(len(key)), np.zeros(len(key)), np.ones(len(key))
        for f, lo, hi in self._each(self.grams[level - 2], key):
            at = np.minimum(np.searchsorted(f["key"], key[lo:hi]), len(f["key"]) - 1)
            hit = f["key"][at] == key[lo:hi]
            c = np.where(hit, f["count"][at], 0).astype(float)
            for i in np.flatnonzero(c == 255):
                c[i] = f["big_count"][np.searchsorted(f["big"], at[i])]
            count[lo:hi] = c
            ctx, back = np.unique(context[lo:hi], return_inverse=True)
            at = np.minimum(np.searchsorted(f["context"], ctx), len(f["context"]) - 1)
            known = f["context"][at] == ctx
            t = np.where(known, f["total"][at], 0).astype(float)
            g = np.where(known, (d[0] * f["one"][at] + d[1] * f["two"][at] + d[2] * f["more"][at]) / np.maximum(t, 1), 1.0)
            total[lo:hi], free[lo:hi] = t[back], g[back]
        p = self._less(count, d) / np.maximum(total, 1) + free * low[first]
        return p[which]

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, log10 probability."""
        n, before, now = tokens(texts)
        words, index = np.unique(now, return_inverse=True)
        word_count, low = self._words(words)
        p, context = low[index], before
        for level in range(2, len(self.grams) + 2):
            context = longer(n, context, before) if level > 2 else context
            p = self._step(level, context, now, p)
        owner = np.repeat(np.arange(len(texts)), n)
        base = np.log10((word_count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))[index]
        m = len(texts)
        return n, np.bincount(owner, (word_count > 0)[index], m).astype(np.int64), np.bincount(owner, base, m), np.bincount(owner, np.log10(p), m)


def train(docs: DataFrame, folder: str, parts: int | None = None, order: int = ORDER) -> Model:
    """Count ``docs`` (doc_id, text) into files below ``folder``."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grams = [written(_count_pairs(_send_texts(docs, parts, order), folder, parts, order, order))]
    if order > 2:
        grams.insert(0, written(_count_pairs(_send_lower(grams[0]), folder, parts, 2, order)))
    blobs = grams[0].select("blobs")
    for g in grams[1:]:
        blobs = blobs.unionByName(g.select("blobs"))
    words = written(_count_words(blobs, folder, parts))

    def gathered(df: DataFrame) -> tuple[list[tuple], list[int]]:
        # one row a file: as many as there are shuffle partitions
        rows = df.select("number", "path", "layout", "tally").collect()
        return [(r.number, r.path, r.layout) for r in rows], [sum(x) for x in zip(*(r.tally for r in rows), strict=True)] or [0] * 6

    word_files, word_tally = gathered(words)
    return Model([gathered(g) for g in grams], word_files, word_tally, parts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    ship(docs.sparkSession)

    def run(b: pa.RecordBatch):
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        for lo, hi in chunks(texts, 12_000_000):
            n, known, base, log = model.score(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(hi - lo, model.tokens, np.int64)), pa.array(base), pa.array(log)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return arrow_map(docs, run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_of(table(spark, sf_dir, "documents"))
    model = train(docs.filter(~held_out(F.col("doc_id"))), shared_dir(spark))
    return score(docs, model).withColumn("held_out", held_out(F.col("doc_id"))).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
