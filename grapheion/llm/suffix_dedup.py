"""Removal of byte strings that occur earlier, by blockwise suffix sorting with difference-cover ranks.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier (in a
document of smaller id, or in the same one). Sorting the windows of ``LENGTH`` bytes
at all positions at once would move many times the corpus, so it is done twice over
few suffixes, bucket by bucket. Hashes only choose the buckets; what is equal is
decided by the sort alone.

1. Long strings. Documents are cut where the hash of the next ``GRAM`` bytes says so
   (every ``MEAN`` bytes or so), each string reaching ``LENGTH - 1`` bytes past
   its end so that it holds all windows that start in it. Strings whose hash occurs
   once are left; the bytes of the others meet in suffix buckets by that hash,
   are sorted, and all but the first of equal ones repeat it: their windows are
   done. Most of what repeats is long and ends here, at little more than its own
   size.
2. Short contexts of the windows left. The anchor of a window is its substring of
   ``GRAM`` bytes with the least hash, so equal windows have equal anchors at equal
   offsets. Consecutive windows with one anchor form a run (about 31 windows);
   its bytes are its context. Runs whose anchor occurs once are left; the
   contexts of the others meet in suffix buckets by anchor. All but the first of
   equal contexts repeat it; where different contexts remain, all their windows
   are sorted, and windows equal to an earlier one are repeats.

A bucket's suffixes are sorted by their first and last ``PERIOD`` bytes and,
between them, by the rank of what starts at the next position of a difference
cover, so that ties of any length cost one comparison. These ranks are computed
for the block at hand before its sort, by doubling from blocks of ``PERIOD`` bytes.
Buckets arrive in order of (bucket, document, place) from Spark's own sort, which
spills, and are sorted a block of ``BLOCK`` strings or ``BLOCK_BYTES`` at a time; a
bucket that outgrows a block is reduced to its different strings as it goes.

Hot anchors. An anchor with more than ``HOT`` runs among those that a task gathers
(``SEND``), or more than ``HOT_GROUP`` in all, is hot: contexts that differ within a
task's batch travel as single windows in buckets of their content, so no bucket of
different strings passes ``HOT_GROUP``. In each task, strings that it has seen
before (compared by their bytes) do not travel.

The documents are dealt once, as a table bucketed by their number, which every
step reads again without a shuffle.

Defined cases: null text is empty; texts under ``LENGTH`` bytes stay whole; equal
rows that repeat a doc_id are one document; rows of one doc_id with different
texts follow one another in the order of a hash of the text; null ids come last;
other columns are ignored or, in ``deduplicated``, kept.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm.common import arrow_map, chunks, shared_dir, ship, table, written
from grapheion.llm.shingles import _BYTE, _power, mix

LENGTH = 100
GRAM = 40
#: Mean, least and greatest distance between the starts of long strings.
MEAN, LEAST, MOST = 256, 64, 4096
HOT, HOT_GROUP = 256, 20_000
#: Bytes of text hashed together, and runs that a task gathers before it sends them.
CHUNK, SEND = 1_000_000, 500_000
#: Strings, and bytes of strings, sorted together.
BLOCK, BLOCK_BYTES = 16_000, 2_000_000
#: Bytes of strings that a task remembers.
SEEN_BYTES = 16_000_000
#: A difference cover: every residue modulo PERIOD is a difference of two members.
PERIOD = 16
COVER = (0, 1, 2, 5, 8)

_U = np.uint64
_DELTA = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])

#: A place is start << 28 | (windows - 1) << 14 | offset of the anchor << 4 | kind.
JUDGE, POISON, PASSING = 0, 1, 2


def place_of(start: np.ndarray, more: np.ndarray, offset: np.ndarray | int = 0, kind: np.ndarray | int = 0) -> np.ndarray:
    return start.astype(np.int64) << 28 | more.astype(np.int64) << 14 | np.asarray(offset, np.int64) << 4 | kind


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows - 1, offset, kind)"""
    return place >> 28, place >> 14 & 0x3FFF, place >> 4 & 0x3FF, place & 15


def _prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=sums[1:])
    return sums, inv


def _windows(sizes: np.ndarray, n: int, length: int, skip: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Starts of the windows of texts laid end to end, but for those in ``skip`` (text, start, windows - 1)."""
    ends = np.cumsum(sizes)
    inside = np.zeros(n + 1, np.int64)
    big = sizes >= length
    np.add.at(inside, (ends - sizes)[big], 1)
    np.add.at(inside, (ends - length + 1)[big], -1)
    if skip is not None and len(skip[0]):
        at = (ends - sizes)[skip[0]] + skip[1]
        np.add.at(inside, at, -1)
        np.add.at(inside, at + skip[2] + 1, 1)
    return np.flatnonzero(np.cumsum(inside[:-1]) > 0)


_FIELDS = (("anchor", np.uint64), ("doc", np.int64), ("start", np.int64), ("more", np.int64), ("offset", np.int64))


def _none() -> dict[str, np.ndarray]:
    return {k: np.empty(0, t) for k, t in _FIELDS}


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, skip: tuple | None = None) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in order: anchor (hash), doc (index), start, more (windows - 1), offset (of the anchor).

    Windows in ``skip`` (doc, start, more) are left out. Texts hold 2**24 bytes at most.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return _none()
    sums, inv = _prefix(raw)
    n = len(raw) - gram + 1
    g = mix((sums[gram:] - sums[:-gram]) * inv[:n])
    # hash above, position below: the minimum is the leftmost of equal hashes
    low = g >> _U(24) << _U(24) | np.arange(n, dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := span - width:
        low = np.minimum(low[:-rest], low[rest:])
    window = _windows(sizes, len(low), length, skip)
    if not len(window):
        return _none()
    ends = np.cumsum(sizes)
    anchor = (low[window] & _U(0xFFFFFF)).astype(np.int64)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(fresh)
    s0, s1, j = window[first], window[np.append(first[1:], len(window)) - 1], anchor[first]
    doc = np.searchsorted(ends, s0, "right")
    return {"anchor": g[j], "doc": doc, "start": s0 - (ends - sizes)[doc], "more": s1 - s0, "offset": j - s0}


def strings(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, skip: tuple | None = None) -> dict[str, np.ndarray]:
    """Long strings, in the form of ``runs``: anchor is the hash of the string, offset 0."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < length:
        return _none()
    sums, inv = _prefix(raw)
    n = len(raw) - gram + 1
    marks = np.flatnonzero(mix((sums[gram:] - sums[:-gram]) * inv[:n]) & _U(MEAN - 1) == 0)
    ends = np.cumsum(sizes)
    begins, lasts = ends - sizes, ends - length
    lo, hi = np.searchsorted(marks, begins, "right").tolist(), np.searchsorted(marks, lasts, "right").tolist()
    starts, docs = [], []
    for i in np.flatnonzero(sizes >= length).tolist():
        last, end = int(begins[i]), int(lasts[i])
        had = len(starts)
        starts.append(last)
        for c in (*marks[lo[i] : hi[i]].tolist(), end + 1):
            while c - last > MOST:
                last += MOST
                starts.append(last)
            if c - last >= LEAST and c <= end:
                starts.append(c)
                last = c
        docs += [i] * (len(starts) - had)
    if not starts:
        return _none()
    start, doc = np.array(starts), np.array(docs)
    stop = np.append(start[1:], 0)
    new = np.append(doc[1:] != doc[:-1], True)
    stop[new] = lasts[doc[new]] + 1
    size = stop - start + length - 1
    key = mix((sums[start + size] - sums[start]) * inv[start] + size.astype(np.uint64))
    return {"anchor": key, "doc": doc, "start": start - begins[doc], "more": stop - start - 1, "offset": np.zeros(len(start), np.int64)}


def _groups_of_texts(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(index, where it begins, bytes) of texts, ``CHUNK`` bytes together; longer ones in pieces that overlap by a window."""
    index, base, data, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t[at : at + CHUNK + length - 1]
            index.append(i)
            base.append(at)
            data.append(piece)
            size += len(piece)
            if size >= CHUNK:
                yield index, base, data
                index, base, data, size = [], [], [], 0
    if data:
        yield index, base, data


def _long_runs(texts: list[bytes], length: int, gram: int, gone: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, find: Callable = runs) -> dict[str, np.ndarray]:
    """``find`` over texts of any length, in bounded pieces; a run cut at a piece's end is two runs.

    ``gone``: (text, start, windows - 1) of windows to leave out, by text.
    """
    parts = [_none()]
    for index, base, data in _groups_of_texts(texts, length):
        skip = None
        if gone is not None and len(gone[0]):
            doc, start, more = [], [], []
            lo, hi = np.searchsorted(gone[0], index, "left"), np.searchsorted(gone[0], index, "right")
            for k, (a, z) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                s, e = gone[1][a:z] - base[k], gone[1][a:z] + gone[2][a:z] - base[k]
                s, e = np.maximum(s, 0), np.minimum(e, len(data[k]) - length)
                ok = s <= e
                doc.append(np.full(int(ok.sum()), k))
                start.append(s[ok])
                more.append((e - s)[ok])
            skip = tuple(np.concatenate(x) for x in (doc, start, more))
        r = find(data, length, gram, skip)
        r["start"] = r["start"] + np.array(base)[r["doc"]]
        r["doc"] = np.array(index)[r["doc"]]
        parts.append(r)
    return {k: np.concatenate([p[k] for p in parts]) for k, _ in _FIELDS}


def _binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _longs(names: list[str], *arrays: np.ndarray, step: int = 50_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(arrays[0]), step):
        yield pa.RecordBatch.from_arrays([pa.array(a[lo : lo + step].astype(np.int64)) for a in arrays], names=names)


def _listed(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column."""
    sizes = np.diff(column.offsets.to_numpy()) if column.null_count == 0 else np.array([len(x or ()) for x in column.to_pylist()], np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


_MARK = "ord long, key long, place long"


def _shared(rows: DataFrame, length: int, gram: int, hot: int, find: Callable) -> DataFrame:
    """Places of strings or runs whose key others share: (ord, key, place); kind PASSING if the key is hot.

    ``rows``: (ord, text) and, if windows are to be left out, their places as ``gone``.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            key, ord_, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            by = np.argsort(key, kind="stable")
            key, ord_, place = key[by], ord_[by], place[by]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(head, len(key)))
            many = head[count > hot]
            passing = np.repeat(count > hot, count)
            yield from _longs(["ord", "key", "place"], ord_, key.view(np.int64), place | np.where(passing, PASSING, JUDGE))
            yield from _longs(["ord", "key", "place"], np.zeros(len(many), np.int64), key[many].view(np.int64), np.full(len(many), POISON))

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            gone = None
            if b.num_columns > 2:
                owner, flat = _listed(b.column(2))
                start, more, _, _ = unplaced(flat.to_numpy(zero_copy_only=False))
                gone = (owner, start, more)
            r = _long_runs(_binary(b.column(1)), length, gram, gone, find)
            held.append((r["anchor"], ids[r["doc"]], place_of(r["start"], r["more"], r["offset"])))
            size += len(r["doc"])
            if size >= SEND:
                yield from out()
                size = 0
        if size:
            yield from out()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "key", "place"]

        def close(ord_: np.ndarray, key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(key):
                return
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            real = place & 15 == JUDGE
            count = np.bincount(group, real)
            burning = (np.bincount(group, ~real) > 0) | (count > HOT_GROUP)
            go = real & ((count > 1) | burning)[group]
            yield from _longs(names, ord_[go], key[go], place[go] | np.where(burning[group[go]], PASSING, JUDGE))

        held = tuple(np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            new = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
            passing = new[2] & 15 == PASSING
            yield from _longs(names, *(c[passing] for c in new))
            ord_, key, place = (np.concatenate([h, c[~passing]]) for h, c in zip(held, new, strict=True))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1], "left"))
            yield from close(ord_[:cut], key[:cut], place[:cut])
            held = ord_[cut:], key[cut:], place[cut:]
            if len(held[0]) > HOT_GROUP:
                real = held[2] & 15 == JUDGE
                yield from _longs(names, held[0][real], held[1][real], held[2][real] | PASSING)
                # whatever follows of this key is hot too
                held = np.zeros(1, np.int64), held[1][:1], np.full(1, POISON)
        yield from close(*held)

    sent = rows.mapInArrow(send, _MARK)
    spread = F.when(F.col("place").bitwiseAND(F.lit(15)) == PASSING, F.xxhash64("ord", "place")).otherwise(F.col("key"))
    return sent.repartition(n, spread).sortWithinPartitions("key").mapInArrow(judge, _MARK)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of (a, b), both dense ranks already."""
    return np.unique(a.astype(np.uint64) * _U(int(b.max()) + 1) + b.astype(np.uint64), return_inverse=True)[1]


def cover_ranks(text: np.ndarray, words: np.ndarray, blocks: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each m: rank of text[q : q + m * PERIOD] at every difference-cover position q (0 elsewhere).

    ``words``: big-endian 64-bit integer at every position. By doubling, from blocks of PERIOD bytes.
    """
    at = np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(len(text)) % PERIOD])

    def spread(rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + PERIOD * (max(blocks) + 1), np.int64)
        out[at] = rank
        return out

    _, high = np.unique(words[at], return_inverse=True)
    _, low = np.unique(words[at + 8], return_inverse=True)
    power = {1: spread(_pair(high, low) + 1)}
    m = 1
    while 2 * m <= max(blocks):
        power[2 * m] = spread(_pair(power[m][at], power[m][at + m * PERIOD]) + 1)
        m *= 2
    out = {}
    for want in set(blocks):
        rank, done = None, 0
        for m in sorted(power, reverse=True):
            if want & m:
                rank = power[m][at] if rank is None else _pair(rank, power[m][at + done * PERIOD]) + 1
                done += m
        out[want] = spread(rank) if rank is not None else np.zeros(len(text) + PERIOD, np.int64)
    return out


def string_ranks(words: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Rank of text[at : at + blocks * PERIOD] for each place of the cover in ``at``, among those of as many blocks.

    As ``cover_ranks``, but only along the strings asked for, whose number of blocks may differ.
    """
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    if not total:
        return np.zeros(len(at), np.int64)
    p = np.repeat(at - first * PERIOD, blocks) + np.arange(total) * PERIOD
    _, high = np.unique(words[p], return_inverse=True)
    _, low = np.unique(words[p + 8], return_inverse=True)
    rank = _pair(high, low) + 1
    left = blocks
    while left.max() > 1:
        half = (left + 1) // 2
        at0 = np.cumsum(left) - left
        to0 = np.cumsum(half) - half
        k = np.arange(int(half.sum())) - np.repeat(to0, half)
        one = np.repeat(at0, half) + 2 * k
        paired = 2 * k + 1 < np.repeat(left, half)
        two = np.where(paired, rank[np.minimum(one + 1, len(rank) - 1)], 0)
        rank, left = _pair(rank[one], two) + 1, half
    out = np.zeros(len(at), np.int64)
    out[blocks > 0] = rank
    return out


class _Laid:
    """Strings laid out for sorting, anchors at multiples of PERIOD, so that equal windows see the cover alike."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, offset: np.ndarray, length: int):
        lead = (-offset) % PERIOD
        slot = (lead + sizes + PERIOD - 1) // PERIOD * PERIOD
        self.base, self.sizes = np.cumsum(slot) - slot + lead, sizes
        self.text = np.zeros(int(slot.sum()) + length + 3 * PERIOD, np.uint8)
        self.text[np.arange(len(flat)) + np.repeat(self.base - (np.cumsum(sizes) - sizes), sizes)] = flat
        self.words = np.ndarray((len(self.text) - 8,), ">u8", self.text.tobytes(), strides=(1,))


def equal_strings(bucket: np.ndarray, flat: np.ndarray, sizes: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Which strings equal an earlier one of their bucket; ``bucket`` ranks them, and equal ones have equal offsets."""
    laid = _Laid(flat, sizes, offset, PERIOD)
    p, end = laid.base, laid.base + sizes - PERIOD
    delta = _DELTA[p % PERIOD]
    rank = string_ranks(laid.words, p + delta, (sizes - delta) // PERIOD)
    cols = [laid.words[p], laid.words[p + 8], laid.words[end], laid.words[end + 8]]
    by = np.lexsort((np.arange(len(p)), cols[3], cols[2], rank, cols[1], cols[0], sizes, bucket))
    same = np.ones(len(by) - 1, bool)
    for c in (bucket, sizes, rank, *cols):
        s = c[by]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(p), bool)
    out[by[1:][same]] = True
    return out


def repeated_windows(bucket: np.ndarray, contexts: list[bytes], offset: np.ndarray, order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, window in it) of every window equal to an earlier one of its bucket.

    Windows are equal only at equal distance from the anchor. ``order`` ranks contexts by place;
    windows of equal text in one document differ in it too.
    """
    sizes = np.array([len(c) for c in contexts])
    laid = _Laid(np.frombuffer(b"".join(contexts), np.uint8), sizes, offset, length)
    text, words, base = laid.text, laid.words, laid.base
    usable = len(text) - 2 * PERIOD
    n = sizes - length + 1
    ctx = np.repeat(np.arange(len(contexts)), n)
    w = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
    p = base[ctx] + w
    delta = _DELTA[p % PERIOD]
    m = (length - delta) // PERIOD
    rank = np.zeros(len(p), np.int64)
    depths = tuple(int(x) for x in np.unique(m) if x > 0)
    if depths:
        for want, table_ in cover_ranks(text[:usable], words, depths).items():
            here = m == want
            rank[here] = table_[(p + delta)[here]]
    key = bucket[ctx].astype(np.int64) * 8192 + (offset[ctx] - w + 4096)
    ends = p + length - PERIOD
    cols = [words[p], words[p + 8], words[ends], words[ends + 8]]
    by = np.lexsort((w, order[ctx], cols[3], cols[2], rank, cols[1], cols[0], key))
    same = np.ones(len(by) - 1, bool)
    for c in (key, rank, *cols):
        s = c[by]
        same &= s[1:] == s[:-1]
    at = by[1:][same]
    return ctx[at], w[at]


_STRING = "bucket long, ord long, place long, data binary"


class _Cutter:
    """Takes strings from documents in order, leaves out those it has just seen, and breaks up hot ones."""

    def __init__(self, length: int, windows: bool):
        self.length, self.windows = length, windows
        self.seen: set[bytes] = set()
        self.weight = 0
        self.rows: tuple[list, list, list, list] = ([], [], [], [])
        self.size = 0

    def new(self, s: bytes) -> bool:
        if s in self.seen:
            return False
        if self.weight > SEEN_BYTES:
            self.forget()
        self.seen.add(s)
        self.weight += len(s) + 80
        return True

    def forget(self) -> None:
        self.seen.clear()
        self.weight = 0

    def put(self, bucket: int, ord_: int, place: int, data: bytes | None) -> None:
        for c, x in zip(self.rows, (bucket, ord_, place, data), strict=True):
            c.append(x)
        self.size += len(data or b"")

    def take(self, ord_: int, text: bytes, keys: list[int], places: list[int]) -> None:
        for key, place in zip(keys, places, strict=True):
            start, more = place >> 28, place >> 14 & 0x3FFF
            s = text[start : start + more + self.length]
            if not self.new(s):
                self.put(0, ord_, start << 28 | more << 14, None)
            elif place & 15 == PASSING and self.windows:
                known = -1
                for w in range(start, start + more + 2):
                    one = text[w : w + self.length] if w <= start + more else None
                    if one is not None and len(s) > self.length and not self.new(one):
                        known = w if known < 0 else known
                        continue
                    if known >= 0:
                        self.put(0, ord_, known << 28 | (w - 1 - known) << 14, None)
                        known = -1
                    if one is not None:
                        self.put(_content(one), ord_, w << 28, one)
            else:
                self.put(key, ord_, place, s)

    def ready(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.rows, types, strict=True)], names=["bucket", "ord", "place", "data"])
        self.rows, self.size = ([], [], [], []), 0
        return out


def _content(window: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)


def _sorted_repeats(bucket: np.ndarray, ord_: np.ndarray, place: np.ndarray, data: pa.Array, length: int, windows: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ord, place) of the repeats in whole buckets, in order of (bucket, ord, place); and which strings are new."""
    start, more, offset, _ = unplaced(place)
    rank = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]]))
    sizes = more + length
    flat = np.frombuffer(data.buffers()[2], np.uint8)[np.frombuffer(data.buffers()[1], np.int32)[data.offset] :][: int(sizes.sum())]
    again = equal_strings(rank, flat, sizes, offset)
    new = ~again
    out_ord, out_place = [ord_[again]], [place_of(start[again], more[again])]
    if windows:
        several = new & (np.bincount(rank, new) > 1)[rank]
        at = np.flatnonzero(several)
        if len(at):
            ctx, w = repeated_windows(rank[at], [data[i].as_py() for i in at.tolist()], offset[at], np.arange(len(at)), length)
            by = np.lexsort((w, ctx))
            ctx, w = ctx[by], w[by]
            fresh = np.ones(len(ctx), bool)
            fresh[1:] = (ctx[1:] != ctx[:-1]) | (w[1:] != w[:-1] + 1)
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(ctx)) - 1 if len(first) else first
            c = at[ctx[first]]
            out_ord.append(ord_[c])
            out_place.append(place_of(start[c] + w[first], w[last] - w[first]))
    return np.concatenate(out_ord), np.concatenate(out_place), new


def _resolve(dealt: DataFrame, text: str, marks: DataFrame, length: int, windows: bool) -> DataFrame:
    """Repeats among the strings at ``marks``: (ord, place). With ``windows``, those inside of different strings too."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = marks.groupBy("ord").agg(F.collect_list(F.struct("key", "place")).alias("at"))
    found = dealt.select("ord", text).join(wanted.hint("shuffle_hash"), "ord").select("ord", text, "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last = _Cutter(length, windows), None
        for b in batches:
            ords, texts = b.column(0).to_pylist(), _binary(b.column(1))
            ends = b.column(2).offsets.to_numpy() - b.column(2).offsets[0].as_py()
            flat = b.column(2).flatten()
            key, place = flat.field("key").to_numpy(zero_copy_only=False), flat.field("place").to_numpy(zero_copy_only=False)
            for i in sorted(range(len(ords)), key=ords.__getitem__):
                if last is not None and ords[i] < last:
                    cutter.forget()  # what was seen does not come earlier
                last = ords[i]
                by = np.argsort(place[ends[i] : ends[i + 1]], kind="stable") + ends[i]
                cutter.take(ords[i], texts[i], key[by].tolist(), place[by].tolist())
                if cutter.size > BLOCK_BYTES or len(cutter.rows[0]) > BLOCK:
                    yield cutter.ready()
        if cutter.rows[0]:
            yield cutter.ready()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rows, size
            whole = pa.Table.from_batches(held).combine_chunks()
            bucket, ord_, place = (whole.column(i).to_numpy() for i in range(3))
            data = whole.column(3).chunk(0)
            held.clear()
            rows = size = 0
            cut_at = len(bucket) if final else int(np.searchsorted(bucket, bucket[-1], "left"))
            if cut_at:
                o, p, _ = _sorted_repeats(bucket[:cut_at], ord_[:cut_at], place[:cut_at], data.slice(0, cut_at), length, windows)
                yield from _longs(["ord", "place"], o, p)
            if cut_at < len(bucket):
                # the last bucket goes on: only its different strings are kept
                o, p, new = _sorted_repeats(bucket[cut_at:], ord_[cut_at:], place[cut_at:], data.slice(cut_at), length, False)
                yield from _longs(["ord", "place"], o, p)
                rest = whole.slice(cut_at).filter(pa.array(new)).combine_chunks().to_batches()
                held.extend(rest)
                size = 0  # counts what came since: different strings of a bucket are few (HOT_GROUP)

        for b in batches:
            decided = pa.compute.is_null(b.column(3))
            done = b.filter(decided)
            if done.num_rows:
                yield from _longs(["ord", "place"], done.column(1).to_numpy(zero_copy_only=False), done.column(2).to_numpy(zero_copy_only=False))
            b = b.filter(pa.compute.invert(decided))
            step = max(1, min(BLOCK, BLOCK_BYTES // max(1, b.column(3).nbytes // max(1, b.num_rows))))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                held.append(part)
                rows += part.num_rows
                size += part.column(3).nbytes
                if rows >= BLOCK or size >= BLOCK_BYTES:
                    yield from close(False)
        if held:
            yield from close(True)

    spread = F.when(F.col("data").isNull(), F.xxhash64("ord", "place")).otherwise(F.col("bucket"))
    return found.mapInArrow(cut, _STRING).repartition(n, spread).sortWithinPartitions("bucket", "ord", "place").mapInArrow(sort, "ord long, place long")


def spans_of(start: np.ndarray, more: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [from, to) covered by windows that start in [start, start + more]."""
    by = np.argsort(start, kind="stable")
    a, z = start[by], (start + more)[by] + length
    reach = np.maximum.accumulate(z)
    head = np.ones(len(a), bool)
    head[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(head)
    return a[first], reach[np.append(first[1:], len(a)) - 1]


def _keyed(docs: DataFrame, doc: Column, text: Column) -> tuple[DataFrame, bool]:
    """docs with ``ord``, a number that orders distinct (doc_id, text) as documents, null ids last; whether it may repeat."""
    odd = docs.groupBy(doc.alias("d")).agg(F.count("*").alias("n")).filter("n > 1 or d is null").limit(1).count()
    if not odd:
        return docs.withColumn("ord", doc), False
    tie = F.xxhash64(text)
    pairs = docs.select(doc.alias("d"), tie.alias("t")).distinct()
    # a sort by ranges: numbers ascend from one partition to the next, and are written before they are used
    ranked = written(pairs.orderBy(F.col("d").asc_nulls_last(), "t").withColumn("ord", F.monotonically_increasing_id()))
    return docs.withColumn("u", tie).join(ranked, doc.eqNullSafe(F.col("d")) & (F.col("u") == F.col("t"))).drop("u", "d", "t"), True


def _dealt(keyed: DataFrame) -> DataFrame:
    """``keyed`` as a table in the shared folder, bucketed and sorted by ord."""
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"grapheion_{uuid.uuid4().hex}"
    keyed.repartition(n, "ord").write.format("parquet").option("path", shared_dir(spark)).option("compression", "zstd").bucketBy(n, "ord").sortBy("ord").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone when the interpreter ends
        return


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs' columns as c0, c1, ... (null texts empty), and at: places of the repeated windows, or null."""
    spark = docs.sparkSession
    ship(spark)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = inner.columns
    doc = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    t = f"c{docs.columns.index('text')}"
    keyed, repeats = _keyed(inner.withColumn(t, F.coalesce(F.col(t).cast("string"), F.lit(""))), doc, F.col(t))
    dealt = _dealt(keyed)
    once = dealt.select("ord", t).dropDuplicates(["ord"]) if repeats else dealt
    places = lambda df, name: df.groupBy("ord").agg(F.collect_list("place").alias(name)).hint("shuffle_hash")
    long_ones = written(_resolve(once, t, _shared(once.select("ord", t), length, gram, hot, strings), length, windows=False))
    rest = once.join(places(long_ones, "gone"), "ord", "left").select("ord", t, F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    short_ones = _resolve(once, t, _shared(rest, length, gram, hot, runs), length, windows=True)
    return dealt.join(places(long_ones.unionByName(short_ones), "at"), "ord", "left").select(*own, "at")


def _cut(text: bytes, at: list | None, length: int) -> tuple[bytes, int, int, list]:
    """(what is left, removed bytes, spans, span bounds)"""
    if not at:
        return text, 0, 0, []
    start, more, _, _ = unplaced(np.array(at, np.int64))
    a, z = spans_of(start, more, length)
    bounds = list(zip(a.tolist(), z.tolist(), strict=True))
    keep, last = [], 0
    for x, y in bounds:
        keep.append(text[last:x])
        last = y
    keep.append(text[last:])
    return b"".join(keep), int((z - a).sum()), len(bounds), bounds


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans) for every document."""
    found = removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length, gram, hot)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch):
        texts, ats = _binary(b.column(1)), b.column(2).to_pylist()
        for lo, hi in chunks(texts):
            cut = [_cut(t, a, length) for t, a in zip(texts[lo:hi], ats[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([c[0] for c in cut], pa.binary()), pa.array([[{"start": x, "end": y} for x, y in c[3]] for c in cut], span)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
            )

    return arrow_map(found, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, end: long>>")


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs without repeated strings, all columns kept; characters cut in two are dropped; n_chars, if there, is made anew."""
    found = removed(docs, length, gram, hot)
    column, texts = docs.columns.index("text"), list(docs.columns)
    chars = texts.index("n_chars") if "n_chars" in texts else None

    def run(b: pa.RecordBatch):
        cols = [b.column(i) for i in range(len(texts))]
        cut = [_cut(t, a, length)[0].decode("utf-8", "ignore") for t, a in zip(_binary(cols[column]), b.column(len(texts)).to_pylist(), strict=True)]
        cols[column] = pa.array(cut, pa.string())
        if chars is not None:
            cols[chars] = pa.array([len(c) for c in cut], cols[chars].type)
        yield pa.RecordBatch.from_arrays(cols, names=texts)

    return arrow_map(found, run, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
