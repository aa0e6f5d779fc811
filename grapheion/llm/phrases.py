"""Phrase collocations: frequent phrases counted by slot of minimal perfect hashes, scored by their worst cut.

Per language: n counts words, f(phrase) its occurrences inside pieces. A phrase of 2 to LONGEST
words with f >= MIN_COUNT is a candidate. Each cut into two parts with counts l and r gives
floor(1000 * f * n / (l * r)); the least counts. A candidate inside a longer one of the same count
goes. The best TOP of each language stay.

1. *Words.* Tasks count words with dictionaries, Spark adds them up; what occurs MIN_COUNT times
   gets a slot of a minimal perfect hash. Documents are written once as slots of words, -1 standing
   for everything that no candidate contains: rarer words and the ends of pieces.
2. *Buckets.* Every phrase of frequent words is hashed into a bucket; tasks bincount numpy arrays
   of buckets, which a tree of sums adds up. A bucket below MIN_COUNT holds no frequent phrase. This
   makes candidate sets Apriori-safe without listing all pairs: a phrase is looked at only if its
   bucket and those of both phrases one word shorter inside it may be frequent.
3. *Slots.* The distinct phrases that are left get slots of minimal perfect hashes, one a block of
   the key space, stored with their keys. Tasks look phrases up, compare the stored key, bincount by
   slot, and the tree of sums gives exact counts, which are stored beside the keys.
4. *Cuts.* The counts of both parts of each cut are read by slot.

Memory: a task holds one block of buckets or keys at a time, whatever their number; blocks are
files in the shared folder, memory-mapped where the folder is local. The bucket bits are 1/8 bit a
token and length (LOAD tokens a bucket), the keys a few phrases in a hundred tokens. Sums go by
(block, group of tasks), so that no task adds up more than FAN arrays of one block.

Null texts are empty, null languages ``und``; rows are counted each for itself, repeated ones and
those without an id too; other columns are left behind; an empty table has no phrases. Texts of
any length are read whole. Ties go by count, then by the bytes of the phrase.
"""

from __future__ import annotations

import io
import pickle
import re
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.llm.binary_ids import _create, _local
from grapheion.llm.common import CHUNK_CHARS, chunks, shared_dir, ship, table, written

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Phrases of a length that share a bucket on average; far below MIN_COUNT, so that few buckets of rare ones look frequent.
LOAD = 24
#: Buckets or keys a block holds.
BLOCK_BUCKETS, BLOCK_KEYS = 1 << 22, 1 << 18
#: A task counts all bins in one array up to so many, else those it meets, so many at a time.
WHOLE_BINS = 1 << 24
#: Arrays of a block that one task adds up.
FAN = 32
#: Words a task counts before it hands them on, and windows whose repeats it removes at once.
HELD_WORDS, HELD_WINDOWS = 400_000, 1_000_000
#: Words whose slots a worker remembers.
CACHE_WORDS = 1_000_000

#: Lower-cases A-Z, makes every end of a piece a full stop and tabs spaces.
_FOLD = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


_END = re.compile("[.,;:!?\n-\r]")


def tokens(text: str) -> list[bytes]:
    """Words as bytes; b"." ends a piece."""
    data = text.encode("utf8", "surrogatepass").translate(_FOLD).replace(b".", b" . ")
    return [t for t in data.split(b" ") if t]


# Minimal perfect hashes ------------------------------------------------------------


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_rows(rows: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of rows of integers."""
    h = np.full(len(rows), seed + 1, np.uint64)
    for k in range(rows.shape[1]):
        h = _mix(h ^ rows[:, k].astype(np.uint64), k + 1)
    return h


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Perfect:
    """Distinct 64-bit hashes to 0 .. n-1: at each level hashes that meet no other keep a bit, the rest go on.

    A slot is the number of bits before a hash's bit. Hashes that were not given get some slot or
    -1: whoever looks up compares the stored key.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self._starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        per_word = np.bitwise_count(bits.view("<u8")).astype(np.int64)
        self._before = np.concatenate([[0], np.cumsum(per_word)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> Perfect:
        left, sizes, parts, level = hashes, [], [], 0
        while len(left):
            size = max(64, -(-len(left) * 3 // 2 // 64) * 64)
            at = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            mark = np.zeros(size, bool)
            mark[at[alone]] = True
            parts.append(np.packbits(mark, bitorder="little"))
            sizes.append(size)
            left, level = left[~alone], level + 1
            if level > 200:
                raise ValueError("hashes are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.empty(0, np.uint8))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (_mix(hashes[left], level) % np.uint64(size)).astype(np.int64) + self._starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self._before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


# Blocks of arrays in the shared folder ---------------------------------------------------


def _save(folder: str, **arrays: np.ndarray) -> str:
    """Write the arrays under a name of this attempt's own; whoever lists it knows it is whole."""
    path = f"{folder}/{uuid.uuid4().hex}"
    for name, a in arrays.items():
        with _create(f"{path}/{name}.npy") as f:
            out = io.BytesIO()
            np.save(out, a)
            f.write(out.getvalue())
    return path


@lru_cache(maxsize=256)
def _array(path: str) -> np.ndarray:
    """Memory-mapped; of a store that cannot be mapped a copy that goes with the mapping."""
    if (local := _local(path)) is not None:
        return np.load(local, mmap_mode="r")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as src, tempfile.NamedTemporaryFile(suffix=".npy") as dst:
        shutil.copyfileobj(src, dst)
        dst.flush()
        return np.load(dst.name, mmap_mode="r")


@lru_cache(maxsize=64)
def _perfect(path: str) -> Perfect:
    return Perfect(np.array(_array(f"{path}/sizes.npy")), np.asarray(_array(f"{path}/bits.npy")))


class _Keys(NamedTuple):
    """Blocks of keys: block b holds slots starts[b] .. starts[b + 1]; counts are added in a folder of their own."""

    paths: list[str]
    seeds: list[int]
    starts: np.ndarray
    counts: list[str]

    @classmethod
    def of(cls, manifest: DataFrame, blocks: int) -> _Keys:
        """From one row a block that has keys: block, path, seed, n."""
        rows = {r.block: r for r in manifest.collect()}
        sizes = [rows[b].n if b in rows else 0 for b in range(blocks)]
        return cls([rows[b].path if b in rows else "" for b in range(blocks)], [rows[b].seed if b in rows else 0 for b in range(blocks)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), [])

    def _has(self, block: int) -> bool:
        return self.starts[block] < self.starts[block + 1]

    def block_of(self, slots: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, slots, "right") - 1

    def read(self, slots: np.ndarray, name: str, counts: bool = False) -> np.ndarray:
        """What stands at each slot in the arrays of that name."""
        out = None
        for b, at in _grouped(self.block_of(slots)):
            a = _array(f"{(self.counts if counts else self.paths)[b]}/{name}.npy")[slots[at] - self.starts[b]]
            out = np.zeros((len(slots), *a.shape[1:]), a.dtype) if out is None else out
            out[at] = a
        return np.zeros(0, np.int64) if out is None else out

    def slots(self, rows: np.ndarray) -> np.ndarray:
        """Slots of phrases (rows of LONGEST word slots, -1 behind the last), -1 where the stored key differs."""
        out = np.full(len(rows), -1, np.int64)
        for b, at in _grouped(_block(hash_rows(rows), len(self.paths))):
            if self._has(b):
                keys = _array(f"{self.paths[b]}/keys.npy")
                slot = _perfect(self.paths[b]).slots(hash_rows(rows[at], self.seeds[b]))
                slot[slot >= len(keys)] = -1
                same = (slot >= 0) & (keys[slot] == rows[at]).all(1)
                out[at[same]] = slot[same] + self.starts[b]
        return out

    def word_slots(self, words: list[bytes]) -> np.ndarray:
        """Slots of words, likewise."""
        out = np.full(len(words), -1, np.int64)
        for b, at in _grouped(_block(hash_words(words), len(self.paths))):
            if not self._has(b):
                continue
            ends, text = _array(f"{self.paths[b]}/ends.npy"), _array(f"{self.paths[b]}/text.npy")
            slot = _perfect(self.paths[b]).slots(hash_words([words[i] for i in at.tolist()], self.seeds[b]))
            for i, s in zip(at.tolist(), slot.tolist(), strict=True):
                if 0 <= s < len(ends) and text[ends[s - 1] if s else 0 : ends[s]].tobytes() == words[i]:
                    out[i] = s + self.starts[b]
        return out

    def words(self, slots: np.ndarray) -> list[bytes]:
        out = []
        for b, s in zip(self.block_of(slots).tolist(), slots.tolist(), strict=True):
            ends, s = _array(f"{self.paths[b]}/ends.npy"), s - int(self.starts[b])
            out.append(_array(f"{self.paths[b]}/text.npy")[ends[s - 1] if s else 0 : ends[s]].tobytes())
        return out


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (hashes % np.uint64(blocks)).astype(np.int64)


def _grouped(blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(block, places) of each block."""
    order = np.argsort(blocks, kind="stable")
    cuts = np.flatnonzero(np.diff(blocks[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(blocks[part[0]]), part


def _perfect_of(hashes: Callable[[int], np.ndarray], first: int = 1) -> tuple[int, Perfect, np.ndarray]:
    """(seed, hash, slots): the first seed under which no two keys have one hash."""
    for seed in range(first, first + 100):
        h = hashes(seed)
        if len(np.unique(h)) == len(h):
            perfect = Perfect.build(h)
            return seed, perfect, perfect.slots(h)
    raise ValueError("repeated keys")


# Sums of arrays --------------------------------------------------------------------------


def _pack(at: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """Counts of a block: all of them, or places and counts where most are none; then compressed."""
    kind = "u1" if not len(counts) or counts.max() < 1 << 8 else "u2" if counts.max() < 1 << 16 else "u8"
    if len(at) * 8 > size:
        whole = np.zeros(size, kind)
        whole[at] = counts
        head, data = b"w", whole.tobytes()
    else:
        head, data = b"p" + len(at).to_bytes(8, "little"), np.diff(at, prepend=0).astype("<u4").tobytes() + counts.astype(kind).tobytes()
    return head + kind.encode() + zstandard.ZstdCompressor(1).compress(data)


def _add(total: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"w":
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[3:]), packed[1:3].decode()).astype(np.int64)
        return
    n, kind = int.from_bytes(packed[1:9], "little"), packed[9:11].decode()
    data = zstandard.ZstdDecompressor().decompress(packed[11:])
    total[np.cumsum(np.frombuffer(data, "<u4", n).astype(np.int64))] += np.frombuffer(data, kind, n, 4 * n).astype(np.int64)


class _Bins:
    """A task's counts of bins. All bins in one array while they fit, else those met, given up when many."""

    def __init__(self, starts: np.ndarray):
        self._starts, self._n = starts, int(starts[-1])
        self._whole = np.zeros(self._n, np.int64) if self._n <= WHOLE_BINS else None
        self._parts: list[np.ndarray] = []
        self._held = 0

    def add(self, at: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if self._whole is not None:
            self._whole += np.bincount(at, counts, self._n).astype(np.int64)
            return
        self._parts.append(at if counts is None else np.repeat(at, counts))
        self._held += len(self._parts[-1])
        if self._held > WHOLE_BINS:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self._whole is not None:
            at = np.flatnonzero(self._whole)
            counts = self._whole[at]
        else:
            at, counts = np.unique(np.concatenate(self._parts), return_counts=True) if self._parts else (np.zeros(0, np.int64),) * 2
        self._parts, self._held = [], 0
        task = TaskContext.get().partitionId()
        cuts = np.searchsorted(at, self._starts)
        for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if lo < hi:
                start, size = int(self._starts[b]), int(self._starts[b + 1] - self._starts[b])
                packed = _pack(at[lo:hi] - start, counts[lo:hi], size)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([task], pa.int64()), pa.array([packed], pa.binary())], names=["block", "task", "counts"])


SUMS = "block long, task long, counts binary"


def _tree_sum(parts: DataFrame, starts: np.ndarray, tasks: int, done: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Add arrays up by block, those of FAN tasks at a time; ``done`` makes rows of a block and its sums."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = np.diff(starts).tolist()

    def summed(last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None

            def out() -> Iterator[pa.RecordBatch]:
                if last:
                    yield from done(at[0], total)
                else:
                    hit = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([_pack(hit, total[hit], len(total))], pa.binary())], names=["block", "task", "counts"])

            for b in batches:
                for block, task, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (block, task) != at:
                        if at is not None:
                            yield from out()
                        at, total = (block, task), np.zeros(sizes[block], np.int64)
                    _add(total, counts)
            if at is not None:
                yield from out()

        return run

    while True:
        tasks = -(-tasks // FAN)
        up = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("long"))
        dealt = up.repartition(n, "block", "task").sortWithinPartitions("block", "task")
        if tasks <= 1:
            return written(dealt.mapInArrow(summed(True), schema))
        parts = dealt.mapInArrow(summed(False), SUMS)


# Steps -----------------------------------------------------------------------------------


def _slices(text: str) -> Iterator[str]:
    """A long text in parts that end where a piece ends."""
    while len(text) > 2 * CHUNK_CHARS and (m := _END.search(text, CHUNK_CHARS)):
        yield text[: m.end()]
        text = text[m.end() :]
    yield text


def _chunks_of(b: pa.RecordBatch) -> Iterator[dict[bytes, list[bytes]]]:
    """Tokens by language of about CHUNK_CHARS characters of texts each."""
    rows = [(lang.encode(), part) for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for part in _slices(text)]
    for lo, hi in chunks([t for _, t in rows]):
        out: dict[bytes, list[bytes]] = {}
        for lang, text in rows[lo:hi]:
            out.setdefault(lang, []).extend(tokens(text))
            out[lang].append(b".")
        yield out


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, as bytes."""
    schema = pa.schema([("lang", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.binary()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)
            sums.clear()

        for b in batches:
            for part in _chunks_of(b):
                for lang, words in part.items():
                    sums.setdefault(lang, Counter()).update(words)
                    sums[lang].pop(b".", None)
                if sum(map(len, sums.values())) > HELD_WORDS:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


KEYS = "block long, path string, seed long, n long"
_KEYS = pa.schema([("block", pa.int64()), ("path", pa.string()), ("seed", pa.int64()), ("n", pa.int64())])


class _Gather:
    """The rows of one block; ``merge`` removes repeats while they come in."""

    def __init__(self, merge: Callable[[list], list], limit: int):
        self._merge, self._limit, self._rows, self._held, self._kept = merge, limit, [], 0, 0

    def add(self, row: np.ndarray | bytes) -> None:
        self._rows.append(row)
        self._held += len(row)
        if self._held > self._kept * 2 + self._limit:
            self._rows = self._merge(self._rows)
            self._held = self._kept = sum(map(len, self._rows))

    def done(self) -> list:
        return self._merge(self._rows)


def _keys_of(df: DataFrame, make: Callable[[list], dict[str, np.ndarray]], merge: Callable[[list], list], blocks: int, folder: str) -> _Keys:
    """Minimal perfect hashes, one a block, of (block, payload) rows; a block's keys are a bounded share of all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out() -> pa.RecordBatch:
            seed, arrays, size = make(held.done())
            return pa.RecordBatch.from_pylist([{"block": at, "path": _save(folder, **arrays), "seed": seed, "n": size}], schema=pa.schema([("block", pa.int64()), ("path", pa.string()), ("seed", pa.int64()), ("n", pa.int64())]))

        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield out()
                    at, held = block, _Gather(merge, 64 << 20)
                held.add(payload)
        if at is not None:
            yield out()

    return _Keys.of(written(df.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "block long, path string, seed long, n long")), blocks)


def _word_keys(frequent: DataFrame, n_words: int, folder: str) -> _Keys:
    """Slots of (lang, word), with counts and the language's total by slot."""
    blocks = max(1, -(-n_words // BLOCK_KEYS))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [lang + b" " + w for lang, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            for block, at in _grouped(_block(hash_words(words), blocks)):
                mine = [words[i] for i in at.tolist()]
                packed = pickle.dumps((mine, b.column(2).to_numpy()[at], b.column(3).to_numpy()[at]))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary())], names=["block", "payload"])

    def make(rows: list[bytes]) -> tuple[int, dict[str, np.ndarray], int]:
        parts = [pickle.loads(r) for r in rows]
        words = [w for p in parts for w in p[0]]
        n, total = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        seed, perfect, slots = _perfect_of(lambda s: hash_words(words, s))
        order = np.argsort(slots)
        ordered = [words[i] for i in order.tolist()]
        ends = np.cumsum([len(w) for w in ordered], dtype=np.int64)
        return seed, {"sizes": perfect.sizes, "bits": perfect.bits, "ends": ends, "text": np.frombuffer(b"".join(ordered), np.uint8), "n": n[order], "total": total[order]}, len(words)

    return _keys_of(frequent.mapInArrow(number, "block long, payload binary"), make, lambda rows: rows, blocks, folder)


def encode(docs: DataFrame, words: _Keys) -> DataFrame:
    """(ids) rows: documents of one language as int32 slots of words, -1 between what no candidate joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, dict[bytes, int]] = {}
        for b in batches:
            for part in _chunks_of(b):
                for lang, toks in part.items():
                    cache = known.setdefault(lang, {b".": -1})
                    fresh = [w for w in dict.fromkeys(toks) if w not in cache]
                    cache.update(zip(fresh, words.word_slots([lang + b" " + w for w in fresh]).tolist(), strict=True))
                    ids = np.fromiter(map(cache.__getitem__, toks), np.int32, len(toks))
                    if sum(map(len, known.values())) > CACHE_WORDS:
                        known.clear()
                    ids = ids[np.concatenate([[True], (ids[1:] >= 0) | (ids[:-1] >= 0)])]
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], names=["ids"])

    return written(docs.mapInArrow(run, "ids binary"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for r in b.column(0):
            yield np.frombuffer(r.as_buffer(), np.int32)


def _hashes(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, whether a phrase of k words starts there, its hash) for k from 2 on."""
    fine, h = ids >= 0, _mix(ids.astype(np.uint64), 1)
    for k in range(2, LONGEST + 1):
        fine = fine[:-1] & (ids[k - 1 :] >= 0)
        h = _mix(h[:-1] ^ ids[k - 1 :].astype(np.uint64), k)
        yield k, fine, h


def _bucket_bits(corpus: DataFrame, starts: np.ndarray, per_length: int, tasks: int, folder: str) -> dict[int, str]:
    """Files of one bit a bucket, block by block: whether it holds MIN_COUNT phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(starts)
        for ids in _rows(batches):
            for k, fine, h in _hashes(ids):
                yield from bins.add((h[fine] % np.uint64(per_length)).astype(np.int64) + (k - 2) * per_length)
        yield from bins.rows()

    def done(block: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        path = _save(folder, bits=np.packbits(total >= MIN_COUNT, bitorder="little"))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([path], pa.string())], names=["block", "path"])

    sums = _tree_sum(corpus.mapInArrow(count, SUMS), starts, tasks, done, "block long, path string")
    return {r.block: r.path for r in sums.collect()}


class _Filter(NamedTuple):
    """Which phrases may be frequent, by the bits of their buckets."""

    paths: dict[int, str]
    per_length: int

    def _bit(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        for b, place in _grouped(at // BLOCK_BUCKETS):
            if b in self.paths:
                rest = at[place] - b * BLOCK_BUCKETS
                out[place] = (_array(f"{self.paths[b]}/bits.npy")[rest >> 3] >> (rest & 7).astype(np.uint8)) & 1 == 1
        return out

    def windows(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Phrases as rows of LONGEST slots, -1 behind the last: those whose inner phrases may be frequent too."""
        inner = ids >= 0
        for k, _, h in _hashes(ids):
            maybe = np.flatnonzero(inner[:-1] & inner[1:])
            hot = self._bit((h[maybe] % np.uint64(self.per_length)).astype(np.int64) + (k - 2) * self.per_length)
            at = maybe[hot]
            inner = np.zeros(len(h), bool)
            inner[at] = True
            rows = np.full((len(at), LONGEST), -1, np.int32)
            for j in range(k):
                rows[:, j] = ids[at + j]
            yield rows


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * LONGEST)))[:, 0]
    one, counts = np.unique(whole, return_counts=True)
    return np.frombuffer(one.tobytes(), np.int32).reshape(-1, LONGEST), counts


def _window_batches(batches: Iterator[pa.RecordBatch], maybe: _Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct phrases and counts of many rows at once."""
    held, n = [], 0
    for ids in _rows(batches):
        for rows in maybe.windows(ids):
            held.append(rows)
            n += len(rows)
        if n > HELD_WINDOWS:
            yield _distinct(np.concatenate(held))
            held, n = [], 0
    if n:
        yield _distinct(np.concatenate(held))


def _phrase_keys(corpus: DataFrame, maybe: _Filter, n_tokens: int, folder: str) -> _Keys:
    """Slots of all phrases that pass the filter, with their keys."""
    blocks = max(1, -(-n_tokens // (20 * BLOCK_KEYS)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _window_batches(batches, maybe):
            for block, at in _grouped(_block(hash_rows(rows), blocks)):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([rows[at].tobytes()], pa.binary())], names=["block", "payload"])

    def merge(rows: list[bytes]) -> list[bytes]:
        return [_distinct(np.frombuffer(b"".join(rows), np.int32).reshape(-1, LONGEST))[0].tobytes()]

    def make(rows: list[bytes]) -> tuple[int, dict[str, np.ndarray], int]:
        keys = np.frombuffer(rows[0], np.int32).reshape(-1, LONGEST)
        seed, perfect, slots = _perfect_of(lambda s: hash_rows(keys, s))
        return seed, {"sizes": perfect.sizes, "bits": perfect.bits, "keys": keys[np.argsort(slots)]}, len(keys)

    return _keys_of(corpus.mapInArrow(found, "block long, payload binary"), make, merge, blocks, folder)


def _counted(corpus: DataFrame, maybe: _Filter, keys: _Keys, tasks: int, folder: str) -> tuple[_Keys, DataFrame]:
    """The keys with exact counts stored by slot, and the frequent ones: (key, a)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(keys.starts)
        for rows, counts in _window_batches(batches, maybe):
            slots = keys.slots(rows)
            if (slots < 0).any():
                raise ValueError("a phrase has no slot")
            yield from bins.add(slots, counts)
        yield from bins.rows()

    def done(block: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        path = _save(folder, a=total)
        rows = _array(f"{keys.paths[block]}/keys.npy")
        at = np.flatnonzero(total >= MIN_COUNT)
        for lo in range(0, max(1, len(at)), 10_000):
            part = at[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array([path] * len(part), pa.string()), pa.array([rows[i].tobytes() for i in part.tolist()], pa.binary()), pa.array(total[part])], names=["block", "path", "key", "a"])

    frequent = _tree_sum(corpus.mapInArrow(count, SUMS), keys.starts, tasks, done, "block long, path string, key binary, a long")
    paths = {r.block: r.path for r in frequent.select("block", "path").distinct().collect()}
    return keys._replace(counts=[paths.get(b, "") for b in range(len(keys.paths))]), frequent.select("key", "a")


def _scored(frequent: DataFrame, keys: _Keys, words: _Keys) -> DataFrame:
    """(key, lang, phrase, a, l, r, n, score, covers): the worst cut, and the inner phrases of the same count."""
    schema = "key binary, lang string, phrase string, a long, l long, r long, n long, score long, covers array<binary>"

    def counts_of(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        one = rows[:, 1] < 0
        out[one] = words.read(rows[one, 0].astype(np.int64), "n")
        out[~one] = keys.read(keys.slots(rows[~one]), "a", counts=True)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.array([np.frombuffer(k, np.int32) for k in b.column(0).to_pylist()], np.int32).reshape(-1, LONGEST)
            a, length = b.column(1).to_pylist(), (rows >= 0).sum(1)
            firsts, rests = [], []
            for k in range(1, LONGEST):
                first, rest = rows.copy(), np.full_like(rows, -1)
                first[:, k:] = -1
                rest[:, : LONGEST - k] = rows[:, k:]
                valid = length > k
                left, right = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                left[valid], right[valid] = counts_of(first[valid]), counts_of(rest[valid])
                firsts.append((first, left.tolist()))
                rests.append((rest, right.tolist()))
            n = words.read(rows[:, 0].astype(np.int64), "total").tolist()
            names = [words.words(r[r >= 0].astype(np.int64)) for r in rows]
            out = []
            for i, (m, total, count) in enumerate(zip(length.tolist(), n, a, strict=True)):
                score, k = min((1000 * count * total // (firsts[k - 1][1][i] * rests[k - 1][1][i]), k) for k in range(1, m))
                covers = [x[0][i].tobytes() for x in (firsts[m - 2], rests[0]) if m > 2 and x[1][i] <= count]
                lang = names[i][0].rsplit(b" ", 1)[0]
                phrase = b" ".join(w.rsplit(b" ", 1)[1] for w in names[i])
                out.append({"key": rows[i].tobytes(), "lang": lang.decode(), "phrase": phrase.decode(), "a": count, "l": firsts[k - 1][1][i], "r": rests[k - 1][1][i], "n": total, "score": score, "covers": covers})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("covers", pa.list_(pa.binary()))]))

    return written(frequent.mapInArrow(run, schema))


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    counted = written(count_words(docs))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = written(counted.filter(F.col("n") >= MIN_COUNT).join(totals, "lang").select("lang", "word", "n", "total"))
    n_words, n_tokens = frequent.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    words = _word_keys(frequent, n_words, f"{folder}/words")
    corpus = encode(docs, words)
    tasks = corpus.rdd.getNumPartitions()
    per_length = 1024 + n_tokens // LOAD
    n_buckets = per_length * (LONGEST - 1)
    starts = np.minimum(np.arange(-(-n_buckets // BLOCK_BUCKETS) + 1, dtype=np.int64) * BLOCK_BUCKETS, n_buckets)
    maybe = _Filter(_bucket_bits(corpus, starts, per_length, tasks, f"{folder}/buckets"), per_length)
    keys = _phrase_keys(corpus, maybe, n_tokens, f"{folder}/keys")
    keys, found = _counted(corpus, maybe, keys, tasks, f"{folder}/counts")
    scored = _scored(found, keys, words)
    covered = scored.select(F.explode("covers").alias("key")).distinct()
    left = scored.join(covered, "key", "left_anti")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))
