"""Byte-level BPE by rounds over length-bucketed, padded numpy matrices.

Texts are cut by the vocabulary's pattern. White-space-delimited spans (with
the single space before them) are the unit of a bounded per-worker cache; what
the cache lacks is cut into pattern matches, and the distinct matches are
encoded together: rows of similar length form one padded matrix of ids, each
round looks all adjacent pairs up in a hash table, merges every row's leftmost
pair of minimum rank, compacts the row by one, and retires rows without a
mergeable pair. Matches longer than ``MATRIX_BYTES`` would need as many rounds
as bytes; they take a heap over a linked list with the same merge order.

Defined cases: null text counts as empty (no ids); any Unicode text is encoded
and decodes to its own UTF-8 bytes; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grapheion.llm.common import arrow_map, chunks, ship, table, texts_of

#: Longer matches are merged by heap.
MATRIX_BYTES = 256
CACHE_SPANS = 800_000
CACHE_CHARS = 40
NO_RANK = np.int32(2**31 - 1)

#: Unicode white space, spelt out because the regular-expression engines differ on it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPAN = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

_CODECS: dict[tuple[str, str], Codec] = {}


class PairTable:
    """(left id, right id) -> rank by open addressing, looked up a matrix at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 2.5))))
        self._shift = np.uint64(64 - bits)
        self._mask = np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NO_RANK, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo, self._probes = self._home(key), np.arange(len(key)), 0
        while len(todo):
            self._probes += 1
            free = todo[self._keys[slot[todo]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self._keys[slot[first]], self._ranks[slot[first]] = key[first], rank[first]
            todo = todo[self._keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self._mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NO_RANK`` where there is no merge or an id is negative."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        key[((left < 0) | (right < 0)).ravel()] = -2
        slot, out = self._home(key), np.full(len(key), NO_RANK, np.int32)
        todo = np.flatnonzero(key >= 0)
        for _ in range(self._probes):
            if not len(todo):
                break
            found = self._keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & self._mask
        return out.reshape(left.shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = {v: k for k, v in self.ranks.items()}
        self._match = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))
        self._byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self._spans: dict[str, bytes] = {}

    def encode_matches(self, matches: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each match."""
        out: list[bytes] = [b""] * len(matches)
        buckets: dict[int, list[int]] = {}
        for i, m in enumerate(matches):
            if (whole := self.ranks.get(m)) is not None:
                out[i] = np.array([whole], "<u4").tobytes()
            elif len(m) > MATRIX_BYTES:
                out[i] = self._by_heap(m)
            elif m:
                buckets.setdefault((len(m) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            self._by_matrix(matches, rows, out)
        return out

    def _by_matrix(self, matches: list[bytes], rows: list[int], out: list[bytes]) -> None:
        sizes = np.array([len(matches[i]) for i in rows])
        width = int(sizes.max())
        flat = np.frombuffer(b"".join(matches[i] for i in rows), np.uint8)
        cols = np.arange(width)
        ids = np.full((len(rows), width), -1, np.int32)
        ids[cols < sizes[:, None]] = self._byte[flat]
        where = np.array(rows)
        while True:
            ranks = self._pairs(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NO_RANK)
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            done = best == NO_RANK
            if done.any():
                for i, row, n in zip(where[done].tolist(), ids[done].astype("<u4"), sizes[done].tolist(), strict=True):
                    out[i] = row[:n].tobytes()
                if done.all():
                    return
                ids, at, best, sizes, where = ids[~done], at[~done], best[~done], sizes[~done], where[~done]
            shifted = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1, np.int32)], axis=1)
            ids = np.where(np.arange(ids.shape[1]) <= at[:, None], ids, shifted)
            ids[np.arange(len(ids)), at] = best
            sizes = sizes - 1
            ids = ids[:, : int(sizes.max())]

    def _by_heap(self, match: bytes) -> bytes:
        ids = self._byte[np.frombuffer(match, np.uint8)].tolist()
        n = len(ids)
        words: list[bytes | None] = [match[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(match[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            j = after[i]
            if words[i] is None or j >= n or len(words[i]) + len(words[j]) != size or rank(words[i] + words[j]) != r:
                continue
            words[i] += words[j]
            words[j] = None
            ids[i] = r
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (new := rank(words[a] + words[b])) is not None:
                    heapq.heappush(heap, (new, a, len(words[a]) + len(words[b])))
        return np.array([t for t, w in zip(ids, words, strict=True) if w is not None], "<u4").tobytes()

    def _learn(self, spans: Iterable[str]) -> dict[str, bytes]:
        """Ids of spans that the cache lacks; the cache keeps the short ones while it has room."""
        cuts = {s: self._match.findall(s) for s in spans}
        distinct = list({m for ms in cuts.values() for m in ms})
        ids = dict(zip(distinct, self.encode_matches([m.encode() for m in distinct]), strict=True))
        out = {s: b"".join([ids[m] for m in ms]) for s, ms in cuts.items()}
        room = CACHE_SPANS - len(self._spans)
        if room > 0:
            keep = [s for s in out if len(s) <= CACHE_CHARS][:room]
            self._spans.update((s, out[s]) for s in keep)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        spans = [_SPAN.findall(t) for t in texts]
        known = self._spans
        missing = set().union(*spans).difference(known) if spans else set()
        extra = self._learn(missing) if missing else {}
        out = []
        for ss in spans:
            try:
                out.append(b"".join([known[s] for s in ss]))
            except KeyError:
                out.append(b"".join([known[s] if s in known else extra[s] for s in ss]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for every document."""
    return _mapped(docs, path, pattern, "doc_id long, ids binary, decoded binary", lambda ids, decoded: [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())])


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); what it digests never leaves the worker."""

    def sha(values: list[bytes]) -> pa.Array:
        return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())

    return _mapped(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, decoded: [pa.array([len(i) // 4 for i in ids], pa.int64()), sha(ids), sha(decoded)])


def _mapped(docs: DataFrame, path: str, pattern: str, schema: str, columns) -> DataFrame:
    ship(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(b: pa.RecordBatch):
        c = codec(path, pattern)
        doc, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in chunks(texts, 2_000_000):
            ids = c.encode(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), *columns(ids, [c.decode(i) for i in ids])], names=names)

    return arrow_map(texts_of(docs), run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"), *default_vocabulary())
