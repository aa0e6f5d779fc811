"""Which texts hold which others: every pair, whatever the length of either.

A text begins and ends with strings of L bytes, L the largest power of two that is no longer than it,
and these two cover it. Hashes of all strings of L bytes of a document come from those of half the
length, so a document is passed once for each length that texts have, however many texts there are:
where both hashes are met at the text's distance, its bytes are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grapheion.shipping import ship

#: Texts and bytes of texts that a pass over the documents looks for, about.
TEXTS, BYTES = 65_536, 1 << 23
#: Places of documents that are hashed at once, and of these the candidates that are looked at together.
WINDOW, TOGETHER = 1 << 16, 1 << 20
#: Rows handed on at once.
ROWS = 200_000
#: Odd, so that powers keep all bits; the second one spreads hashes over a table.
BASE, MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xD6E8FEB86659FD93)


def pairs(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, key): each text of ``asked`` (query_id, text) with each row of ``docs`` (key, body) that holds it, byte for byte.

    Documents are not moved. Texts go out in blocks, whose bound holds at any size. An empty text is
    held by all, a null one by none.
    """
    ship(docs.sparkSession)
    asked = asked.filter("text is not null").select("query_id", "text")
    docs = docs.filter("body is not null").select("key", "body")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // TEXTS), -(-(size.bytes or 0) // BYTES))
    spread = F.pmod(F.xxhash64("query_id", "text"), F.lit(blocks))
    kinds = [(asked.schema["query_id"].dataType, "query_id"), (docs.schema["key"].dataType, "key")]
    schema = ", ".join(f"{n} {t.simpleString()}" for t, n in kinds)
    found = None
    for b in range(blocks):
        table = asked.filter(spread == b).toArrow().combine_chunks()
        part = docs.mapInArrow(_held(table), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _doubled(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(L, hashes of the strings of L bytes at each place) for L = 1, 2, 4 ... up to ``most``."""
    size, power, hashes = 1, BASE, data.astype(np.uint64) + np.uint64(1)
    while size <= most and len(hashes):
        yield size, hashes
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:] if len(hashes) > size else hashes[:0]
        size, power = 2 * size, power * power % (1 << 64)


def _hashes(strings: np.ndarray) -> np.ndarray:
    """The same hashes of rows of L bytes."""
    power, hashes = BASE, strings.astype(np.uint64) + np.uint64(1)
    while hashes.shape[1] > 1:
        hashes = hashes[:, ::2] * np.uint64(power) + hashes[:, 1::2]
        power = power * power % (1 << 64)
    return hashes[:, 0]


class _Texts:
    """Texts of one L in the order of the hash that they begin with."""

    def __init__(self, size: int, numbers: np.ndarray, texts: list[bytes]):
        heads, tails = (_hashes(np.frombuffer(b"".join(texts[n][part] for n in numbers), np.uint8).reshape(-1, size)) for part in (slice(size), slice(-size, None)))
        order = np.argsort(heads, kind="stable")
        self.size, self.numbers, self.tails = size, numbers[order], tails[order]
        self.lengths = np.array([len(texts[n]) for n in self.numbers], np.int64)
        self.heads, self.first, self.counts = np.unique(heads[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(max(len(self.heads).bit_length() + 6, 8), 22))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[(self.heads * MIX) >> self.shift] = True

    def found(self, hashes: np.ndarray, places: int, room: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, text's number) of what begins at one of the first ``places`` and ends in ``room(place)`` bytes."""
        at = np.flatnonzero(self.table[(hashes[:places] * MIX) >> self.shift])
        head = np.minimum(np.searchsorted(self.heads, hashes[at]), len(self.heads) - 1)
        met = self.heads[head] == hashes[at]
        at, head = at[met], head[met]
        until = np.cumsum(self.counts[head])
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + TOGETHER, "right")))
            n = self.counts[head[lo:hi]]
            place = np.repeat(at[lo:hi], n)
            which = np.repeat(self.first[head[lo:hi]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(place))
            fits = np.flatnonzero(self.lengths[which] <= room(place))
            place, which = place[fits], which[fits]
            same = hashes[place + self.lengths[which] - self.size] == self.tails[which]
            yield place[same], self.numbers[which[same]]
            lo = hi


def _held(table: pa.Table) -> Callable:
    """mapInArrow function: (query_id, key) of (key, body) for the texts of ``table`` (query_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = table.column(0).combine_chunks(), [t.encode() for t in table.column(1).to_pylist()]
        ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
        lengths = np.array([len(t) for t in texts], np.int64)
        empty, longest = np.flatnonzero(lengths == 0), int(lengths.max(initial=0))
        by_size = {1 << k: np.flatnonzero(lengths >> k == 1) for k in range(longest.bit_length())}
        by_size = {s: _Texts(s, numbers, texts) for s, numbers in by_size.items() if len(numbers)}
        for b in batches:
            if not b.num_rows or not texts:
                continue
            body = b.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
            codes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo in range(int(offsets[0]), int(offsets[-1]) if by_size else 0, step := max(WINDOW, longest)):
                here = min(step, int(offsets[-1]) - lo)
                part = data[lo : min(lo + here + longest - 1, int(offsets[-1]))]
                for size, hashes in _doubled(part, max(by_size)):
                    if size in by_size:
                        row = lambda place: np.searchsorted(offsets, lo + place, "right") - 1  # noqa: B023, E731
                        for place, number in by_size[size].found(hashes, here, lambda place: offsets[row(place) + 1] - lo - place):  # noqa: B023
                            code, one = np.unique(row(place) * len(texts) + number, return_index=True)
                            codes.append(code)
                            places.append(lo + place[one])
            code, one = np.unique(np.concatenate(codes), return_index=True)
            place = np.concatenate(places)[one]
            # what two hashes say is compared; were it another text here, the document could hold it elsewhere
            bytes_ = lambda lo, hi: data[lo:hi].tobytes()  # noqa: B023, E731
            sure = [bytes_(p, p + len(t := texts[n])) == t or t in bytes_(offsets[r], offsets[r + 1]) for r, n, p in zip(*(x.tolist() for x in (*np.divmod(code, len(texts)), place)))]
            code = code[np.array(sure, bool)]
            code = np.concatenate([code, (np.arange(b.num_rows)[:, None] * len(texts) + empty).ravel()]) if len(empty) else code
            for lo in range(0, len(code), ROWS):
                r, n = np.divmod(code[lo : lo + ROWS], len(texts))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), b.column(0).take(pa.array(r))], names=["query_id", "key"])

    return run
