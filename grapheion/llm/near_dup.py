"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct four-word shingles; documents are linked
when 100 * |intersection| >= 80 * |union|, and classes are the connected
components of the links.

1. Documents of equal sets become one class at once (a partial aggregation), so
   copies, however many, are one member from here on.
2. ``TREES`` independent trees: in each, a class walks a path of ``DEPTH`` selected
   minwise tokens; classes on equal paths meet in a node. A pair of similarity s
   meets in a tree with probability s**DEPTH, so at 0.8 all trees together find
   it with 1 - (1 - 0.8**3)**10 > 0.999.
3. A node of more than ``NODE_CLASSES`` classes, or ``NODE_SHINGLES`` shingles, is branched:
   each class goes to ``CHILDREN`` children, by minwise tokens that no node above
   was made by. At similarity 0.8 a pair stays together in one of three children
   with probability above 0.99. A node most of whose members agree on each of these
   tokens is dense: branching would hardly make it smaller, so it is dealt over
   blocks of bounded size, as is what is left after the last level. As dealt
   nodes are finished exactly, this decides on cost only.
4. Nodes with equal members are compared once. In a node a pivot is compared
   with all others on full sets; those linked to it leave the node. By the
   triangle inequality of the Jaccard distance only members at 0.6 or more to the
   pivot can be linked to what left, and these are compared with it one by one
   until a link is found. So a node's components are exact without all pairs.
5. Pivots of a dealt node meet again a few times, which joins large groups of near
   copies cheaply. Then every dealt node that still holds several components is
   finished exactly: all members but those of its largest component visit the other
   blocks and are compared with their members of other components on full sets. In
   nodes of more than ``FEW_BLOCKS`` blocks a member visits only blocks that it can be
   linked in: sets linked at s share one of their n - ceil(s * n) + 1 first tokens in
   any common order, and the node's rarest tokens come first. So members that share
   only what is frequent in the node travel nowhere.
6. Components by least-label propagation with pointer jumping over written
   tables.

Sets never leave the worker except towards nodes of two or more classes. All texts
are shuffled once; those of classes that meet another are then kept as a table of
their own, from which every comparison reads.

Defined cases: null or empty text has an empty set and is linked with nothing;
texts under four words are one shingle of all words; repeated rows are copies of
one another; a null doc_id ranks after all others, and a class none of whose rows
has an id meets no other class (component_id null, kept); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.llm.common import arrow_map, chunks, ship, table, texts_of, written
from grapheion.llm.shingles import mix, shingle_sets

SHINGLE_WORDS = 4
#: Link where PERCENT * |union| <= 100 * |intersection|.
PERCENT = 80
TREES = 10
DEPTH = 3
#: Larger nodes are branched or dealt over blocks: classes, and shingles of their sets.
NODE_CLASSES, NODE_SHINGLES = 1000, 1_000_000
#: Bytes of sets that leave a worker together.
SEND_BYTES = 4_000_000
#: Levels of branching below a tree's first node, and children of a member at each.
LEVELS, CHILDREN = 12, 3
#: Further minwise tokens of each tree for branching.
EXTRA = 8
#: Ways in which the rows of one large component are dealt.
SALTS = 8
#: Meetings of the pivots of dealt nodes before these are finished exactly.
PIVOT_ROUNDS = 3
#: Dealt nodes of at most so many blocks are finished without a look at their prefixes; links are the same.
FEW_BLOCKS = 8
#: Tokens that leave a worker together.
SEND_TOKENS = 500_000
#: Share of a node that agrees on each of its tokens from which it counts as dense.
DENSE = 0.6

_SEEDS = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, 2 * TREES * (DEPTH + EXTRA), dtype=np.uint64)


def _binary(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def minwise(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Minwise tokens (functions x texts); columns of empty sets are meaningless."""
    n = len(_SEEDS) // 2
    out = np.zeros((n, len(sizes)), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for k in range(n):
            out[k, some] = np.minimum.reduceat((sets ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), starts)
    return out


def _class_of(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def text_digest() -> Column:
    """64 bits of the text, that tell rows of one doc_id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, digest, n_shingles, cls, paths, extra) for every document."""

    def run(b: pa.RecordBatch):
        texts = _binary(b.column(1))
        for lo, hi in chunks(texts):
            sizes, sets = shingle_sets(texts[lo:hi], width)
            low = minwise(sets, sizes)
            paths = np.zeros((TREES, hi - lo), np.uint64)
            for t in range(TREES):
                h = np.full(hi - lo, t + 1, np.uint64)
                for d in range(DEPTH):
                    h = mix(h + low[t * DEPTH + d])
                paths[t] = h
            extra = (mix(low[TREES * DEPTH :]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(sizes), pa.array(_class_of(sets, sizes)), pa.array(list(paths.T.copy().view(np.int64)), longs), pa.array(list(extra.T.copy()), pa.list_(pa.int32()))],
                names=["doc_id", "digest", "n_shingles", "cls", "paths", "extra"],
            )

    return arrow_map(texts_of(docs).withColumn("digest", text_digest()), run, "doc_id long, digest long, n_shingles long, cls long, paths array<long>, extra array<int>")


def nodes(classes: DataFrame) -> DataFrame:
    """(path, block, blocks, cls) of every node of two or more classes, nodes of equal members once.

    ``classes``: (cls, paths, extra) and size if known, one row a class; ``extra`` holds ``EXTRA`` tokens for each path.
    """
    if "size" not in classes.columns:
        classes = classes.withColumn("size", F.lit(1).cast("long"))
    rows = classes.select("cls", "size", F.posexplode("paths").alias("tree", "path"))
    done = []
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("n"), _blocks().alias("blocks")).filter("n > 1")
        rows = written(rows.join(sizes, "path"))
        done.append(rows.filter("blocks = 1").select("path", "cls", "n", "blocks"))
        large = rows.filter("blocks > 1")
        if large.limit(1).count() == 0:
            break
        if level == LEVELS:
            done.append(large.select("path", "cls", "n", "blocks"))
            break
        # only members of large nodes carry tokens: their tree's own first, then those of the next trees
        token = lambda k: F.element_at("extra", F.pmod(F.col("tree") * EXTRA + CHILDREN * level + k, F.size("extra")) + 1)  # noqa: B023, E731
        tokens = F.array(*[token(k) for k in range(CHILDREN)])
        large = written(large.join(classes.select("cls", "extra"), "cls").select("path", "cls", "size", "tree", "n", "blocks", tokens.alias("tokens")))
        # a node is dense if each token has a value that most of it holds: counted, never gathered
        held = large.select("path", "n", F.posexplode("tokens").alias("k", "token")).groupBy("path", "n", "k", "token").agg(F.count("*").alias("m"))
        most = held.groupBy("path", "n", "k").agg(F.max("m").alias("m"))
        dense = most.groupBy("path").agg((F.min("m") >= DENSE * F.max("n")).alias("dense"))
        large = written(large.join(dense, "path"))
        done.append(large.filter("dense").select("path", "cls", "n", "blocks"))
        more = large.filter("not dense")
        if more.limit(1).count() == 0:
            break
        child = F.explode(F.transform("tokens", lambda t, k: F.xxhash64("path", t, k)))
        rows = more.select("cls", "size", "tree", child.alias("path"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    same = found.groupBy("path").agg(F.max("n").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("xor"))
    once = same.groupBy("n", "sum", "xor").agg(F.min("path").alias("path")).select("path")
    return found.join(once, "path").select("path", "blocks", F.pmod(F.xxhash64("cls", "path"), F.col("blocks")).cast("int").alias("block"), "cls")


def _blocks() -> Column:
    """Blocks over which a node is dealt, from its classes and their sizes."""
    return F.greatest(F.ceil(F.count("*") / NODE_CLASSES), F.ceil(F.sum("size") / NODE_SHINGLES)).cast("int")


class _Group:
    """Classes of one block of a node, with full sets."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.ids = [c for c, _ in members]
        self.sets = [s for _, s in members]
        self.sizes = np.array([len(s) for s in self.sets])

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of a member with others."""
        mine = self.sets[one]
        tokens = np.concatenate([self.sets[o] for o in others])
        owner = np.repeat(np.arange(len(others)), self.sizes[others])
        hit = mine[np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)] == tokens
        return np.bincount(owner[hit], minlength=len(others))

    def components(self, percent: int = PERCENT) -> tuple[list[tuple[int, int]], list[int]]:
        """Links that connect what is linked, and the pivots."""
        links, pivots = [], []
        rest = np.argsort(self.sizes, kind="stable")
        while len(rest):
            pivot, rest = int(rest[0]), rest[1:]
            pivots.append(self.ids[pivot])
            if not len(rest):
                break
            # sizes ascend: beyond size * 100 / (2 * percent - 100) no member can be linked even through what leaves
            near = rest[: np.searchsorted(self.sizes[rest], self.sizes[pivot] * 100 / max(1, 2 * percent - 100), "right")]
            if not len(near):
                continue
            both = self.shared(pivot, near)
            union = self.sizes[pivot] + self.sizes[near] - both
            linked = 100 * both >= percent * union
            left = near[linked]
            if not len(left):
                continue
            links += [(self.ids[pivot], self.ids[o]) for o in left]
            for b in near[~linked & (100 * both >= (2 * percent - 100) * union)]:
                close = left[(100 * self.sizes[left] >= percent * self.sizes[b]) & (100 * self.sizes[b] >= percent * self.sizes[left])]
                for lo in range(0, len(close), 64):
                    part = close[lo : lo + 64]
                    s = self.shared(int(b), part)
                    if (found := np.flatnonzero(100 * s >= percent * (self.sizes[b] + self.sizes[part] - s))).size:
                        links.append((self.ids[b], self.ids[part[found[0]]]))
                        break
            rest = rest[~np.isin(rest, left)]
        return links, pivots


def _with_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``members`` (doc_id, cls, ... of long and int) with each class's set as ``data`` in place of doc_id.

    A document is read once for all rows of its class.
    """
    ship(docs.sparkSession)
    fields = [f for f in members.schema.fields if f.name != "doc_id"]
    names = [f.name for f in fields]
    types = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() for f in fields]
    wanted = members.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("at"))
    read = texts_of(docs).join(wanted.hint("merge"), "doc_id")

    def spread(b: pa.RecordBatch):
        ats, texts = b.column(2).to_pylist(), _binary(b.column(1))
        for lo, hi in chunks(texts, 1_000_000):
            sizes, sets = shingle_sets(texts[lo:hi], width)
            cls = _class_of(sets, sizes).tolist()
            ends = np.cumsum(sizes).tolist()
            rows, weight = [], 0

            def out(rows: list[tuple]) -> pa.RecordBatch:
                *keys, d = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(keys, types, strict=True)], pa.array(d, pa.binary())], names=[*names, "data"])

            for i, at in enumerate(ats[lo:hi]):
                data = sets[ends[i] - int(sizes[i]) : ends[i]].tobytes()
                for a in at:
                    # rows that repeat a doc_id with another text are of another class
                    if a["cls"] == cls[i]:
                        rows.append((*(a[n] for n in names), data))
                        weight += len(data)
                        if weight > SEND_BYTES:
                            yield out(rows)
                            rows, weight = [], 0
            if rows:
                yield out(rows)

    return arrow_map(read, spread, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", data binary")


def compare(docs: DataFrame, members: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b, path): links found in each block, and with null b the pivots of nodes dealt over blocks.

    ``members``: (doc_id, cls, path, block, blocks).
    """
    met = _with_sets(docs, members.select("doc_id", "path", "block", "blocks", "cls"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        a, b, path = [], [], []

        def close() -> None:
            if len(group) > 1 or key and key[2] > 1:
                links, pivots = _Group(list(group.items())).components(percent)
                for x, y in links:
                    a.append(x)
                    b.append(y)
                    path.append(key[0])
                if key[2] > 1:
                    a.extend(pivots)
                    b.extend([None] * len(pivots))
                    path.extend([key[0]] * len(pivots))

        def out() -> pa.RecordBatch:
            r = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(path, pa.int64())], names=["a", "b", "path"])
            a.clear()
            b.clear()
            path.clear()
            return r

        for batch in batches:
            for p, bl, bs, c, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (p, bl, bs) != key:
                    close()
                    key, group = (p, bl, bs), {}
                group[c] = np.frombuffer(data, np.uint64)
            if len(a) > 10_000:
                yield out()
        close()
        yield out()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "path", "block").sortWithinPartitions("path", "block").mapInArrow(run, "a long, b long, path long")


class _Index:
    """Postings of one block, to count what a set shares with every member."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.ids = [c for c, _, _ in members]
        self.roots = [r for _, r, _ in members]
        self.distinct = set(self.roots)
        self.sizes = np.array([len(s) for _, _, s in members])
        tokens = np.concatenate([s for _, _, s in members])
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by], np.repeat(np.arange(len(members)), self.sizes)[by]

    def linked(self, one: np.ndarray, percent: int) -> list[int]:
        first = np.searchsorted(self.tokens, one, "left")
        n = np.searchsorted(self.tokens, one, "right") - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (len(one) + self.sizes - both)).tolist()


def _tokens(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(path, cls, token) of all members (doc_id, path, cls)."""

    def spread(b: pa.RecordBatch):
        paths, classes, sets = (b.column(i) for i in range(3))
        sizes = np.array([len(d.as_buffer()) // 8 for d in sets], np.int64)
        lo = 0
        while lo < len(sizes):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), SEND_TOKENS)))
            tokens = np.concatenate([np.frombuffer(d.as_buffer(), np.int64) for d in sets.slice(lo, hi - lo)])
            at = pa.array(np.repeat(np.arange(lo, hi if hi < len(sizes) else len(sizes)), sizes[lo:hi]))
            yield pa.RecordBatch.from_arrays([paths.take(at), classes.take(at), pa.array(tokens)], names=["path", "cls", "token"])
            lo = hi

    return arrow_map(_with_sets(docs, members.select("doc_id", "path", "cls"), width), spread, "path long, cls long, token long")


def _visits(docs: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """(path, cls, block): where members outside of ``main`` can be linked to members of other components.

    Blocks of a token are distinct with their least and greatest root, so nothing grows with
    the pairs: at worst a member visits every block.
    """
    tokens = written(_tokens(docs, dealt, width))
    met = tokens.groupBy("path", "token").agg(F.count("*").alias("n"))
    member = Window.partitionBy("path", "cls")
    first = tokens.join(met, ["path", "token"]).withColumn("r", F.row_number().over(member.orderBy("n", "token"))).withColumn("size", F.count("*").over(member))
    # at least ceil(percent * size / 100) tokens are shared with whatever is linked
    prefix = first.filter(F.col("r") <= F.col("size") - F.expr(f"({percent} * size + 99) div 100") + 1).filter("n > 1")
    held = written(prefix.select("path", "cls", "token").join(dealt.select("path", "cls", "block", "root", "main"), ["path", "cls"]))
    at = held.groupBy("path", "token", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumnRenamed("block", "there")
    seen = held.filter("root <> main").join(at, ["path", "token"]).filter("there <> block and (lo <> root or hi <> root)")
    return seen.select("path", "cls", F.col("there").alias("block")).distinct()


def finish(docs: DataFrame, members: DataFrame, roots: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): what connects members of different blocks of a dealt node that ``roots`` (cls, root) leaves apart.

    Members outside of the node's largest component visit other blocks: all of them in nodes of
    few blocks, else those where their prefix is met (``_visits``). Their own block's pairs have
    been compared before. Nothing else is copied, and a node of one component is left out.
    """
    dealt = members.filter("blocks > 1").join(roots, "cls")
    parts = dealt.groupBy("path", "root").agg(F.count("*").alias("m"))
    largest = parts.groupBy("path").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    dealt = written(dealt.join(largest, "path").select("doc_id", "path", "block", "blocks", "cls", "root", "main").withColumn("side", F.lit(0)))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block")))
    visits = dealt.filter("root <> main").filter(F.col("blocks") <= FEW_BLOCKS).withColumn("side", F.lit(1)).withColumn("block", other)
    many = dealt.filter(F.col("blocks") > FEW_BLOCKS)
    if many.limit(1).count():
        there = _visits(docs, many, width, percent)
        visits = visits.unionByName(many.drop("block").join(there, ["path", "cls"]).withColumn("side", F.lit(1)).select(visits.columns))
    met = _with_sets(docs, dealt.unionByName(visits).select("doc_id", "path", "block", "side", "cls", "root"), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, index, top, out = None, [], None, {}, []

        def find(r: int) -> int:
            while (up := top.get(r, r)) != r:
                r = up
            return r

        for batch in batches:
            for p, bl, side, c, root, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (p, bl) != key:
                    key, block, index, top = (p, bl), [], None, {}
                tokens = np.frombuffer(data, np.uint64)
                if side == 0:
                    block.append((c, root, tokens))
                    continue
                if not block:
                    continue
                index = index or _Index(block)
                if len(index.distinct) == 1 and find(root) == find(index.roots[0]):
                    continue
                for o in index.linked(tokens, percent):
                    a, b = find(root), find(index.roots[o])
                    if a != b:
                        top[a] = b
                        out.append((c, index.ids[o]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                out.clear()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(n, "path", "block").sortWithinPartitions("path", "block", "side").mapInArrow(run, "a long, b long")


def _spread_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Join where ``left`` may hold one key very often and ``right`` holds each once: dealt over salts by ``by``."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right, [key, "salt"]).drop("salt")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, label, root): least label over each connected component, and a class that stands for it.

    ``vertices``: (cls, label) with distinct cls; ``links``: (a, b). Every round takes the least
    label of the neighbours, then follows the label's owner once; null labels rank last.
    Before, each b keeps its least a only, to which its other a are linked instead: the links
    that every tree has found to some pivot shrink to one a class.
    """
    links = links.select("a", "b").filter("a <> b").distinct()
    led = links.join(links.groupBy("b").agg(F.min("a").alias("lead")), "b")
    links = written(led.select(F.col("lead").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct())
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    touched = written(vertices.join(both.select(F.col("a").alias("cls")).distinct(), "cls", "left_semi").withColumn("root", F.col("cls")))
    # a component is labelled by its least (label, root); root leads to the vertex that owns the label
    rank = F.struct(F.col("label").isNull().alias("none"), "label", "root")
    state = touched.select("cls", rank.alias("r"))
    while True:
        near = _spread_join(both, state.withColumnRenamed("cls", "b"), "b", "a").groupBy("a").agg(F.min("r").alias("m")).withColumnRenamed("a", "cls")
        lower = state.join(near, "cls").select("cls", F.col("r").alias("old"), F.least("r", "m").alias("r"))
        owner = lower.select(F.col("cls").alias("root"), F.col("r").alias("up"))
        jumped = _spread_join(lower.withColumn("root", F.col("r.root")), owner, "root", "cls").select("cls", "old", F.least("r", "up").alias("r"))
        step = written(jumped)
        state = step.select("cls", "r")
        if step.filter("old <> r").limit(1).count() == 0:
            break
    return vertices.join(state, "cls", "left").select("cls", F.when(F.col("r").isNull(), F.col("label")).otherwise(F.col("r.label")).alias("label"), F.coalesce("r.root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    return judged(docs, width, percent).drop("digest")


def judged(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) for every document."""
    ship(docs.sparkSession)
    signed = written(signatures(docs, width))
    # equal sets: least id, and the paths, which are the same for all of them
    classes = written(signed.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("label"), F.first("n_shingles").alias("size"), F.first("paths").alias("paths"), F.first("extra").alias("extra")))
    reader = classes.filter("label is not null").select("cls", F.col("label").alias("doc_id"), "size")
    members = written(nodes(classes.filter("label is not null").select("cls", "size", "paths", "extra")).join(reader, "cls"))
    # the texts of classes that meet another: all that is compared from here on
    docs = written(texts_of(docs).join(members.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    found = written(compare(docs, members, width, percent))
    links = found.filter("b is not null").select("a", "b")
    for salt in range(PIVOT_ROUNDS):
        # pivots of a node dealt over blocks meet; ever fewer of them, dealt anew while they fill more than a block
        pivots = found.filter("b is null").select(F.col("a").alias("cls"), "path").distinct()
        if pivots.limit(1).count() == 0:
            break
        pivots = pivots.join(reader, "cls")
        sizes = pivots.groupBy("path").agg(F.count("*").alias("n"), _blocks().alias("blocks")).filter("n > 1")
        again = pivots.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(salt)), F.col("blocks")).cast("int"))
        found = written(compare(docs, again, width, percent))
        links = links.unionByName(found.filter("b is not null").select("a", "b"))
    labelled = written(components(classes.select("cls", "label"), links))
    if members.filter("blocks > 1").limit(1).count():
        links = written(links.unionByName(finish(docs, members, labelled.select("cls", "root"), width, percent)))
        labelled = written(components(classes.select("cls", "label"), links))
    # a plain join of two tables, so that Spark can split the rows of a large class
    out = signed.join(labelled.select("cls", "label"), "cls", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Exact on small tables: all pairs that share a shingle.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN m ON a = doc_id
"""
