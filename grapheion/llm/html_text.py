"""Main text of web pages by site template removal.

Every page is parsed into a light tree of elements. Block elements are hashed
with their whole subtree (tags and texts); Spark counts on how many distinct
articles of a host each hash occurs, and subtrees that recur on many of them are
template and deleted, wherever they stand. What remains is reduced to the
article: elements that are never main text by tag (nav, header, footer, aside,
form, script, ...), by role or as hidden are dropped; then the outermost article
elements are taken, else main, else the whole page.

Furniture whose text differs from page to page (adverts, reader comments) has no
recurring subtree. There an element's tag, class and id are counted like a subtree
if they hold a telling word (ad, sidebar, cookie, comments, ...): the element goes
where that frame stands on ``NAMED_PAGES`` articles of its host or more and on
``NAMED_SHARE`` of them. A block that merely bears such a word on few pages of many
stays. Only on hosts of fewer than
``OUTSIDE_PAGES`` articles, where nothing can be counted, the word alone decides.

Inside an article a passage may recur honestly, so there a subtree is template
only from ``INSIDE_PAGES`` articles and ``INSIDE_SHARE`` of the host's articles on;
elsewhere from ``OUTSIDE_PAGES`` and ``OUTSIDE_SHARE`` on. Pages of one host with
equal articles count once: a copied article is no template.

Batches reduce their pages to distinct articles, counts are pre-aggregated
before the shuffle over (host, hash), and a host's templates number at most its
blocks and frames a page over the share. They come back to the pages in a broadcast only
while there are at most ``BROADCAST_ROWS`` of them in all, beyond that in a join
whose skewed hosts Spark splits.

Defined cases: null or empty html, or a page without main text, gives an empty
text; broken markup (unclosed or crossed tags, bare ``<``) is read as browsers
do in the simple cases and in time linear in its length; repeated rows are pages
of their own; a null page_id or url stays null (null urls share one host); other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm.common import arrow_map, chunks, ship, table, written

OUTSIDE_PAGES, OUTSIDE_SHARE = 5, 0.05
INSIDE_PAGES, INSIDE_SHARE = 20, 0.5
NAMED_PAGES, NAMED_SHARE = 3, 0.05
BROADCAST_ROWS = 50_000
#: In place of a hash: the host has too few articles to count on.
FEW = 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
DROP = frozenset("head nav header footer aside form button select menu dialog canvas object audio video fieldset label option".split()) | RAW
BLOCK = frozenset(
    "address article blockquote body br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | DROP
#: An opening tag on the left closes an open element on the right.
CLOSES = {
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()},
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: ... but never across one of these.
SCOPE = frozenset("article section main div ul ol dl table body html nav header footer aside form td th blockquote".split())
#: Words in class or id that mark what is not main text.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|header|masthead|footer|foot|cookie|cookies|consent|notice|alert|popup|modal|newsletter|subscribe|signup|share|social|related|recommended|comment|comments|respond|disqus|reader-comments|widget|pagination|pager|toolbar|skip|login|search)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]{0,63})")
_DELIMITER = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


#: The two lowest bits of a hash: a subtree outside or inside of an article, or the frame of a named element.
OUTSIDE, INSIDE, NAMED = 0, 1, 3


def _signed(digest: bytes, kind: int) -> int:
    return int.from_bytes(digest, "little", signed=True) & ~3 | kind


class Node:
    __slots__ = ("tag", "attrs", "children", "kept")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.children, self.kept = tag, attrs, [], None


class _Ends:
    """Where tags end: the first ``>`` outside of quotes.

    Once a tag has none, ends are taken from a table over all quotes and ``>``, made from the
    end of the page backwards, so that a page full of unclosed tags is not scanned from each.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.at: list[int] | None = None
        self.end: list[int] = []

    def find(self, at: int) -> int:
        if at > self.last:
            return -1
        if self.at is not None:
            return self.end[bisect_left(self.at, at)]
        p = at
        while (m := _DELIMITER.search(self.source, p)) is not None:
            if m[0] == ">":
                return m.start()
            p = self.source.find(m[0], m.end()) + 1
            if not p:
                break
        self._tabulate()
        return -1

    def _tabulate(self) -> None:
        found = [(m.start(), m[0]) for m in _DELIMITER.finditer(self.source)]
        self.at = [p for p, _ in found]
        self.end = [-1] * (len(found) + 1)
        nearest: dict[str, int] = {}
        for i in range(len(found) - 1, -1, -1):
            p, c = found[i]
            if c == ">":
                self.end[i] = p
            else:
                self.end[i] = self.end[nearest[c] + 1] if c in nearest else -1
                nearest[c] = i


class _Stack:
    """Open elements, with the places of each tag and of those that end a search for what a tag closes."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def innermost(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(source: str) -> Node:
    """A tree whose children are Nodes and decoded strings."""
    root = Node("#root", "")
    stack, ends = _Stack(root), _Ends(source)
    done, at, size = 0, source.find("<"), len(source)

    def text(upto: int) -> None:
        if upto > done:
            stack.nodes[-1].children.append(html.unescape(source[done:upto]))

    # source[:done] is in the tree; at is the next "<", or -1
    while at >= 0:
        mark = source[at + 1 : at + 2]
        if mark in ("!", "?"):
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                end = size if end < 0 else end + 3
            else:
                end = source.find(">", at) + 1 if at < ends.last else 0
            if end:
                text(at)
                done = end
            at = source.find("<", max(end, at + 1))
            continue
        m = _NAME.match(source, at + 1)
        close = ends.find(m.end()) if m else -1
        if close < 0:
            at = source.find("<", at + 1) if at < ends.last else -1
            continue
        text(at)
        done = close + 1
        tag, attrs = m[2].lower(), source[m.end() : close]
        if m[1]:
            if i := stack.innermost((tag,)):
                stack.cut(i)
            elif tag == "p":
                stack.nodes[-1].children.append(Node("p", ""))
        else:
            if closes := CLOSES.get(tag):
                i = stack.innermost(closes)
                if i and i >= (stack.scopes[-1] if stack.scopes else 0):
                    stack.cut(i)
            node = Node(tag, attrs)
            stack.nodes[-1].children.append(node)
            if tag in RAW:
                # their content is no markup: up to the matching end tag, or all
                found = _CLOSE[tag].search(source, done)
                done = found.end() if found else size
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                stack.push(node)
        at = source.find("<", done)
    text(size)
    return root


def _attr(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}


def is_noise(node: Node) -> bool:
    """Never main text, judged by tag and role, or hidden."""
    if node.tag in DROP:
        return True
    if not node.attrs or node.tag in ("main", "body", "html"):
        return False
    a = _attr(node.attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES:
        return True
    return "display:none" in a.get("style", "").replace(" ", "").lower()


def named(node: Node) -> int | None:
    """Hash of tag, class and id (but for digits) of an element that a telling word marks as furniture."""
    if not node.attrs or node.tag in ("main", "body", "html"):
        return None
    a = _attr(node.attrs)
    names = a.get("class", ""), a.get("id", "")
    if not any(NOISE.search(n) for n in names):
        return None
    frame = "\0".join([node.tag, *(re.sub(r"\d+", "0", n.lower()) for n in names)])
    return _signed(hashlib.blake2b(frame.encode("utf-8", "replace"), digest_size=8).digest(), NAMED)


def prune(node: Node, template: frozenset[int] | set[int]) -> None:
    stack = [node]

    def goes(c: Node) -> bool:
        return is_noise(c) or (frame := named(c)) is not None and (FEW in template or frame in template)

    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not goes(c)]
        stack.extend(c for c in n.children if not isinstance(c, str))


def main_part(root: Node) -> list[Node]:
    """The outermost article elements, else main, else the whole page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag == wanted:
                found.append(n)
            else:
                stack.extend(c for c in reversed(n.children) if not isinstance(c, str))
        if found:
            return found
    return [root]


def blocks(nodes: list[Node], template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of blocks in page order; subtrees in ``template`` (by hash) are left out."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(part)).strip()
        if text:
            out.append(text)
        part.clear()

    # None stands for the end of a block
    for node in nodes:
        stack: list[Node | str | None] = [node]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                part.append(n)
            elif not (template and n.kept in template):
                if n.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(n.children))
        flush()
    return out


def hash_subtrees(root: Node) -> tuple[set[int], int]:
    """Hashes of block subtrees that hold text and of named frames, and the digest of the main part.

    Sets ``kept`` to each node's hash; its lowest bits tell whether the node stands in an article.
    """
    found: set[int] = set()
    main = hashlib.blake2b(digest_size=8)

    def entered(n: Node, inside: bool) -> list:
        return [n, inside, iter(n.children), hashlib.blake2b(n.tag.encode(), digest_size=8), False]

    stack, whole = [entered(root, False)], b""
    while stack:
        n, inside, children, h, holds = top = stack[-1]
        inside_here = inside or n.tag in ("article", "main")
        for c in children:
            if isinstance(c, str):
                if text := _SPACE.sub(" ", c).strip():
                    h.update(b"\0" + text.encode("utf-8", "replace"))
                    top[4] = holds = True
            elif c.tag not in RAW:
                stack.append(entered(c, inside_here))
                break
        else:
            stack.pop()
            d = h.digest()
            n.kept = _signed(d, INSIDE if inside else OUTSIDE)
            if (frame := named(n)) is not None:
                found.add(frame)
            if holds and n.tag in BLOCK and n.tag not in ("html", "body", "article", "main"):
                found.add(n.kept)
            if inside_here and not inside:
                main.update(d)
            if stack:
                stack[-1][3].update(b"\1" + d)
                stack[-1][4] |= holds
            else:
                whole = d
    if len(main_part(root)) == 1 and main_part(root)[0] is root:
        main.update(whole)
    return found, int.from_bytes(main.digest(), "little", signed=True)


def text_of(source: str | None, template: frozenset[int] | set[int] = frozenset({FEW})) -> str:
    """Main text of a page, given the template of its host (of a page by itself: nothing to count on)."""
    if not source:
        return ""
    root = parse(source)
    if template - {FEW}:
        hash_subtrees(root)
    prune(root, template)
    return " ".join(blocks(main_part(root), template))


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash): subtrees that are template on their host; ``pages`` as from ``_with_host``."""

    def run(b: pa.RecordBatch):
        seen: dict[tuple[str, int], set[int]] = {}
        for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if source:
                found, main = hash_subtrees(parse(source))
                # equal articles may stand in different frames: what all of them hold counts once
                seen.setdefault((host, main), set()).update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in seen], pa.string()), pa.array([m for _, m in seen], pa.int64()), pa.array([sorted(v) for v in seen.values()], pa.list_(pa.int64()))],
            names=["host", "article", "hashes"],
        )

    # written, as it is read for the counts and twice for the totals
    rows = written(arrow_map(pages.select("host", "html"), run, "host string, article long, hashes array<long>"))
    each = rows.select("host", "article", F.explode_outer("hashes").alias("hash")).distinct()
    counts = each.filter("hash is not null").groupBy("host", "hash").agg(F.count("*").alias("n"))
    totals = rows.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("total"))
    kind, n, total = F.col("hash").bitwiseAND(F.lit(3)), F.col("n"), F.col("total")
    many = F.when(kind == NAMED, (n >= NAMED_PAGES) & (n >= NAMED_SHARE * total)).when(kind == INSIDE, (n >= INSIDE_PAGES) & (n >= INSIDE_SHARE * total)).otherwise((n >= OUTSIDE_PAGES) & (n >= OUTSIDE_SHARE * total))
    found = counts.filter(n >= min(INSIDE_PAGES, OUTSIDE_PAGES, NAMED_PAGES)).join(totals, "host").filter(many).select("host", "hash")
    return found.unionByName(totals.filter(total < OUTSIDE_PAGES).select("host", F.lit(FEW).cast("long").alias("hash")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    ship(pages.sparkSession)
    pages = _with_host(pages)
    found = written(templates(pages))
    small = found.count() <= BROADCAST_ROWS
    by_host = found.groupBy("host").agg(F.collect_list("hash").alias("template"))
    joined = pages.join(F.broadcast(by_host) if small else by_host, "host", "left").select("page_id", "url", "html", "template")

    def run(b: pa.RecordBatch):
        sources, sets = b.column(2).to_pylist(), {}
        lists = b.column(3).to_pylist()
        for lo, hi in chunks([s or "" for s in sources]):
            texts = []
            for s, t in zip(sources[lo:hi], lists[lo:hi], strict=True):
                key = tuple(t or ())
                texts.append(text_of(s, sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(joined, run, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
