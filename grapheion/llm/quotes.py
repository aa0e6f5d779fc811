"""Quotation linking for message threads, in DataFrame functions only.

Lines that start with ``>`` signs (spaces between them allowed) are quoted, at the
level of their number. A passage is a maximal run of quoted lines of one level,
without attribution lines ("On ... wrote:"). Passages and their lines are
normalised (lower case, white space to one space, trimmed) and hashed, as are
every message's own text, paragraphs and lines. A quoted text is joined to the
latest earlier message of its conversation that holds it as its own, by its hash and
then by the text itself. The lowest level at which anything is found decides:
what stands behind one ``>`` was written by the message answered, what stands
behind two was quoted by it. Of several messages found at that level, the one
with the most matched characters is the parent, the latest of equals; ``quotes``
lists what was found at every level. The conversation is then ordered by
thread: messages under the first message they answer to, in turn order, which puts
every message behind the one it replies to.

The join is a window over (conversation, text, span of ``SPAN`` turns) that carries the
last own turn, with what earlier spans bring in as one row a span, so a line
repeated m times and quoted n times gives n rows, not m * n, and a line that a
third of all messages hold is dealt over its spans. Places come from a sort by
ranges and the sizes of its partitions, so no conversation and no thread is
sorted in one task. Threads follow parents by pointer jumping: rounds grow with
the logarithm of the longest chain; members of one thread are dealt over salts.

Defined cases: null text is empty; a text of quotes only gives an empty clean
text; repeated (conv_id, turn) rows are kept each and share what is linked; a null
conv_id or turn takes part in no link; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grapheion.llm.common import ship, table, written

#: Turns whose quotes are looked up together.
SPAN = 1024
#: Ways in which the messages of one thread are dealt.
SALTS = 8
QUOTED = r"^[ \t]*>"
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^[ \t]*(on|am|le|el)\b.{0,200}\b(wrote|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hash(normal: Column) -> Column:
    return F.xxhash64(normal)


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, lines): each message as an array of (level, line) without attribution lines before a quote."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r\n?", "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("line")))
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines.alias("all"))
    follows = lambda x, i: x.line.rlike(ATTRIBUTION) & (F.coalesce(F.try_element_at("all", i + 2).level, x.level) > x.level)
    return base.select("conv_id", "turn", "role", F.filter("all", lambda x, i: ~follows(x, i)).alias("lines"))


def clean_text(lines: Column) -> Column:
    """Own lines only, blank edges trimmed."""
    own = F.transform(F.filter(lines, lambda x: x.level == 0), lambda x: x.line)
    return F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")


def passages(lines: str) -> Column:
    """Quoted passages of a column of lines: array of (level, text), runs of lines of one level."""
    at = F.sequence(F.lit(1), F.size(lines))
    level = lambda i: F.try_element_at(lines, i).level
    first = F.filter(at, lambda i: (level(i) > 0) & ((i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i))))
    last = F.filter(at, lambda i: (level(i) > 0) & ~level(i).eqNullSafe(level(i + 1)))
    text = lambda a, z: F.array_join(F.transform(F.slice(lines, a, z - a + 1), lambda x: x.line), "\n")
    return F.zip_with(first, last, lambda a, z: F.struct(level(a).alias("level"), text(a, z).alias("text")))


def n_passages(lines: str) -> Column:
    """How many passages there are."""
    at = F.sequence(F.lit(1), F.size(lines))
    level = lambda i: F.try_element_at(lines, i).level
    return F.size(F.filter(at, lambda i: (level(i) > 0) & ~level(i).eqNullSafe(level(i + 1)))).cast("long")


def _keys(parts: Column) -> Column:
    """(hash, text) of normalised texts, empty ones left out."""
    return F.transform(F.filter(F.transform(parts, _normal), lambda x: x != ""), lambda x: F.struct(_hash(x).alias("hash"), x.alias("text")))


def quoted(msgs: DataFrame) -> DataFrame:
    """(conv_id, turn, level, parent_turn, matched): the messages whose text each message quotes, at each level."""
    known = msgs.filter("conv_id is not null and turn is not null")
    own_lines = F.transform(F.filter("lines", lambda x: x.level == 0), lambda x: x.line)
    whole = F.array_join(own_lines, "\n")
    own = known.select("conv_id", "turn", F.explode(_keys(F.concat(F.array(whole), F.split(whole, r"\n\s*\n"), own_lines))).alias("k"))
    quoting = known.filter(F.exists("lines", lambda x: x.level > 0)).select("conv_id", "turn", F.explode(passages("lines")).alias("p"))
    asked = quoting.select("conv_id", "turn", "p.level", F.explode(_keys(F.concat(F.array("p.text"), F.split("p.text", "\n")))).alias("k"))
    asked = asked.select("conv_id", "turn", "level", "k.hash", "k.text").distinct()
    # only what somebody quotes is sorted
    wanted = asked.select("conv_id", "hash").distinct()
    held = own.select("conv_id", "turn", "k.hash", "k.text").distinct().join(wanted, ["conv_id", "hash"], "left_semi")
    span = F.floor(F.col("turn") / SPAN).alias("span")
    key = ["conv_id", "hash", "text"]
    held = held.select(*key, span, "turn", F.lit(None).cast("int").alias("level"))
    asked = asked.select(*key, span, "turn", "level")
    # what the spans before hold last, for each span that anything stands in
    ends = held.unionByName(asked).groupBy(*key, "span").agg(F.max(F.when(F.col("level").isNull(), F.col("turn"))).alias("last"))
    brought = ends.withColumn("turn", F.max("last").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
    brought = brought.filter("turn is not null").select(*key, "span", "turn", F.lit(None).cast("int").alias("level"))
    before = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = held.unionByName(asked).unionByName(brought).withColumn("parent_turn", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before))
    found = found.filter("level is not null and parent_turn is not null")
    return found.groupBy("conv_id", "turn", "level", "parent_turn").agg(F.sum(F.length("text")).alias("matched"))


def replies(msgs: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, matched, quotes): the message that each quoting message answers to."""
    best = F.min(F.struct("level", (-F.col("matched")).alias("less"), (-F.col("parent_turn")).alias("before")))
    # as many entries as a message quotes others
    every = F.sort_array(F.collect_list(F.struct("level", F.col("parent_turn").alias("turn"), F.col("matched").alias("chars"))))
    links = quoted(msgs).groupBy("conv_id", "turn").agg(best.alias("b"), every.alias("quotes"))
    return links.select("conv_id", "turn", (-F.col("b.before")).alias("parent_turn"), (-F.col("b.less")).alias("matched"), "quotes")


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of every message that answers another; parents have lower turns."""
    state = written(links.select("conv_id", "turn", F.col("parent_turn").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
        step = state.withColumn("salt", F.pmod("turn", F.lit(SALTS)).cast("int")).join(up, ["conv_id", "root", "salt"], "left")
        step = step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        step = written(step)
        if step.filter("moved").limit(1).count() == 0:
            return step.drop("moved")
        state = step.drop("moved")


def link(conversations: DataFrame) -> DataFrame:
    """One row a message: its text without quotes, what it answers to, and its place in the conversation."""
    ship(conversations.sparkSession)
    msgs = messages(conversations)
    links = written(replies(msgs))
    tree = threads(links)
    placed = links.join(tree, ["conv_id", "turn"])
    rows = msgs.select("conv_id", "turn", "role", clean_text(F.col("lines")).alias("clean_text"), n_passages("lines").alias("n_quotes"), F.coalesce(F.array_max(F.transform("lines", lambda x: x.level)), F.lit(0)).cast("long").alias("max_level"))
    rows = rows.join(placed, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))
    # a sort by ranges, whose numbers hold the partition above 33 bits; rank = rows in the partitions before + row in its own
    rows = written(rows.orderBy("conv_id", "root", "turn", "clean_text", "role").withColumn("number", F.monotonically_increasing_id()))
    part = F.shiftright("number", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row a partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("number").bitwiseAND(F.lit((1 << 33) - 1)))
    starts = ranked.groupBy("conv_id").agg(F.min("rank").alias("start")).select(F.col("conv_id").alias("oc"), "start", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("os"))
    out = ranked.withColumn("salt", F.pmod("rank", F.lit(SALTS)).cast("int"))
    out = out.join(starts, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("salt") == F.col("os")))
    return out.select("conv_id", "turn", "role", "clean_text", "n_quotes", "max_level", "parent_turn", F.coalesce("matched", F.lit(0)).cast("long").alias("matched_chars"), F.coalesce("quotes", F.array().cast("array<struct<level:int,turn:long,chars:long>>")).alias("quotes"), F.col("root").alias("thread_turn"), "depth", (F.col("rank") - F.col("start") + 1).cast("long").alias("position"))


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
