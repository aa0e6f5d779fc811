"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

All of it is column expressions over one row a text: no shuffle, no Python worker. The positions
of a pattern's matches come from the lengths of its matches and of the text between them.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their check;
they always stay. The method adds, where no base span lies:

* iban: two letters, two digits and 11 to 30 letters or digits, whole or in groups of four,
  whose rearranged number leaves 1 modulo 97;
* card_part: 13 to 19 digits in a row that pass Luhn, such as two cards written side by side,
  which base reads as one number; up to 15 digits need a word nearby;
* ssn: 3-2-4 digits with an area, group and serial that are given out, and a word nearby;
* phone_local: 3-3-4 digits without a country, and a word nearby.

Words nearby are those of the 40 characters before and 20 after a match, or up to the next match
of the same kind. A span stays from THRESHOLD on; of two kinds that overlap the one listed first
stays.

Null and empty texts have no spans; rows are judged each for itself, so repeated rows and null
ids give a row each; an empty table gives none; other columns are left behind. Patterns use
possessive loops and start only where a run starts, so time grows with the length of a text and
no text is too long. Arrays are as long as a text has matches.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grapheion.llm.common import table, texts_of

THRESHOLD = 0.5
#: Characters before and after a match that are searched for words.
BEFORE, AFTER = 40, 20
#: Matches whose lengths are summed at once; sums of such blocks are summed after.
BLOCK = 256

# Words that make a kind likelier, and words that make any number something else.
CARD_WORDS = "card visa mastercard amex credit debit karte kreditkarte carte bancaire tarjeta"
PHONE_WORDS = "phone tel telephone call mobile cell fax telefon handy anruf téléphone portable teléfono móvil"
SSN_WORDS = "ssn social security"
IBAN_WORDS = "iban account bank konto compte cuenta bic swift"
OTHER_WORDS = "isbn issn order invoice version serial sku part tracking"
# End of fixed values.

#: A run of what can stand before the @; the first character of a match follows no other of its run, or the last match.
_LOCAL = r"[A-Za-z0-9._%+-]"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    padded = F.lpad(digits, 20, "0")

    def value(i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an international account number (no spaces) leaves 1 modulo 97 after rearranging."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    code = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def step(rest: Column, c: Column) -> Column:
        v = F.instr(code, c) - 1
        return F.when(v < 10, rest * 10 + v).otherwise(rest * 100 + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(c == "", s).otherwise(step(s, c))) == 1


def _ip(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))


def _iban(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & mod97(plain)


def _ssn(hit: Column) -> Column:
    return ~hit.rlike(r"\A(?:000|666|9)|-00-|0000\z")


class Kind(NamedTuple):
    """A kind of personal data; ``score`` is that of a confirmed match, ``nearby`` what words add."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    score: Callable[[Column], Column]
    words: str = ""
    #: Texts without it hold no match; where none is given, texts without a digit.
    mark: str = ""
    base: bool = False


def _sure(hit: Column) -> Column:
    return F.lit(1.0)


BASE = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), _sure, mark="@", base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, _sure, base=True),
    # a match is a whole run of digits with single separators: those of other lengths need not be matched to be dropped
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", lambda h: luhn(_digits(h)), _sure, base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: F.length(_digits(h)).between(8, 15), _sure, mark="+", base=True),
]
EXTRA = [
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _iban, lambda h: F.lit(0.7), IBAN_WORDS),
    Kind("card_part", r"(?<![0-9])[2-6][0-9]{12,18}+(?![0-9])", luhn, lambda h: F.when(F.length(h) > 15, 0.6).otherwise(0.3), CARD_WORDS),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, lambda h: F.lit(0.3), SSN_WORDS),
    Kind("phone_local", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])", lambda h: F.lit(True), lambda h: F.lit(0.3), PHONE_WORDS),
]


def _running(lengths: Column, first: Column) -> Column:
    """Sums of what stands before each element, plus ``first``."""
    zero = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    return F.aggregate(lengths, zero, step, lambda s: s["out"])


def running(lengths: Column) -> Column:
    """The same from 0 on, in blocks: appending one by one costs the square of a block only."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    long = F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), _running(sums, F.lit(0).cast("bigint")).alias("at")), lambda z: _running(z["b"], z["at"])))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= BLOCK, _running(lengths, F.lit(0).cast("bigint"))).otherwise(long)


def _nearby(words: str) -> str:
    return r"(?U)(?i)\b(?:" + "|".join(words.split()) + r")\b"


def _score(kind: Kind, hit: Column, around: Column) -> Column:
    out = kind.score(hit)
    if kind.words:
        out = out + F.when(around.rlike(_nearby(kind.words)), 0.4).otherwise(0.0) - F.when(around.rlike(_nearby(OTHER_WORDS)), 0.3).otherwise(0.0)
    return out


def _spans(df: DataFrame, text: str, kinds: list[Kind]) -> DataFrame:
    """For each kind a column of its confirmed matches, in order: start, end (code points), value, score."""
    df = df.withColumn("_digit", F.col(text).rlike("[0-9]"))
    whole = {k.name: F.col(text).contains(k.mark) if k.mark else F.col("_digit") for k in kinds}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_hits_{k.name}": F.when(whole[k.name], F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in kinds})
    df = df.withColumns({f"_gaps_{k.name}": F.when(F.size(f"_hits_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in kinds})
    lengths = lambda k: F.transform(f"_hits_{k.name}", lambda h, i: (F.length(h) + F.length(F.get(F.col(f"_gaps_{k.name}"), i))).cast("bigint"))
    df = df.withColumns({f"_long_{k.name}": lengths(k) for k in kinds})
    df = df.withColumns({f"_at_{k.name}": running(F.col(f"_long_{k.name}")) for k in kinds})

    def found(k: Kind) -> Column:
        gap = lambda i: F.get(F.col(f"_gaps_{k.name}"), i)

        def one(h: Column, i: Column) -> Column:
            start = F.get(F.col(f"_at_{k.name}"), i) + F.length(gap(i))
            around = F.concat(F.right(gap(i), F.lit(BEFORE)), F.lit(" "), F.left(gap(i + 1), F.lit(AFTER))) if k.words else F.lit("")
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("value"), F.when(k.confirmed(h), _score(k, h, around)).otherwise(0.0).alias("score"))

        return F.filter(F.transform(f"_hits_{k.name}", one), lambda s: s["score"] >= THRESHOLD)

    df = df.withColumns({k.name: found(k) for k in kinds})
    return df.drop("_digit", *[f"_{part}_{k.name}" for part in ("hits", "gaps", "long", "at") for k in kinds])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[Kind] | None = None) -> DataFrame:
    """(doc_id, text, spans): spans is an array of (kind, start, end, value, score, base), by kind, then start."""
    extra = EXTRA if extra is None else extra
    df = _spans(texts_of(docs, id_col, text_col), "text", BASE + extra)
    named = lambda k: F.transform(F.col(k.name), lambda s: F.struct(F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score"), F.lit(k.base).alias("base")))
    df = df.withColumn("spans", F.concat(*map(named, BASE)))
    for k in extra:
        free = lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        df = df.withColumn("spans", F.concat("spans", F.filter(named(k), free)))
    return df.select("doc_id", "text", "spans")


def redacted(found: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``find``'s rows with every span of the text replaced by its kind; overlapping spans become one mask, that of the first."""
    order = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    left, right = mask.split("{}")

    def step(s: Column, x: Column) -> Column:
        new = x["start"] >= s["at"]
        gap = F.substr(F.col("text"), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        parts = F.when(new, F.concat(s["parts"], F.array(gap, F.concat(F.lit(left), x["kind"], F.lit(right))))).otherwise(s["parts"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), parts.alias("parts"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    done = lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(F.col("text"), (s["at"] + 1).cast("int")))
    return found.withColumn("text", F.aggregate(order, zero, step, done))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
