"""Spans of personal data against plain patterns, and the kinds that words decide."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from grapheion.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string"


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "phone" and 8 <= len(d) <= 15 or kind == "card" and 16 <= len(d) <= 19 and luhn(d)
            if kind == "ip":
                ok = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find(df).collect()}


def test_query_equals_plain_patterns(spark):
    got = pii.op11_pii(spark, "/root/testdata/sf0.01").toPandas()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    want = {d: brute(t) for d, t in zip(texts.doc_id, texts.text, strict=True)}
    assert len(got) == len(want) and sum(got.n_email + got.n_ip + got.n_card + got.n_phone) > 50
    for r in got.itertuples():
        assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert set(filter(None, want[r.doc_id].split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want[r.doc_id].count(k + ":") for k in PATTERNS]


def test_odd_texts_equal_plain_patterns(spark):
    rnd = random.Random(5)
    parts = ["a", "Z", "9", "1", "@", ".", ".", "-", " ", "+", "(", ")", "_", "%", "é", "😀", "4111 1111 1111 1111", "1.2.3.4", "0001.2.3.255", "+1 (555) 123-4567", "a@b.c", "\n", "0", "25"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    # more matches than a block of sums, runs too long for recursion
    texts += ["1.1.1.1 " * 700, "a@b.c " * 600, "a@" + "b." * 50_000, "1 " * 50_000, "+1" + " " * 50_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r in pii.find(df).select("doc_id", pii._listed(F.filter("spans", lambda s: s["base"])).alias("got")).collect():
        assert r.got == brute(texts[r.doc_id]), texts[r.doc_id][:80]


def test_long_runs_end(spark):
    got = spans(spark, ["a" * 500_000, "1" * 500_000, "1." * 300_000 + " x@y.de"])
    assert got[0] == got[1] == [] and ("email", "x@y.de") in got[2]


def test_words_and_checksums_decide(spark):
    iban = "DE89 3704 0044 0532 0130 00"
    got = spans(
        spark,
        [
            f"pay to {iban} now, not DE88 3704 0044 0532 0130 00",
            "4111111111111111 5500005555555559",  # one run of 32 digits: base drops it
            "my card 378282246310005 here",
            "invoice 378282246310005 here",
            "his SSN is 123-45-6789",
            "part 123-45-6789 of it, or ssn 666-45-6789",
            "call (555) 123-4567 today",
            "row 555-123-4567 of the table",
            "GB82WEST12345698765432",
        ],
    )
    assert got[0] == [("iban", iban)]
    assert got[1] == [("card_part", "4111111111111111"), ("card_part", "5500005555555559")]
    assert got[2] == [("card_part", "378282246310005")] and got[3] == []
    assert got[4] == [("ssn", "123-45-6789")] and got[5] == []
    assert got[6] == [("phone_local", "(555) 123-4567")] and got[7] == []
    assert got[8] == [("iban", "GB82WEST12345698765432")]


def test_rows_and_columns(spark):
    rows = [(1, "a@b.cd", "x"), (1, "a@b.cd", "y"), (None, "1.2.3.4", "z"), (2, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in pii.find(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert pii.find(df.limit(0)).count() == 0
    other = df.select(F.col("doc_id").alias("k"), F.col("text").alias("body"), F.lit(1).alias("doc_id"))
    assert pii.find(other, "k", "body").count() == 4


def test_redacted(spark):
    df = spark.createDataFrame([(1, "😀 mail a@b.cd, ip 1.2.3.4."), (2, ""), (3, "none")], SCHEMA)
    got = {r.doc_id: r.text for r in pii.redacted(pii.find(df)).collect()}
    assert got == {1: "😀 mail [email], ip [ip].", 2: "", 3: "none"}
