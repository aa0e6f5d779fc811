import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from grapheion.llm import quality, wordtokens

from test_near_dup import brute as near_brute
from test_suffix_dedup import brute as suffix_brute

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert kept.schema == docs.schema
    one = {r.doc_id for r in kept.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stats = quality.statistics([rows[d].encode() for d in rows])
    failed = dict(zip(rows, quality.base_failed(stats), strict=True))
    assert not any(failed[d] for d in one)
    clean = [d for d in rows if labels.get(d) == 1 and not failed[d]]
    junk = [d for d in rows if labels.get(d) == 0 and not failed[d]]
    assert sum(d in one for d in clean) > 0.99 * len(clean) and sum(d in one for d in junk) < 0.1 * max(10, len(junk))

    unique = corpus_pipeline.near_dup_removal(spark, kept, SF).cache()
    assert unique.schema == docs.schema
    two = {r.doc_id: r.text for r in unique.collect()}
    assert set(two) == {d for d, _, _, stays in near_brute([(d, rows[d]) for d in one]) if stays}

    cut = corpus_pipeline.suffix_dedup_removal(spark, unique, SF).cache()
    assert cut.schema == docs.schema
    three = {r.doc_id: r.text for r in cut.collect()}
    want = {d: w[3].decode("utf-8", "ignore") for d, w in suffix_brute(list(two.items()), 100).items()}
    assert three == want and all(r.n_chars == len(r.text) for r in cut.collect())

    t = Tokenizer.from_file(wordtokens.default_path())
    pieces = corpus_pipeline.pack(spark, cut, SF).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == set(three)
    for d, text in three.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(by[d], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and out.count() > 50


def test_one_of_repeated_rows_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(2, "A b c d e f", "en", "s", 11), (4, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dup_removal(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 4]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_rows_of_one_id_are_judged_by_text(spark):
    x, y, a, b = "a b c d e f", "q r s t u v", "k l m n o p", "g h i j w z"
    rows = [(1, x), (1, x), (1, y), (None, a), (None, b), (None, x), (0, "o o p p q q"), (5, "O o p p q q"), (5, "r r t t u u")]
    docs = spark.createDataFrame([(*r, "en", "s", 11) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dup_removal(spark, docs, SF)
    assert got.schema == docs.schema
    # one of the repeats goes, as do the copies of texts that a lesser id holds
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, x), (1, y), (None, a), (None, b), (0, "o o p p q q"), (5, "r r t t u u")], key=str)


def test_extra_columns_with_the_stages_own_names(spark):
    """Columns called as the stages' helpers are kept, whatever they hold."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["text_digest", "kept_id", "Kept_Digest", "digest", "kept", "block", "piece", "at"]
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names]).cache()
    plain = {r.doc_id for r in corpus_pipeline.near_dup_removal(spark, docs, SF).collect()}
    out = corpus_pipeline.near_dup_removal(spark, wide, SF)
    assert out.schema == wide.schema and {r.doc_id for r in out.collect()} == plain
    assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    cut = corpus_pipeline.suffix_dedup_removal(spark, wide, SF)
    assert cut.schema == wide.schema and all(r[n] == f"{n}{r.doc_id}" for r in cut.collect() for n in names)
    assert corpus_pipeline.pack(spark, wide, SF).count() > 60
