import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from grapheion.llm import binary_ids, packing, wordtokens

TEXTS = [None, "<|ENDOFTEXT|> <|endoftext|> <|EndOfText|>, a<|startoftext|>.", "Thinor, THE! été. ÉTÉ; Ça: a.b, x.. Ω, ΣΑΣ. İx, ſt. ŉ, ẞ. DŽ. ǅ, A\u0301. e\u0301, it'S. 1, 2. Don'T,", "", "Hello, World!\nit's 2024", "a\x1cb c\x85d　e", "x" * 5000, "naïve é ΣΑΣ ΟΔΟΣ İ", "word " * 9000, "word " * 9000]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(wordtokens.default_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * i, t, "z", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows[::-1], "doc_id long, text string, start string, length int").repartition(3)


def test_decompose():
    for n in range(1, 5000, 7):
        parts = packing.decompose(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert parts == sorted(parts, reverse=True)


def test_pack_covers_each_id_once(docs, ids):
    rows = packing.digest(packing.pack(docs)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert len({r.sequence_id >> 55 for r in rows}) == len({r.length for r in rows})
    for i, want in enumerate(ids):
        mine = sorted((r for r in rows if r.doc_id == 10 * i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(want[at : at + r.length].tobytes())
            at += r.length
        assert at == len(want)


def test_files_read_back(spark, docs, ids, tmp_path):
    manifest = binary_ids.write_ids(docs, f"file://{tmp_path}/ids", partitions=3)
    rows = sorted(binary_ids.read_ids(manifest, with_ids=True).collect())
    at = 0
    for r, want in zip(rows, ids, strict=True):
        assert r.start == at and r.n_tokens == len(want) and r.ids_crc32 == zlib.crc32(want.tobytes()) and bytes(r.ids) == want.tobytes()
        at += len(want)


def test_null_ids_repeats_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (-5, "c"), (0, None), (0, None)], "doc_id long, text string")
    rows = binary_ids.read_ids(binary_ids.write_ids(docs, f"file://{tmp_path}/x")).collect()
    assert sorted((r.start, r.doc_id) for r in rows) == [(0, None), (2, None), (4, -5), (6, 0), (7, 0)]
    assert binary_ids.read_ids(binary_ids.write_ids(docs.limit(0), f"file://{tmp_path}/y")).count() == 0
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs).filter("doc_id is null").count() == 4 - 2


def test_queries_equal_the_library_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t = Tokenizer.from_file(wordtokens.default_path())
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for d, x in texts.items()}
    at = 0
    for r in sorted(binary_ids.op7_binary_ids(spark, sf).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), zlib.crc32(want[r.doc_id].tobytes()))
        at += r.n_tokens
    pieces = {}
    rows = packing.op5_packing(spark, sf).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want) and len({r.sequence_id for r in rows}) == len(rows)
    for d, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.offset == 0 and r.doc_tokens == len(want[d]) and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(want[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(want[d])


def test_plain_words_equal_the_library():
    t = Tokenizer.from_file(wordtokens.default_path())
    enc = wordtokens.WordEncoder(wordtokens.default_path())
    letters = [chr(c) for c in range(0xC0, 0x180)] + list("abcxyzABCXYZ")
    words = [a + b + c for a in letters for b in ("", "e", "\u00e9", "\u0301", "\u00d7") for c in ("", "s.", "tion", "'s", "\u00df")]
    for w in words:
        assert enc.ids(w) == np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w


def test_other_vocabularies_go_to_the_library_whole(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert wordtokens.by_words(wordtokens.default_path()) and not wordtokens.by_words(path)
    t = Tokenizer.from_file(path)
    enc = wordtokens.encoder(path)
    for x in filter(None, TEXTS):
        assert enc.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_mixed_alphabets_equal_the_library():
    """Words of many scripts, marks and punctuation; U+0130 lower-cases to a letter and a mark that joins what follows."""
    whole, enc = Tokenizer.from_file(wordtokens.default_path()), wordtokens.encoder(wordtokens.default_path())
    rnd = random.Random(3)
    pools = ["abcXYZ", "éàÉÇß", "ıİĞşŞğ", "АБВгде", "ΑΒΣσς", "中文字", "أبت", "̧́̇", "0129²½", "🙂👍", "ĄąŁłŽž", "ǅǆﬁﬂſ", "กขค", "ႠႡაბ", "𐐀𐐨𝐀"]
    texts = ["İ,", "ISPARTALİ, x", "aİ. İ;İ!"]
    for _ in range(20_000):
        words = ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 7))) + "".join(rnd.choice(".,;:!?-'\"(<|>)") for _ in range(rnd.randrange(3))) for _ in range(rnd.randrange(1, 6))]
        texts.append(rnd.choice([" ", "  ", "\n", "\t", " ", "　"]).join(words))
    assert all(enc.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)
