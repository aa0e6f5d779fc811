"""Token ids of whole texts from the tokenizers library, with a bounded cache of words.

Where the vocabulary's normalizer ignores case and its pre-tokenizer never joins
characters across white space, or letters with punctuation, the ids of a text are
the ids of its white-space separated words in order. Whether that holds is read
from the vocabulary's file; the texts of any other vocabulary, and texts holding a
separator on which Python and the library disagree, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

#: Words a worker remembers; further words are encoded anew each time they appear.
CACHE_WORDS = 1_000_000
#: Words longer than this are not remembered.
CACHE_CHARS = 48
#: Python splits on these, the library does not.
_ODD = re.compile("[\x1c-\x1f]")

#: Below this every character has one lower case, whatever stands around it.
_SIMPLE = "\u0130"

#: Words that normalizing leaves alone and splitting leaves whole: lower-case letters of ASCII and Latin-1.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

#: Splits into runs of letters, single numbers and runs of what is neither, white space left out.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ENCODERS: dict[str, WordEncoder] = {}


def by_words(path: str) -> bool:
    """Whether a vocabulary file tells that words can be encoded each for itself, whatever their case."""
    with open(path, encoding="utf8") as f:
        spec = json.load(f)

    def parts(name: str, inner: str) -> list[dict]:
        top = spec.get(name) or {}
        return top.get(inner, [top])

    normal = [p.get("type") for p in parts("normalizer", "normalizers")]
    split = [p for p in parts("pre_tokenizer", "pretokenizers") if p.get("type") == "Split"]
    rest = [p for p in parts("pre_tokenizer", "pretokenizers") if p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex")]
    words = [p for p in split if p.get("pattern") == {"Regex": _WORDS} and p.get("behavior") == "Removed" and p.get("invert")]
    whole = not spec.get("truncation") and not spec.get("padding") and not spec.get("post_processor") and spec["model"].get("type") == "BPE"
    return whole and normal == ["NFC", "Replace", "Lowercase"] and len(words) == len(split) == 1 and len(rest) == 1 and len(parts("pre_tokenizer", "pretokenizers")) == 2


class WordEncoder(dict):
    """word -> little-endian unsigned 32-bit ids; behaves as a dict that fills itself."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._by_words = by_words(path)
        self.vocab_size = self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, word: str) -> bytes:
        """The library's merges alone, for a word on which its normalizer and splitter do nothing."""
        tokens = self._model.tokenize(word if word.isascii() else word.translate(self._as_bytes))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def __missing__(self, word: str) -> bytes:
        # the vocabulary ignores case (but for its special tokens) and never joins a letter with punctuation: "Word," is "word" and ","
        # (a letter from U+0130 on may end in a mark when it is lower-cased, and the mark joins the punctuation)
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha() and max(word) < _SIMPLE:
            out = self[word[:-1]] + self[word[-1]]
        elif (lower := word.lower()) != word and max(word) < _SIMPLE and "<|" not in word:
            out = self[lower]
        elif _PLAIN.fullmatch(word):
            out = self._plain(word)
        else:
            out = self._whole(word)
        if len(word) <= CACHE_CHARS and len(self) < CACHE_WORDS:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self._by_words or _ODD.search(text):
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
