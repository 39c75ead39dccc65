"""Pre-tokens of a word BPE vocabulary, found over whole batches at a time in numpy.

Vocabularies of this kind compose characters (NFC), lower-case them, drop white space and
cut the rest into contractions, runs of letters, single digits and runs of other signs.
Strings of special tokens are found in the text as it is, ahead of all that.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer

SPACE, LETTER, NUMBER, OTHER, SPECIAL = range(5)
#: Fixed values of the format: white space and contractions.
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
END_OF_WORD = "</w>"
#: Special tokens stand in the code points as numbers above all characters.
FIRST_SPECIAL = 0x110000
#: Characters handled at once; a longer document is handled by itself.
CHARS_AT_ONCE = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def _classes(specials: int, source: str) -> np.ndarray:
    """The kind of each code point, and of the special tokens above them.

    Letters that the standard library does not know yet may be unknown to the vocabulary's
    own library as well; for those few it decides.
    """
    table = np.full(FIRST_SPECIAL + specials, OTHER, np.uint8)
    points = np.append(np.arange(0xD800), np.arange(0xE000, FIRST_SPECIAL))  # all but surrogates
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            table[points[run.start() : run.end()]] = kind
    cut = Tokenizer.from_str(source).pre_tokenizer.pre_tokenize_str
    for code in np.flatnonzero(table != OTHER).tolist():
        sign = chr(code)
        if unicodedata.category(sign) == "Cn":
            letter, number = len(cut("a" + sign)) == 1, len(cut(sign + sign)) == 2
            table[code] = LETTER if letter else NUMBER if number else OTHER
    table[list(WHITE_SPACE)] = SPACE
    table[FIRST_SPECIAL:] = SPECIAL
    return table


@cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def spelled(word: str) -> str:
    """A pre-token in the letters of the vocabulary, one per UTF-8 byte."""
    if word.isascii() and word.isprintable():
        return word
    letters = byte_letters()
    return "".join(letters[b] for b in word.encode())


@dataclass
class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file, small and of fixed size."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int]
    source: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Read on the driver; tasks get the content, so they need no file of their own."""
        with open(path, encoding="utf-8") as file:
            return cls.parse(file.read(), path)

    @classmethod
    def parse(cls, source: str, path: str = "the file") -> Vocabulary:
        content = json.loads(source)
        model = content["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END_OF_WORD:
            raise ValueError(f"{path} holds no BPE vocabulary with word ends")
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        specials = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        return cls(model["vocab"], pairs, specials, source)


@dataclass
class Tokens:
    """Pre-tokens of some documents: distinct ones, and which of them each place holds."""

    words: list[str]
    places: np.ndarray
    bounds: np.ndarray


def _normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # each sign by itself, without regard to word ends


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(_normal(text).encode("utf-32-le"), np.uint32)


class Splitter:
    def __init__(self, specials: dict[str, int], source: str):
        self.source = source
        self.names = list(specials)
        self.cut = re.compile("|".join(map(re.escape, sorted(specials, key=len)[::-1])) or r"(?!)")

    def batches(self, texts: list):
        """(first document, Tokens) for consecutive documents; a null text is an empty one."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= CHARS_AT_ONCE or i == len(texts) - 1:
                yield first, self.split(texts[first : i + 1])
                first, size = i + 1, 0

    def split(self, texts: list) -> Tokens:
        parts, lengths = [], []
        gap = np.array([32], np.uint32)
        for text in texts:
            own = []
            at = 0
            for found in self.cut.finditer(text or ""):
                own.append(_code_points(text[at : found.start()]))
                own.append(np.array([FIRST_SPECIAL + self.names.index(found[0])], np.uint32))
                at = found.end()
            own.append(_code_points(text[at:] if text else ""))
            own.append(gap)
            parts += own
            lengths.append(sum(map(len, own)))
        return self._tokens(np.concatenate(parts), np.cumsum([0, *lengths]))

    def _tokens(self, codes: np.ndarray, documents: np.ndarray) -> Tokens:
        kinds = _classes(len(self.names), self.source)[codes]
        starts = np.empty(len(codes), bool)
        starts[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts |= (kinds == NUMBER) | (kinds == SPECIAL)
        for at in np.flatnonzero((codes == 39) & starts).tolist():
            near = "".join(map(chr, codes[at : at + 3].clip(max=0x10FFFF).tolist()))
            for short in CONTRACTIONS:
                if near.startswith(short):
                    starts[at + 1] = False
                    starts[at + len(short)] = True
                    break
        filled = kinds != SPACE
        edges = np.flatnonzero(starts | ~filled)
        ends = np.append(edges[1:], len(codes))
        own = filled[edges]
        first, last = edges[own], ends[own]
        bounds = np.searchsorted(first, documents)
        if not len(first):
            return Tokens([], np.zeros(0, np.int64), bounds)
        length = last - first
        flat = np.flatnonzero(filled)
        heads = np.cumsum(length) - length
        place = np.arange(len(flat)) - np.repeat(heads, length)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(length.max()), STEP, np.uint64))
            value = (codes[flat].astype(np.uint64) + np.uint64(1)) * powers[place]
            value = np.add.reduceat(value ^ (value >> np.uint64(31)), heads)
        places, distinct = pd.factorize(value)
        example = np.empty(len(distinct), np.int64)
        example[places[::-1]] = np.arange(len(places) - 1, -1, -1)
        text = np.where(kinds == SPECIAL, 32, codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        words = [text[a:b] for a, b in zip(first[example].tolist(), last[example].tolist(), strict=True)]
        for e in np.flatnonzero(kinds[first[example]] == SPECIAL).tolist():
            words[e] = self.names[codes[first[example[e]]] - FIRST_SPECIAL]
        return Tokens(words, places, bounds)
