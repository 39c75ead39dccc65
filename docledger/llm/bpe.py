"""BPE encoding and decoding over a trie of distinct words.

The encoding of a prefix is its last token after the encoding of what comes before that
token, so one last token per prefix describes all encodings. The new words of a batch go
into a trie, held as their sorted list with the lengths of common prefixes; the walk along it
is depth first, keeps the last tokens of the prefixes it stands on, and finds those of a
prefix that words share once. Which tokens may end a prefix comes from an automaton over all
tokens, longest first; a token t may follow a token s if merging
the letters of both leaves them as they are; exactly one token that ends a prefix may.
Very long words are not remembered.

A null text is an empty one, and an empty text has no ids and decodes to an empty text.
Repeated rows come out alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docledger.llm.common import tidy
from docledger.llm.pretokens import END_OF_WORD, Splitter, Vocabulary, spelled

#: Distinct words of each kind, and pairs of tokens, that a worker remembers at most, about.
REMEMBERED, REMEMBERED_PAIRS = 100_000, 100_000
#: Letters of the longest word that is remembered.
LONGEST = 256
#: Rows handled at once.
ROWS_AT_ONCE = 512
NEVER = 1 << 60


class Codec:
    """Encodes pre-tokens with the ids and merges of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids
        self.specials = vocabulary.specials
        self.texts = {i: t for t, i in [*ids.items(), *vocabulary.specials.items()]}
        self.rank = {}
        self.parts = {}
        for at, (left, right) in enumerate(vocabulary.merges):
            pair = (ids[left], ids[right])
            self.rank[pair] = at
            self.parts[ids[left + right]] = (*pair, at)
        # Every ending of a token, with the token's id if it is a whole one.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, token in ids.items():
            letters = text.removesuffix(END_OF_WORD)
            endings = self.inner if letters == text else self.final
            for at in range(1, len(letters)):
                endings.setdefault(letters[at:], -1)
            endings[letters] = token
        self.sizes = {token: len(text.removesuffix(END_OF_WORD)) for text, token in ids.items()}
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)
        # All tokens that may stand inside a word, to find those that end at each letter.
        self.inside = ahocorasick.Automaton()
        for letters, token in self.inner.items():
            if token >= 0:
                self.inside.add_word(letters, (len(letters), token))
        self.inside.make_automaton()
        # Words of late and of before; what is not used for long falls out of both.
        self.recent: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.own: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of `token` while it is built up, each with the merge that ends it."""
        found = self.edges.get((token, side))
        if found is None:
            found = [(token, NEVER)]
            inner = token
            while inner in self.parts:
                made = self.parts[inner][2]
                inner = self.parts[inner][side]
                found.append((inner, made))
            found.reverse()
            self.edges[token, side] = found
        return found

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the letters of both tokens leaves the two apart.

        Step through the merges that change either side of the seam, in their order. The
        two tokens at the seam merge if their own merge comes first; of equal merges the
        one further left is made first.
        """
        answer = self.pairs.get((left, right))
        if answer is None:
            ends, heads = self.edge(left, 1), self.edge(right, 0)
            i = j = 0
            while True:
                (a, a_until), (b, b_until) = ends[i], heads[j]
                seam = self.rank.get((a, b), NEVER)
                if seam < a_until and seam <= b_until and seam < NEVER:
                    answer = False
                    break
                if a_until == NEVER and b_until == NEVER:
                    answer = True
                    break
                if a_until <= b_until:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = answer
        return answer

    def stands(self, token: int) -> bool:
        """Whether merging the letters of a token gives that token back."""
        answer = self.own.get(token)
        if answer is None:
            parts = self.parts.get(token)
            answer = True
            if parts:
                left, right, at = parts
                answer = self.stands(left) and self.stands(right) and self.joined(left, right, at)
            self.own[token] = answer
        return answer

    def joined(self, left: int, right: int, at: int) -> bool:
        """Whether two tokens come to meet each other whole, before any other merge at the seam."""
        ends, heads = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while (i, j) != (len(ends) - 1, len(heads) - 1):
            (a, a_until), (b, b_until) = ends[i], heads[j]
            seam = self.rank.get((a, b), NEVER)
            if seam < a_until and seam <= b_until and seam < NEVER:
                return False
            if a_until <= b_until:
                i += 1
            else:
                j += 1
        return self.rank[ends[i][0], heads[j][0]] == at

    def last_token(self, letters: str, endings: dict[str, int], last: list[int], start: int = 0) -> int:
        """The last token of a prefix that ends in `letters`, given those of all shorter ones.

        What comes before place `start` may be left out if `letters` are as many as the
        longest token has.
        """
        fitting = []
        for at in range(len(letters) - 1, -1, -1):
            token = endings.get(letters[at:])
            if token is None:
                break
            if token >= 0:
                fitting.append((at, token))
        pairs = self.pairs
        for at, token in reversed(fitting):
            at += start
            fits = pairs.get((last[at], token)) if at else self.stands(token)
            if fits is None:
                fits = self.follows(last[at], token)
            if fits:
                return token
        raise ValueError(f"no token ends {letters!r}")

    def encode_all(self, words: list[str]) -> None:
        """Encode the spelled words along one trie, and keep what they come to."""
        if not words or self.inside.kind != ahocorasick.AHOCORASICK:
            for word in words:  # no token but those that end a word
                self.remember(word, [-1])
            return
        pairs, matches = self.pairs, self.inside.iter
        # Last tokens of the prefixes of the walk's place; that of the empty prefix is unused.
        last, before = [-1], ""
        for word in sorted(words):
            # The last letter of a word is spelled with its end, so a whole word needs no state.
            shared = 1
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[min(shared, len(word)) :]
            for end, (size, token) in matches(word, 0, len(word) - 1):
                if end + 1 < len(last):
                    continue  # known from words before, or settled by a longer token
                at = end + 1 - size
                fits = pairs.get((last[at], token)) if at else self.stands(token)
                if fits is None:
                    fits = self.follows(last[at], token)
                if fits:
                    last.append(token)
            if len(last) != len(word):
                raise ValueError(f"no token ends {word[: len(last)]!r}")
            self.remember(word, last)
            before = word

    def remember(self, word: str, last: list[int]) -> None:
        found = []
        at, suffix = len(word), END_OF_WORD
        start = max(0, at - self.longest)
        while at:
            token = self.last_token(word[start:], self.final, last, start) if suffix else last[at]
            found.append(token)
            at -= self.sizes[token]
            suffix = ""
        found.reverse()
        self.encoded[word] = self.entry(found)

    def entry(self, found: list[int]) -> tuple[bytes, str]:
        return pack(f"<{len(found)}I", *found), " ".join([self.texts[t] for t in found])

    def look_up(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each distinct pre-token."""
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        new = [word for word in words if word not in recent and word not in older]
        letters = {word: spelled(word) for word in new if word not in self.specials}
        self.encoded = {}
        self.encode_all(list(letters.values()))
        for word in new:
            special = self.specials.get(word)
            recent[word] = self.encoded[letters[word]] if special is None else self.entry([special])
        answers = list(map(recent.get, words))
        for at in [at for at, answer in enumerate(answers) if answer is None]:
            answers[at] = recent[words[at]] = older[words[at]]
        for word in new:
            if len(word) > LONGEST:
                del recent[word]
        self.encoded = {}
        return answers


@lru_cache(maxsize=1)
def codec_of(source: str) -> Codec:
    """The codec of a vocabulary, one for all tasks of a Python worker. What it remembers is
    bounded, and tasks reach it by the name of this function."""
    return Codec(Vocabulary.parse(source))


def encode_texts(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: `n_tokens`, `ids_sha256`, `decoded_sha256`, and on demand the
    ids themselves as `ids` and the text they decode to as `decoded`.

    Ids are hashed as little-endian unsigned 32-bit integers. Tokens decode to their
    strings, word ends included, with one space between two of them.
    """
    source = Vocabulary.read(path).source
    shared = docs.sparkSession.sparkContext.broadcast(source)  # of the file's fixed size
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    @tidy
    def encode(batches):
        codec = codec_of(shared.value)
        splitter = Splitter(codec.specials, shared.value)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        parts = (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for batch in parts:
            for first, part in splitter.batches(batch.column("text").to_pylist()):
                columns: list[list] = [[] for _ in names[1:]]
                found = codec.look_up(part.words)
                data, text = zip(*found, strict=True) if found else ((), ())
                places, bounds = part.places.tolist(), part.bounds.tolist()
                for begin, end in zip(bounds, bounds[1:], strict=False):
                    own = places[begin:end]
                    ids = b"".join([data[i] for i in own])
                    decoded = " ".join([text[i] for i in own])
                    row = [
                        len(ids) // 4,
                        hashlib.sha256(ids).hexdigest(),
                        hashlib.sha256(decoded.encode()).hexdigest(),
                    ]
                    if with_ids:
                        row += [np.frombuffer(ids, "<u4").astype(np.int32), decoded]
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                # Written out piece by piece: ids and decoded texts outgrow their documents.
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
                own_ids = batch.column("doc_id").slice(first, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([own_ids, *arrays], names)

    types = [docs.schema["doc_id"].dataType.simpleString(), "long", "string", "string", "array<int>", "string"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, types, strict=False))
    return docs.select("doc_id", "text").mapInArrow(encode, schema)
