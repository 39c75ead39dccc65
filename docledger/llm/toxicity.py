"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of words of a fixed list of insults and of two
learned lexicons (words, and beginnings of words of 3 to 6 letters), how many of these have a
second person near them, capitals, punctuation, and signs of obfuscation: marks and digits
inside words, drawn-out letters, letters set apart, and words that are in a lexicon once such
marks are read as letters.

Learning is from labelled rows only, a bounded sample of them: at most `per_class` documents
for each of the two labels, those with the least seeded hashes. Rows of the sample are dealt
into folds. The lexicons that a row's features come from are learned without its fold, and so
are the trees whose log odds the isotonic step is fitted on; rows weigh as much as the labels
they stand for. Everything else is one pass over the texts.

A null text counts as an empty one and is scored like any other. Labels other than 0 and 1
teach nothing; a document with both is toxic. Without labelled documents every score is 0; with
one label alone it is that label. Rows of equal text get equal scores; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Set
from dataclasses import dataclass, field
from math import log1p
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.boosting import Isotonic, Trees, boost, isotonic
from docledger.llm.common import remainder, sent_if_small, staged, tidy

# Plain insults of the four languages, and their second persons.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers pathetic disgusting worthless scum trash clown "
    "dumb fool garbage imbecile jerk vermin "
    "idioten dumm dummkopf trottel versager abschaum widerlich erbärmlich wertlos müll depp "
    "idiote imbécile crétin nul minable ordure pathétique dégoûtant débile raclure "
    "idiota estúpido estúpida imbécil tonto tonta basura asqueroso patético inútil escoria payaso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem euch euer eure "
    "tu toi ton tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
# Marks read as the letters they stand for.
READ_AS = str.maketrans("013457@$!|", "oieastasil", "*.-_")

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
MARKED = re.compile(r"[^\W\d_][0-9@$*!|._-]+[^\W\d_]")
APART = re.compile(r"(?<!\S)(?:[^\W\d_][ \t]){3,}[^\W\d_](?!\S)")
#: Signs that do not count where a token begins or ends.
OUTER = ".,;:!?\"'()[]{}<>«»„“”…"
STEMS = range(3, 7)
#: Words on either side among which a second person counts as near.
NEAR = 5
FOLDS = 4
#: Least evidence (G statistic) and log odds of a lexicon's words, and their number at most.
EVIDENCE, ODDS, ENTRIES = 24.0, 1.5, 400
TOXIC = 0.7
#: What a word of the fixed list weighs behind marks.
LISTED = 3.0
#: Plain tokens that a task remembers; terms a task counts before it sends them on.
REMEMBERED, COUNTED = 200_000, 200_000
FEATURES = 27


class Token(NamedTuple):
    """What one token, a run of signs between spaces, adds to the features of its text."""

    as_word: float  # log odds as a word
    as_stem: float  # log odds of a beginning of it
    listed: int  # on the fixed list
    hidden: float  # log odds of a lexicon's word behind marks
    person: int
    marked: int

    @property
    def hit(self) -> bool:
        return bool(self.as_word or self.as_stem or self.listed or self.hidden)


PLAIN = Token(0.0, 0.0, 0, 0.0, 0, 0)


@dataclass
class Lexicon:
    """Log odds of words and of beginnings of words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    plain: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.listed = INSULTS | SECOND_PERSON | set(self.words)
        self.heads = {stem[: STEMS[0]] for stem in self.stems}

    def special(self, tokens: Set[str]) -> dict[str, Token]:
        """The tokens, in lower case, that are more than plain words. Plain ones are remembered."""
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        found = {}
        for token in tokens - self.plain:
            bare = token.strip(OUTER)
            if bare.isalpha() and bare not in self.listed and bare[: STEMS[0]] not in self.heads:
                self.plain.add(token)
            elif (known := self._token(bare)) != PLAIN:
                found[token] = known
        return found

    def _token(self, token: str) -> Token:
        words = WORD.findall(token)
        as_word = max((self.words.get(w, 0.0) for w in words), default=0.0)
        as_stem = max((self.stems.get(w[:n], 0.0) for w in words for n in STEMS if len(w) >= n), default=0.0)
        marked = MARKED.search(token) is not None
        return Token(
            as_word,
            as_stem,
            sum(w in INSULTS for w in words),
            self.hidden(token) if marked else 0.0,
            sum(w in SECOND_PERSON for w in words),
            marked,
        )

    def hidden(self, lower: str) -> float:
        """Log odds of the word that is left once marks and digits are read as letters."""
        plain = WORD.findall(lower.translate(READ_AS))
        return max((max(self.words.get(w, 0.0), LISTED * (w in INSULTS)) for w in plain), default=0.0)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The `FEATURES` numbers of a text."""
    text = text or ""
    raw, lower = text.split(), text.lower()
    tokens = lower.split()
    n = max(len(tokens), 1)
    counted = Counter(tokens)
    known = lexicon.special(counted.keys())
    special = [(t, counted[token]) for token, t in known.items()]
    hits = [(t, c) for t, c in special if t.hit]
    word_hits = sum(c for t, c in hits if t.as_word)
    stem_hits = sum(c for t, c in hits if t.as_stem)
    listed = sum(t.listed * c for t, c in hits)
    hidden = sum(c for t, c in hits if t.hidden)
    hidden_most = max((t.hidden for t, _ in hits), default=0.0)
    persons = sum(t.person * c for t, c in special)
    alone = sum(c for token, c in counted.items() if len(token) == 1)
    apart = APART.findall(lower) if alone > 3 else []
    for letters in apart:
        weight = lexicon.hidden("".join(letters.split()))
        hidden += weight > 0
        hidden_most = max(hidden_most, weight)
    near = 0
    if hits and persons:
        met = [known.get(token, PLAIN) for token in tokens]
        at_persons = np.array([-NEAR - 1, *(i for i, t in enumerate(met) if t.person), len(met) + NEAR])
        at_hits = np.array([i for i, t in enumerate(met) if t.hit])
        after = np.searchsorted(at_persons, at_hits)
        apart_by = np.minimum(at_persons[after] - at_hits, at_hits - at_persons[after - 1])
        near = int((apart_by <= NEAR).sum())
    signs = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    folded = signs | 32
    drawn_out = (folded[2:] == folded[1:-1]) & (folded[2:] == folded[:-2]) & (folded[2:] > 96) & (folded[2:] < 123)
    counts = np.bincount(signs, minlength=256)
    size = max(int(counts.sum()), 1)
    capitals = int(counts[65:91].sum())
    letters = max(capitals + int(counts[97:123].sum()) + int(counts[192:].sum()), 1)
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    return [
        log1p(len(tokens)),
        listed / n,
        log1p(listed),
        sum(t.as_word * c for t, c in hits) / n,
        log1p(word_hits),
        word_hits / n,
        max((t.as_word for t, _ in hits), default=0.0),
        sum(t.as_stem * c for t, c in hits) / n,
        log1p(stem_hits),
        stem_hits / n,
        max((t.as_stem for t, _ in hits), default=0.0),
        len(hits) / n,
        log1p(len(hits)),
        near / n,
        log1p(near),
        persons / n,
        capitals / letters,
        sum(len(token) > 1 for token in raw if token.isupper()) / n,
        int(counts[33]) / size,
        int(counts[63]) / size,
        marks / size,
        int(drawn_out.sum()) / n,
        sum(t.marked * c for t, c in special) / n,
        len(apart) / n,
        log1p(hidden),
        hidden_most,
        log1p(word_hits + listed + hidden),
    ]


def table_of(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    rows = [features(text.as_py(), lexicon) for text in texts]
    return np.array(rows, np.float64).reshape(-1, FEATURES)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: int) -> tuple[DataFrame, dict]:
    """Texts, labels and folds of at most `per_class` documents a label, and labels in all.

    Labels are drawn by rate before they meet the documents, so few texts are moved.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}  # two rows
    rate = F.lit(0.0)
    for toxic, count in sizes.items():
        rate = F.when(F.col("toxic") == toxic, 1.5 * per_class / count).otherwise(rate)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20)
    drawn = staged(known.filter(drawn), "drawn-labels")
    first = Window.partitionBy("toxic").orderBy("draw", "doc_id", "text")
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(sent_if_small(drawn, 16), "doc_id")
        .withColumn("draw", F.xxhash64(F.lit(seed + 1), "doc_id", "text"))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= per_class)
        .select("text", "toxic", F.pmod(F.xxhash64(F.lit(seed + 2), "draw"), F.lit(FOLDS)).cast("int").alias("fold"))
    )
    return staged(sample, "labelled-texts"), sizes


def learned_lexicons(sample: DataFrame) -> list[Lexicon]:
    """A lexicon without each fold, and as the last one that of all folds."""

    @tidy
    def count(batches):
        found: dict = defaultdict(Counter)

        def sent():
            rows = [(t, f, y, n) for (f, y), terms in found.items() for t, n in terms.items()]
            found.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["term", "fold", "toxic", "n"])

        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                words = set(WORD.findall(text.lower()))
                terms = {f"w{w}" for w in words} | {f"s{w[:n]}" for w in words for n in STEMS if len(w) >= n}
                found[fold, toxic].update(terms)
                if sum(map(len, found.values())) > COUNTED:
                    yield sent()
        yield sent()

    parts = sample.mapInArrow(count, "term string, fold int, toxic int, n long")
    here = {(f, y): F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)) for f in range(FOLDS) for y in (0, 1)}
    terms = staged(
        parts.groupBy("term").agg(*[column.cast("double").alias(f"n{f}{y}") for (f, y), column in here.items()]), "terms"
    )
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    lexicons = []
    for out in [*range(FOLDS), None]:
        folds = [f for f in range(FOLDS) if f != out]
        clean, toxic = (float(sum(sizes.get((f, y), 0) for f in folds)) for y in (0, 1))
        a = sum((F.col(f"n{f}1") for f in folds), F.lit(0.0))
        b = sum((F.col(f"n{f}0") for f in folds), F.lit(0.0))
        share = toxic / max(toxic + clean, 1.0)
        expected = (a + b) * share
        surprise = F.when(a > 0, a * F.log(a / expected)).otherwise(0.0) + F.when(
            b > 0, b * F.log(b / (a + b - expected))
        ).otherwise(0.0)
        odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
        best = Window.partitionBy("kind").orderBy(F.desc("evidence"), "term")
        chosen = (
            terms.select("term", F.substring("term", 1, 1).alias("kind"), (2 * surprise).alias("evidence"), odds.alias("odds"))
            .filter((F.col("evidence") >= EVIDENCE) & (F.col("odds") >= ODDS))
            .withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= ENTRIES)
        )
        rows = chosen.select("kind", F.substr("term", F.lit(2)).alias("term"), "odds").collect()  # at most 2 * ENTRIES
        words, stems = ({r["term"]: r["odds"] for r in rows if r["kind"] == kind} for kind in ("w", "s"))
        lexicons.append(Lexicon(words, stems))
    return lexicons


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None = None
    calibration: Isotonic | None = None
    constant: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        return self.calibration(self.trees.log_odds(table_of(texts, self.lexicon)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4_000, seed: int = 11) -> Model:
    """Learn from the documents that `labels` (doc_id, toxic) names."""
    sample, sizes = labelled_sample(docs, labels, per_class, seed)
    lexicons = learned_lexicons(sample)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # bounded by ENTRIES

    @tidy
    def measure(batches):
        for batch in batches:
            folds = batch.column("fold").to_pylist()
            rows = [features(t, shared.value[f]) for t, f in zip(batch.column("text").to_pylist(), folds, strict=True)]
            packed = pa.array([np.array(row, "<f8").tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column("toxic"), batch.column("fold")], ["row", "toxic", "fold"])

    # At most 2 * per_class rows of FEATURES numbers.
    rows = sorted(tuple(r) for r in sample.mapInArrow(measure, "row binary, toxic int, fold int").collect())
    label = np.array([toxic for _, toxic, _ in rows], np.float64)
    if len(set(label.tolist())) < 2:
        return Model(Lexicon(), constant=float(label.mean()) if len(label) else 0.0)
    table = np.array([np.frombuffer(bytes(row), "<f8") for row, _, _ in rows])
    fold = np.array([f for _, _, f in rows])
    weight = np.where(label == 1, sizes[1] / label.sum(), sizes[0] / (1 - label).sum())
    weight /= weight.mean()
    apart = np.zeros(len(rows))
    for f in np.unique(fold).tolist():
        rest = fold != f
        if len(set(label[rest].tolist())) == 2:
            apart[~rest] = boost(table[rest], label[rest], weight[rest]).log_odds(table[~rest])
    return Model(lexicons[-1], boost(table, label, weight), isotonic(apart, label, weight))


def score(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """One row per document: `score` and whether it is `predicted` toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ENTRIES and the trees
    held_out = F.lit(False) if held_out is None else held_out
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column("text"))
            predicted = (scores >= TOXIC).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(predicted)],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of documents whose remainder by 3 is not 1, score all."""
    held_out = remainder("doc_id", 3) == 1
    known = labels.select("doc_id", "toxic").filter(~held_out)
    return score(docs, fit(docs.select("doc_id", "text"), known), held_out)
