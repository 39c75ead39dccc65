"""Language identification by the nearest of several centroids per language.

Texts become vectors of hashed n-grams of bytes, weighted log(1 + tf) idf and scaled to
length 1. Each language has up to `clusters` centroids, found by spherical k-means on a
bounded sample; a text belongs to the language of the centroid with the highest cosine.
Cosines grow with the length of a text, also those of matter that has nothing to do with the
language, so each centroid has a cut per length: what texts without any structure reach at
that length, plus `reject` of the way from there to a low quantile of the sample's own texts,
thinned to that length. A text under the cut is rejected.

Document frequencies count all training documents; the sample bounds the clustering only.
A null text, and one without a letter, is `und` with score 0 and rejected, and so is every
text if nothing was learned. Rows with a null language, and texts without a letter, teach
nothing. Repeated rows are
judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import remainder, tidy

DIMENSIONS = 4096
N = 3
#: A letter, in the spelling of Java and of RE2.
LETTER = r"\p{L}"
#: Lengths in n-grams for which there are cuts; in between they are interpolated.
LENGTHS = 1 << np.arange(4, 15)
#: The quantile of own cosines, own texts it is taken of at most and at least, texts without
#: structure made for a length, and how far above these the least cut lies.
LOW, MOST_OWN, LEAST_OWN, MADE, ABOVE = 0.01, 200, 20, 8, 1.1
UNKNOWN = "und"
#: Bytes that are no ASCII letter and no part of a longer character count as spaces.
LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)
#: Bytes and documents turned into vectors at once.
BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 256


def ngram_counts(texts: pa.Array):
    """(first row, counts) for consecutive rows; counts has a row per text."""
    texts = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", "")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + BYTES_AT_ONCE, "right")) - 1
        last = min(max(last, first + 1), first + ROWS_AT_ONCE, len(texts))
        begin, end = offsets[first], offsets[last]
        letters = LETTERS[data[begin:end]]
        gram = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
        row = np.repeat(np.arange(last - first), np.diff(offsets[first : last + 1]))
        inside = (row[:-2] == row[2:]) & (gram != 0x202020)
        place = (gram * np.uint32(2654435761)) >> np.uint32(20)
        cell = row[:-2][inside] * DIMENSIONS + place[inside]
        counts = np.bincount(cell, minlength=(last - first) * DIMENSIONS)
        yield first, counts.reshape(-1, DIMENSIONS)
        first = last


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


@dataclass
class Model:
    """idf, centroids with their languages, and the cosines below which each rejects texts of
    no n-grams and of each of LENGTHS."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def cuts(self, nearest: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The cut of each text, by its centroid and its number of n-grams."""
        at = np.interp(np.log2(np.maximum(lengths, 1)), [0, *np.log2(LENGTHS)], np.arange(len(LENGTHS) + 1))
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, len(LENGTHS))
        return self.least[nearest, low] * (1 - at + low) + self.least[nearest, high] * (at - low)


def cluster(vectors: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from far apart starts; at most as many centroids as vectors."""
    starts = [unit(vectors.mean(axis=0, keepdims=True))[0]]
    for _ in range(min(clusters, len(vectors)) - 1):
        starts.append(vectors[(vectors @ np.array(starts).T).max(axis=1).argmin()])
    centroids = np.array(starts)
    for _ in range(rounds):
        nearest = (vectors @ centroids.T).argmax(axis=1)
        used = np.unique(nearest)
        centroids = unit(np.array([vectors[nearest == c].mean(axis=0) for c in used]))
    return centroids


def structureless(random) -> list[np.ndarray]:
    """For each of LENGTHS, counts of texts of random letters and of evenly hashed n-grams."""
    made = []
    for length in LENGTHS.tolist():
        letters = random.integers(97, 123, (MADE, length)).astype(np.uint8)
        letters[random.random(letters.shape) < 0.15] = 32
        texts = pa.array([row.tobytes().decode() for row in letters])
        counts = [counts for _, counts in ngram_counts(texts)]
        even = random.multinomial(length, np.full(DIMENSIONS, 1 / DIMENSIONS), MADE)
        made.append(np.concatenate([*counts, even]))
    return made


def cuts_of(model: Model, centroid: np.ndarray, own: np.ndarray, chance: list, reject: float, random) -> list[float]:
    """The cuts of a centroid, from the counts of its own texts."""
    own = own[:MOST_OWN]
    sizes, low, found = own.sum(axis=1), 0.0, [0.0]
    for length, vectors in zip(LENGTHS.tolist(), chance, strict=True):
        floor = ABOVE * float((vectors @ centroid).max())
        fits = sizes >= length
        if fits.sum() >= min(LEAST_OWN, len(own)):
            thinned = own[fits]
            row, gram = thinned.nonzero()
            thinned[row, gram] = random.binomial(thinned[row, gram], (length / sizes[fits])[row])
            low = float(np.quantile(model.vectors(thinned) @ centroid, LOW))
        found.append(floor + reject * max(0.0, low - floor))
    return found


def fit(
    docs: DataFrame,
    clusters: int = 4,
    per_language: int = 800,
    reject: float = 0.25,
    seed: int = 1,
) -> Model:
    """Learn from rows with a text and a language.

    `per_language` bounds the documents of a language that are clustered: those with the
    least seeded hashes, drawn by rate first so that few texts are moved.
    """
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null")
    docs = docs.filter(F.col("text").rlike(LETTER))
    # One row per language.
    sizes = docs.groupBy("lang").count().withColumn("rate", F.lit(1.5 * per_language) / F.col("count"))
    known = sizes.collect()
    total = sum(row["count"] for row in known)
    if not total:
        return Model(np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros((0, 1 + len(LENGTHS))))

    @tidy
    def frequencies(batches):
        found = np.zeros(DIMENSIONS, np.int64)
        for batch in batches:
            for _, counts in ngram_counts(batch.column("text")):
                found += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), pa.array(found)], ["gram", "df"])

    @tidy
    def sparse(batches):
        for batch in batches:
            rows = []
            for _, counts in ngram_counts(batch.column("text")):
                rows += [(row.nonzero()[0].astype("<u4").tobytes() + row[row > 0].astype("<u4").tobytes()) for row in counts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "counts"])

    df = np.zeros(DIMENSIONS)
    per_gram = docs.select("text").mapInArrow(frequencies, "gram long, df long")
    for gram, n in per_gram.groupBy("gram").agg(F.sum("df")).collect():
        df[gram] = n
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    first = Window.partitionBy("lang").orderBy("draw", "doc_id")
    sample = (
        docs.join(F.broadcast(sizes.select("lang", "rate")), "lang")
        .withColumn("draw", draw)
        .filter(F.pmod("draw", F.lit(1 << 20)) < F.col("rate") * (1 << 20))
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= per_language)
        .select("lang", "text")
        .mapInArrow(sparse, "lang string, counts binary")
    )
    drawn: dict[str, list] = {}
    for lang, counts in sample.collect():
        drawn.setdefault(lang, []).append(bytes(counts))
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    centroids, least = [], []
    random = np.random.default_rng(seed)
    chance = [model.vectors(counts) for counts in structureless(random)]
    for lang in sorted(drawn):
        table = np.zeros((len(drawn[lang]), DIMENSIONS), np.int64)
        for row, cells in zip(table, sorted(drawn[lang]), strict=True):
            gram, n = np.frombuffer(cells, "<u4").reshape(2, -1)
            row[gram] = n
        vectors = model.vectors(table)
        own = cluster(vectors, clusters)
        nearest = (vectors @ own.T).argmax(axis=1)
        centroids.append(own)
        least += [cuts_of(model, c, table[nearest == i], chance, reject, random) for i, c in enumerate(own)]
        model.languages += [lang] * len(own)
    model.centroids = np.concatenate(centroids)
    model.least = np.array(least)
    return model


def predicted(texts: pa.Array, model: Model):
    """(languages, cosines, rejected) of an array of texts."""
    known = pc.fill_null(pc.match_substring_regex(texts, LETTER), False)
    known = known.to_numpy(zero_copy_only=False) & bool(model.languages)
    nearest, cosine = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    lengths = np.zeros(len(texts), np.int64)
    if model.languages:
        for first, counts in ngram_counts(texts):
            found = model.vectors(counts) @ model.centroids.T
            nearest[first : first + len(found)] = found.argmax(axis=1)
            cosine[first : first + len(found)] = found.max(axis=1)
            lengths[first : first + len(found)] = counts.sum(axis=1)
    cosine = np.where(known, cosine.clip(0, 1), 0.0)
    low = cosine < model.cuts(nearest, lengths) if model.languages else ~known
    pairs = zip(nearest.tolist(), known.tolist(), strict=True)
    languages = [model.languages[n] if k else UNKNOWN for n, k in pairs]
    return languages, cosine, low | ~known


def identify(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """One row per document: `lang_pred`, `score` (its cosine) and `rejected`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the languages

    @tidy
    def predict(batches):
        for batch in batches:
            languages, cosine, rejected = predicted(batch.column("text"), shared.value)
            arrays = [batch.column("doc_id"), batch.column("held_out")]
            arrays += [pa.array(languages, pa.string()), pa.array(cosine), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["doc_id", "held_out", "lang_pred", "score", "rejected"]
            )

    held_out = F.lit(False) if held_out is None else held_out
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(
        predict,
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean",
    )


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @tidy
    def keep(batches):
        for batch in batches:
            rejected = predicted(batch.column("text"), shared.value)[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder by 3 is not 1, judge all."""
    held_out = remainder("doc_id", 3) == 1
    return identify(docs, fit(docs.filter(~held_out)), held_out)
