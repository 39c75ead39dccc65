"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, weight tf * damped idf. Samples
of the set (Ioffe, 2010) agree between two documents with the probability of their weighted
Jaccard similarity; `bands` groups of `rows` samples propose pairs, and the similarity
itself, computed from the texts, decides at `threshold`.

idf is log(N / df), held at log(1 / rare): a shingle in fewer than one of 1 / rare documents
counts as rare. So the table of frequent shingles has at most (mean shingles a document) /
rare entries, whatever the number of documents, and may be broadcast. Counts cover all
documents. The weight runs from `least` to 1 as idf runs from 0 to its ceiling; `least`
keeps the common part of a large group of copies from fading beside their few differences.

Texts with the same words are one node. Inside a bucket every text is first compared with
the least id. Buckets whose texts are still of several classes are then settled in tiles of
bounded size: texts of different classes are compared, one against many, if sizes and the
distances to that least id (the distance is a metric) do not rule the pair out, and a link
is returned for each two classes that meet. So no pair is lost, and none is written out.

Words are runs without white space, A-Z in lower case; a text of one to four words is one
shingle. A text without words, and a null text, is a class of its own; a null id never
joins a class, its row is kept. Rows equal in id and text are one document and come out as
one row each, in the same class. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import sent_if_small, staged, tidy
from docledger.llm.components import components
from docledger.llm.words import STEP, mixed, word_hashes

WORDS = 5
#: Random triples for the samples, drawn by hash; and shingles of one counting bucket.
POOL_BITS, PER_BUCKET = 16, 1 << 16
#: Rows of a matrix of samples, and shingles that a task counts before it hands them on.
AT_ONCE, COUNT_AT_ONCE = 1 << 12, 1 << 20
#: Pairs compared at once, and texts of a bucket that one task gets at most, twice.
PAIRS_AT_ONCE, TILE = 256, 1024


def shingles(hashes: np.ndarray, bounds: np.ndarray):
    """(shingle hashes, bounds) of documents given by their word hashes."""
    n = np.diff(bounds)
    windows = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    ends = np.append(0, np.cumsum(windows))
    place = np.arange(ends[-1]) - np.repeat(ends[:-1], windows) + np.repeat(bounds[:-1], windows)
    left = np.repeat(bounds[1:], windows) - place
    value = np.zeros(ends[-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            here = np.minimum(place + k, max(len(hashes) - 1, 0))
            word = hashes[here] if len(hashes) else value
            value = np.where(k < left, value * STEP + word, value)
    return mixed(value), ends


def distinct_by_document(value: np.ndarray, bounds: np.ndarray):
    """(values, counts, bounds): the sorted distinct values of each document."""
    values, counts, ends = [], [], [0]
    for begin, end in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        own, n = np.unique(value[begin:end], return_counts=True)
        values.append(own)
        counts.append(n)
        ends.append(ends[-1] + len(own))
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return joined(values, np.uint64), joined(counts, np.int64), np.array(ends)


class Weights:
    """tf * damped idf, from the table of frequent shingles."""

    def __init__(self, frequent: np.ndarray, df: np.ndarray, total: int, rare: float, least: float):
        order = np.argsort(frequent)
        ceiling = math.log(1 / rare)
        idf = np.clip(np.log(max(total, 1) / df[order]), 0, ceiling)
        self.frequent = frequent[order]
        self.damped = least + (1 - least) * idf / ceiling

    def of(self, value: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = tf.astype(np.float64)
        if len(self.frequent):
            at = np.searchsorted(self.frequent, value).clip(max=len(self.frequent) - 1)
            weight *= np.where(self.frequent[at] == value, self.damped[at], 1.0)
        return weight


class Sampler:
    """Consistent weighted samples of weighted sets, `count` of each."""

    def __init__(self, count: int, seed: int):
        random = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = random.gamma(2.0, 1.0, size)
        self.log_c = np.log(random.gamma(2.0, 1.0, size))
        self.beta = random.random(size)
        self.factors = random.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plain, _ = self.draw(np.arange(size), np.zeros(size))
        self.plain = self.plain.astype(np.float32)

    def draw(self, place: np.ndarray, log_weight: np.ndarray):
        """(log of the race's value, level) for places of the pool and weights."""
        r = self.r[place]
        level = np.floor(log_weight / r + self.beta[place])
        return self.log_c[place] - r * (level - self.beta[place] + 1), level

    def samples(self, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash per sample of a set, which must not be empty."""
        shift = np.uint64(64 - POOL_BITS)
        log_weight = np.log(weight)
        best = np.full(len(self.factors), np.inf, np.float32)
        chosen = np.zeros(len(self.factors), np.int64)
        for begin in range(0, len(value), AT_ONCE):
            part = value[begin : begin + AT_ONCE]
            with np.errstate(over="ignore"):
                place = (self.factors[:, None] * part[None, :]) >> shift
            race = self.plain[place]
            odd = np.flatnonzero(log_weight[begin : begin + AT_ONCE])
            if len(odd):
                race[:, odd] = self.draw(place[:, odd], log_weight[begin + odd])[0]
            first = race.argmin(axis=1)
            low = race[np.arange(len(best)), first]
            won = low < best
            best[won], chosen[won] = low[won], begin + first[won]
        with np.errstate(over="ignore"):
            place = (self.factors * value[chosen]) >> shift
        level = self.draw(place, log_weight[chosen])[1].astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            return mixed(value[chosen] + level * STEP)


def frequent_shingles(docs: DataFrame, total: int, rare: float):
    """Shingles in at least `rare` of all documents, in how many each is, and the low bits
    of a shingle that do not count here.

    Tasks send their distinct shingles packed, one row per bucket of the upper bits, so a
    shingle costs 8 bytes of shuffle; buckets grow in number, not in size, with the table.
    """
    bits = max(4, math.ceil(math.log2(max(total, 1) * 512 / PER_BUCKET)))
    least = max(1, math.ceil(rare * total))

    def packed(values: list[np.ndarray]) -> pa.RecordBatch:
        own, counts = np.unique(np.concatenate(values), return_counts=True)
        bucket = (own >> np.uint64(64 - bits)).astype(np.int64)
        low = ((own >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(own))
        pairs = list(zip(cuts.tolist(), ends.tolist(), strict=True))
        columns = (bucket[cuts], [low[a:b].tobytes() for a, b in pairs], [counts[a:b].astype("<u4").tobytes() for a, b in pairs])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
            ["bucket", "low", "counts"],
        )

    @tidy
    def count(batches):
        values, size = [], 0
        for batch in batches:
            for _, hashes, bounds in word_hashes(batch.column("text")):
                own, _, _ = distinct_by_document(*shingles(hashes, bounds))
                values.append(own)
                size += len(own)
                if size >= COUNT_AT_ONCE:
                    yield packed(values)
                    values, size = [], 0
        if size:
            yield packed(values)

    def add_up(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.frombuffer(x, "<u4") for x in table["low"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()])
        order = np.argsort(low, kind="stable")
        heads = np.flatnonzero(np.diff(low[order].astype(np.int64), prepend=-1))
        sums = np.add.reduceat(counts[order].astype(np.int64), heads)
        often = sums >= least
        bucket = table["bucket"][0].as_py()
        key = (bucket << 32) | low[order][heads][often].astype(np.int64)
        return pa.table({"key": key, "df": sums[often]})

    found = (
        docs.select("text")
        .mapInArrow(count, "bucket long, low binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(add_up, "key long, df long")
        .toArrow()
    )
    unused = np.uint64(32 - bits)
    return found["key"].to_numpy().astype(np.uint64) << unused, found["df"].to_numpy(), unused


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    bands: int = 20,
    rows: int = 5,
    rare: float = 0.001,
    least: float = 0.75,
    seed: int = 5,
) -> DataFrame:
    """One row per document: `class_id`, the least id of its class, whether it is `kept`, and
    `text_hash`, which tells texts of one id apart.

    What is grouped are texts, not ids: a node is an id with the hash of its text.
    """
    texts = docs.select("doc_id", "text", text_hash())
    total = texts.count()
    keys, df, unused = frequent_shingles(texts, total, rare)
    # At most (mean shingles a document) / rare rows; see above.
    shared = docs.sparkSession.sparkContext.broadcast((keys, df))

    def weighted(weights: Weights, batch_texts: pa.Array):
        """(row, shingles, weights) of each text with words."""
        for first, hashes, bounds in word_hashes(batch_texts):
            value, tf, ends = distinct_by_document(*shingles(hashes, bounds))
            weight = weights.of((value >> unused) << unused, tf)
            for i, (begin, end) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                words = hashes[bounds[i] : bounds[i + 1]]
                yield first + i, value[begin:end], weight[begin:end], words

    @tidy
    def sign(batches):
        weights, sampler = Weights(*shared.value, total, rare, least), Sampler(bands * rows, seed)
        for batch in batches:
            n = batch.num_rows
            upper, lower = np.zeros(n, np.int64), np.zeros(n, np.int64)
            weight, signature = np.zeros(n), [None] * n
            for i, value, own, words in weighted(weights, batch.column("text")):
                if not len(value):
                    continue
                with np.errstate(over="ignore"):
                    powers = np.cumprod(np.full(len(words), STEP, np.uint64))
                    upper[i] = np.int64(np.sum(words * powers).view(np.int64))
                    lower[i] = np.int64(np.sum(mixed(words + powers)).view(np.int64))
                    drawn = sampler.samples(value, own).reshape(bands, rows)
                    band = np.zeros(bands, np.uint64)
                    for k in range(rows):
                        band = band * STEP + drawn[:, k]
                weight[i] = own.sum()
                signature[i] = mixed(band).view(np.int64)
            arrays = [pa.array(x) for x in (upper, lower, weight)]
            arrays.append(pa.array(signature, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *arrays],
                ["doc_id", "text_hash", "upper", "lower", "weight", "signature"],
            )

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    kind = f"struct<doc_id:{id_kind},text_hash:bigint>"
    node = F.struct("doc_id", "text_hash")
    signed = staged(
        texts.filter("doc_id is not null").mapInArrow(
            sign,
            f"doc_id {id_kind}, text_hash long, upper long, lower long, weight double, signature array<long>",
        ),
        "signatures",
    )
    # Texts with the same words: one node, of the least id. Others without words: themselves.
    worded = signed.filter("signature is not null").withColumn("own", node)
    first = worded.groupBy("upper", "lower").agg(F.min("own").alias("node"))
    members = staged(
        worded.select("own", "upper", "lower").join(first, ["upper", "lower"]).select("own", "node").distinct(),
        "members",
    )
    nodes = (
        worded.join(first, ["upper", "lower"])
        .filter("own = node")
        .groupBy("node")
        .agg(F.first("weight").alias("weight"), F.first("signature").alias("signature"))
    )
    entries = nodes.select("node", F.posexplode("signature").alias("band", "value")).select(
        "node", "band", F.xxhash64("band", "value").alias("bucket")
    )
    centres = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n"))
    crowded = staged(
        entries.join(centres.filter("n > 1"), "bucket").select("bucket", "band", "centre", "node"),
        "buckets",
    )
    wanted = staged(crowded.select("node.*").distinct(), "crowded")
    key = ["doc_id", "text_hash"]
    needed = staged(
        texts.join(sent_if_small(wanted, 64), key, "left_semi")
        .dropDuplicates(key)
        .select(node.alias("node"), "text"),
        "texts",
    )

    def compare(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with the weighted Jaccard similarity of their texts."""

        @tidy
        def similarity(batches):
            weights = Weights(*shared.value, total, rare, least)
            parts = (b.slice(at, PAIRS_AT_ONCE) for b in batches for at in range(0, b.num_rows, PAIRS_AT_ONCE))
            for batch in parts:
                sets = [
                    {i: (value, own) for i, value, own, _ in weighted(weights, batch.column(c))}
                    for c in ("text_a", "text_b")
                ]
                found = np.zeros(batch.num_rows)
                for i in range(batch.num_rows):
                    (a, wa), (b, wb) = sets[0][i], sets[1][i]
                    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                    shared_weight = np.minimum(wa[at_a], wb[at_b]).sum()
                    found[i] = shared_weight / (wa.sum() + wb.sum() - shared_weight)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]
                )

        left = needed.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = needed.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return staged(
            pairs.join(left, "a").join(right, "b").mapInArrow(
                similarity, f"a {kind}, b {kind}, similarity double"
            ),
            "similarities",
        )

    to_centre = (
        crowded.filter("centre < node").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    ).distinct()
    starred = compare(to_centre)
    linked = starred.filter(F.col("similarity") >= threshold).select("a", "b")
    # What is left: pairs of a bucket in different classes.
    classes = staged(components(linked), "classes")
    distance = starred.select(
        F.col("a").alias("centre"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("far")
    )
    labelled = (
        crowded.join(classes, "node", "left")
        .withColumn("class", F.coalesce("component", "node"))
        .join(distance, ["centre", "node"], "left")
        .select("bucket", "band", "node", "class", F.coalesce("far", F.lit(0.0)).alias("far"))
    )
    split = (
        labelled.groupBy("bucket")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n"))
        .filter("low < high")
        .select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("chunks"))
    )
    # Every two chunks of a bucket meet in one tile.
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    tiled = (
        labelled.join(split, "bucket")
        .withColumn("chunk", chunk)
        .withColumn("other", other)
        .withColumn("tile", F.struct(F.least("chunk", "other"), F.greatest("chunk", "other")))
        .join(nodes.select("node", "signature"), "node")
        .join(needed, "node")
        .withColumn("class", F.xxhash64("class"))
        .drop("chunks")
    )

    def settle(tile: pa.Table) -> pa.Table:
        """Links between the classes that meet in a tile."""
        tile = tile.combine_chunks()
        weights = Weights(*shared.value, total, rare, least)
        found = list(weighted(weights, tile["text"].combine_chunks()))
        sets, own = [x[1] for x in found], [x[2] for x in found]
        whole = np.array([w.sum() for w in own])
        nodes_here, far = tile["node"], tile["far"].to_numpy()
        start = np.unique(tile["class"].to_numpy(), return_inverse=True)[1]
        signature = np.array(tile["signature"].to_pylist(), np.int64)[:, : tile["band"][0].as_py()]
        chunk = tile["chunk"].to_numpy()
        across = len(np.unique(chunk)) > 1
        main, label = np.bincount(start).argmax(), start.copy()
        links = []
        for i in np.flatnonzero(start != main).tolist():
            # A pair that met in an earlier band is settled there.
            open_ = (label != label[i]) & ((start == main) | (np.arange(len(label)) > i))
            open_ &= ~(signature == signature[i]).any(axis=1) & (np.abs(far - far[i]) <= 1 - threshold + 1e-9)
            open_ &= np.minimum(whole, whole[i]) >= threshold * np.maximum(whole, whole[i]) - 1e-9
            if across:
                open_ &= chunk != chunk[i]
            others = np.flatnonzero(open_)
            if not len(others):
                continue
            value = np.concatenate([sets[j] for j in others])
            heads = np.cumsum([0, *(len(sets[j]) for j in others[:-1])])
            at = np.searchsorted(sets[i], value).clip(max=len(sets[i]) - 1)
            both = np.minimum(own[i][at], np.concatenate([own[j] for j in others]))
            both = np.add.reduceat(np.where(sets[i][at] == value, both, 0.0), heads)
            near = others[both / (whole[i] + whole[others] - both) >= threshold]
            for j in near.tolist():
                if label[j] != label[i]:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
        ends = [nodes_here.take(pa.array([x[k] for x in links], pa.int64())) for k in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1]})

    more = tiled.groupBy("bucket", "tile").applyInArrow(settle, f"a {kind}, b {kind}")
    final = components(linked.union(more))
    named = members.join(final, "node", "left").select(
        "own.*", F.coalesce("component", "node").alias("class")
    )
    class_id = F.coalesce("class.doc_id", "doc_id").alias("class_id")
    kept = F.coalesce(F.col("class") == node, F.lit(True)).alias("kept")
    return texts.select(*key).join(named, key, "left").select("doc_id", class_id, kept, "text_hash")


def text_hash() -> Column:
    """Tells the texts of one id apart; a null text is one of its own."""
    return F.xxhash64("text", F.col("text").isNull()).alias("text_hash")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class; rows without an id stay as they are.

    Of rows that are equal in id and text, one stays; an id with several texts keeps those
    that are no near duplicates.
    """
    mark = "text_hash"
    while mark in docs.columns:
        mark = f"_{mark}"
    keep = near_duplicates(docs, **options).filter("kept and doc_id is not null")
    keep = keep.select("doc_id", F.col("text_hash").alias(mark)).distinct()
    named = docs.withColumn(mark, text_hash()).join(keep, ["doc_id", mark], "left_semi")
    return named.dropDuplicates(["doc_id", mark]).select(*docs.columns).union(docs.filter("doc_id is null"))
