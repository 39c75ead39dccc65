"""A log-bilinear language model (Mnih and Hinton, 2007) and the scores it gives texts.

Tokens are the words of a text, A-Z in lower case, and one end. The model knows every word
that the training texts have `min_count` times, the end, and all other words as one, so its
vocabulary grows with the corpus, up to the 1 / `least_share` words that can make up that share
of all tokens. A context is the `places` tokens before, starts of the text where there are
none. The vectors of a context's tokens, each turned by the matrix of its place, add up to the
prediction; a word's energy is the logarithm of its share of the tokens, plus the product of
the prediction with the word's vector, plus a bias.

It is trained by noise-contrastive estimation in tasks over the table of chunks: small batches
of short runs of neighbouring tokens are told from noise words drawn by their shares. Each round starts all tasks from the
same model; what they changed is averaged per vector, weighted by how often each task met it.
Every training token is met `passes` times, whatever the size of the table.

Probabilities are normalised exactly, by a tree (see `Tree`): the probability of a word is the
product of those of the branches on its way, each a softmax over the branches of one node, so
those of all words add up to one in every context, for any vocabulary, at the cost of some
hundred energies a token. Other words share the probability of their class by their counts,
with one added to each and to one word never seen.

Texts are tokenised once, into a table of chunks with word numbers of their own. Counts of
distinct words go from each chunk to the bucket of their hash, and the counts of rare words
come back; frequent ones are in the model. Chunks are scored where they lie, and only sums of
documents and their rare words move to meet the counts. Words are told apart by 64-bit hashes.

A null text is an empty one; it has its end as only token. A null id is training data.
Repeated rows are scored alike, and all count; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import remainder, staged, tidy
from docledger.llm.words import word_hashes

#: The hash that stands for the end of a text.
END = np.uint64(0)
MOST_BUCKETS = 1 << 16
#: Tokens of a training batch, of a run of neighbours in it, and noise words drawn for it.
BATCH, RUN, NOISE = 512, 16, 64
#: Contexts added up at once; tokens scored at once, in all (a usual chunk is two equal parts),
#: below the root and against it: what is computed between two passes stays in the processor's cache.
GATHERED_AT_ONCE, SCORED_AT_ONCE, ROWS_BELOW, ROWS_OF_ROOT = 1 << 13, 5 << 17, 2048, 512
#: Sums of float32 exponentials that have lost nothing.
SAFE = np.float32(1e-25), np.float32(1e35)
#: An energy of no probability.
NONE = np.float32(-1e30)
#: Words that are branches of the tree's root, words of a leaf, and bits of a branching.
TOP, LEAF, BITS = 128, 64, 5
#: Rate of the first round, and what sums of squared slopes start from.
RATE, FIRST_SQUARES = 0.3, 60.0
#: Vectors whose changes are averaged together.
ROWS_AT_ONCE = 4096
#: Tokens of a chunk, about; a longer document is a chunk by itself.
TOKENS_AT_ONCE = 1 << 20


def tokenised(docs: DataFrame, kind: str) -> DataFrame:
    """One row per chunk of documents: their ids, bounds, and tokens as numbers of `words`."""

    def parts_of(texts: pa.Array):
        """(first row, hashes with ends, sizes) of consecutive rows, of bounded length."""
        begin, parts, sizes = 0, [], []
        for first, hashes, bounds in word_hashes(texts):
            parts.append(np.insert(hashes, bounds[1:], END))
            sizes.append(np.diff(bounds) + 1)
            last = first + len(bounds) - 1
            if sum(map(len, parts)) >= TOKENS_AT_ONCE or last == len(texts):
                yield begin, np.concatenate(parts), np.concatenate(sizes)
                begin, parts, sizes = last, [], []

    @tidy
    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            kept_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for begin, hashes, sizes in parts_of(batch.column("text")):
                ids = batch.column("doc_id").slice(begin, len(sizes))
                held_out = kept_out[begin : begin + len(sizes)]
                words, tokens = np.unique(hashes, return_inverse=True)
                counts = np.bincount(tokens[np.repeat(~held_out, sizes)], minlength=len(words))
                columns = [
                    pa.array([serial]),
                    pa.array([int(counts.sum())]),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    *(
                        pa.array([c.tobytes()], pa.binary())
                        for c in (held_out, sizes, tokens.astype("<u4"), words, counts.astype("<u4"))
                    ),
                ]
                serial += 1
                yield pa.RecordBatch.from_arrays(
                    columns, ["chunk", "trains", "doc_ids", "held_out", "sizes", "tokens", "words", "counts"]
                )

    return docs.mapInArrow(
        run,
        f"chunk long, trains long, doc_ids array<{kind}>, held_out binary, sizes binary, tokens binary, "
        "words binary, counts binary",
    )


def rare_kind(min_count: int) -> str:
    """The numbers in which counts up to `min_count` are sent back."""
    return "<u1" if min_count < 1 << 8 else "<u2" if min_count < 1 << 16 else "<i8"


def totals(chunks: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """Rows of two kinds: for a chunk and a bucket, training counts of the chunk's words in
    order, `min_count` for more; for a bucket (chunk null), its words and counts in all and
    its frequent ones."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    @tidy
    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                counts = np.frombuffer(row["counts"], "<u4")
                bucket = (words >> shift).astype(np.int64)
                heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*heads[1:].tolist(), len(words)]
                pairs = list(zip(heads.tolist(), ends, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(heads), row["chunk"])),
                        pa.array(bucket[heads]),
                        pa.array([words[a:b].tobytes() for a, b in pairs], pa.binary()),
                        pa.array([counts[a:b].tobytes() for a, b in pairs], pa.binary()),
                    ],
                    ["chunk", "bucket", "words", "counts"],
                )

    def add_up(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        counts = [np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()]
        words, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts)).astype("<i8")
        cuts = np.cumsum([len(x) for x in own])[:-1]
        sent = np.minimum(total, min_count).astype(rare_kind(min_count))
        back = [sent[p].tobytes() for p in np.split(place, cuts)]
        top = np.flatnonzero((total >= min_count) & (words != END))
        ends = int(total[words == END].sum())
        n, bucket = table.num_rows, table["bucket"][0].as_py()
        return pa.table(
            {
                "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
                "bucket": pa.array([bucket] * (n + 1), pa.int64()),
                "counts": pa.array([*back, None], pa.binary()),
                "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
                "distinct": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
                "ends": pa.array([None] * n + [ends], pa.int64()),
                "top": pa.array([None] * n + [words[top].tobytes()], pa.binary()),
                "top_counts": pa.array([None] * n + [total[top].tobytes()], pa.binary()),
            }
        )

    return (
        chunks.select("chunk", "words", "counts")
        .mapInArrow(split, "chunk long, bucket long, words binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(
            add_up,
            "chunk long, bucket long, counts binary, tokens long, distinct long, "
            "ends long, top binary, top_counts binary",
        )
    )


def picked(energies: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of each row's softmax at its chosen place."""
    own = energies[np.arange(len(chosen)), chosen]
    with np.errstate(over="ignore"):
        total = np.exp(energies) @ np.ones(energies.shape[1], np.float32)
    found = own - np.log(np.clip(total, *SAFE))
    # Energies are of modest size; rows whose sums leave the safe range are taken by their largest.
    far = np.flatnonzero((total <= SAFE[0]) | (total >= SAFE[1]))
    if len(far):
        largest = energies[far].max(axis=1, keepdims=True)
        found[far] = own[far] - largest[:, 0] - np.log(np.exp(energies[far] - largest).sum(axis=1))
    return found


class Tree:
    """Exact normalisation over any number of tokens.

    The root's branches are the `TOP` most frequent tokens and the first groups of all others.
    These are halved, at the median of the column that varies most, until no group has more
    than `LEAF`; so groups hold tokens of like vectors. Each level of groups takes up to `BITS`
    halvings, and the branches of the last level are tokens. A token's energy is its own; that
    of a group, the logarithm of a sum over its tokens, is taken as if their energies were
    spread normally around their mean: the log of its share, plus mean times prediction, plus
    half the variance, by columns. That choice shapes the probabilities; that they add up to
    one does not depend on it.
    """

    def __init__(self, share: np.ndarray, token: np.ndarray):
        self.log_share = np.log(share).astype(np.float32)
        order = np.argsort(-share, kind="stable")
        self.top, self.rest = order[:TOP], np.sort(order[TOP:])
        depth = max(0, int(np.ceil(np.log2(max(len(self.rest), 1) / LEAF))))
        bounds = [0, len(self.rest)]
        for _ in range(depth):
            halved = [0]
            for begin, end in zip(bounds, bounds[1:], strict=False):
                half = (end - begin + 1) // 2
                if end - begin > 1:
                    own = self.rest[begin:end]
                    vectors = token[own].astype(np.float32)
                    column = vectors[:, vectors.var(axis=0).argmax()]
                    self.rest[begin:end] = own[np.argpartition(column, half)]
                halved += [begin + half, end]
            bounds = halved
        self.bounds = np.array(bounds)
        # The leaf of a token, -1 for those of the root, and its place there or among the root's.
        self.leaf = np.full(len(share), -1, np.int16 if len(bounds) < 1 << 15 else np.int32)
        self.place = np.zeros(len(share), np.int64)
        self.leaf[self.rest] = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.place[self.rest] = np.arange(len(self.rest)) - np.repeat(self.bounds[:-1], np.diff(bounds))
        self.place[self.top] = np.arange(len(self.top))
        levels = max(1, -(-depth // BITS))
        self.upto = np.cumsum([depth // levels + (k < depth % levels) for k in range(levels)]).tolist()
        self.groups = []
        if len(self.rest):
            own = share[self.rest].astype(np.float32)[:, None]
            vectors = token[self.rest].astype(np.float32)
            sums = [np.add.reduceat(x.astype(np.float64), self.bounds[:-1]) for x in (own, own * vectors, own * vectors**2)]
            for bits in self.upto:
                whole, first, second = (s.reshape(1 << bits, -1, s.shape[1]).sum(axis=1) for s in sums)
                mean = first / whole
                spread = np.maximum(second / whole - mean**2, 0) / 2
                mean[:, -1] += np.log(whole[:, 0])
                self.groups.append(np.concatenate([mean, spread], axis=1).astype(np.float32))

    def against(self, tokens: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Vectors whose products with predictions are the energies; the last column meets a one."""
        vectors = token[tokens].astype(np.float32)
        vectors[..., -1] += self.log_share[tokens]
        return vectors

    def members(self, leaves: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Vectors of the tokens of leaves. Leaves differ by one token at most; what the smaller
        ones lack has no probability."""
        begin, size = self.bounds[leaves], self.bounds[leaves + 1] - self.bounds[leaves]
        places = np.arange(size.max())
        lacking = places >= size[:, None]
        vectors = self.against(self.rest[np.where(lacking, begin[:, None], begin[:, None] + places)], token)
        vectors[lacking] = 0
        vectors[lacking, -1] = NONE
        return vectors

    def log_probabilities(self, guess: np.ndarray, own: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each token `own` under its prediction."""
        found, leaf = np.zeros(len(own)), self.leaf[own]
        depth, size = self.upto[-1], guess.shape[1]
        wide = lambda rows: np.concatenate([rows, rows**2], axis=1)
        root, first = self.against(self.top, token).T, self.place[own]
        if self.groups:
            first = np.where(leaf < 0, first, len(self.top) + (leaf >> (depth - self.upto[0])))
        for at in range(0, len(own), ROWS_OF_ROOT):
            rows = guess[at : at + ROWS_OF_ROOT]
            energies = np.empty((len(rows), len(self.top) + (len(self.groups[0]) if self.groups else 0)), np.float32)
            np.matmul(rows, root, out=energies[:, : len(self.top)])
            if self.groups:
                np.matmul(wide(rows), self.groups[0].T, out=energies[:, len(self.top) :])
            found[at : at + ROWS_OF_ROOT] = picked(energies, first[at : at + ROWS_OF_ROOT])

        def inside(rows: np.ndarray, node: np.ndarray, chosen: np.ndarray, vectors) -> np.ndarray:
            """The same among the branches of each row's node; rows of a node lie together."""
            heads = np.flatnonzero(np.diff(node, prepend=-1))
            branches = vectors(node[heads])
            energies = np.empty((len(rows), branches.shape[1]), np.float32)
            heads = heads.tolist()
            for begin, end, those in zip(heads, [*heads[1:], len(node)], branches, strict=True):
                np.matmul(rows[begin:end], those.T, out=energies[begin:end])
            return picked(energies, chosen)

        below = np.flatnonzero(leaf >= 0)
        below = below[np.argsort(leaf[below], kind="stable")]
        for at in range(0, len(below), ROWS_BELOW):
            part = below[at : at + ROWS_BELOW]
            rows, leaves = wide(guess[part]), leaf[part].astype(np.int64)
            inner = inside(rows[:, :size], leaves, self.place[own[part]], lambda nodes: self.members(nodes, token))
            for k in range(1, len(self.upto)):
                child, bits = leaves >> (depth - self.upto[k]), self.upto[k] - self.upto[k - 1]
                groups = self.groups[k].reshape(-1, 1 << bits, 2 * size)
                inner += inside(rows, child >> bits, child & ((1 << bits) - 1), groups.__getitem__)
            found[part] += inner
        return found


@dataclass
class Model:
    """Tokens are the words in falling order of counts, then all other words, then the end;
    contexts have the start besides. So the vectors that are met most lie together. `ranks`
    are the tokens of the sorted `words`. The last column of `token` is the bias."""

    words: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    share: np.ndarray
    context: np.ndarray
    token: np.ndarray
    turn: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: int
    rare_words: int
    squares: dict[str, np.ndarray] = field(default_factory=dict)
    tree: Tree | None = None

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The model's number of each word of a chunk."""
        known = len(self.words)
        at = np.searchsorted(self.words, hashes)
        fits = at < known
        fits[fits] = self.words[at[fits]] == hashes[fits]
        numbers = np.full(len(hashes), known, np.int32)
        numbers[fits] = self.ranks[at[fits]]
        numbers[hashes == END] = known + 1
        return numbers

    def sent(self) -> Model:
        """The same with vectors of half the length, as tasks get it."""
        return replace(self, context=self.context.astype("<f2"), token=self.token.astype("<f2"))


def contexts(tokens: np.ndarray, position: np.ndarray, at: np.ndarray, start: int, places: int) -> np.ndarray:
    """For each place, the token so far before those `at` places; `start` ahead of a document."""
    inside = position[at]
    return np.stack([np.where(inside > k, tokens[np.maximum(at - k - 1, 0)], start) for k in range(places)])


def predictions(model: Model, before: np.ndarray) -> np.ndarray:
    """Turned vectors of each place added up, with a one for the bias. Each distinct token of
    the contexts is turned once."""
    met = np.zeros(len(model.context), bool)
    met[before] = True
    used = np.flatnonzero(met)
    place = np.empty(len(met), np.int32)
    place[used] = np.arange(len(used))
    turned = model.context[used].astype(np.float32) @ model.turn
    found = np.empty((before.shape[1], model.token.shape[1]), np.float32)
    found[:, -1] = 1
    for at in range(0, len(found), GATHERED_AT_ONCE):
        rows = place[before[:, at : at + GATHERED_AT_ONCE]]
        added = turned[0].take(rows[0], axis=0)
        for own, r in zip(turned[1:], rows[1:], strict=True):
            added += own.take(r, axis=0)
        found[at : at + GATHERED_AT_ONCE, :-1] = added
    return found


class Learner:
    """A task's copy of the model, and what it met."""

    def __init__(self, model: Model, noise: float, rate: float, random):
        self.model, self.noise, self.rate, self.random = model, noise, rate, random
        self.weights = {k: getattr(model, k).astype(np.float32) for k in ("context", "token", "turn")}
        self.squares = {k: v.copy() for k, v in model.squares.items()}
        self.met = {k: np.zeros(len(self.weights[k]), np.int64) for k in ("context", "token")}
        self.last = np.zeros(len(model.context), np.int32)
        self.upto = np.cumsum(model.share)
        self.tokens = 0

    def learn(self, own: np.ndarray, sizes: np.ndarray, trains: np.ndarray) -> None:
        """Batches of short runs of neighbours from documents that train, in random order.
        Every document has starts ahead of it, which are contexts and never learned."""
        start, places = len(self.weights["context"]) - 1, len(self.weights["turn"])
        own, sizes = own[np.repeat(trains, sizes)], sizes[trains]
        if not len(own):
            return
        self.tokens += len(own)
        own = np.insert(own, np.repeat(np.cumsum(sizes) - sizes, places), start)
        own = np.concatenate([own, np.full(-len(own) % RUN + places, start, own.dtype)])
        runs = np.lib.stride_tricks.sliding_window_view(own, RUN + places)[::RUN]
        runs, at_once = runs[self.random.permutation(len(runs))], BATCH // RUN
        # The run of the last starts may have nothing to learn, and be a batch by itself.
        if len(runs) % at_once == 1 and (runs[-1, places:] == start).all():
            runs = runs[:-1]
        starts = range(0, len(runs), at_once)
        drawn = np.searchsorted(self.upto, self.random.random((len(starts), NOISE)) * self.upto[-1], "right")
        drawn = drawn.clip(max=len(self.weights["token"]) - 1)
        for name, rows in (("context", runs[:, :-1]), ("token", own[own != start]), ("token", drawn)):
            self.met[name] += np.bincount(rows.ravel(), minlength=len(self.met[name]))
        with np.errstate(over="ignore"):
            for at, others in zip(starts, drawn, strict=True):
                self.step(runs[at : at + at_once], others, start)

    def step(self, runs: np.ndarray, drawn: np.ndarray, start: int) -> None:
        """Tell tokens from `noise` draws each, whose slopes are those of NOISE shared ones."""
        context, token, turn = self.weights["context"], self.weights["token"], self.weights["turn"]
        places, size = turn.shape[:2]
        after = runs[:, places:].ravel()
        learned = np.flatnonzero(after != start)
        own = after.take(learned)
        vectors, words, others = context.take(runs, axis=0), token.take(own, axis=0), token.take(drawn, axis=0)
        # The turns of all places side by side, and which rows and columns belong to a place.
        flat, side = vectors.reshape(-1, size), turn.transpose(1, 0, 2).reshape(size, -1)
        where = [np.s_[:, places - k - 1 : places - k - 1 + RUN, k * size : (k + 1) * size] for k in range(places)]
        turned = (flat @ side).reshape(*runs.shape, -1)
        added = sum(turned[w] for w in where).reshape(-1, size)
        guess = np.ones((len(learned), size + 1), np.float32)
        guess[:, :-1] = added.take(learned, axis=0)
        odds = np.float32(np.log(self.noise))
        real = 1 / (1 + np.exp(np.einsum("ij,ij->i", guess, words) - odds))
        false = guess @ others.T
        np.exp(np.subtract(odds, false, out=false), out=false)
        false += 1
        np.divide(np.float32(-self.noise / NOISE), false, out=false)
        to_guess = np.zeros((len(after), size), np.float32)
        to_guess[learned] = (real[:, None] * words + false @ others)[:, :-1]
        to_runs, slopes = to_guess.reshape(len(runs), RUN, size), np.zeros_like(turned)
        for w in where:
            slopes[w] = to_runs
        slopes = slopes.reshape(len(flat), -1)
        to_turn = (flat.T @ slopes).reshape(size, places, size).transpose(1, 0, 2) / np.float32(len(own))
        to_vectors = (slopes @ side.T).reshape(vectors.shape)
        to_words = np.concatenate([real[:, None] * guess, false.T @ guess])
        self.climb("token", np.concatenate([own, drawn]), to_words)
        self.climb("context", runs[:, :-1].ravel(), to_vectors[:, :-1].reshape(-1, size))
        self.squares["turn"] += to_turn**2
        turn += np.float32(0.1 * self.rate) * to_turn / np.sqrt(self.squares["turn"])

    def climb(self, name: str, rows: np.ndarray, slopes: np.ndarray) -> None:
        """Move each row by its slope over the root of its mean squared slopes so far."""
        width, every = slopes.shape[1], np.arange(len(rows), dtype=np.int32)
        # One of the places of each row stands for it, and the others' slopes are added to its own.
        self.last[rows] = every
        last = self.last.take(rows)
        ones = last == every
        first, more = np.flatnonzero(ones), np.flatnonzero(~ones)
        summed = slopes.take(first, axis=0)
        cells = (np.cumsum(ones) - 1).take(last.take(more))[:, None] * width + np.arange(width)
        np.add.at(summed.reshape(-1), cells.ravel(), slopes.take(more, axis=0).ravel())
        rows, squares, weights = rows.take(first), self.squares[name], self.weights[name]
        own = squares.take(rows) + np.einsum("ij,ij->i", summed, summed) / width
        squares[rows] = own
        summed *= (np.float32(self.rate) / np.sqrt(own))[:, None]
        summed += weights.take(rows, axis=0)
        weights[rows] = summed

    def changes(self):
        """(name, bucket, packed changes) of what was met."""
        if not self.tokens:
            return
        for name, met in self.met.items():
            first, used = getattr(self.model, name), np.flatnonzero(met)
            for bucket in np.unique(used // ROWS_AT_ONCE).tolist():
                begin, end = np.searchsorted(used, [bucket * ROWS_AT_ONCE, (bucket + 1) * ROWS_AT_ONCE])
                rows = used[begin:end]
                change = self.weights[name][rows] - first[rows]
                squares = self.squares[name][rows] - self.model.squares[name][rows]
                yield name, bucket, packed(rows, met[rows], squares, change)
        change = (self.weights["turn"] - self.model.turn).reshape(-1, 1)
        squares = (self.squares["turn"] - self.model.squares["turn"]).ravel()
        rows = np.arange(len(change))
        yield "turn", 0, packed(rows, np.full(len(rows), self.tokens), squares, change)


CHANGES = "name string, bucket long, part long, changes binary"


def packed(rows: np.ndarray, met: np.ndarray, squares: np.ndarray, change: np.ndarray) -> bytes:
    """Rows, how often they were met, and changes, rounded to 127 steps of each row's largest."""
    step = np.abs(change).max(axis=1) / 127
    steps = np.rint(change / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
    kinds = ((rows, "<u4"), (met, "<i8"), (squares, "<f4"), (step, "<f4"))
    return np.int64(len(rows)).tobytes() + b"".join(a.astype(k).tobytes() for a, k in kinds) + steps.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, at, found = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in ("<u4", "<i8", "<f4", "<f4"):
        found.append(np.frombuffer(data, kind, n, at))
        at += found[-1].nbytes
    rows, met, squares, step = found
    return rows, met, squares, np.frombuffer(data, np.int8, offset=at).reshape(n, -1) * step[:, None]


def averaged(table: pa.Table) -> pa.Table:
    """One row of changes from those of several tasks, by how often each met a vector."""
    order = np.argsort(table["part"].to_numpy(), kind="stable")
    parts = [unpacked(data) for data in table["changes"].take(pa.array(order)).to_pylist()]
    places, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total, at = np.zeros(len(places)), 0
    squared, summed = np.zeros(len(places)), np.zeros((len(places), parts[0][3].shape[1]))
    for rows, met, squares, change in parts:
        here = place[at : at + len(rows)]
        summed[here] += met[:, None] * change
        squared[here] += met * squares
        total[here] += met
        at += len(rows)
    data = packed(places, total, squared / total, summed / total[:, None])
    one = table.slice(0, 1)
    return pa.table(
        {"name": one["name"], "bucket": one["bucket"], "part": one["part"], "changes": pa.array([data], pa.binary())}
    )


def train(chunks: DataFrame, model: Model, noise: float, rounds: int, passes: int, seed: int) -> None:
    """Rounds of tasks over the chunks, with the changes of all averaged into the model; each
    of them goes through so large a share of the documents that all make `passes` passes."""
    spark = chunks.sparkSession
    shares = max(1, rounds // passes)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model.sent())
        rate = RATE * (1 - turn / rounds)

        @tidy
        def learn(batches, shared=shared, rate=rate, turn=turn):
            part = TaskContext.get().partitionId()
            learner = None
            for batch in batches:
                for row in batch.to_pylist():
                    learner = learner or Learner(
                        shared.value, noise, rate, np.random.default_rng((seed, turn, part))
                    )
                    own, _, sizes = placed(row, learner.model)
                    trains = ~np.frombuffer(row["held_out"], bool)
                    trains &= np.arange(len(sizes)) % shares == turn % shares
                    learner.learn(own, sizes, trains)
            for name, bucket, data in learner.changes() if learner else ():
                columns = [pa.array([name]), pa.array([bucket]), pa.array([part]), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["name", "bucket", "part", "changes"])

        found = (
            chunks.select("words", "sizes", "tokens", "held_out")
            .mapInArrow(learn, CHANGES)
            .groupBy("name", "bucket")
            .applyInArrow(averaged, CHANGES)
            .select("name", "changes")
            .toArrow()  # bounded by the model
        )
        for batch in found.to_batches():
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, _, squares, change = unpacked(data)
                weights, own = getattr(model, name), model.squares[name]
                weights.reshape(len(own.ravel()), -1)[rows] += change
                own.reshape(-1)[rows] += squares
        shared.destroy()


def placed(row: dict, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's tokens of a chunk, their places in their documents, the documents' sizes."""
    numbers = model.numbers(np.frombuffer(row["words"], np.uint64))
    sizes = np.frombuffer(row["sizes"], np.int64)
    own = numbers[np.frombuffer(row["tokens"], "<u4")]
    return own, np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes), sizes


def log_probabilities(model: Model, own: np.ndarray, before) -> np.ndarray:
    """Log10 of the normalised probability of each token after its context;
    `before` gives the contexts of a slice of the tokens."""
    found = np.empty(len(own))
    parts = -(-len(own) // SCORED_AT_ONCE)
    for at, end in pairwise(len(own) * k // max(parts, 1) for k in range(parts + 1)):
        guess = predictions(model, before(slice(at, end)))
        found[at:end] = model.tree.log_probabilities(guess, own[at:end], model.token)
    return found / np.log(10)


def fit(
    chunks: DataFrame,
    counted: DataFrame,
    size: int,
    places: int,
    noise: float,
    rounds: int,
    passes: int,
    seed: int,
) -> Model:
    """The model of the training documents among the tokenised ones."""
    found = counted.filter("chunk is null").select("tokens", "distinct", "ends", "top", "top_counts").toArrow()
    tokens, distinct, ends = (sum(found[c].to_pylist()) for c in ("tokens", "distinct", "ends"))
    words = np.frombuffer(b"".join(found["top"].to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(found["top_counts"].to_pylist()), "<i8")
    order = np.lexsort((words, -counts))
    words, counts = words[order], counts[order]
    ranks = np.argsort(words).astype(np.int32)
    rare_tokens = tokens - ends - int(counts.sum())
    rare_words = max(0, distinct - len(words) - (ends > 0))
    # With one added to each count, as in `base_score`; the class has what its words have.
    share = np.concatenate([counts, [rare_tokens + rare_words, ends]]) + 1.0
    random = np.random.default_rng(seed)
    model = Model(
        words[ranks],
        ranks,
        counts,
        share / share.sum(),
        random.normal(0, 0.1, (len(words) + 3, size)).astype(np.float32),
        random.normal(0, 0.1, (len(words) + 2, size + 1)).astype(np.float32),
        np.tile(np.eye(size, dtype=np.float32), (places, 1, 1)),
        tokens,
        distinct,
        rare_tokens,
        rare_words,
    )
    model.token[:, -1] = 0
    for name in ("context", "token"):
        model.squares[name] = np.full(len(getattr(model, name)), FIRST_SQUARES, np.float32)
    model.squares["turn"] = np.full(model.turn.shape, 1e-4, np.float32)
    if tokens:
        train(chunks, model, noise, rounds, passes, seed)
    model.squares = {}
    model = model.sent()
    model.tree = Tree(model.share, model.token)
    return model


def score_texts(
    docs: DataFrame,
    held_out=None,
    min_count: int = 10,
    least_share: float = 1e-7,
    size: int = 24,
    places: int = 3,
    noise: float = 20.0,
    rounds: int = 2,
    passes: int = 1,
    seed: int = 6,
) -> DataFrame:
    """One row per document: counts of its tokens, log10 probability under the unigram
    distribution with one added to each count (`base_score`), and under the model (`score`)."""
    held_out = F.lit(False) if held_out is None else held_out
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    chunks = staged(tokenised(rows, kind), "chunks")
    number, trains = chunks.agg(F.count("*"), F.sum("trains")).first()
    # So at most 1 / least_share words are known, which bounds the model.
    min_count = max(min_count, 1, int(np.ceil((trains or 0) * least_share)))
    buckets = 1 << min(4 * max(number, 1), MOST_BUCKETS).bit_length()
    counted = staged(totals(chunks, buckets, min_count), "counts")
    model = fit(chunks, counted, size, places, noise, rounds, passes, seed)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see above
    sizes_of_rare = (model.tokens, model.distinct, model.rare_tokens, model.rare_words)

    @tidy
    def score(batches):
        """Sums over the known tokens of each document, and its rare words."""
        model = shared.value
        known, start = len(model.words), len(model.words) + 2
        # Of the words, the class of rare ones (which meet their counts later) and the end.
        ends = round(model.share[-1] * (model.tokens + model.distinct + 2)) - 1 if model.tokens else 0
        counts = np.concatenate([model.counts, [0, ends]])
        for batch in batches:
            kind_of_ids = batch.schema.field("doc_ids").type
            for row in batch.to_pylist():
                own, position, sizes = placed(row, model)
                every, doc = np.arange(len(own)), np.repeat(np.arange(len(sizes)), sizes)

                def before(part: slice, own=own, position=position, every=every) -> np.ndarray:
                    return contexts(own, position, every[part], start, len(model.turn))

                rare = own == known
                base = np.log10((counts[own] + 1) / (model.tokens + model.distinct + 1))
                sums = lambda values, doc=doc, n=len(sizes): np.bincount(doc, values, n)
                columns = [
                    sums(np.where(rare, 0.0, base)),
                    sums(log_probabilities(model, own, before)),
                    sums(~rare & (counts[own] > 0)).astype("<i8"),
                    sums(rare).astype("<i8"),
                    np.frombuffer(row["tokens"], "<u4")[rare],
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["chunk"]]),
                        pa.array([row["doc_ids"]], kind_of_ids),
                        pa.array([row["held_out"]], pa.binary()),
                        pa.array([row["sizes"]], pa.binary()),
                        *(pa.array([c.tobytes()], pa.binary()) for c in columns),
                    ],
                    ["chunk", "doc_ids", "held_out", "sizes", "base", "score", "known", "rare_sizes", "rare"],
                )

    def complete(scored: pa.Table, replies: pa.Table) -> pa.Table:
        """What the rare words of a chunk's documents add, by their counts."""
        row = scored.to_pylist()[0]
        tokens, distinct, rare_tokens, rare_words = sizes_of_rare
        replies = sorted(zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True))
        counts = np.frombuffer(b"".join(c for _, c in replies), rare_kind(min_count))
        counts = counts[np.frombuffer(row["rare"], "<u4")].astype(np.int64)
        n_rare = np.frombuffer(row["rare_sizes"], "<i8")
        doc = np.repeat(np.arange(len(n_rare)), n_rare)
        base = np.bincount(doc, np.log10((counts + 1) / (tokens + distinct + 1)), len(n_rare))
        inner = np.bincount(doc, np.log10((counts + 1) / (rare_tokens + rare_words + 1)), len(n_rare))
        known = np.bincount(doc, counts > 0, len(n_rare)).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], scored.schema.field("doc_ids").type.value_type),
                "held_out": np.frombuffer(row["held_out"], bool),
                "n_tokens": np.frombuffer(row["sizes"], np.int64),
                "n_known": np.frombuffer(row["known"], "<i8") + known,
                "train_tokens": np.full(len(n_rare), tokens, np.int64),
                "base_score": np.frombuffer(row["base"]) + base,
                "score": np.frombuffer(row["score"]) + inner,
            }
        )

    asked = (
        chunks.select("chunk", "doc_ids", "held_out", "sizes", "tokens", "words")
        .mapInArrow(
            score,
            f"chunk long, doc_ids array<{kind}>, held_out binary, sizes binary, base binary, "
            "score binary, known binary, rare_sizes binary, rare binary",
        )
        .groupBy("chunk")
    )
    given = counted.filter("chunk is not null").select("chunk", "bucket", "counts").groupBy("chunk")
    return asked.cogroup(given).applyInArrow(
        complete,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double",
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder by 7 is not 2, score all."""
    return score_texts(docs, remainder("doc_id", 7) == 2)
