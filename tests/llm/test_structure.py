"""Toxicity, whitening and conversation repair against brute force and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import transfer
from docledger.llm.boosting import boost, isotonic
from docledger.llm.conversations import repair_conversations
from docledger.llm.toxicity import FEATURES, Lexicon, features, fit, score, score_held_out
from docledger.llm.whitening import fit as fit_whitening
from docledger.llm.whitening import whiten

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"
VECTORS = "vec_id long, embedding array<double>, label int"
SPACES = " \t\n\x0b\x0c\r"


# --- conversations -----------------------------------------------------------------------

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def every_repair(rows, limit):
    """Cost and audit of every sequence of edits up to a cost, by plain enumeration."""
    found = []

    def go(at, state, cost, audit):
        if cost > limit:
            return
        if at == len(rows) and state in (0, 3):
            found.append((cost, audit))
        for role in "ua":
            if (state, role) in NEXT:
                go(at, NEXT[state, role], cost + 3, audit + "I")
        if at < len(rows):
            role, gone, unended = rows[at]
            go(at + 1, state, cost + 4, audit + "D")
            if not gone:
                if (state, role[:1]) in NEXT:
                    go(at + 1, NEXT[state, role[:1]], cost + 3 * unended, audit + "K")
                for other in "ua":
                    if (state, other) in NEXT:
                        go(at + 1, NEXT[state, other], cost + 3 + 3 * unended, audit + "R")

    go(0, 0, 0, "")
    return found


def cheapest(rows):
    """Uniform-cost search that keeps the least (cost, audit) of each state."""

    def inserted(states):
        states, heap = dict(states), sorted((c, s, q) for q, (c, s) in states.items())
        while heap:
            cost, audit, q = heap.pop(0)
            for role in "ua":
                if (q, role) in NEXT:
                    to, value = NEXT[q, role], (cost + 3, audit + "I")
                    if to not in states or value < states[to]:
                        states[to] = value
                        heap.append((*value, to))
        return states

    states = inserted({0: (0, "")})
    for role, gone, unended in rows:
        new = {}

        def put(state, value):
            new[state] = min(new.get(state, value), value)

        for q, (cost, audit) in states.items():
            put(q, (cost + 4, audit + "D"))
            if not gone:
                if (q, role[:1]) in NEXT:
                    put(NEXT[q, role[:1]], (cost + 3 * unended, audit + "K"))
                for other in "ua":
                    if (q, other) in NEXT:
                        put(NEXT[q, other], (cost + 3 + 3 * unended, audit + "R"))
        states = inserted(new)
    return min(states[q] for q in (0, 3) if q in states)


def expected(rows):
    """The whole contract in plain Python."""
    by_conv = {row[0]: [] for row in rows}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        by_conv[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    results = {}
    for conv, own in by_conv.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, met, kinds = collections.Counter(), set(), []
        for _, role, text in own:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in met else ""
            fault = fault or ("" if bare[-1] in ".!?" else "truncated")
            faults[fault] += 1
            met.add((role, text))
            kinds.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(kinds)
        count = len(audit) - audit.count("D")
        roles = [None] * (count % 2) + ["user", "assistant"] * (count // 2)
        lines, rest = [], iter(own)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(rest)
            if edit != "D":
                asked = roles[len(lines)]
                lines.append(f"{role if edit == 'K' else asked}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        numbers = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost)
        results[conv] = (*numbers, audit, digest)
    return results


def repaired(df, **options):
    rows = repair_conversations(df, **options).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def test_transfer_matrices_equal_enumeration():
    kinds = [("u", False, False), ("a", False, False), ("s", False, False), ("x", False, True)]
    kinds += [("a", True, False), ("u", False, True), ("", False, False)]
    sequences = [s for n in range(4) for s in itertools.product(kinds, repeat=n)]
    symbols = [[transfer.GONE if g else transfer.symbol(r, u) for r, g, u in s] for s in sequences]
    grammar = transfer.Grammar()
    compressed = grammar.compress(symbols)
    assert grammar.rules
    for sequence, left in zip(sequences, compressed, strict=True):
        found = grammar.repair(left)
        assert found == cheapest(sequence)
        assert transfer.ended(grammar.matrix(left)[0]) == found
        if len(sequence) < 3:
            assert found == min(every_repair(sequence, found[0]))


def test_grammar_of_long_and_repeated_sequences():
    rng = random.Random(4)
    turns = [("u", False, False), ("a", False, False)]
    sequences = [turns * 400, turns * 399 + [("a", True, False)] * 500]
    sequences += [[rng.choice(turns + [("s", False, True), ("a", True, False)]) for _ in range(700)] for _ in range(3)]
    grammar = transfer.Grammar(limit=60)
    symbols = [[transfer.GONE if g else transfer.symbol(r, u) for r, g, u in s] for s in sequences]
    for part in (symbols[:2], symbols[2:], symbols):
        for own, left in zip(part, grammar.compress(part), strict=True):
            assert grammar.repair(left) == cheapest(sequences[symbols.index(own)])
            assert len(left) < len(own) / 2
    assert len(grammar.rules) <= 60


def test_conversations_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert repaired(df) == expected(rows)


@pytest.mark.parametrize("bounds", [{}, {"piece_rows": 3, "fan": 2}])
def test_odd_conversations(spark, bounds):
    """Nulls, ties, repeats, odd roles, spaces, long texts, pieces, a crowded conversation."""
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = ["Hi.", "ok", "What?", None, "", "  \n", "yes!", "no.", "a b c. ", "\xa0", "é."]
    rows = [
        (c or None, rng.choice([None, -2, *range(8), 10**12]), rng.choice(roles), rng.choice(texts))
        for c in range(120)
        for _ in range(rng.randint(1, 12))
    ]
    rows += [(500, t // 2, rng.choice(roles[:2]), f"text {rng.randint(0, 90)}.") for t in range(400)]
    rows += [(501, 1, "user", "same.")] * 60 + [(502, None, "assistant", "x " * 50_000)]
    dropped = next(t for t in range(99) if zlib.crc32(f"503:{t}".encode()) % 20 == 0)
    rows += [(503, dropped, "user", "gone.")]
    df = spark.createDataFrame(rows, ROWS)
    df = df.withColumn("copies", F.lit("clash")).withColumn("hash", F.lit(1)).repartition(5)
    found = repaired(df, **bounds)
    assert found == expected(rows)
    assert found[503] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- whitening ---------------------------------------------------------------------------


def compared(vectors, rows, components=8):
    """Whitened rows and figures against numpy's singular vectors, up to the sign of each."""
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    left, values, _ = np.linalg.svd((n * x - sums) / n, full_matrices=False)
    values = values**2 / n
    for k in range(components):
        own = np.array([r.whitened for r in rows if r.component == k + 1])
        wanted = left[:, k] * np.sqrt(n)
        sign = np.sign(own @ wanted)
        assert np.abs(sign * own - wanted).max() < 1e-8
        first = next(r for r in rows if r.component == k + 1)
        assert first.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert [int(r.deviation_exact) for r in rows if r.component == 1] == exact
    assert [r.deviation for r in rows if r.component == 1] == [e if e < 2**63 else None for e in exact]
    assert all(r.n == n and r.identity_error < 1e-9 for r in rows)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").coalesce(2)
    rows = sorted(whiten(df).collect(), key=lambda r: (r.vec_id, r.component))
    vectors = [r.embedding for r in df.orderBy("vec_id").collect()]
    assert len(rows) == 8 * len(vectors)
    compared(vectors, rows)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(0)
    # Three directions in 16 dimensions; variances over 14 orders of magnitude; large numbers.
    flat = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 16))
    steep = rng.normal(size=(400, 8)) * 10.0 ** -np.arange(8) @ np.linalg.qr(rng.normal(size=(8, 8)))[0] * 1e6
    for vectors, rank in ((np.round(flat * 1024 * 64) / 1024, 3), (steep * 1e3, 8)):
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], VECTORS)
        rows = sorted(whiten(df.repartition(3)).collect(), key=lambda r: (r.vec_id, r.component))
        compared(vectors, rows, rank)
    rows = [(1, None), (2, [None] * 16), (3, [float("nan")] * 16), (4, []), (5, [float("inf")] * 16), (6, [1e300] * 16)]
    rows += [(None, [1.0, 2.0]), (7, [3.0, 2.5]), (7, [3.0, 2.5]), (8, [5.0])]
    df = spark.createDataFrame([(*row, 1) for row in rows], VECTORS).withColumn("n", F.lit("clash"))
    found = sorted(map(tuple, whiten(df).select("vec_id", "component", "n").collect()), key=str)
    assert found == [(7, 1, 3), (7, 1, 3), (None, 1, 3)]  # one vector of length 1 has no variance
    assert whiten(df.limit(0)).count() == 0
    assert not fit_whitening(df.where("vec_id = 8"))


# --- toxicity ----------------------------------------------------------------------------


def test_boosted_trees_and_isotonic_steps():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(3000, 5))
    chance = 1 / (1 + np.exp(-3 * (table[:, 0] > 0.3) * (table[:, 1] < 0) * 2 + 3))
    label = (rng.random(3000) < chance).astype(float)
    model = boost(table[:2000], label[:2000], np.ones(2000))
    odds = model.log_odds(table)
    rank = np.argsort(np.argsort(odds[2000:]))
    own = label[2000:] == 1
    auc = (rank[own].sum() - own.sum() * (own.sum() - 1) / 2) / (own.sum() * (~own).sum())
    assert auc > 0.85
    fitted = isotonic(odds, label, np.ones(3000))
    assert (np.diff(fitted.chance) > 0).all() and (np.diff(fitted.at) > 0).all()
    # Least squares under the order, by the max-min formula, on a few points.
    y, w = rng.random(12), rng.integers(1, 4, 12).astype(float)
    step = isotonic(np.arange(12.0), y, w)
    best = [
        max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1))
        for i in range(12)
    ]
    assert sorted(set(np.round(best, 9))) == sorted(set(np.round(step.chance, 9)))


def test_features_see_what_they_are_named_for():
    lexicon = Lexicon({"grob": 4.0}, {"schlim": 3.0})
    plain = features("A calm text, with commas. And an end.", lexicon)
    assert len(plain) == FEATURES == len(features(None, lexicon)) and not any(features("", lexicon))
    near = features("you are an idiot and grob", lexicon)
    far = features("idiot " + "word " * 20 + "you", lexicon)
    assert near[1] > 0 and near[3] > 0 and near[14] > far[14] == 0 and far[15] > 0
    assert features("schlimmer", lexicon)[10] == 3.0
    assert features("1d1ot gr0b", lexicon)[24] > 0 and features("i d i o t", lexicon)[24] > 0
    loud = features("STOP!!! noooo", lexicon)
    assert loud[16] > 0 and loud[17] > 0 and loud[18] > 0 and loud[21] > 0 and loud[22] == 0
    assert features("sn4ke c*ld", lexicon)[22] == 1.0


def test_toxicity_of_the_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = score_held_out(docs, labels).collect()
    assert len(found) == docs.count()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    own = [r for r in found if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert not any(r.predicted for r in own if toxic[r.doc_id] == 0)
    caught = [r.predicted for r in own if toxic[r.doc_id] == 1]
    assert sum(caught) >= 0.65 * len(caught)  # 34 toxic texts to learn from, in four languages
    # Labels of held-out documents, and columns that are no text, change nothing.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    blind = docs.select("doc_id", "text", F.lit("x").alias("lang"), F.lit("y").alias("score"))
    again = {r.doc_id: r.score for r in score_held_out(blind.repartition(3), turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in found)


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(i, f"you are an idiot number {i}" if i % 2 else f"a calm text {i}.") for i in range(80)]
        + [(None, None), (900, ""), (901, "you idiot " * 30_000), (900, "")],
        "doc_id long, text string",
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(80)] + [(3, 0), (None, 1), (5, None), (902, 1), (6, 7)], "doc_id long, toxic int"
    )
    model = fit(docs, labels)
    found = {r.doc_id: r for r in score(docs, model).collect()}
    assert found[901].predicted == 1 and found[900].predicted == 0 and found[None].score == found[900].score
    assert all(found[i].predicted == i % 2 for i in range(80))
    assert score(docs, model).count() == 84 and score(docs.limit(0), model).count() == 0
    none = fit(docs, labels.limit(0))
    assert {r.score for r in score(docs, none).collect()} == {0.0}
    one = fit(docs, labels.where("toxic = 1"))
    assert {r.score for r in score(docs, one).collect()} == {1.0}
    assert score(docs, fit(docs.limit(0), labels)).count() == 84
