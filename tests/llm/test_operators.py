"""Corpus operators against brute force, on the given tables and on odd rows."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docledger.llm import lm
from docledger.llm.bpe import Codec, encode_texts
from docledger.llm.components import components
from docledger.llm.embeddings import near_vectors
from docledger.llm.langid import fit, identify, identify_held_out, recognised
from docledger.llm.lm import Model, Tree, log_probabilities, score_held_out, score_texts
from docledger.llm.minhash import near_duplicates, without_near_duplicates
from docledger.llm.mixing import mix, mixed_documents
from docledger.llm.pretokens import Vocabulary
from docledger.llm.sharding import jump, shard_documents
from docledger.llm.token_counts import count_tokens
from docledger.llm.topk import top_k
from docledger.llm.urls import judge

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, score double, n_tokens int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "some words that go on and on " * 3000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, special strings, clashing columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog tonight", "en", "a", 0.0, 1),
        (1, "The quick brown fox jumps over the lazy dog tonight", "en", "a", 0.0, 1),
        (2, "the quick  brown fox jumps over\nthe lazy DOG tonight", "en", None, None, None),
        (3, None, None, None, None, None),
        (4, "", "en", "b", None, None),
        (5, "  \n\t ", None, "b", None, None),
        (6, LONG, "en", "b", None, None),
        (None, "Der schnelle Hund läuft über die Straße 12 <|endoftext|> 's", "de", "c", None, None),
        (8, "12345 !!!   ''s '' don't", "de", "c", None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def held(doc_id, by, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % by == rest


def test_empty_tables(spark, docs, vectors):
    none, no_vectors = docs.limit(0), vectors.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for result in (
        identify_held_out(none),
        near_duplicates(none),
        mix(none),
        judge(pages),
        count_tokens(none, VOCABULARY),
        score_texts(none),
        encode_texts(none, VOCABULARY),
        top_k(no_vectors, F.col("vec_id") % 50 == 0),
        near_vectors(no_vectors),
        shard_documents(none),
    ):
        assert result.collect() == []


def test_language(docs, odd):
    rows = identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(own) / len(own) > 0.95
    found = {r.doc_id: r for r in identify_held_out(odd).collect()}
    assert found[3].lang_pred == found[4].lang_pred == found[5].lang_pred == "und"
    assert found[3].rejected and found[6].lang_pred != "und"
    assert recognised(odd).columns == odd.columns


def test_language_rejects_other_matter(spark, docs):
    """Matter of no learned language goes at any length, also if labelled rows have no letter."""
    random = np.random.default_rng(7)
    latin = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    scripts = [latin, np.array([chr(c) for c in range(0x4E00, 0x9FA5)]), np.array([chr(c) for c in range(0xE01, 0xE2F)])]
    other = ["".join(random.choice(s, n)) for s in scripts for n in (150, 1500, 15_000, 60_000)]
    bare = [(i, t, lang) for i, (t, lang) in enumerate([("", "en"), ("12345", "en"), ("!", "de"), (" ", "fr"), ("0", "es")])]
    taught = docs.select("doc_id", "text", "lang")
    taught = taught.unionByName(spark.createDataFrame(bare, taught.schema))
    df = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    model = fit(taught)
    assert all(r.rejected for r in identify(df, model).collect())
    assert not any(r.rejected for r in identify(docs, model).collect())


def shingles(text):
    words = [w.lower() for w in WORD.findall(text or "")]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(docs, odd):
    classes = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sets = {i: shingles(t) for i, t in texts_of(docs)}
    for a, own in sets.items():
        for b, other in sets.items():
            if a < b and own and other:
                similarity = len(own & other) / len(own | other)
                if similarity >= 0.9:
                    assert classes[a] == classes[b], (a, b, similarity)
    members = collections.defaultdict(set)
    for i, c in classes.items():
        members[c].add(i)
    for group in members.values():
        for a in group:
            best = max((len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in group if b != a), default=1)
            assert best > 0.75
    rows = near_duplicates(odd).collect()
    assert len(rows) == 9
    assert [r.class_id for r in rows if r.doc_id in (1, 2)] == [1, 1, 1]
    assert all(r.kept == (r.doc_id != 2) for r in rows)
    left = without_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6", "8", "None"]


def expected_targets(sizes, weights=(3, 1, 2)):
    """Hand out 150 %, cap at twice the size, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        left = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / left for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_mix(name, request):
    df = request.getfixturevalue(name)
    rows = mix(df).collect()
    sizes = collections.Counter()
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = expected_targets(sizes)
    taken = collections.Counter()
    assert len(rows) == df.count()
    for r in rows:
        assert math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and sum(r.taken_by_shard) == r.taken
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 16 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mix(df).collect()))
    copies = collections.Counter(r.doc_id for r in mixed_documents(df).collect())
    wanted = collections.Counter()
    for r in rows:
        wanted[r.doc_id] += math.ceil(r.taken / r.size) if r.size else 0
    assert set(copies) == {i for i, n in wanted.items() if n}


def test_apportionment_is_sainte_lague(spark):
    rows = [(i, "w " * n, s, s) for i, (s, n) in enumerate([("a", 530), ("b", 240), ("c", 230)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    votes = expected_targets({"a": 530, "b": 240, "c": 230})
    seats = collections.Counter()
    for _ in range(round(sum(votes.values()) / 50)):
        seats[max(sorted(votes), key=lambda s: votes[s] / (2 * seats[s] + 1))] += 1
    for r in mix(df, block_words=50).collect():
        assert r.taken == min(50 * seats[r.source], 2 * r.size)


def test_urls(spark):
    rows = [
        (1, "https://x.example.net/en/1", None),
        (2, "https://x.example.net/de/1", ""),
        (3, "HTTP://EXAMPLE.com/de/x?q=://a", None),
        (4, "http://shop.test/a", '<link rel="canonical" href="http://www.spam.net/b?utm_source=z">'),
        (5, "http://shop.test/c", "<META http-equiv=refresh content='0; url=/a'>"),
        (6, "http://free.test/", '<link href="http://q.example.net/en/5" rel=canonical>'),
        (7, "https://m.shop.test/a/?utm_medium=x#top", None),
        (8, None, None),
        (9, "no scheme", None),
        (10, "http://example.net", None),
        (11, "http://notexample.com/de/", None),
        (12, "http://www.spam.net/b", None),
        (12, "http://www.spam.net/b", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages).collect()}
    assert found[1] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert found[2][2:] == ("net/", "block")
    assert found[3] == ("example.com", "/de/x", "example.com/de/", "block")
    assert [found[i][3] for i in (4, 5, 7)] == ["block"] * 3  # aliases of a blocked page
    assert found[6][2:] == (None, "allow")
    assert found[8] == ("", "", None, "allow") and found[9] == ("", "", None, "allow")
    assert found[10] == ("example.net", "", None, "allow")
    assert found[11][2] is None and found[12][3] == "block"


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_tokens(name, request):
    df = request.getfixturevalue(name)
    library = Tokenizer.from_file(VOCABULARY)
    expected = collections.Counter()
    for doc_id, text in texts_of(df):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        hashes = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), decoded.encode())]
        expected[doc_id, len((text or "").encode()), len(ids), *hashes] += 1
    encoded = encode_texts(df, VOCABULARY).collect()
    counted = count_tokens(df, VOCABULARY).collect()
    key = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert collections.Counter(map(key, encoded)) == sum((collections.Counter({(k[0], *k[2:]): n}) for k, n in expected.items()), collections.Counter())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in counted) == sum((collections.Counter({k[:3]: n}) for k, n in expected.items()), collections.Counter())
    assert all(r.over_limit == (r.n_tokens > 2048) for r in counted)
    assert all(len(r.ids) == r.n_tokens for r in encoded)


def test_tokens_of_long_runs(spark):
    """One unbroken run each; the library decides, and memory grows with the letters only."""
    letters = "".join(np.random.default_rng(4).choice(list("etaoinshr"), 200_000))
    runs = [letters, "a" * 200_000, "=" * 200_000, "-=" * 100_000, "語" * 70_000, "x" * 256, "x" * 257]
    codec = Codec(Vocabulary.read(VOCABULARY))
    tracemalloc.start()
    codec.look_up([letters, "=" * 200_000])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert not codec.recent and not codec.encoded
    df = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(runs)], "doc_id long, text string")
    found = {r.doc_id: r.ids for r in encode_texts(df, VOCABULARY).collect()}
    library = Tokenizer.from_file(VOCABULARY)
    for i, text in enumerate(runs):
        assert found[i] == library.encode(f"before {text} after", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_language_model(name, request):
    df = request.getfixturevalue(name)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(i, [*WORD.findall((t or "").translate(lower)), None]) for i, t in texts_of(df)]
    counts = collections.Counter(w for i, ws in tokens if not held(i, 7, 2) for w in ws)
    total = sum(counts.values())
    expected = collections.Counter()
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)
        expected[i, held(i, 7, 2), len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4)] += 1
    rows = score_held_out(df).collect()
    assert expected == collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows
    )
    assert all(r.score < 0 for r in rows)
    if name == "docs":
        new = [r for r in rows if r.held_out]
        assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_language_model_learns_rare_words(spark):
    """Words far from the most frequent ones tell which words are near them."""
    random = np.random.default_rng(5)
    rows = [" ".join(f"f{i}" for i in random.integers(0, 600, 100)) for _ in range(500)]
    topics = [[f"t{k}-{i}" for i in range(100)] for k in range(4)]
    rows += [" ".join(random.permutation(topic)) for topic in topics for _ in range(40)]
    own = [" ".join(random.permutation(topic)) for topic in topics]
    mixed = [" ".join(random.permutation(sum(topics, []))[:100]) for _ in topics]
    table = [(i, t, i >= len(rows)) for i, t in enumerate(rows + own + mixed)]
    df = spark.createDataFrame(table, "doc_id long, text string, new boolean")
    found = {r.doc_id: r.score for r in score_texts(df, F.col("new")).collect()}
    new = [found[len(rows) + i] for i in range(8)]
    assert min(new[:4]) > max(new[4:]) + 10


def test_normaliser_of_language_model():
    """The probabilities of all tokens after a context add up to 1 at every size; where the
    tree is its root alone they are the softmax of the energies."""
    random = np.random.default_rng(6)
    for known in (1, 100, 200, 3000, 70_000):
        share = 1 / np.arange(1, known + 3)
        model = Model(
            np.sort(random.integers(1, 1 << 60, known).astype(np.uint64)),
            np.arange(known, dtype=np.int32),
            np.ones(known, np.int64),
            share / share.sum(),
            random.normal(0, 0.3, (known + 3, 8)).astype("f4"),
            random.normal(0, 0.3, (known + 2, 9)).astype("f4"),
            np.tile(np.eye(8, dtype="f4"), (2, 1, 1)),
            0, 0, 0, 0,
        )
        model.tree = Tree(model.share, model.token)
        every = np.arange(known + 2)
        for context in (known + 2, min(5, known)):
            logs = log_probabilities(model, every, lambda part: np.full((2, len(every[part])), context))
            assert abs((10**logs).sum() - 1) < 1e-4
            if known <= 100:
                guess = np.append(2 * model.context[context], 1)
                energies = np.log(model.share) + model.token @ guess
                assert np.allclose(logs * math.log(10), energies - np.log(np.exp(energies).sum()), atol=1e-4)


def language_model(known, size=8, places=2):
    random = np.random.default_rng(6)
    share = 1 / np.arange(1, known + 3)
    model = Model(
        np.sort(random.integers(1, 1 << 60, known).astype(np.uint64)),
        np.arange(known, dtype=np.int32),
        np.ones(known, np.int64),
        share / share.sum(),
        random.normal(0, 0.3, (known + 3, size)).astype("f4"),
        random.normal(0, 0.3, (known + 2, size + 1)).astype("f4"),
        random.normal(0, 0.3, (places, size, size)).astype("f4"),
        0, 0, 0, 0,
    )
    model.tree = Tree(model.share, model.token)
    return model, random


def test_language_model_scores_leaves_together(monkeypatch):
    """Every token has the product of its branches' softmaxes, one by one; many leaves, which
    few tokens meet each, are not handled one by one."""
    model, random = language_model(70_000)
    tree, own = model.tree, random.integers(0, 70_002, 20_000).astype(np.int32)
    own[:300] = np.arange(300)
    before = random.integers(0, 70_003, (2, len(own)))
    calls = []
    monkeypatch.setattr(lm, "picked", lambda e, chosen, picked=lm.picked: calls.append(1) or picked(e, chosen))
    logs = log_probabilities(model, own, lambda part: before[:, part])
    assert len(np.unique(tree.leaf[own])) > 1000 > 10 * len(calls)
    softmax = lambda e, at: e[at] - np.log(np.exp(e).sum())
    energy = lambda words, guess: np.log(model.share[words]) + model.token[words] @ guess
    for i in [*range(0, 300, 7), *range(300, len(own), 499)]:
        guess = np.append(sum(model.context[before[k, i]] @ model.turn[k] for k in range(2)), 1).astype("f8")
        wide = np.append(guess, guess**2)
        leaf, place, depth = int(tree.leaf[own[i]]), tree.place[own[i]], tree.upto[-1]
        root = np.append(energy(tree.top, guess), tree.groups[0] @ wide)
        node = leaf >> (depth - tree.upto[0])
        expected = softmax(root, place if leaf < 0 else len(tree.top) + node)
        if leaf >= 0:
            for k in range(1, len(tree.upto)):
                child, bits = leaf >> (depth - tree.upto[k]), tree.upto[k] - tree.upto[k - 1]
                branches = tree.groups[k][child >> bits << bits :][: 1 << bits]
                expected += softmax(branches @ wide, child & ((1 << bits) - 1))
            members = tree.rest[tree.bounds[leaf] : tree.bounds[leaf + 1]]
            assert members[place] == own[i]
            expected += softmax(energy(members, guess), place)
        assert abs(logs[i] * math.log(10) - expected) < 1e-3


def test_language_model_learns_a_batch_as_by_single_tokens():
    """One batch against sums over its tokens; noise is drawn once for a call, not a batch."""
    model, random = language_model(300)
    for name in ("context", "token"):
        model.squares[name] = np.full(len(getattr(model, name)), 2.0, np.float32)
    model.squares["turn"] = np.full(model.turn.shape, 1e-4, np.float32)
    draws = []

    class Random:
        def permutation(self, n):
            return np.arange(n)

        def random(self, shape):
            draws.append(np.random.default_rng(1).random(shape))
            return draws[-1]

    sizes = np.array([40, 1, 200, 90])
    learner = lm.Learner(model, 20.0, 0.3, Random())
    own = random.integers(0, 302, sizes.sum()).astype(np.int32)
    learner.learn(own, sizes, np.array([True, True, False, True]))
    trained = np.split(own, np.cumsum(sizes)[:-1])
    texts = [[302, 302, *trained[k].tolist()] for k in (0, 1, 3)]
    upto = np.cumsum(model.share)
    drawn = np.searchsorted(upto, draws[0].ravel() * upto[-1], "right")
    slopes = {k: np.zeros(getattr(model, k).shape) for k in ("context", "token", "turn")}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for text in texts:
        for i in range(2, len(text)):
            before = [text[i - 1 - k] for k in range(2)]
            guess = np.append(sum(model.context[b] @ model.turn[k] for k, b in enumerate(before)), 1)
            cases = [(text[i], 1 - sigmoid(guess @ model.token[text[i]] - math.log(20)))]
            cases += [(w, -20 / lm.NOISE * sigmoid(guess @ model.token[w] - math.log(20))) for w in drawn]
            to_guess = sum(x * model.token[w] for w, x in cases)[:-1]
            for w, x in cases:
                slopes["token"][w] += x * guess
            for k, b in enumerate(before):
                slopes["context"][b] += model.turn[k] @ to_guess
                slopes["turn"][k] += np.outer(model.context[b], to_guess) / 131
    for name in ("context", "token"):
        squares = 2 + (slopes[name] ** 2).mean(axis=1, keepdims=True)
        moved = learner.weights[name] - getattr(model, name)
        # The starts are contexts, never learned.
        assert np.allclose(moved[:302], (0.3 * slopes[name] / np.sqrt(squares))[:302], atol=1e-4)
    moved = 0.03 * slopes["turn"] / np.sqrt(1e-4 + slopes["turn"] ** 2)
    assert np.allclose(learner.weights["turn"] - model.turn, moved, atol=1e-4)
    met = np.bincount([*drawn, *(w for text in texts for w in text[2:])], minlength=302)
    assert (learner.met["token"] == met).all() and learner.tokens == 131
    big = np.tile(np.arange(300, dtype=np.int32), 10)
    learner.learn(big, np.array([len(big)]), np.array([True]))
    assert [d.shape for d in draws] == [(1, lm.NOISE), (6, lm.NOISE)]


def with_odd_vectors(spark, vectors):
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = [(9001, None, 1), (9050, [0.0] * 64, 1), (9100, [float("nan")] * 64, 1), (9002, [1.0, None], 1)]
    extra = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")
    copy = vectors.limit(1).withColumn("vec_id", F.lit(9003).cast("long"))
    unlabelled = vectors.limit(1).withColumn("vec_id", F.lit(9004).cast("long")).withColumn("label", F.lit(None).cast("int"))
    return vectors.unionByName(extra).unionByName(copy).unionByName(unlabelled)


def test_top_k(spark, vectors):
    df = with_odd_vectors(spark, vectors)
    rows = {
        r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(int)
        for r in df.collect()
        if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all()
    }
    expected = set()
    for q in (i for i in rows if i % 50 == 0):
        scores = sorted((-int(rows[q] @ v), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:5], 1)}
    found = top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found} == expected
    assert len(found) == len(expected)


def test_near_vectors(spark, vectors):
    df = with_odd_vectors(spark, vectors)
    rows = df.collect()
    unit = {}
    for r in rows:
        v = np.array(r.embedding or [0], float)
        if r.label is not None and np.isfinite(v).all() and v.any():
            unit[r.vec_id] = (r.label, v / np.linalg.norm(v))
    near = {i: set() for i in (r.vec_id for r in rows)}
    for i, (label, v) in unit.items():
        near[i] = {j for j, (other, w) in unit.items() if j != i and other == label and v @ w >= 0.98}
    found = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(found) == len(rows)
    for i, links in near.items():
        reach, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (len(links), min(reach), i == min(reach))


def test_shards(odd, docs):
    for df in (odd, docs):
        rows = shard_documents(df).collect()
        assert len(rows) == df.count()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
            assert r.grown_shard in (r.shard, 8) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in shard_documents(odd).collect())
    assert sizes == collections.Counter(
        (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in texts_of(odd)
    )
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    spread = np.bincount(jump(keys, 8))
    assert spread.min() > 2200 and (jump(keys, 1) == 0).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
