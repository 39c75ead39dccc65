"""URL graph, repeated ids, SQL of the corpus queries, and the pipeline's stages in sequence."""

import collections
import random
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docledger.llm import queries
from docledger.llm.langid import recognised
from docledger.llm.minhash import near_duplicates, without_near_duplicates
from docledger.llm.mixing import mix
from docledger.llm.topk import top_k
from docledger.llm.urls import RULES, judge

SMALL = "/root/testdata/sf0.001"


def ruled(url):
    """(rule, verdict) of the longest rule for a plain http URL."""
    host, _, path = url.split("://", 1)[1].partition("/")
    path = ("/" + path if "/" in url.split("://", 1)[1] else "").split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_urls_against_brute_force(spark):
    """Random canonical links and redirects among pages and URLs that are no pages."""
    draw = random.Random(4)
    hosts = ["a.test", "b.test", "c.example.net", "example.com", "k.org", "spam.net"]
    urls = [f"http://{h}/{folder}/{i}" for h in hosts for folder in ("en", "de", "fr") for i in range(6)]
    pages, links = [], []
    for i, url in enumerate(draw.sample(urls, 70) + ["http://a.test/en/1"] * 3):
        html = None
        if draw.random() < 0.5:
            target = draw.choice(urls)
            html = f'<p>x</p><link rel="{draw.choice(["canonical", "Canonical alternate", "x  canonical"])}" href="{target}">'
            links.append((url, target))
        pages.append((i, url, html))
    redirects = [tuple(draw.sample(urls, 2)) for _ in range(12)]
    up = {u: u for u in urls}

    def top(u):
        while up[u] != u:
            u = up[u]
        return u

    for a, b in links + redirects:
        up[top(a)] = top(b)
    verdicts = collections.defaultdict(set)
    for u in {p[1] for p in pages} | {u for pair in links + redirects for u in pair}:
        if ruled(u):
            verdicts[top(u)].add(ruled(u)[2])
    expected = set()
    for i, url, _ in pages:
        rule, met = ruled(url), verdicts[top(url)]
        verdict = rule[2] if rule else "block" if met == {"block"} else "allow"
        expected.add((i, rule and rule[0] + rule[1], verdict))
    found = judge(
        spark.createDataFrame(pages, "page_id long, url string, html string"),
        redirects=spark.createDataFrame(redirects, "from_url string, to_url string"),
    )
    assert {(r.page_id, r.rule, r.verdict) for r in found.collect()} == expected
    assert len({v for _, rule, v in expected if rule is None}) == 2


@pytest.mark.parametrize(
    ("url", "html", "verdict"),
    [
        ("http://s.test/a", '<link rel="canonical" href="http://b.example.net/q">', "block"),  # no page
        ("http://s.test/a", "<link rel='shortlink canonical' href='//b.spam.net/q'>", "block"),
        ("http://s.test/a", "<!-- <link rel=canonical href=http://b.spam.net/q> -->", "allow"),
        ("http://s.test/a", "<!-- <link rel=canonical href=http://b.spam.net/q>", "allow"),
        ("http://s.test/a", '<link rel=alternate href="http://b.spam.net/q">', "allow"),
        ("http://s.test/a", '<link data-rel=canonical href="http://b.spam.net/q">', "allow"),
        ("http://s.test/a", '<link rel=canonical href="mailto:x@spam.net">', "allow"),
        ("http://s.test/a", '<link rel=canonical href="http&#58;&#x2f;/spam.net/?a=1&amp;b=2">', "block"),
        ("http://s.test/a/b?x=1", '<link rel=canonical href="../z">', "block"),
        ("http://s.test/a/b?x=1", '<link rel=canonical href="./../z">', "block"),
        ("http://s.test/y", '<link rel=canonical href="z">', "block"),
        ("http://s.test/y", '<link rel=canonical href="?q=1">', "block"),
        ("http://s.test/y", '<link rel=canonical href="#z">', "allow"),
        ("https://WWW.s.test/z/?utm_source=m#x", None, "block"),
        ("http://s.test/y", "<meta http-equiv='Refresh' content=\"0; URL='/z'\">", "block"),
        ("http://s.test/y", "<p>" + "x" * 2_000_000 + '<link rel=canonical href="z">', "block"),
    ],
)
def test_links_of_pages(spark, url, html, verdict):
    redirects = [("http://s.test/z", "http://deep.spam.net/1"), ("http://s.test/y?q=1", "http://spam.net/2"), (None, "http://x.net/")]
    found = judge(
        spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"),
        redirects=spark.createDataFrame(redirects, "from_url string, to_url string"),
    )
    assert [r.verdict for r in found.collect()] == [verdict]


def test_top_k_of_repeated_ids(spark):
    """Unusable rows go first; the least vector of an id asks; every row is a candidate."""
    rows = [(50, None), (50, [2.0, 0.0]), (50, [1.0, 0.0]), (50, [float("inf"), 1.0])]
    rows += [(1, [3.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0]), (3, [None, 1.0]), (4, [])]
    for turn in range(3):
        random.Random(turn).shuffle(rows)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        found = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()]
        assert sorted(found) == [(50, 1, 1, 3 * 65536), (50, 2, 1, 65536), (50, 3, 2, 32768)]


def test_near_duplicates_of_one_id(spark):
    """One id with two texts: both classes keep a text, whatever the order of rows."""
    a, b = (" ".join(f"{s}{i}" for i in range(40)) for s in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (3, b), (4, None), (None, a)]
    for turn in range(2):
        random.Random(turn).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        kept = without_near_duplicates(docs).collect()
        assert collections.Counter((r.doc_id, r.text) for r in kept) == {(1, a): 1, (1, b): 1, (4, None): 1, (None, a): 1}
        found = near_duplicates(docs).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, r.class_id, r.kept) for r in found if r.doc_id in (2, 3)} == {(2, 1, False), (3, 1, False)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, SMALL)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(expected)


def test_pipeline(spark):
    """Each stage decides on what the one before kept; the last one encodes what is left."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL).cache()
        steps.append(now)
    known, apart, mixed, encoded = steps
    for step in steps[:3]:
        assert step.columns == docs.columns
    assert collections.Counter(known.select("doc_id").collect()) == collections.Counter(
        recognised(docs).select("doc_id").collect()
    )
    kept = {r.doc_id for r in near_duplicates(known).collect() if r.kept}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(kept)
    size = {r.doc_id: (r.size, r.taken) for r in mix(apart).collect()}
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    for doc_id, (words, taken) in size.items():
        assert (copies[doc_id] > 0) == (taken > 0) and copies[doc_id] * max(words, 1) >= taken
    text = {r.doc_id: r.text or "" for r in apart.collect()}
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(queries.VOCABULARY)))
    rows = encoded.collect()
    assert collections.Counter(r.doc_id for r in rows) == copies
    for row in rows[:200]:
        ids = tokenizer.encode(text[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest()
