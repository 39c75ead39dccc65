"""Copies, the ledger probe and duplicates against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from docledger.functions.keys import with_keys
from docledger.operators import copies, dedup
from docledger.plans.batch import judge_documents, route_documents
from docledger.operators.routing import ledger_events, summarize
from docledger.operators.rules import default_rules
from docledger.sources.ledger import latest_events, lookup, status_counts

RECORD = (
    "struct<invoice_number: string, supplier_name: string, invoice_date: string, due_date: string,"
    " total_amount: double, currency: string, confidence_score: double>"
)
DOCS = f"file_name string, file_path string, file_hash string, record {RECORD}"
FAILURE = "struct<issue_type: string, details: string>"
LEDGER = "file_hash string, supplier_name string, invoice_number string, status string"


def make_batch(seed, n=400):
    """Documents over few names, keys and contents; equal contents give equal records."""
    rng = random.Random(seed)
    records = {}
    docs = []
    for i in range(n):
        content = f"h{rng.randrange(n // 2)}"
        if content not in records:
            records[content] = (
                rng.choice([" INV-1", "inv-1 ", "INV-2", "INV-3", "INV-4", None]),
                rng.choice(["Acme", "ACME ", "Beta", "Gamma"]),
                rng.choice(["2024-01-05", "2024-01-05", "2024-01-05", "bad"]),
                rng.choice(["2024-02-01", None]),
                rng.choice([10.0, 20.0, -1.0]),
                "EUR",
                0.9,
            )
        docs.append((f"n{rng.randrange(n)}", f"p/{i}", content, records[content]))
    ledger = [
        (f"h{i}", rng.choice(["Acme", "beta", "Delta"]), rng.choice(["INV-1", "INV-2", "inv-9"]),
         rng.choice(["OK", "FLAGGED", "EXCEPTION"]))
        for i in rng.sample(range(n), 12)
    ]
    return docs, ledger


def simple_rule(record):
    if record[0] is None:
        return "MISSING_INVOICE_NUMBER"
    if record[2] == "bad":
        return "MISSING_INVOICE_DATE"
    return "INVALID_AMOUNT" if record[4] <= 0 else None


def routed_batch(spark, docs, ledger, force):
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    df = df.withColumn("failure", F.lit(None).cast(FAILURE))
    book = spark.createDataFrame(ledger, LEDGER)
    judged = judge_documents(df, default_rules())
    marked = copies.mark_admitted(judged, book, force)
    return route_documents(marked, dedup.history_index(book), "hash")


def key_of(record):
    return record[1].strip().lower(), record[0].strip().lower()


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_who_owns_a_key(spark, seed, force):
    """Per key, history allows its only hash, two leave none, and without history the first
    passing document's hash is the one allowed."""
    docs, ledger = make_batch(seed)
    found = {
        r.file_path: (r.status, r.exception.issue_type if r.exception else None)
        for r in routed_batch(spark, docs, ledger, force).collect()
    }
    assert len(found) == len(docs)
    seen = {row[0] for row in ledger}
    ordered = sorted(docs, key=lambda d: d[:2])
    first = {}
    for name, path, file_hash, _ in ordered:
        first.setdefault(file_hash, path)
    passing = {}
    for name, path, file_hash, record in ordered:
        issue = simple_rule(record)
        if not force and (file_hash in seen or first[file_hash] != path):
            assert found[path] == ("SKIPPED_CACHED", None)
        elif issue:
            assert found[path] == ("EXCEPTION", issue)
        else:
            passing.setdefault(key_of(record), []).append((path, file_hash, record))
    kept = [(h, (s.strip().lower(), n.strip().lower())) for h, s, n, status in ledger if status != "EXCEPTION"]
    for key, rows in passing.items():
        history = {h for h, other in kept if other == key}
        allowed = history or {rows[0][1]}
        for path, file_hash, record in rows:
            fine = len(allowed) == 1 and file_hash in allowed
            good = ("OK" if record[3] else "FLAGGED", None)
            assert found[path] == (good if fine else ("EXCEPTION", "DUPLICATE_INVOICE"))


def test_summary_adds_up_and_ledger_gets_the_last_of_each_hash(spark):
    docs, ledger = make_batch(9)
    routed = routed_batch(spark, docs, ledger, True).persist()
    total, *parts = summarize(routed).first()
    assert total == len(docs) == sum(parts)
    events = {r.file_hash: r for r in ledger_events(routed).collect()}
    last = {}
    for name, path, file_hash, record in sorted(docs, key=lambda d: (d[0], d[1])):
        last[file_hash] = (name, record)
    assert {h: e.file_name for h, e in events.items()} == {h: n for h, (n, _) in last.items()}
    for file_hash, event in events.items():
        supplier = last[file_hash][1][1]
        accepted = event.status in ("OK", "FLAGGED")
        assert event.supplier_name == (supplier.strip() if accepted else supplier)
    routed.unpersist()


def test_copies(spark):
    rng = random.Random(5)
    docs = [(f"n{rng.randrange(50)}", f"p{i}", f"h{min(rng.randrange(30), 20)}") for i in range(900)]
    df = spark.createDataFrame(docs, "file_name string, file_path string, file_hash string")
    seen, expected = set(), {}
    for name, path, file_hash in sorted(docs):
        expected[path] = file_hash in seen
        seen.add(file_hash)
    marked = copies.mark_copies(df.repartition(7))
    assert {r.file_path: r.is_copy for r in marked.collect()} == expected
    firsts = {r.file_path for r in copies.first_documents(df).collect()}
    assert firsts == {path for path, copy in expected.items() if not copy}


def test_probe_counts_identical_new_files_separately(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",)], "file_hash string")
    seen = spark.createDataFrame([("c",), ("c",), ("z",)], "file_hash string")
    assert tuple(copies.probe_counts(docs, seen).first()) == (5, 3, 2, 3)
    nothing = docs.where("false")
    assert tuple(copies.probe_counts(nothing, seen).first()) == (0, 0, 0, 0)


HISTORY = [
    ("h1", "Acme", "INV-1", "OK"),
    ("h2", " acme ", "inv-1", "FLAGGED"),
    ("h3", "Beta", "INV-1", "OK"),
    ("h4", "Beta", "INV-2", "EXCEPTION"),
    ("h5", None, "INV-3", "OK"),
    ("h6", "Beta", " \t", "OK"),
]


def test_history_index(spark):
    book = spark.createDataFrame(HISTORY, LEDGER)
    found = {tuple(r) for r in dedup.history_index(book).collect()}
    assert found == {("acme", "inv-1", 2, "h1", "h2"), ("beta", "inv-1", 1, "h3", "h3")}


def test_history_and_key_only_probes(spark):
    book = spark.createDataFrame(HISTORY, LEDGER)
    rows = [
        (1, "h1", "ACME", "INV-1"),
        (2, "h3", "beta", "inv-1"),
        (3, "hx", "Beta", "INV-1"),
        (4, "hx", "Beta", "INV-2"),
    ]
    keyed = with_keys(
        spark.createDataFrame(rows, "i int, file_hash string, supplier_name string, invoice_number string")
    )
    assert {r.i for r in dedup.duplicates_of_history(keyed, dedup.history_index(book)).collect()} == {1, 3}
    known = dedup.accepted_history(book)
    assert {r.i for r in dedup.duplicates_by_key(keyed, known).collect()} == {1, 2, 3}


def test_dedup_modes(spark):
    rows = [
        ("a", "p1", "h1", "acme", "1", None),
        ("b", "p2", "h2", "acme", "1", None),
        ("c", "p3", "h3", "beta", "1", "X"),
        ("d", "p4", "h4", "beta", "1", None),
    ]
    judged = spark.createDataFrame(
        rows,
        "file_name string, file_path string, file_hash string, supplier_key string,"
        " number_key string, issue string",
    )
    known = spark.createDataFrame([("beta", "1")], "supplier_key string, number_key string")

    def marked(history, mode):
        found = dedup.mark_duplicates(judged, history, mode).collect()
        return {r.file_path for r in found if r.is_duplicate}, len(found)

    assert marked(None, "hash") == ({"p2"}, 4)
    assert marked(None, "off") == (set(), 4)
    assert marked(known, "key") == ({"p4"}, 4)
    assert marked(None, "key") == (set(), 4)
    with pytest.raises(ValueError):
        dedup.mark_duplicates(judged, None, "other")


def test_latest_event_keeps_all_columns_of_one_event(spark):
    rows = [("h", "2024-01-01", "r1", "OK", "x"), ("h", "2024-01-02", "r2", "EXCEPTION", None)]
    rows += [("g", "2024-01-02", "r1", "OK", "y"), ("g", "2024-01-02", "r2", "FLAGGED", "z")]
    events = spark.createDataFrame(
        rows, "file_hash string, processed_at string, run_id string, status string, note string"
    )
    found = {(r.file_hash, r.status, r.note) for r in latest_events(events).collect()}
    assert found == {("h", "EXCEPTION", None), ("g", "FLAGGED", "z")}


def test_status_counts_and_lookup(spark):
    book = spark.createDataFrame(HISTORY, LEDGER)
    counts = {r.status: r.documents for r in status_counts(book).collect()}
    assert counts == {"OK": 4, "FLAGGED": 1, "EXCEPTION": 1, "TOTAL": 6}
    empty = {r.status: r.documents for r in status_counts(book.where("false")).collect()}
    assert empty == {"TOTAL": 0}
    wanted = spark.createDataFrame([("h1",), ("h1",), ("zz",)], "file_hash string")
    found = {r.file_hash: r.status for r in lookup(wanted, book).collect()}
    assert found == {"h1": "OK", "zz": None}
