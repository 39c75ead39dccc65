"""Whole runs over a folder: first run, repeat, forced, retried, cleared, streamed."""

import csv
import json
import random
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import docledger
from docledger.operators.extract import custom_extractor, response_extractor
from docledger.plans import batch
from docledger.sinks import exports
from docledger.sources.files import scan_files, table_documents
from docledger.streaming.incremental import run_arrivals

DOCUMENTS = {
    "memo_11.pdf": ("Norrland Timber", "NT/77-A", "2022-07-19", "2022-08-02", "2,318.40", "EUR"),
    "memo_12.pdf": ("Blue Kettle", "BK 4410", "23.11.2021", None, "96.50", "USD"),
    "memo_13.pdf": ("Ferry Cargo", "FC.0912", "2023-01-30", "2023-03-01", "-12.30", "EUR"),
    "memo_14.pdf": ("NORRLAND Timber ", "nt/77-a", "2022-07-19", "2022-08-02", "2,318.40", "EUR"),
    "memo_15.PDF": ('Halden, "North"', "H31", "2020-02-29", "2020-06-15", "7,005.00", "£"),
    "memo_16.pdf": ("Quarry Lane", None, "2022-12-24", "2023-01-07", "640.00", "USD"),
    "memo_17.pdf": ("Osaka Pens", "OP-55", "2021-05-08", "2021-05-09", "88000.00", "JPY"),
}
ISSUES = {
    "memo_13.pdf": "INVALID_AMOUNT",
    "memo_14.pdf": "DUPLICATE_INVOICE",
    "memo_16.pdf": "MISSING_INVOICE_NUMBER",
    "memo_17.pdf": "UNKNOWN_CURRENCY",
}


def page(supplier, number, day, due, total, currency):
    lines = [supplier, "INVOICE"]
    lines += [f"Invoice Number: {number}"] if number else ["Reference: pending"]
    lines += [f"Invoice Date: {day}"] + ([f"Due Date: {due}"] if due else [])
    return "\n".join([*lines, f"Currency: {currency}", f"Total Amount: {total} {currency}"])


@pytest.fixture
def inbox(tmp_path):
    root = tmp_path / "inbox"
    (root / "nested").mkdir(parents=True)
    for i, (name, fields) in enumerate(DOCUMENTS.items()):
        (root / ("nested" if i % 2 else ".") / name).write_text(page(*fields))
    (root / "notes.txt").write_text("not an invoice")
    return root


def decode_text(content):
    return content.decode("utf-8").split("\f")


@pytest.fixture
def run(spark, inbox, tmp_path):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))

    def start(**options):
        docs = scan_files(spark, str(inbox))
        plain = lambda content: content.decode("utf-8").split("\f")
        options = {"decoders": [plain], **options}
        return docledger.run_batch(docs, ledger, str(tmp_path / "out"), **options)

    start.ledger = ledger
    return start


def counts(run):
    names = ("total_scanned", "processed_ok", "flagged_review", "exceptions_count", "skipped_cached")
    return tuple(run.summary[name] for name in names)


def read_csv(path):
    rows, headers = [], set()
    for part in sorted(Path(path).glob("*.csv")):
        with open(part, newline="", encoding="utf-8") as handle:
            reader = csv.DictReader(handle)
            rows += list(reader)
            headers.add(tuple(reader.fieldnames))
    assert len(headers) == 1
    return list(headers.pop()), rows


def read_json(path):
    parts = sorted(Path(path).glob("*.json"))
    return [json.loads(line) for part in parts for line in part.read_text().splitlines()]


def test_first_run_outputs(run):
    progress = []
    first = run(ordered=True, on_progress=lambda stage, metrics: progress.append((stage, metrics)))
    assert counts(first) == (7, 2, 1, 4, 0)
    issues = {r.file_name: r.exception.issue_type for r in first.results.collect() if r.exception}
    assert issues == ISSUES

    header, invoices = read_csv(first.output_files["invoices_csv"])
    assert header == [
        "file_name",
        "file_hash",
        "invoice_number",
        "supplier_name",
        "invoice_date",
        "due_date",
        "total_amount",
        "currency",
        "status",
    ]
    assert [r["file_name"] for r in invoices] == ["memo_11.pdf", "memo_12.pdf", "memo_15.PDF"]
    assert [r["status"] for r in invoices] == ["OK", "FLAGGED", "OK"]
    assert [r["total_amount"] for r in invoices] == ["2318.40", "96.50", "7005.00"]
    assert [r["due_date"] for r in invoices] == ["2022-08-02", "", "2020-06-15"]
    assert invoices[1]["invoice_date"] == "2021-11-23"
    assert invoices[2]["supplier_name"] == 'Halden, "North"' and invoices[2]["currency"] == "GBP"

    header, exceptions = read_csv(first.output_files["exceptions_csv"])
    assert header == ["file_name", "file_hash", "issue_type", "details"]
    assert {r["file_name"]: r["issue_type"] for r in exceptions} == ISSUES

    as_json = read_json(first.output_files["invoices_json"])
    assert as_json[1]["due_date"] is None and as_json[0]["total_amount"] == 2318.4
    assert {r["issue_type"] for r in read_json(first.output_files["exceptions_json"])} == set(ISSUES.values())
    summary = read_json(first.output_files["run_summary_json"])
    assert len(summary) == 1 and summary[0]["exceptions_count"] == 4
    assert summary[0]["output_files"]["invoices_csv"] == first.output_files["invoices_csv"]
    assert datetime.fromisoformat(summary[0]["started_at"])
    assert [stage for stage, _ in progress] == ["hashed", "admitted", "extracted", "routed"]
    assert progress[1][1] == {"documents": 7, "admitted": 7}
    assert progress[3][1]["exceptions"] == 4


def test_repeat_forced_and_changed_runs(run, inbox):
    assert counts(run()) == (7, 2, 1, 4, 0)
    again = run()
    assert counts(again) == (7, 0, 0, 0, 7)
    header, rows = read_csv(again.output_files["invoices_csv"])
    assert rows == [] and len(header) == 9  # an empty output still has its header
    assert counts(run(force=True)) == (7, 2, 1, 4, 0)
    assert counts(run(force=True, dedup="off")) == (7, 3, 1, 3, 0)

    (inbox / "copy_of_001.pdf").write_bytes((inbox / "memo_11.pdf").read_bytes())
    (inbox / "new_a.pdf").write_text(page("Nova", "N-1", "2024-01-01", "2024-02-01", "5.00", "EUR"))
    (inbox / "new_b.pdf").write_text(page("Nova", "N-1", "2024-01-01", "2024-02-01", "5.00", "EUR"))
    mixed = run()
    assert counts(mixed) == (10, 1, 0, 0, 9)
    status = {r.file_name: r.status for r in mixed.results.collect()}
    assert status["new_a.pdf"] == "OK" and status["new_b.pdf"] == "SKIPPED_CACHED"


def test_ledger_after_a_run(run):
    first = run(run_id="one")
    stats = {r.status: r.documents for r in run.ledger.stats().collect()}
    assert stats == {"OK": 2, "FLAGGED": 1, "EXCEPTION": 4, "TOTAL": 7}
    rejected = first.results.where("file_name = 'memo_14.pdf'").first()
    record = run.ledger.get(rejected.file_hash).first()
    assert record.issue_type == "DUPLICATE_INVOICE" and record.supplier_name == "NORRLAND Timber"
    assert record.processed_at.replace(tzinfo=timezone.utc) == first.summary["started_at"]
    assert run.ledger.get("no such hash").count() == 0
    assert {tuple(r)[:3] for r in run.ledger.history().collect()} == {
        ("norrland timber", "nt/77-a", 1),
        ("blue kettle", "bk 4410", 1),
        ('halden, "north"', "h31", 1),
    }
    run.ledger.clear()
    assert {r.status: r.documents for r in run.ledger.stats().collect()} == {"TOTAL": 0}
    assert counts(run()) == (7, 2, 1, 4, 0)


def test_same_run_id_replaces_itself(run):
    first = run(run_id="one")
    repeated = run(run_id="one")
    assert counts(repeated) == counts(first) == (7, 2, 1, 4, 0)
    assert run.ledger.current().count() == 7
    assert run.ledger.events().count() == 7


def test_dry_run_changes_nothing(spark, run, inbox):
    docs = scan_files(spark, str(inbox))
    assert tuple(docledger.dry_run(docs, run.ledger).first()) == (7, 7, 0, 7)
    assert run.ledger.events().count() == 0
    run()
    (inbox / "late.pdf").write_text("x")
    docs = scan_files(spark, str(inbox))
    assert tuple(docledger.dry_run(docs, run.ledger).first()) == (8, 1, 7, 1)


def test_unreadable_and_failed_documents_are_recorded(run, inbox):
    (inbox / "bad.pdf").write_bytes(b"\xff\xfe")
    (inbox / "blank.pdf").write_text(" \f\n")
    (inbox / "crash.pdf").write_text("crash")

    def factory():
        def extract(text, name):
            if text == "crash":
                raise RuntimeError("line down")
            return {"invoice_number": name, "supplier_name": "S", "invoice_date": "2024-01-01",
                    "due_date": "2024-01-02", "total_amount": 1.0, "currency": "EUR",
                    "confidence_score": 0.8}

        return extract

    options = {"extractor": custom_extractor(factory)}
    first = run(**options)
    assert counts(first) == (10, 7, 0, 3, 0)
    issues = {r.file_name: r.exception.issue_type for r in first.results.collect() if r.exception}
    assert issues == {
        "bad.pdf": "UNREADABLE_PDF",
        "blank.pdf": "UNREADABLE_PDF",
        "crash.pdf": "EXTRACTION_FAILED",
    }
    assert counts(run(**options)) == (10, 0, 0, 0, 10)  # failures are not tried again
    retried = run(retry_issue_types=["EXTRACTION_FAILED"], **options)
    assert counts(retried) == (10, 0, 0, 1, 9)
    assert counts(run(force=True, confidence_floor=0.81, **options)) == (10, 0, 0, 10, 0)


def test_empty_folder(spark, run, tmp_path):
    (tmp_path / "none").mkdir()
    docs = scan_files(spark, str(tmp_path / "none"))
    empty = docledger.run_batch(docs, run.ledger, str(tmp_path / "out"), decoders=[lambda content: [content.decode()]])
    assert counts(empty) == (0, 0, 0, 0, 0)
    header, rows = read_csv(empty.output_files["exceptions_csv"])
    assert rows == [] and header[0] == "file_name"


def test_table_of_texts(spark, run, tmp_path):
    rows = [(i, page(*fields)) for i, fields in enumerate(DOCUMENTS.values())] + [(9, " ")]
    table = spark.createDataFrame(rows, "id int, body string")
    docs = table_documents(table, "id", "id", "body")
    done = docledger.run_batch(docs, run.ledger, str(tmp_path / "out"))
    assert counts(done) == (8, 2, 1, 5, 0)
    found = {r.file_name: r.exception.issue_type for r in done.results.collect() if r.exception}
    assert found["9"] == "UNREADABLE_PDF"


def test_bad_arguments(spark, run, inbox):
    with pytest.raises(ValueError):
        run(decoders=[])
    with pytest.raises(ValueError):
        run(dedup="sometimes")
    with pytest.raises(ValueError):
        run(run_id="a/b")


def test_csv_survives_quotes_commas_newlines_and_spaces(spark, folder):
    rows = [("a.pdf", "h", "X", ' he said "no", \n twice\r\n '), ("b.pdf", "h", "X", "")]
    columns = "file_name string, file_hash string, issue_type string, details string"
    df = spark.createDataFrame(rows, columns).coalesce(1)
    exports.export_exceptions_csv(df, f"{folder}/x")
    _, found = read_csv(f"{folder}/x")
    assert [r["details"] for r in found] == [rows[0][3], ""]


def test_exports_replace_older_files(spark, folder):
    df = spark.createDataFrame([("a", "h", "X", "d")], "file_name string, file_hash string, issue_type string, details string")
    exports.export_exceptions_json(df.union(df), f"{folder}/x")
    exports.export_exceptions_json(df.withColumn("details", F.lit(None).cast("string")), f"{folder}/x")
    assert read_json(f"{folder}/x") == [
        {"file_name": "a", "file_hash": "h", "issue_type": "X", "details": None}
    ]


def test_arrivals_run_once_each(spark, inbox, tmp_path):
    ledger = docledger.Ledger(spark, str(tmp_path / "stream-ledger"))
    plain = lambda content: content.decode("utf-8").split("\f")

    def arrive():
        query = run_arrivals(
            spark,
            str(inbox),
            ledger,
            str(tmp_path / "stream-out"),
            str(tmp_path / "stream-state"),
            decoders=[plain],
        )
        query.awaitTermination(240)
        assert query.exception() is None

    arrive()
    assert {r.status: r.documents for r in ledger.stats().collect()}["TOTAL"] == 7
    (inbox / "renamed.pdf").write_bytes((inbox / "memo_11.pdf").read_bytes())
    (inbox / "later.pdf").write_text(page("Nova", "N-1", "2024-01-01", "2024-02-01", "5.00", "EUR"))
    arrive()
    stats = {r.status: r.documents for r in ledger.stats().collect()}
    assert stats == {"OK": 3, "FLAGGED": 1, "EXCEPTION": 4, "TOTAL": 8}
    assert len(list((tmp_path / "stream-out").glob("run_id=*"))) == 2


def test_large_runs_take_the_shuffle_paths(run, inbox, monkeypatch):
    """With no room to broadcast, every size-checked join has to give the same results."""
    monkeypatch.setattr(batch, "BROADCAST_BYTES", 0)
    assert counts(run()) == (7, 2, 1, 4, 0)
    (inbox / "copy_of_001.pdf").write_bytes((inbox / "memo_11.pdf").read_bytes())
    (inbox / "dup_of_002.pdf").write_text(page("blue kettle ", "BK 4410", "2024-01-01", None, "1", "EUR"))
    (inbox / "new.pdf").write_text(page("Nova", "N-1", "2024-01-01", "2024-02-01", "5.00", "EUR"))
    mixed = run()
    assert counts(mixed) == (10, 1, 0, 1, 8)
    issues = {r.file_name: r.exception.issue_type for r in mixed.results.collect() if r.exception}
    assert issues == {"dup_of_002.pdf": "DUPLICATE_INVOICE"}
    assert counts(run(force=True)) == (10, 4, 1, 5, 0)


def test_run_history_is_the_index_of_its_keys(spark, folder):
    """Events of one hash may change key or status; only the last one counts."""
    rng = random.Random(11)
    events = [
        (f"h{rng.randrange(60)}", rng.choice("ABCDEFGH"), rng.choice(["1", "2", " "]),
         rng.choice(["OK", "FLAGGED", "EXCEPTION"]), f"2024-01-{rng.randrange(1, 29):02d}", f"r{i:04d}")
        for i in range(400)
    ]
    columns = "file_hash string, supplier_name string, invoice_number string, status string,"
    log = spark.createDataFrame(events, f"{columns} processed_at string, run_id string")
    wanted = [("a", "1", None), ("c", "2", None), ("zz", "1", None), ("d", "1", "rejected")]
    documents = spark.createDataFrame(
        wanted, "supplier_name string, invoice_number string, issue string"
    )
    found = batch.run_history(log, documents, f"{folder}/history").collect()
    everything = batch.history_index(batch.latest_events(log)).collect()
    keys = {(s, n) for s, n, issue in wanted if issue is None}

    def asked(rows):
        return {tuple(r) for r in rows if (r.supplier_key, r.number_key) in keys}

    assert asked(found) == asked(everything)
    assert asked(everything)


def test_document_gone_before_it_is_read(spark):
    issue = "struct<issue_type: string, details: string>"
    marked = spark.createDataFrame(
        [("a", "p/a", True), ("b", "p/b", True), ("c", "p/c", False)],
        "file_name string, file_path string, admitted boolean",
    )
    extracted = spark.createDataFrame([("p/a", None)], f"file_path string, issue {issue}")
    found = {r.file_path: r.issue for r in batch._with_extracted(marked, extracted).collect()}
    assert found["p/a"] is None and found["p/c"] is None
    assert found["p/b"].issue_type == "UNREADABLE_PDF" and "b" in found["p/b"].details


def test_new_ledger_is_empty(spark, folder):
    ledger = docledger.Ledger(spark, f"{folder}/ledger")
    assert [tuple(r) for r in ledger.stats().collect()] == [("TOTAL", 0)]
    assert ledger.get("x").count() == 0 and ledger.history().count() == 0
    assert docledger.Ledger(spark, f"{folder}/ledger").epoch() == 0


def test_stored_responses_and_null_texts(spark, tmp_path):
    answer = json.dumps(
        {
            "supplier_name": "Ferry Cargo",
            "invoice_number": "FC.1",
            "invoice_date": "2023-02-01",
            "due_date": "2023-03-01",
            "total_amount": 12.5,
            "currency": "EUR",
            "confidence_score": 0.95,
        }
    )
    rows = [("a", "p/a", "some text", answer), ("b", "p/b", None, None), ("c", "p/c", "other", "{")]
    docs = spark.createDataFrame(rows, "file_name string, file_path string, raw_text string, response string")
    ledger = docledger.Ledger(spark, str(tmp_path / "stored"))
    run = docledger.run_batch(docs, ledger, str(tmp_path / "out"), extractor=response_extractor())
    found = {r.file_name: (r.status, r.exception and r.exception.issue_type) for r in run.results.collect()}
    assert found == {
        "a": ("OK", None),
        "b": ("EXCEPTION", "UNREADABLE_PDF"),
        "c": ("EXCEPTION", "EXTRACTION_FAILED"),
    }
    assert ledger.events().where("file_hash IS NULL").isEmpty()
    again = docledger.run_batch(docs, ledger, str(tmp_path / "out"), extractor=response_extractor())
    assert {r.status for r in again.results.collect()} == {"SKIPPED_CACHED"}


def test_a_run_id_is_not_taken_over(spark, tmp_path):
    kind = "file_name string, file_path string, raw_text string"
    ledger = docledger.Ledger(spark, str(tmp_path / "owned"))
    one, two = (spark.createDataFrame([(n, n, n)], kind) for n in ("x", "y"))
    docledger.run_batch(one, ledger, str(tmp_path / "out"), run_id="r")
    with pytest.raises(ValueError, match="documents that are not in this one"):
        docledger.run_batch(two, ledger, str(tmp_path / "out"), run_id="r")
    assert ledger.events().count() == 1
    with pytest.raises(ValueError, match="confidence_floor"):
        docledger.run_batch(one, ledger, str(tmp_path / "out"), rules=[], confidence_floor=0.1)


def test_files_that_cannot_be_read_have_an_outcome(spark, inbox, tmp_path):
    limit = "spark.sql.sources.binaryFile.maxLength"
    (inbox / "large.pdf").write_text("x" * 5000)
    spark.conf.set(limit, "4000")
    try:
        docs = scan_files(spark, str(inbox))
        (inbox / "memo_11.pdf").unlink()
        ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
        plain = lambda content: content.decode("utf-8").split("\f")
        run = docledger.run_batch(docs, ledger, str(tmp_path / "out"), decoders=[plain])
        found = {r.file_name: r for r in run.results.collect()}
    finally:
        spark.conf.unset(limit)
    assert set(found) == {*DOCUMENTS, "large.pdf"}
    unread = {n for n, r in found.items() if r.exception and r.exception.issue_type == "UNREADABLE_PDF"}
    assert unread == {"large.pdf", "memo_11.pdf"}
    assert found["large.pdf"].file_hash != found["memo_11.pdf"].file_hash
