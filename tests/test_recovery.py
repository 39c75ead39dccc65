"""Runs that break, files that cannot be had, and what a reader sees meanwhile."""

import os
import time

import pytest

import docledger
from docledger.operators.extract import custom_extractor
from docledger.plans import batch
from docledger.sources.files import scan_files
from docledger.streaming.incremental import run_arrivals


def plain():
    """Made anew, so that workers, which do not have this module, get it by value."""
    return lambda content: [content.decode()]


def counting_extractor(log, **options):
    """Every call leaves a line in `log`; texts that hold a number are invoices of it."""

    def factory():
        def extract(text, name):
            with open(log, "a") as calls:
                calls.write(f"{name}\n")
            if "slow" in text:
                time.sleep(1.5)
            return {
                "supplier_name": "Ferry Cargo",
                "invoice_number": name,
                "invoice_date": "2023-02-01",
                "due_date": "2023-03-01",
                "total_amount": 5.0,
                "currency": "EUR",
            }

        return extract

    return custom_extractor(factory, **options)


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    for i in range(6):
        (folder / f"doc_{i}.pdf").write_text(f"text {i}")
    return folder


def lines(path):
    return path.read_text().split() if path.exists() else []


@pytest.mark.parametrize("kind", ["files", "texts", "waves"])
def test_a_broken_run_asks_for_no_answer_twice(spark, inbox, tmp_path, monkeypatch, kind):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    log, out = tmp_path / "calls", tmp_path / "out"
    files = scan_files(spark, str(inbox))
    texts = [(f"doc_{i}.pdf", f"p/{i}", f"text {i}") for i in range(6)]
    table = spark.createDataFrame(texts, "file_name string, file_path string, raw_text string")
    options = {"extractor": counting_extractor(log), "run_id": "r"}
    options |= {"decoders": [plain()]} if kind == "files" else {}
    options |= {"answers_per_commit": 2} if kind == "waves" else {}
    docs = files if kind == "files" else table

    def broken(*args):
        raise RuntimeError("out of luck")

    with monkeypatch.context() as patch:
        patch.setattr(batch.exports, "export_summary", broken)
        with pytest.raises(RuntimeError):
            docledger.run_batch(docs, ledger, str(out), **options)
    assert len(lines(log)) == 6
    assert not list(out.glob("run_id=*")) and ledger.events().isEmpty()
    run = docledger.run_batch(docs, ledger, str(out), **options)
    assert len(lines(log)) == 6
    assert (run.summary["total_scanned"], run.summary["processed_ok"]) == (6, 6)
    assert not (tmp_path / "ledger" / "answers" / "run_id=r").exists()
    assert [p.name for p in out.iterdir() if not p.name.startswith("_")] == ["run_id=r"]


def test_answers_are_committed_as_a_run_goes(spark, inbox, tmp_path):
    """A run that breaks while it extracts keeps what it has committed."""
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    log, trap = tmp_path / "calls", tmp_path / "trap"
    trap.write_text("")

    def factory():
        def extract(text, name):
            with open(log, "a") as calls:
                calls.write(f"{name}\n")
            if os.path.exists(trap) and len(open(log).read().split()) > 3:
                os._exit(1)  # takes the worker down, and the job with it
            return {"supplier_name": "A", "invoice_number": name, "total_amount": 1.0}

        return extract

    texts = [(f"d{i}", f"p/{i}", f"text {i}") for i in range(8)]
    docs = spark.createDataFrame(texts, "file_name string, file_path string, raw_text string").coalesce(1)
    options = {"extractor": custom_extractor(factory), "run_id": "r", "answers_per_commit": 2}
    with pytest.raises(Exception):
        docledger.run_batch(docs, ledger, str(tmp_path / "out"), **options)
    kept = spark.read.parquet(f"{ledger.path}/answers/run_id=r").count()
    assert 1 <= kept <= 4
    trap.unlink()
    before = len(lines(log))
    run = docledger.run_batch(docs, ledger, str(tmp_path / "out"), **options)
    assert run.summary["total_scanned"] == 8 and len(lines(log)) - before == 8 - kept


def test_changed_documents_are_asked_for_again(spark, inbox, tmp_path, monkeypatch):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    log = tmp_path / "calls"
    options = {"extractor": counting_extractor(log), "decoders": [plain()], "run_id": "r"}
    with monkeypatch.context() as patch:
        patch.setattr(batch, "_publish", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            docledger.run_batch(scan_files(spark, str(inbox)), ledger, str(tmp_path / "out"), **options)
    (inbox / "doc_3.pdf").write_text("other text")
    run = docledger.run_batch(scan_files(spark, str(inbox)), ledger, str(tmp_path / "out"), **options)
    assert sorted(lines(log)) == sorted([f"doc_{i}.pdf" for i in range(6)] + ["doc_3.pdf"])
    assert run.summary["processed_ok"] == 6


def test_outputs_appear_together(spark, inbox, tmp_path, monkeypatch):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    out = tmp_path / "out"
    first = docledger.run_batch(scan_files(spark, str(inbox)), ledger, str(out), decoders=[plain()], run_id="r")
    old = {p.name for p in (out / "run_id=r" / "exceptions_csv").iterdir()}
    with monkeypatch.context() as patch:
        patch.setattr(batch.exports, "export_exceptions_json", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            docledger.run_batch(scan_files(spark, str(inbox)), ledger, str(out), decoders=[plain()], run_id="r")
    # What was there before the attempt still is, whole.
    assert {p.name for p in (out / "run_id=r").iterdir()} >= set(first.output_files)
    assert {p.name for p in (out / "run_id=r" / "exceptions_csv").iterdir()} == old
    docledger.run_batch(scan_files(spark, str(inbox)), ledger, str(out), decoders=[plain()], run_id="r")
    assert {p.name for p in (out / "run_id=r" / "exceptions_csv").iterdir()} != old
    assert not any((out / "_replaced").iterdir())


def test_progress_rises_while_documents_are_extracted(spark, tmp_path):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    texts = [(f"d{i}", f"p/{i}", f"slow {i}") for i in range(8)]
    docs = spark.createDataFrame(texts, "file_name string, file_path string, raw_text string").coalesce(1)
    seen = []
    docledger.run_batch(
        docs,
        ledger,
        str(tmp_path / "out"),
        extractor=counting_extractor(tmp_path / "calls", partitions=8),
        on_progress=lambda stage, counts: seen.append((stage, counts["documents"])),
        report_every=0.2,
    )
    during = [n for stage, n in seen if stage == "extracting"]
    assert len(set(during)) > 1 and during == sorted(during) and during[-1] <= 8
    assert [stage for stage, _ in seen if stage != "extracting"][-2:] == ["extracted", "routed"]


def test_arrivals_with_bad_files_among_them(spark, inbox, tmp_path):
    """Files too large, empty, oddly named or gone get their outcome; the others are processed."""
    limit = "spark.sql.sources.binaryFile.maxLength"
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))

    def arrive(**options):
        state = {"output_dir": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}
        query = run_arrivals(spark, str(inbox), ledger, **state, decoders=[plain()], **options)
        query.awaitTermination(240)
        assert query.exception() is None
        return {r.file_name: r for r in ledger.current().collect()}

    (inbox / "large.pdf").write_text("x" * 5000)
    (inbox / "_x.pdf").write_text("hidden")
    (inbox / ".y.pdf").write_text("hidden too")
    (inbox / "empty.pdf").write_text("")
    spark.conf.set(limit, "4000")
    try:
        found = arrive()
        assert set(found) == {f"doc_{i}.pdf" for i in range(6)} | {"large.pdf", "_x.pdf", ".y.pdf", "empty.pdf"}
        unread = {name for name, r in found.items() if r.issue_type == "UNREADABLE_PDF"}
        assert unread == {"large.pdf", "empty.pdf"}
        # Fingerprinted by content: a renamed copy of the large file is known.
        (inbox / "large.pdf").rename(inbox / "renamed.pdf")
        (inbox / "later.pdf").write_text("later")
        assert set(arrive()) == {*found, "later.pdf"}
    finally:
        spark.conf.unset(limit)
    assert set(arrive()) == {*found, "later.pdf"}  # nothing new


def test_a_backlog_is_split_into_runs(spark, inbox, tmp_path):
    ledger = docledger.Ledger(spark, str(tmp_path / "ledger"))
    out = tmp_path / "out"
    query = run_arrivals(
        spark, str(inbox), ledger, str(out), str(tmp_path / "state"), decoders=[plain()], files_per_batch=2
    )
    query.awaitTermination(240)
    assert query.exception() is None
    runs = {r.run_id: r["count"] for r in ledger.events().groupBy("run_id").count().collect()}
    assert sum(runs.values()) == 6 and max(runs.values()) <= 2
    assert len(list(out.glob("run_id=*"))) == len(runs) >= 3
