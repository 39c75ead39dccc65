"""One query per operator over the given tables. Each takes a session and a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.currency import normalize_currency
from docledger.functions.dates import with_parsed_dates
from docledger.functions.keys import KEY, with_keys
from docledger.functions.text import file_name, file_suffix, strip
from docledger.operators import copies, dedup, extract, routing, rules
from docledger.plans import recipes
from docledger.plans.batch import (
    extract_records,
    judge_documents,
    route_documents,
    run_batch,
    run_history,
)
from docledger.schemas import EXCEPTION, INVOICE, RAW_EXTRACTION
from docledger.session import new_folder, stage
from docledger.sinks import exports
from docledger.sources import files, pages
from docledger.sources.ledger import Ledger, latest_events, lookup, status_counts

# --- sources ---------------------------------------------------------------------------


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written out as a file in a folder that Spark's own sources pass over."""
    folder = new_folder(spark, "hidden-texts")
    recipes.write_texts(spark, sf_dir, folder, ".id")
    found = files.scan_files(spark, folder, ".TXT")
    doc_id = recipes.written_id(".id").alias("doc_id")
    begin = F.substring("file_name", 1, 5).alias("name_begins")
    return found.select(doc_id, begin, file_suffix(F.col("file_name")).alias("suffix"), "length")


def scanned_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written out as a file of its own, then scanned and hashed."""
    folder = new_folder(spark, "texts")
    recipes.write_texts(spark, sf_dir, folder, "doc_id")
    found = files.with_content_hash(files.scan_files(spark, folder, ".txt"))
    doc_id = recipes.written_id("doc_id").alias("doc_id")
    suffix = file_suffix(F.col("file_name")).alias("suffix")
    return found.select(doc_id, suffix, "length", "file_hash")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.read(spark, sf_dir, "documents")
    return files.with_content_hash(docs, "text").select("doc_id", "file_hash")


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = recipes.read(spark, sf_dir, "conversations")
    return pages.assemble_pages(turns, "conv_id", "turn", "text")


def unreadable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.read(spark, sf_dir, "documents")
    return docs.select("doc_id", pages.unreadable(F.col("text")).alias("issue_type"))


def decoder_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    def plain(content: bytes) -> list[str]:
        return content.decode("ascii").split("\n")

    def unicode(content: bytes) -> list[str]:
        return content.decode("utf-8").split("\n")

    docs = recipes.text_documents(spark, sf_dir).select(
        "doc_id",
        F.col("name").alias("file_name"),
        F.col("path").alias("file_path"),
        F.col("text").cast("binary").alias("content"),
    )
    read = pages.read_text(pages.decode(docs, [plain, unicode]))
    return read.select("doc_id", F.col("decoder").cast("long"), "page_count", "raw_text")


def url_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = file_name(F.col("url"))
    return recipes.read(spark, sf_dir, "pages").select(
        "page_id", name.alias("file_name"), file_suffix(name).alias("suffix")
    )


# --- extraction ------------------------------------------------------------------------


def build_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.text_documents(spark, sf_dir)
    return docs.select("doc_id", extract.build_request(F.col("name"), F.col("text")).alias("request"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.label_text(recipes.raw_invoices(spark, sf_dir))
    return docs.select("seq", "file_name", "file_path", "raw_text")


def _record_columns(extracted: DataFrame) -> DataFrame:
    return extracted.select("seq", "record.*", "extract_error")


def extract_fields_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_columns(extract.label_extractor().apply(_labelled(spark, sf_dir)))


def pluggable_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    def label_reader():
        import re

        labels = {
            "invoice_number": "Invoice Number",
            "invoice_date": "Invoice Date",
            "due_date": "Due Date",
            "currency": "Currency",
        }
        patterns = {k: re.compile(rf"^{v}: *(\S.*)$", re.M) for k, v in labels.items()}
        amount = re.compile(r"^Total Amount: *(-?[\d,.]+)", re.M)

        def read(request: str, name: str) -> dict:
            heading, text = request.split("\n\nText:\n", 1)
            assert heading == f"File: {name}"
            found = {k: p.search(text) for k, p in patterns.items()}
            record = {k: m.group(1).strip() if m else None for k, m in found.items()}
            total = amount.search(text)
            record["total_amount"] = float(total.group(1).replace(",", "")) if total else None
            record["supplier_name"] = text.strip().split("\n")[0]
            return record

        return read

    extractor = extract.custom_extractor(label_reader, request=extract.build_request)
    return _record_columns(extractor.apply(_labelled(spark, sf_dir)))


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.model_responses(recipes.raw_invoices(spark, sf_dir)).select("seq", "response")


def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _record_columns(extract.parse_response(_answered(spark, sf_dir), "response"))


def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without any known field: every field takes its default."""
    events = recipes.read(spark, sf_dir, "events").select("event_id", "props")
    bound = extract.parse_response(events, "props")
    return bound.select("event_id", "record.*", "extract_error")


def extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, one in eleven of them blank, with stored answers.

    As in a run, extraction is staged before it is filtered: Spark would push the
    filter below the projections and parse every answer again for each use.
    """
    docs = recipes.model_responses(recipes.label_text(recipes.raw_invoices(spark, sf_dir)))
    blank = F.when(F.col("seq") % 11 == 3, F.lit(" \n")).otherwise(F.col("raw_text"))
    sent = docs.select("seq", "response", blank.alias("raw_text"))
    found = extract.response_extractor().apply(sent).select("seq", "extract_error")
    failed = stage(found, new_folder(spark, "extracted")).where("extract_error IS NOT NULL")
    return failed.select(
        "seq", F.lit("EXTRACTION_FAILED").alias("issue_type"), F.col("extract_error").alias("details")
    )


# --- scalar functions --------------------------------------------------------------------


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.order_documents(spark, sf_dir)
    parsed = with_parsed_dates(docs, parsed_date="invoice_date", parsed_due_date="due_date")
    return parsed.select(
        "seq", F.col("parsed_date").alias("invoice_date"), F.col("parsed_due_date").alias("due_date")
    )


def parse_date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = recipes.written_dates(recipes.read(spark, sf_dir, "orders"))
    return with_parsed_dates(written, parsed="text").select("o_orderkey", "text", "parsed")


def currency_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.order_documents(spark, sf_dir)
    return docs.select("seq", normalize_currency(F.col("currency")).alias("currency"))


def currency_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three-letter word of every whole text, the currency rule on long input."""
    docs = recipes.read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(normalize_currency(F.col("text")), 256).alias("code_hash"))


def clean_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.raw_invoices(spark, sf_dir)
    return docs.select(
        "seq",
        strip(F.col("invoice_number")).alias("invoice_number"),
        strip(F.col("supplier_name")).alias("supplier_name"),
    )


def dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_keys(recipes.raw_invoices(spark, sf_dir)).select("seq", *KEY)


# --- rules -------------------------------------------------------------------------------


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(recipes.raw_invoices(spark, sf_dir))


def rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return judged.select("seq", F.col("issue.issue_type").alias("issue_type"))


def issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.coalesce("issue_type", F.lit("PASSED")).alias("issue_type")
    return rule_chain(spark, sf_dir).groupBy(issue).agg(F.count("*").alias("documents"))


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = _judged(spark, sf_dir).where("issue IS NULL")
    return passed.select("seq", rules.review_status().alias("status"))


# --- history, copies and duplicates ------------------------------------------------------


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.text_documents(spark, sf_dir)
    hashed = files.table_documents(docs, "name", "path", "text")
    return copies.mark_copies(hashed.select("doc_id", *copies.DOCUMENT)).select(
        "doc_id", "file_hash", "is_copy"
    )


def history_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.history_index(recipes.ledger(spark, sf_dir))


def dup_against_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices against a ledger's key layout, as a run asks it."""
    invoices = recipes.raw_invoices(spark, sf_dir)
    book = _past_ledger(spark, sf_dir)
    asking = invoices.select("supplier_name", "invoice_number", F.lit(None).alias("issue"))
    history = run_history(book.events(), asking, new_folder(spark, "hits"), book.hashes_of_keys)
    keyed = with_keys(invoices).select("seq", "file_hash", *KEY)
    return dedup.duplicates_of_history(keyed, stage(history, new_folder(spark, "index"))).select("seq")


def _past_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """A ledger that holds every past result."""
    book = Ledger(spark, new_folder(spark, "ledger"))
    past = recipes.ledger(spark, sf_dir)
    book.append(past.withColumn("processed_at", F.col("processed_at").cast("timestamp")), "past")
    return book


def dup_key_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_keys(recipes.raw_invoices(spark, sf_dir)).select("seq", *KEY)
    known = dedup.accepted_history(recipes.ledger(spark, sf_dir))
    return dedup.duplicates_by_key(keyed, known).select("seq")


def _judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw invoices as a run has them after extraction and rules."""
    raw = recipes.raw_invoices(spark, sf_dir)
    record = F.struct(*[F.col(name) for name in RAW_EXTRACTION.names])
    failure = F.lit(None).cast("struct<issue_type: string, details: string>")
    docs = raw.select("seq", *copies.DOCUMENT, record.alias("record"), failure.alias("failure"))
    return judge_documents(docs, rules.default_rules())


def _staged(judged: DataFrame) -> DataFrame:
    """Duplicate marking reads its input twice, so that input is written once."""
    return stage(judged, new_folder(judged.sparkSession, "judged"))


def _batch(spark: SparkSession, sf_dir: str, dedup_mode: str = "hash") -> DataFrame:
    """All invoices as one run that starts with an empty ledger."""
    judged = _judged_documents(spark, sf_dir).withColumn("admitted", F.lit(True))
    if dedup_mode != "off":
        judged = _staged(judged)
    return route_documents(judged, None, dedup_mode)


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices as one run against the ledger of earlier runs."""
    judged = _judged_documents(spark, sf_dir)
    marked = copies.mark_admitted(judged, recipes.seen_hashes(spark, sf_dir))
    history = dedup.history_index(recipes.ledger(spark, sf_dir))
    return route_documents(_staged(marked), history, "hash")


def dedup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced run against history: which rows that pass the rules are duplicates."""
    history = dedup.history_index(recipes.ledger(spark, sf_dir))
    names = ["supplier_name", "invoice_number"]
    judged = _judged_documents(spark, sf_dir).select(
        "seq", *copies.DOCUMENT, *names, F.col("issue.issue_type").alias("issue")
    )
    marked = dedup.mark_duplicates(with_keys(_staged(judged)), history)
    return marked.where("issue IS NULL").select("seq", "is_duplicate")


def dedup_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, "off").select("file_name", "status")


def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.order_documents(spark, sf_dir).select("seq", "file_hash")
    return copies.new_documents(docs, recipes.seen_hashes(spark, sf_dir)).select("seq")


def already_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.order_documents(spark, sf_dir).select("seq", "file_hash")
    return copies.already_seen(docs, recipes.seen_hashes(spark, sf_dir)).select("seq")


# --- ledger ------------------------------------------------------------------------------


def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = recipes.order_documents(spark, sf_dir)
    return lookup(wanted, recipes.ledger(spark, sf_dir))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_events(recipes.ledger_events(spark, sf_dir), ["processed_at", "seq"])


def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(_latest(spark, sf_dir))


def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recipes.order_documents(spark, sf_dir).select("file_hash")
    return copies.probe_counts(docs, recipes.seen_hashes(spark, sf_dir))


def ledger_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, append every past result, count, clear, count again."""
    book = _past_ledger(spark, sf_dir)
    filled = book.stats()
    book.clear()
    return filled.withColumn("phase", F.lit("filled")).unionByName(
        book.stats().withColumn("phase", F.lit("cleared"))
    )


# --- results and exports -----------------------------------------------------------------


def validated_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.accepted_invoices(_batch(spark, sf_dir)).select(*INVOICE.names)


def exceptions_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.exception_queue(_batch(spark, sf_dir)).select(*EXCEPTION.names)


def _result_facts(results: DataFrame) -> DataFrame:
    return results.select(
        "file_name",
        "file_hash",
        "status",
        F.col("exception.issue_type").alias("issue_type"),
        F.col("invoice.total_amount").alias("total_amount"),
        "message",
    )


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _result_facts(_run(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.summarize(_run(spark, sf_dir))


def text_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over the documents table: whole texts are hashed and read for labels
    in one scan, copies are skipped, and the outcomes are counted per issue."""
    docs = files.table_documents(recipes.text_documents(spark, sf_dir), "name", "path", "text")
    read = extract_records(docs.select(*copies.DOCUMENT, "raw_text"), extract.label_extractor())
    records = read.select(*copies.DOCUMENT, "record", "failure")
    judged = _staged(judge_documents(records, rules.default_rules()))
    results = route_documents(_staged(copies.mark_admitted(judged, None)), None, "hash")
    return _outcomes(results)


def _outcomes(results: DataFrame) -> DataFrame:
    issue = F.coalesce("exception.issue_type", F.lit("NONE"))
    return results.groupBy("status", issue.alias("issue_type")).agg(F.count("*").alias("documents"))


def _text_run(spark: SparkSession, sf_dir: str, book: Ledger) -> DataFrame:
    docs = files.table_documents(recipes.text_documents(spark, sf_dir), "name", "path", "text")
    return _outcomes(run_batch(docs, book, new_folder(spark, "out")).results)


def run_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run_batch` over the documents table with a new ledger: outcomes per issue."""
    return _text_run(spark, sf_dir, Ledger(spark, new_folder(spark, "ledger")))


def run_batch_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents once more: all are known."""
    book = Ledger(spark, new_folder(spark, "ledger"))
    _text_run(spark, sf_dir, book)
    return _text_run(spark, sf_dir, book)


def run_batch_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`run_batch` over stored answers against the ledger of earlier runs.

    An invoice's text is its order key, whose hash the ledger has for finished orders.
    """
    book = _past_ledger(spark, sf_dir)
    fields = F.struct(*[F.col(name) for name in RAW_EXTRACTION.names])
    docs = recipes.raw_invoices(spark, sf_dir).select(
        "file_name",
        "file_path",
        F.col("o_orderkey").cast("string").alias("raw_text"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("response"),
    )
    run = run_batch(docs, book, new_folder(spark, "out"), extractor=extract.response_extractor())
    return _result_facts(run.results)


def export_invoices_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.invoice_csv_columns(validated_invoices(spark, sf_dir))


def export_invoices_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = validated_invoices(spark, sf_dir)
    return exports.json_text(invoices, INVOICE.names)


def _read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"{name} STRING" for name in columns)
    options = {**exports.CSV_OPTIONS, "multiLine": True, "enforceSchema": False}
    return spark.read.schema(schema).options(**options).csv(path)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "invoices-csv")
    exports.export_invoices_csv(validated_invoices(spark, sf_dir), path)
    return _read_csv(spark, path, INVOICE.names)


def csv_round_trip_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "exceptions-csv")
    exports.export_exceptions_csv(exceptions_queue(spark, sf_dir), path)
    return _read_csv(spark, path, EXCEPTION.names)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "invoices-json")
    exports.export_invoices_json(validated_invoices(spark, sf_dir), path)
    return spark.read.schema(INVOICE).json(path)


def json_round_trip_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "exceptions-json")
    exports.export_exceptions_json(exceptions_queue(spark, sf_dir), path)
    return spark.read.schema(EXCEPTION).json(path)


def summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "summary-json")
    summary = run_summary(spark, sf_dir)
    exports.export_summary(summary, path)
    return spark.read.schema(summary.schema).json(path)


QUERIES = {
    query.__name__: query
    for query in (
        scan_files,
        scanned_file_hashes,
        content_hash,
        assemble_pages,
        unreadable_documents,
        decoder_fallback,
        url_file_names,
        build_request,
        extract_fields_regex,
        pluggable_extract,
        parse_model_json,
        parse_event_json,
        extraction_failures,
        parse_dates,
        parse_date_layouts,
        currency_in_text,
        clean_identifiers,
        dedup_keys,
        rule_chain,
        issue_breakdown,
        review_flags,
        exact_copies,
        history_index,
        dup_against_history,
        dup_key_only,
        dedup_batch,
        dedup_off,
        new_documents,
        already_seen,
        ledger_lookup,
        ledger_upsert,
        ledger_stats,
        dry_run,
        ledger_lifecycle,
        validated_invoices,
        exceptions_queue,
        batch_results,
        run_summary,
        text_run_summary,
        run_batch_results,
        run_batch_rerun,
        run_batch_responses,
        export_invoices_projection,
        export_invoices_json,
        csv_round_trip,
        csv_round_trip_exceptions,
        json_round_trip,
        json_round_trip_exceptions,
        summary_round_trip,
    )
} | {"normalize_currency": currency_codes}
