"""One run over a set of documents: admit, read, extract, judge, route, export, record."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark import Accumulator, StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions.keys import KEY, with_keys
from docledger.functions.text import is_blank
from docledger.operators.copies import DOCUMENT, mark_admitted, probe_counts
from docledger.operators.dedup import (
    DEDUP_MODES,
    accepted_history,
    history_index,
    mark_duplicates,
)
from docledger.operators.extract import Extractor, label_extractor
from docledger.operators.routing import (
    accepted_invoices,
    exception_queue,
    ledger_events,
    result_columns,
    route,
    summarize,
)
from docledger.operators.rules import Rule, default_rules, judge
from docledger.schemas import ANSWER, DEFAULT_CONFIDENCE_FLOOR, RAW_EXTRACTION, RUN_SUMMARY
from docledger.session import exists, move, new_folder, remove, split_stages, stage
from docledger.sinks import exports
from docledger.sources.files import with_content_hash
from docledger.sources.ledger import MIXED, Ledger, bucket_of, latest_events
from docledger.sources.pages import DECODE_SECONDS, Decoder, decode, read_text
from docledger.sources.stores import Store, open_store

# A list of names or hashes up to this size is sent to every executor, so that contents
# and the ledger stay where they are. Above it the same joins run by shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024

# What the later steps need of a judged document. Keys and stripped names are made again
# from the two raw names: that is cheaper than to write and move them.
JUDGED_COLUMNS = (
    "issue",
    "supplier_name",
    "invoice_number",
    "parsed_date",
    "parsed_due_date",
    "total_amount",
    "currency_code",
)

OUTPUTS = ("invoices_csv", "invoices_json", "exceptions_csv", "exceptions_json", "run_summary_json")

Progress = Callable[[str, dict], None]


@dataclass(frozen=True)
class BatchRun:
    run_id: str
    summary: dict
    results: DataFrame
    output_files: dict[str, str]


def _issue(issue_type: str, details: Column) -> Column:
    return F.struct(F.lit(issue_type).alias("issue_type"), details.alias("details"))


def extract_records(docs: DataFrame, extractor: Extractor) -> DataFrame:
    """Documents with `raw_text` to `record` and `failure` (unreadable or not extracted)."""
    if "unreadable_details" not in docs.columns:
        empty = F.when(is_blank(F.col("raw_text")), F.concat(F.lit("No text in "), "file_name"))
        docs = docs.withColumn("unreadable_details", empty)
    extracted = extractor.apply(docs)
    failure = F.when(
        F.col("unreadable_details").isNotNull(),
        _issue("UNREADABLE_PDF", F.col("unreadable_details")),
    ).when(
        F.col("extract_error").isNotNull(), _issue("EXTRACTION_FAILED", F.col("extract_error"))
    )
    return extracted.withColumn("failure", failure)


def judge_documents(documents: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules over `record`; an earlier `failure` comes first. Only narrow columns remain."""
    carried = [c for c in documents.columns if c not in ("record", "failure")]
    fields = [F.col(f"record.{name}").alias(name) for name in RAW_EXTRACTION.names]
    flat = documents.select(*carried, "failure", *fields)
    issue = F.coalesce("failure", "issue")
    return judge(flat, rules).withColumn("issue", issue).select(*carried, *JUDGED_COLUMNS)


def route_documents(judged: DataFrame, history: DataFrame | None, dedup: str) -> DataFrame:
    """One result per judged document. `judged` has `admitted` and is read twice."""
    competes = "admitted AND issue IS NULL"
    return route(mark_duplicates(with_keys(judged), history, dedup, competes))


def _fits(rows: DataFrame) -> bool:
    """Whether the text in `rows` is small enough to send to every executor."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in rows.columns), F.lit(32))
    return (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def _keep_admitted(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Drop documents that need no work, moving the paths and not the contents.

    Usually one of the two path lists is short. If it fits the limit it is broadcast
    and the contents stay where they were read; otherwise the join is left to Spark.
    """
    admitted = marked.where("admitted").select("file_path")
    skipped = marked.where("NOT admitted").select("file_path")
    if skipped.isEmpty():
        return docs
    if _fits(skipped):
        return docs.join(F.broadcast(skipped), "file_path", "left_anti")
    if _fits(admitted):
        return docs.join(F.broadcast(admitted), "file_path", "left_semi")
    return docs.join(admitted, "file_path", "left_semi")


def _events_of(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ledger events that share the columns of `wanted`, without shuffling the ledger if
    the run is small, and reading only the buckets of wanted hashes. For a large run this
    is no gain and the events stay as they are."""
    if not _fits(wanted):
        return events
    if "bucket" in events.columns and "file_hash" in wanted.columns:
        # At most as many rows as a ledger has buckets.
        buckets = wanted.select(bucket_of(F.col("file_hash"))).distinct().collect()
        events = events.where(F.col("bucket").isin([*(row[0] for row in buckets), MIXED]))
    return events.join(F.broadcast(wanted.distinct()), wanted.columns, "left_semi")


def run_history(
    events: DataFrame,
    documents: DataFrame,
    path: str,
    hashes_of_keys: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """History index over the keys that `documents` can ask for.

    A small run looks for hashes that any accepted event gave one of its keys, in the
    ledger's key layout if `hashes_of_keys` reads it, then takes all events of those hashes,
    since a later event may have moved a hash to another key or rejected it. A large run
    indexes the whole ledger.
    """
    keys = with_keys(documents.where("issue IS NULL")).select(*KEY)
    if not _fits(keys):
        return history_index(latest_events(events))
    if hashes_of_keys is not None:
        hits = hashes_of_keys(keys)
    else:
        hits = accepted_history(events).join(F.broadcast(keys.distinct()), KEY, "left_semi")
    hashes = stage(hits.select("file_hash").distinct(), path)
    return history_index(latest_events(_events_of(events, hashes)))


def _with_extracted(marked: DataFrame, extracted: DataFrame) -> DataFrame:
    """Bring the judged records back to all documents, over the unique path.

    A document that was hashed but is gone when its content is read is unreadable.
    """
    joined = marked.join(extracted.withColumn("_read", F.lit(True)), "file_path", "left")
    gone = F.col("admitted") & F.col("_read").isNull()
    lost = _issue("UNREADABLE_PDF", F.concat(F.lit("Gone before it was read: "), "file_name"))
    return joined.withColumn("issue", F.when(gone, lost).otherwise(F.col("issue"))).drop("_read")


def _observed(
    df: DataFrame, name: str, path: str, on_progress: Progress | None, **metrics
) -> DataFrame:
    """Stage `df`, reporting its row count and `metrics` when it is written."""
    if on_progress is None:
        return stage(df, path)
    seen = Observation(name)
    columns = [column.alias(label) for label, column in metrics.items()]
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("documents"), *columns), path)
    on_progress(name, seen.get)
    return staged


@contextmanager
def _watched(docs: DataFrame, name: str, on_progress: Progress | None, every: float) -> Iterator:
    """Give a function that counts the rows of a DataFrame as its tasks end, and report the
    count while the block runs, at most once in `every` seconds. Tasks that are run twice
    count twice here; what a stage reports when it is written does not."""
    if on_progress is None:
        yield lambda df: df
        return
    seen, over = docs.sparkSession.sparkContext.accumulator(0), threading.Event()

    def report() -> None:
        last = 0
        while not over.wait(every):
            if seen.value != last:
                last = seen.value
                on_progress(name, {"documents": last})

    thread = threading.Thread(target=report, daemon=True)
    thread.start()
    try:
        yield lambda df: _counted(df, seen)
    finally:
        over.set()
        thread.join()


def _counted(df: DataFrame, seen: Accumulator) -> DataFrame:
    def count(batches: Iterator) -> Iterator:
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema)


def _with_answers(
    docs: DataFrame,
    marked: DataFrame,
    texts_of: Callable[[DataFrame], DataFrame],
    extractor: Extractor,
    folder: str,
    work: str,
    per_commit: int,
) -> DataFrame:
    """`record` and `failure` of every admitted document, each extracted once.

    What the extractor answers is written to `folder`, by path and content hash, before
    anything else is done with it, and committed every `per_commit` documents; documents whose
    answer is there already are not sent again. So a run that broke and is started again under
    its id pays for the documents of one commit at most.
    """
    spark, key = docs.sparkSession, ["file_path", "file_hash"]
    todo = marked.select(*DOCUMENT, "admitted")
    if exists(spark, folder):
        done = spark.read.schema(ANSWER).parquet(folder).select(*key, F.lit(True).alias("done"))
        todo = todo.join(done, key, "left").withColumn(
            "admitted", F.col("admitted") & F.col("done").isNull()
        )
    todo = stage(todo.select(*DOCUMENT, "admitted"), f"{work}/todo")
    commits = -(-todo.where("admitted").count() // per_commit)
    share = F.pmod(F.xxhash64("file_path"), F.lit(max(commits, 1)))
    wide = commits > 1 and not {"raw_text", "content"}.isdisjoint(docs.columns)
    if wide:
        # Contents are picked out once, not once for each commit.
        _keep_admitted(docs, todo).withColumn("_share", share).write.partitionBy("_share").parquet(f"{work}/wanted")
        schema = T.StructType([*docs.schema.fields, T.StructField("_share", T.LongType())])
        docs = spark.read.schema(schema).parquet(f"{work}/wanted")
    for turn in range(commits):
        mine = todo.withColumn("admitted", F.col("admitted") & (share == turn))
        part = docs.where(F.col("_share") == turn).drop("_share") if wide else _keep_admitted(docs, mine)
        records = extract_records(texts_of(part), extractor)
        records.select(ANSWER.names).write.mode("append").parquet(folder)
    if not commits and not exists(spark, folder):
        return spark.createDataFrame([], ANSWER).drop("file_hash")
    answers = spark.read.schema(ANSWER).parquet(folder)
    return answers.join(marked.where("admitted").select(*key), key, "left_semi").drop("file_hash")


def _publish(output_dir: str, pending: str, target: str, docs: DataFrame) -> None:
    """Let the outputs of a run appear, all at once, in place of those of an earlier attempt.

    Between the two renames there are none; a reader never meets a part of them.
    """
    spark, replaced = docs.sparkSession, f"{output_dir}/_replaced/{uuid.uuid4().hex}"
    if exists(spark, target):
        move(spark, target, replaced)
    move(spark, pending, target)
    remove(spark, replaced)


def _refuse_other_run(ledger: Ledger, run_id: str, staged: DataFrame) -> None:
    """A run id may be repeated for the documents it recorded, never for others."""
    recorded = ledger.recorded(run_id).select("file_hash")
    if not recorded.join(staged.select("file_hash"), "file_hash", "left_anti").isEmpty():
        raise ValueError(f"run {run_id!r} is recorded with documents that are not in this one")


def _known_hashes(events: DataFrame, retry_issue_types: Sequence[str]) -> DataFrame:
    """Hashes to skip; documents that last failed with a type to retry are not among them."""
    if not retry_issue_types:
        return events
    retried = F.coalesce(F.col("issue_type").isin(*retry_issue_types), F.lit(False))
    return latest_events(events).where(~retried).select("file_hash")


def run_batch(
    docs: DataFrame,
    ledger: Ledger,
    output_dir: str,
    *,
    extractor: Extractor | None = None,
    decoders: Sequence[Decoder] = (),
    rules: Sequence[Rule] | None = None,
    confidence_floor: float = DEFAULT_CONFIDENCE_FLOOR,
    force: bool = False,
    dedup: str = "hash",
    retry_issue_types: Sequence[str] = (),
    ordered: bool = False,
    run_id: str | None = None,
    on_progress: Progress | None = None,
    report_every: float = 1.0,
    answers_per_commit: int = 100_000,
    decode_seconds: float = DECODE_SECONDS,
    store: Store = open_store,
) -> BatchRun:
    """Process `docs`, write the outputs of the run, then record it in the ledger.

    `docs` has `file_name`, a unique `file_path`, and `raw_text`, or `content` (bytes for
    `decoders`), or neither: then it lists files, which are read by path. Outputs go to
    `output_dir/run_id=<run_id>/`, which appears when all of them are written, with
    `ordered` in processing order (by name, then path) across their part files. The
    ledger is written last, and a repeated `run_id` replaces its own outputs and ledger
    rows, so a run that broke off anywhere can simply be started again; the answers of a
    custom extractor are kept until then and not asked for twice. An id that the
    ledger has with documents which are not among `docs` is refused. `docs` also has the
    columns that the extractor names.

    `on_progress(stage, counts)` is called after each stage, and while documents are extracted
    every `report_every` seconds, as "extracting", from a thread of its own.
    """
    spark = docs.sparkSession
    has_text = "raw_text" in docs.columns
    extractor = extractor or label_extractor()
    if not has_text and not decoders:
        raise ValueError("documents without raw_text need at least one decoder")
    if dedup not in DEDUP_MODES:
        raise ValueError(f"dedup must be one of {DEDUP_MODES}, not {dedup!r}")
    if run_id is not None and not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"run_id names a folder, so it cannot be {run_id!r}")
    if rules is not None and confidence_floor != DEFAULT_CONFIDENCE_FLOOR:
        raise ValueError("confidence_floor belongs to the default rules; give it to your own")
    rules = default_rules(confidence_floor) if rules is None else rules
    given_run = run_id
    started_at = datetime.now(timezone.utc)
    run_id = run_id or f"{started_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    work = new_folder(spark, run_id)
    events = ledger.events().where(F.col("run_id") != run_id)

    def read(wanted: DataFrame) -> DataFrame:
        """Documents with name, path, hash and text, read and decoded where they are files."""
        if has_text:
            texts = with_content_hash(wanted, "raw_text")
        else:
            files = with_content_hash(wanted) if "content" in wanted.columns else wanted
            kept = [c for c in ("content", "length", "file_hash") if c in files.columns]
            files = files.select("file_name", "file_path", *kept, *extractor.columns)
            texts = read_text(decode(files, decoders, decode_seconds, store))
        details = [c for c in ("unreadable_details",) if c in texts.columns]
        return texts.select(*DOCUMENT, "raw_text", *details, *extractor.columns)

    # Every document is hashed once. Where nothing can be skipped, decoding shares that scan,
    # and so does cheap extraction, with the rules: from there on only narrow rows are moved.
    # Where the ledger knows documents, it is asked first, and only new ones are read again.
    nothing_known = force or events.isEmpty()
    one_pass = nothing_known and extractor.native
    decoded = nothing_known and not has_text and not extractor.native
    if one_pass:
        records = extract_records(read(docs), extractor).select(*DOCUMENT, "record", "failure")
        narrow = judge_documents(records, rules)
    elif decoded:
        narrow = read(docs)
    else:
        narrow = with_content_hash(docs, "raw_text" if has_text else "content", store).select(*DOCUMENT)
    label = "extracting" if one_pass else "hashing"
    with _watched(docs, label, on_progress, report_every) as counted, split_stages(spark):
        staged = _observed(counted(narrow), "hashed", f"{work}/intake", on_progress)
    texts = staged if decoded else docs
    if decoded:
        staged = staged.select(*DOCUMENT)
    if given_run is not None:
        _refuse_other_run(ledger, run_id, staged)

    known = None
    if not force:
        met = _events_of(events, staged.select("file_hash"))
        known = _known_hashes(met, retry_issue_types)
    marked = _observed(
        mark_admitted(staged, known, force),
        "admitted",
        f"{work}/admitted",
        on_progress,
        admitted=F.count_if("admitted"),
    )

    answers = f"{ledger.path}/answers/run_id={run_id}"
    if one_pass and not has_text and on_progress is not None:
        done = F.count("*").alias("documents"), F.count("issue").alias("rejected")
        on_progress("extracted", marked.where("admitted").agg(*done).first().asDict())
    if not one_pass:
        with _watched(docs, "extracting", on_progress, report_every) as counted:

            def texts_of(wanted: DataFrame) -> DataFrame:
                return wanted if decoded else read(wanted)

            if extractor.native:
                records = extract_records(texts_of(_keep_admitted(texts, marked)), extractor)
                records = counted(records.select("file_path", "record", "failure"))
            else:
                watched = replace(extractor, apply=lambda part: counted(extractor.apply(part)))
                records = _with_answers(
                    texts, marked, texts_of, watched, answers, work, answers_per_commit
                )
            with split_stages(spark):
                extracted = _observed(
                    judge_documents(records, rules),
                    "extracted",
                    f"{work}/extracted",
                    on_progress,
                    rejected=F.count_if(F.col("issue").isNotNull()),
                )
        marked = _with_extracted(marked, extracted)

    history = None
    if dedup != "off":
        hits = lambda keys: ledger.hashes_of_keys(keys, run_id)
        history = run_history(events, marked, f"{work}/history", hits)
    routed = _observed(
        route_documents(marked, history, dedup),
        "routed",
        f"{work}/routed",
        on_progress,
        exceptions=F.count_if(F.col("status") == "EXCEPTION"),
    )

    output_dir = output_dir.rstrip("/")
    target, pending = f"{output_dir}/run_id={run_id}", f"{output_dir}/_pending/{run_id}-{uuid.uuid4().hex}"
    accepted, rejected = accepted_invoices(routed), exception_queue(routed)
    if ordered:
        accepted = exports.in_document_order(accepted).persist(StorageLevel.DISK_ONLY)
        rejected = exports.in_document_order(rejected).persist(StorageLevel.DISK_ONLY)
    exports.export_invoices_csv(accepted, f"{pending}/invoices_csv")
    exports.export_invoices_json(accepted, f"{pending}/invoices_json")
    exports.export_exceptions_csv(rejected, f"{pending}/exceptions_csv")
    exports.export_exceptions_json(rejected, f"{pending}/exceptions_json")
    outputs = {name: f"{target}/{name}" for name in OUTPUTS}

    if ordered:
        accepted.unpersist()
        rejected.unpersist()

    counters = summarize(routed).first().asDict()
    completed_at = datetime.now(timezone.utc)
    summary = {
        **counters,
        "started_at": started_at,
        "completed_at": completed_at,
        "duration_seconds": round((completed_at - started_at).total_seconds(), 2),
        "output_files": outputs,
    }
    row = spark.createDataFrame([tuple(summary[n] for n in RUN_SUMMARY.names)], RUN_SUMMARY)
    exports.export_summary(row, f"{pending}/run_summary_json")
    _publish(output_dir, pending, target, docs)

    recorded = ledger_events(routed).withColumn("processed_at", F.lit(started_at))
    ledger.append(recorded, run_id)
    remove(spark, answers)
    return BatchRun(run_id, summary, result_columns(routed), outputs)


def dry_run(docs: DataFrame, ledger: Ledger, store: Store = open_store) -> DataFrame:
    """Counts of total, new and known documents; reads the ledger and changes nothing."""
    hashed = with_content_hash(docs, "raw_text" if "raw_text" in docs.columns else "content", store)
    return probe_counts(hashed.select("file_hash"), ledger.seen())
