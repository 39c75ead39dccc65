"""What the plans do at scale: pruning, pushdown, early grouping and crowded keys."""

import re
import shutil
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docledger.operators import copies, dedup
from docledger.plans.queries import QUERIES
from docledger.plans import batch
from docledger.session import stage
from docledger.sources import ledger as ledgers
from docledger.sources.ledger import BUCKETS, Ledger, latest_events

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def run_plan(df):
    """The final adaptive plan, after the query ran."""
    df.collect()
    return plan(df)


@contextmanager
def settings(spark, **values):
    old = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


CROWDED = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
}
ROWS = 120_000


@pytest.fixture
def crowded(spark):
    """A third of all rows share one value of `k`; `h` is unique."""
    with settings(spark, **CROWDED):
        yield spark.range(ROWS).select(
            F.concat(F.lit("n"), "id").alias("file_name"),
            F.concat(F.lit("p/"), "id").alias("file_path"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
            F.col("id").cast("string").alias("h"),
        )


def book(spark):
    name = F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string"))
    return spark.range(20_000).select(
        F.concat(F.lit("L"), "id").alias("file_hash"),
        name.alias("supplier_name"),
        F.lit("1").alias("invoice_number"),
        F.lit("OK").alias("status"),
    )


def keyed(df, hash_column):
    return df.select(
        "file_name",
        "file_path",
        F.col(hash_column).alias("file_hash"),
        F.col("k").alias("supplier_key"),
        F.lit("1").alias("number_key"),
        F.lit(None).cast("string").alias("issue"),
    )


def largest_task(df):
    """Share of the rows in the fullest partition; `df` must really be computed."""
    column = df.columns[-1]
    sizes = df.select(column, F.spark_partition_id().alias("task")).groupBy("task")
    counts = [r.n for r in sizes.agg(F.count("*").alias("n"), F.max(column)).collect()]
    return max(counts) / sum(counts)


def test_crowded_keys_are_split_in_probes(spark, crowded, folder):
    docs = crowded.select("file_name", "file_path", F.col("k").alias("file_hash"))
    seen = book(spark).select(F.col("supplier_name").alias("file_hash"))
    rows = keyed(crowded, "h")
    known = dedup.accepted_history(book(spark))
    index = stage(dedup.history_index(book(spark)), f"{folder}/index")
    for df in (
        copies.new_documents(docs, seen),
        copies.already_seen(docs, seen),
        dedup.duplicates_of_history(rows, index),
        dedup.duplicates_by_key(rows, known),
        # forced run: a third of the rows are copies of one document
        dedup.mark_duplicates(keyed(crowded, "k"), dedup.history_index(book(spark))),
    ):
        wanted = ["file_path"] + [c for c in df.columns if c == "is_duplicate"]
        assert "skew=true" in run_plan(df.select(*wanted))


def test_crowded_groups_stay_spread(spark, crowded):
    docs = crowded.select("file_name", "file_path", F.col("k").alias("file_hash"))
    marked = copies.mark_copies(docs).select("file_path", "is_copy")
    assert marked.where("is_copy").count() == ROWS // 3 - 1
    assert largest_task(marked) < 0.15
    rows = dedup.mark_duplicates(keyed(crowded, "h"), None).select("file_path", "is_duplicate")
    assert rows.where("is_duplicate").count() == ROWS // 3 - 1
    assert largest_task(rows) < 0.15
    admitted = copies.mark_admitted(docs, None).select("file_path", "admitted")
    assert admitted.where("admitted").count() == ROWS - ROWS // 3 + 1
    assert largest_task(admitted) < 0.15


def test_first_of_a_group_is_cut_before_the_shuffle(spark):
    docs = spark.createDataFrame([], "file_name string, file_path string, file_hash string")
    events = spark.createDataFrame([], "file_hash string, processed_at timestamp, run_id string")
    rows = docs.withColumns({"supplier_key": F.col("file_name"), "number_key": F.col("file_path")})
    for df in (
        copies.first_documents(docs),
        latest_events(events),
        dedup.key_owners(rows, None),
    ):
        text = plan(df)
        assert re.search(r"Exchange hashpartitioning[\s\S]*WindowGroupLimit .*Partial", text)


def test_keyed_lookup_shares_one_partitioning(spark):
    """Wanted hashes and the ledger meet on the grouping they already have."""
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        text = plan(QUERIES["ledger_lookup"](spark, SF))
    on_hash = re.findall(r"Exchange hashpartitioning\(file_hash", text)
    assert len(on_hash) <= 2


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"ledger_lifecycle"}))
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def scan_of(text, table):
    """ReadSchema and filters of the scan of one table."""
    lines = [line for line in text.splitlines() if f"{table}.parquet" in line]
    assert lines, text
    return lines


def test_scans_read_what_they_need(spark):
    text = plan(QUERIES["already_seen"](spark, SF))
    for line in scan_of(text, "orders"):
        assert "totalprice" not in line.split("ReadSchema")[1]
    assert any("EqualTo(o_orderstatus,F)" in line for line in scan_of(text, "orders"))
    assert "customer.parquet" not in text
    (line,) = scan_of(plan(QUERIES["content_hash"](spark, SF)), "documents")
    assert line.split("ReadSchema: ")[1].strip() == "struct<doc_id:bigint,text:string>"


def test_texts_are_read_once(spark):
    for name in ("exact_copies", "content_hash", "currency_in_text", "unreadable_documents"):
        assert len(scan_of(plan(QUERIES[name](spark, SF)), "documents")) == 1


def test_point_lookup_reaches_the_scan(spark, folder):
    ledger = Ledger(spark, f"{folder}/ledger")
    text = plan(ledger.get("abc"))
    assert "EqualTo(file_hash,abc)" in text
    assert re.search(r"PartitionFilters: \[.*bucket", text)


def test_small_runs_read_few_buckets_and_compaction_keeps_records(spark, folder):
    ledger = Ledger(spark, f"{folder}/ledger")
    columns = "file_hash string, file_name string, supplier_name string, invoice_number string,"
    columns += "status string, issue_type string, processed_at timestamp"

    def record(run_id, hashes, day):
        at = datetime(2024, 1, day)
        rows = [(f"h{i}", f"n{i}", "s", str(i), "OK", None, at) for i in hashes]
        ledger.append(spark.createDataFrame(rows, columns), run_id)

    record("a", range(0, 200), 1)
    record("b", range(100, 300), 2)
    wanted = spark.createDataFrame([("h5",), ("h150",)], "file_hash string")
    met = batch._events_of(ledger.events(), wanted)
    assert sorted(r.run_id for r in met.collect()) == ["a", "a", "b"]
    assert len({r.bucket for r in met.collect()}) <= 2 < BUCKETS
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan(met).replace("(bucket", "bucket"))
    before = {tuple(r) for r in ledger.current().collect()}
    ledger.compact()
    assert ledger.events().count() == len(before) == 300
    assert {tuple(r) for r in ledger.current().collect()} == before
    assert ledger.recorded("a").count() == 100 and ledger.recorded("b").count() == 200
    record("a", range(0, 200), 3)
    assert ledger.current().count() == 300 and ledger.recorded("a").count() == 300
    assert ledger.get("h150").first().processed_at.day == 3
    ledger.clear()
    assert ledger.events().isEmpty() and ledger.epoch() == 2



def events_of(spark, rows):
    columns = "file_hash string, file_name string, supplier_name string, invoice_number string,"
    return spark.createDataFrame(rows, f"{columns} status string, issue_type string, processed_at timestamp")


def test_key_probe_reads_the_buckets_of_its_keys(spark, folder, monkeypatch):
    """Also of a ledger written before there was a key layout, and not the run's own keys."""
    monkeypatch.setattr(ledgers, "SMALL_RUN", 0)
    ledger = Ledger(spark, f"{folder}/ledger")
    at = datetime(2024, 1, 1)
    rows = [(f"h{i}", f"n{i}", f" S{i % 50} ", str(i % 50), "OK" if i % 3 else "EXCEPTION", None, at) for i in range(300)]
    ledger.append(events_of(spark, rows[:200]), "a")
    ledger.append(events_of(spark, rows[200:]), "b")
    keys = spark.createDataFrame([("s7", "7"), ("s9", "9"), ("s9", "8")], "supplier_key string, number_key string")
    probe = ledger.hashes_of_keys(keys, "b")
    expected = {f"h{i}" for i in range(200) if i % 50 in (7, 9) and i % 3}
    assert {r.file_hash for r in probe.collect()} == expected
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", plan(probe))
    entries = spark.read.parquet(f"{folder}/ledger/keys")
    assert 10 < entries.select("bucket").distinct().count() <= BUCKETS
    shutil.rmtree(f"{folder}/ledger/keys")
    again = Ledger(spark, f"{folder}/ledger")
    assert {r.file_hash for r in again.hashes_of_keys(keys, "b").collect()} == expected


def test_many_small_runs_leave_few_folders(spark, folder):
    ledger = Ledger(spark, f"{folder}/ledger", merge_at=3, grace=0)
    before = ledger.events()
    for n in range(14):
        rows = [(f"h{i}", f"n{i}", "s", str(i), "OK", None, datetime(2024, 1, 1 + n)) for i in range(n, n + 4)]
        ledger.append(events_of(spark, rows), f"run-{n}")
        if n == 5:
            beside = ledger.current()
            seen = {r.file_hash for r in beside.collect()}
    assert before.count() == 0 and len(seen) == 9
    names = [p.name for p in Path(f"{folder}/ledger/events/0").iterdir()]
    assert len(names) <= 1 + 2 * 3 + 3
    assert len(list(Path(f"{folder}/ledger/events/0").glob("*/bucket=*"))) <= 9  # a small run is one file
    latest = {r.file_hash: r.processed_at.day for r in ledger.current().collect()}
    assert latest == {f"h{i}": min(i, 13) + 1 for i in range(17)}
    assert ledger.history().count() == 17
    assert {r.file_hash for r in ledger.recorded("run-2").collect()} == {f"h{i}" for i in range(2, 6)}
    key = spark.createDataFrame([("s", "3")], "supplier_key string, number_key string")
    assert [r.file_hash for r in ledger.hashes_of_keys(key).collect()] == ["h3"]
    # A run that was merged away and is repeated keeps its new rows through further merges.
    ledger.append(events_of(spark, [("h2", "n2", "s", "2", "EXCEPTION", "X", datetime(2024, 3, 1))]), "run-2")
    for n in range(20, 27):
        ledger.append(events_of(spark, [(f"h{n}", f"n{n}", "s", str(n), "OK", None, datetime(2024, 1, n))]), f"run-{n}")
    assert ledger.get("h2").first().issue_type == "X"
    assert {r.documents for r in ledger.stats().where("status = 'TOTAL'").collect()} == {24}


def test_merged_folders_stay_for_jobs_that_read_them(spark, folder):
    ledger = Ledger(spark, f"{folder}/ledger", merge_at=2, grace=3600)
    ledger.append(events_of(spark, [("h1", "n", "s", "1", "OK", None, datetime(2024, 1, 1))]), "a")
    listed = ledger.events()
    ledger.append(events_of(spark, [("h2", "n", "s", "2", "OK", None, datetime(2024, 1, 1))]), "b")
    ledger.append(events_of(spark, [("h3", "n", "s", "3", "OK", None, datetime(2024, 1, 1))]), "c")
    assert [r.file_hash for r in listed.collect()] == ["h1"]
    assert {r.documents for r in ledger.stats().where("status = 'OK'").collect()} == {3}
