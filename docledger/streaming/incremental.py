"""Run batches over files as they arrive, with the ledger deciding what is new."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docledger.plans.batch import run_batch
from docledger.session import exists
from docledger.sources.files import named_files
from docledger.sources.ledger import Ledger
from docledger.sources.stores import Store, list_files, open_store

ARRIVAL = "path STRING, length LONG, modified TIMESTAMP"


def note_arrivals(
    spark: SparkSession, folder: str, suffix: str, arrivals: str, store: Store, per_file: int | None
) -> None:
    """Append the files under `folder` that `arrivals`, a Parquet table, does not have.

    A file counts as another one when its length or time has changed.
    """
    found = list_files(spark, folder, suffix, store=store)
    if exists(spark, arrivals):
        known = spark.read.schema(ARRIVAL).parquet(arrivals)
        found = found.join(known, ["path", "length", "modified"], "left_anti")
    writer = found.select("path", "length", "modified").write.mode("append")
    if per_file is not None:
        found = found.repartitionByRange(max(1, -(-found.count() // per_file)), "modified", "path")
        writer = found.write.mode("append").option("maxRecordsPerFile", per_file)
    writer.parquet(arrivals)


def run_arrivals(
    spark: SparkSession,
    folder: str,
    ledger: Ledger,
    output_dir: str,
    checkpoint: str,
    *,
    suffix: str = ".pdf",
    files_per_batch: int | None = None,
    store: Store = open_store,
    **options,
) -> StreamingQuery:
    """Process the files that arrived since the last call, then stop.

    The stream carries names, not contents: new files are noted in a table beside the
    checkpoint, the stream reads that table, and each micro-batch is one run that reads its
    files by path. So a file that is too large, gone, damaged, empty or oddly named gets its
    outcome, and the others of its batch are processed.

    A run is named by the stream's id and the batch number, so a batch that Spark repeats after
    a failure replaces its own outputs and ledger rows. The id is kept in the checkpoint: a
    checkpoint that was deleted and begun again is another stream, and leaves the rows of the
    former one alone. `files_per_batch` splits a backlog into several runs of at most so many
    files, by their times; then the first copy of a document, and the first owner of a key,
    follow the order of arrival, not of file names. The table remembers paths and the ledger
    remembers content: a renamed copy is still skipped.
    """
    checkpoint = checkpoint.rstrip("/")
    noted = f"{checkpoint}-arrivals"
    note_arrivals(spark, folder, suffix, noted, store, files_per_batch)
    reader = spark.readStream.schema(ARRIVAL)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", 1)
    arrivals = reader.parquet(noted)

    def stream_id() -> str:
        return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]

    def process(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{stream_id()}-{batch_id:010d}"
        run_batch(named_files(batch), ledger, output_dir, run_id=run_id, store=store, **options)

    return (
        arrivals.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
