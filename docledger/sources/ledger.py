"""The ledger: an append-only Parquet event log with a latest-per-hash view.

Layout under the ledger path:

    epochs/                       one tiny row per clear or compaction; the highest is current
    events/EPOCH/batch=R/bucket=B/    what run R recorded of the hashes of bucket B
    keys/EPOCH/batch=R/bucket=B/      hashes of its accepted invoices, by bucket of the invoice key
    merges/EPOCH/                 which folders were written into which
    answers/run_id=R/             what an extractor said in a run that is not over

A run writes its own folder, so writing it again after a failure replaces it. A run
or a lookup of few hashes reads only their buckets, and of the current epoch only; so does a
run of few invoice keys. Runs of few documents write one file, in a bucket for all (`MIXED`).
Clearing and compacting start a new epoch, in a folder of a new name, and delete nothing
that a running job may be reading.

When an epoch has `merge_at` folders of one generation, the run that finds them writes their
rows as one folder of the next, so a ledger of many small runs keeps a number of folders that
grows with the logarithm of the runs. The merged folders stay for `grace` seconds, for jobs
that have listed them: until then their events are there twice, which no reader minds, as
events are taken by hash and time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from docledger.functions.keys import KEY
from docledger.operators.dedup import accepted_history, history_index
from docledger.schemas import LEDGER, LEDGER_EVENT, LEDGER_KEY, LEDGER_KEYS
from docledger.session import folder_times, new_folder, remove, stage

# Fixed for the life of a ledger: the folder of a hash follows from it.
BUCKETS = 64
# Where runs of at most so many documents put them, whatever their hashes and keys.
MIXED, SMALL_RUN = -1, 10_000
# The folder of compacted events and the beginnings of merged ones; no run id is like these.
COMPACTED = "~compacted"
MERGED = "~merged-"
MERGES = "merged STRING, into STRING, at DOUBLE"


def bucket_of(file_hash: Column) -> Column:
    return F.pmod(F.crc32(file_hash.cast("binary")), F.lit(BUCKETS)).cast("int")


def key_bucket_of() -> Column:
    return bucket_of(F.concat_ws("\x1f", *KEY))


def latest_events(events: DataFrame, order: Sequence[str] = ("processed_at", "run_id")) -> DataFrame:
    """Last event per hash, every column from that one event.

    The `= 1` filter becomes a group limit ahead of the shuffle: one row per hash
    leaves each map task, so a hash with very many events stays cheap.
    """
    newest = Window.partitionBy("file_hash").orderBy(*[F.desc(c) for c in order])
    ranked = events.withColumn("age", F.row_number().over(newest))
    return ranked.where("age = 1").drop("age")


def status_counts(ledger: DataFrame) -> DataFrame:
    """Rows per status and a TOTAL row, which an empty ledger has too."""
    counts = ledger.groupBy("status").agg(F.count("*").alias("documents"))
    total = counts.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"))
    return counts.unionByName(total.withColumn("status", F.lit("TOTAL")))


def lookup(hashes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger row of each distinct hash in `hashes`, nulls where there is none.

    `ledger` comes grouped by hash, so grouping the wanted hashes the same way lets
    the two meet without another shuffle, and repeats cannot pile up.
    """
    return hashes.select("file_hash").distinct().join(ledger, "file_hash", "left")


class Ledger:
    """The ledger kept under `path` on a shared file system, made if it is not there."""

    def __init__(self, spark: SparkSession, path: str, merge_at: int = 32, grace: float = 86_400) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.merge_at, self.grace = merge_at, grace
        self._create()

    @property
    def _epochs(self) -> str:
        return f"{self.path}/epochs"

    @property
    def _events(self) -> str:
        return f"{self.path}/events"

    @property
    def _keys(self) -> str:
        return f"{self.path}/keys"

    def _create(self) -> None:
        if folder_times(self.spark, self._epochs) and folder_times(self.spark, f"{self._keys}/{self._current().folder}"):
            return
        known = folder_times(self.spark, f"{self._events}/0")
        self._prepare("0")
        self._add_epoch(0, "0", mode="ignore")
        if known:
            self._add_keys(self._current().folder)

    def _add_keys(self, folder: str) -> None:
        """The key layout of a ledger that was written before there was one."""
        self.spark.createDataFrame([], LEDGER_KEY).write.mode("ignore").parquet(f"{self._keys}/{folder}/batch=0/bucket=0")
        events = self.spark.read.schema(LEDGER).parquet(f"{self._events}/{folder}")
        self._write_part(self._keys, accepted_history(events, "run_id"), folder, COMPACTED, False)

    def _prepare(self, folder: str) -> None:
        """An empty file, so that a folder without runs can be read."""
        empty = self.spark.createDataFrame([], LEDGER_EVENT).withColumn("run_id", F.lit("0"))
        empty.write.mode("ignore").parquet(f"{self._events}/{folder}/batch=0/bucket=0")
        keys = self.spark.createDataFrame([], LEDGER_KEY)
        keys.write.mode("ignore").parquet(f"{self._keys}/{folder}/batch=0/bucket=0")

    def _add_epoch(self, number: int, folder: str, mode: str) -> None:
        row = self.spark.range(number, number + 1, 1, 1).toDF("epoch")
        row.withColumn("folder", F.lit(folder)).write.mode(mode).parquet(self._epochs)

    def _current(self) -> Row:
        """The current epoch: one row from a table of one row per clear or compaction."""
        epochs = self.spark.read.schema("epoch LONG, folder STRING").parquet(self._epochs)
        return epochs.agg(F.max(F.struct("epoch", "folder")).alias("last")).first().last

    def epoch(self) -> int:
        return self._current().epoch

    def _all(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self._events}/{self._current().folder}")

    def events(self) -> DataFrame:
        """All events of the current epoch, as listed now: a snapshot for this run."""
        return self._all().drop("batch")

    def recorded(self, run_id: str) -> DataFrame:
        """What a run recorded; reads the run's own folder, the merged and the compacted ones."""
        place = (F.col("batch") == run_id) | F.col("batch").contains("~")
        return self._all().where(place & (F.col("run_id") == run_id)).drop("batch")

    def current(self) -> DataFrame:
        return latest_events(self.events()).drop("run_id", "bucket")

    def seen(self) -> DataFrame:
        """Hashes with any event, repeats included: enough for semi and anti joins."""
        return self.events().select("file_hash")

    def history(self) -> DataFrame:
        return history_index(self.current())

    def get(self, file_hash: str) -> DataFrame:
        """The record of one hash, or no row. Both equalities reach the Parquet scan."""
        here = (F.col("bucket") == bucket_of(F.lit(file_hash))) | (F.col("bucket") == MIXED)
        wanted = here & (F.col("file_hash") == file_hash)
        return latest_events(self.events().where(wanted)).drop("run_id", "bucket")

    def hashes_of_keys(self, keys: DataFrame, run_id: str | None = None) -> DataFrame:
        """Hashes that any accepted event but those of `run_id` gave one of `keys`.

        For keys that are few enough to be sent to every executor: it reads their buckets of
        the key layout, at most as many as there are.
        """
        wanted = keys.select(*KEY).distinct()
        buckets = [row[0] for row in wanted.select(key_bucket_of()).distinct().collect()]
        entries = self.spark.read.schema(LEDGER_KEYS).parquet(f"{self._keys}/{self._current().folder}")
        entries = entries.where(F.col("bucket").isin([*buckets, MIXED]))
        if run_id is not None:
            entries = entries.where(F.col("run_id") != run_id)
        return entries.join(F.broadcast(wanted), KEY, "left_semi").select("file_hash").distinct()

    def append(self, events: DataFrame, run_id: str) -> None:
        """Record a run. Files are cut by bucket and hash range, so a lookup skips most of them.

        The keys are written first: a key whose event is missing finds nothing, while an event
        whose key is missing would not be found.
        """
        # Cutting by ranges reads its input twice, for keys and for events: it is made once.
        work = new_folder(self.spark, "append")
        rows = stage(events.select(*LEDGER_EVENT.names).withColumn("run_id", F.lit(run_id)), work)
        folder = self._current().folder
        merged = self._merged(folder)
        again = merged is not None and not merged.where(F.col("merged") == run_id).isEmpty()
        # The name of a merged folder is not used again.
        batch = f"{run_id}~{uuid.uuid4().hex}" if again else run_id
        self._write(rows, folder, batch, rows.limit(SMALL_RUN + 1).count() <= SMALL_RUN)
        remove(self.spark, work)
        self._merge(folder)

    def _merged(self, folder: str) -> DataFrame | None:
        """One row per merged folder: its name, where its rows are now, and since when."""
        path = f"{self.path}/merges/{folder}"
        return self.spark.read.schema(MERGES).parquet(path) if folder_times(self.spark, path) else None

    def _write(self, rows: DataFrame, folder: str, batch: str, small: bool) -> None:
        self._write_part(self._keys, accepted_history(rows, "run_id"), folder, batch, small)
        self._write_part(self._events, rows, folder, batch, small)

    def _write_part(self, table: str, rows: DataFrame, folder: str, batch: str, small: bool) -> None:
        keyed = table == self._keys
        bucket, order = (key_bucket_of(), KEY) if keyed else (bucket_of(F.col("file_hash")), ["file_hash"])
        rows = rows.withColumn("bucket", F.lit(MIXED) if small else bucket)
        rows = rows.coalesce(1) if small else rows.repartitionByRange("bucket", *order)
        (
            rows.sortWithinPartitions("bucket", *order)
            .write.partitionBy("bucket")
            .option("partitionOverwriteMode", "static")
            .option("parquet.bloom.filter.enabled#file_hash", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .mode("overwrite")
            .parquet(f"{table}/{folder}/batch={batch}")
        )

    def _merge(self, folder: str) -> None:
        """Write generations that have `merge_at` folders as one folder of the next.

        The new folder is complete before any merged one goes, and those only go after
        `grace` seconds, so jobs beside this one always find every event. Two merges at once
        leave events twice, which does no harm.
        """
        place = f"{self._events}/{folder}"
        names = {n.removeprefix("batch=") for n in folder_times(self.spark, place) if n.startswith("batch=")}
        names -= {"0", COMPACTED}
        if len(names) < self.merge_at:
            return
        merged, gone = self._merged(folder), {}
        if merged is not None:
            # Of folders that are still there: bounded by the runs of `grace` seconds.
            gone = {r.merged: r.at for r in merged.where(F.col("merged").isin(list(names))).collect()}
        for name, at in gone.items():
            if time.time() - at >= self.grace:
                remove(self.spark, f"{place}/batch={name}")
                remove(self.spark, f"{self._keys}/{folder}/batch={name}")
        generations: dict[int, list[str]] = {}
        for name in sorted(names - set(gone)):
            generations.setdefault(_generation(name), []).append(name)
        for generation, ready in sorted(generations.items()):
            if len(ready) >= self.merge_at:
                into = f"{MERGED}{generation + 1}-{uuid.uuid4().hex}"
                rows = self._all().where(F.col("batch").isin(ready)).select(*LEDGER_EVENT.names, "run_id")
                self._write(rows, folder, into, rows.limit(SMALL_RUN + 1).count() <= SMALL_RUN)
                done = self.spark.createDataFrame([(n, into, time.time()) for n in ready], MERGES)
                done.coalesce(1).write.mode("append").parquet(f"{self.path}/merges/{folder}")

    def stats(self) -> DataFrame:
        return status_counts(self.current())

    def clear(self) -> None:
        """Forget everything by starting a new epoch."""
        self._begin(None)

    def compact(self) -> None:
        """Start a new epoch with the last event of each hash, in few files.

        Events keep the id of their run, so a run may still be repeated. Not to be called
        while a run is under way: what it appends to the former epoch would not be seen.
        """
        self._begin(latest_events(self.events()).select(*LEDGER_EVENT.names, "run_id"))

    def _begin(self, events: DataFrame | None) -> None:
        """The epoch counts once its row is there; a broken attempt leaves an unused folder."""
        number = self.epoch() + 1
        folder = f"{number}-{uuid.uuid4().hex}"
        self._prepare(folder)
        if events is not None:
            self._write(events, folder, COMPACTED, False)
        self._add_epoch(number, folder, mode="append")


def _generation(batch: str) -> int:
    """0 for what a run wrote, and one more for each merge."""
    return int(batch.removeprefix(MERGED).split("-")[0]) if batch.startswith(MERGED) else 0
