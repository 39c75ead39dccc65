"""Which documents still need work: byte-identical copies and the ledger probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOCUMENT = ["file_name", "file_path", "file_hash"]


def first_documents(docs: DataFrame) -> DataFrame:
    """One row per hash: the first document by name, then path.

    Spark turns `row_number() = 1` into a group limit before the shuffle, so each
    map task sends one row per hash however many copies it holds.
    """
    order = Window.partitionBy("file_hash").orderBy("file_name", "file_path")
    return (
        docs.select(*DOCUMENT)
        .withColumn("copy_no", F.row_number().over(order))
        .where("copy_no = 1")
        .drop("copy_no")
    )


def mark_copies(docs: DataFrame) -> DataFrame:
    """Add `is_copy`: true for every document whose bytes an earlier one has.

    Two rounds. Inside a hash the rows are first spread over `buckets` by path; the
    first row of each bucket is a candidate, all others are copies for certain. Then
    only the candidates of a hash, at most `buckets` of them, meet to find the first.
    So a hash that holds a third of all documents never lands in one task, and the
    documents are read once.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("file_path"), F.lit(buckets))
    order = ["file_name", "file_path"]
    inside = Window.partitionBy("file_hash", "bucket").orderBy(*order)
    across = Window.partitionBy("file_hash", "round").orderBy(*order)
    candidates = docs.withColumn("bucket", bucket).withColumn(
        "candidate", F.row_number().over(inside) == 1
    )
    ranked = candidates.withColumn(
        "round", F.when(F.col("candidate"), -1).otherwise(F.col("bucket"))
    ).withColumn("place", F.row_number().over(across))
    first = F.col("candidate") & (F.col("place") == 1)
    return ranked.withColumn("is_copy", ~first).drop("bucket", "candidate", "round", "place")


def new_documents(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose hash the ledger does not have. `seen` may repeat hashes."""
    return docs.join(seen.select("file_hash"), "file_hash", "left_anti")


def already_seen(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents whose hash the ledger has, whatever came of them."""
    return docs.join(seen.select("file_hash"), "file_hash", "left_semi")


def admitted_documents(docs: DataFrame, seen: DataFrame | None, force: bool = False) -> DataFrame:
    """Name, path and hash of the documents to process in this run.

    Forced: all. Otherwise the first of each hash, unless the ledger has the hash.
    The copies are taken out first: the probe then joins unique hashes, on the
    partitioning that the grouping left behind.
    """
    if force:
        return docs.select(*DOCUMENT)
    firsts = first_documents(docs)
    return firsts if seen is None else new_documents(firsts, seen).select(*DOCUMENT)


def mark_admitted(docs: DataFrame, seen: DataFrame | None, force: bool = False) -> DataFrame:
    """Add `admitted` to every document."""
    if force:
        return docs.withColumn("admitted", F.lit(True))
    chosen = admitted_documents(docs, seen).select("file_path", F.lit(True).alias("admitted"))
    return docs.join(chosen, "file_path", "left").withColumn(
        "admitted", F.coalesce("admitted", F.lit(False))
    )


def probe_counts(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Dry run: one row with total, new, known documents and expected extractions.

    Identical new files count once each. Documents are counted per hash before
    they meet the ledger, so a hash with many copies travels as one row.
    """
    per_hash = docs.groupBy("file_hash").agg(F.count("*").alias("documents"))
    known = seen.select("file_hash").distinct().withColumn("known", F.lit(True))
    total = F.sum("documents")
    cached = F.sum(F.when(F.col("known"), F.col("documents")).otherwise(0))
    return (
        per_hash.join(known, "file_hash", "left")
        .agg(F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(cached, F.lit(0)).alias("old"))
        .select(
            F.col("total").alias("total_documents"),
            (F.col("total") - F.col("old")).alias("new_documents"),
            F.col("old").alias("already_cached"),
            (F.col("total") - F.col("old")).alias("estimated_api_calls"),
        )
    )
