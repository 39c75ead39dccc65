"""Duplicates by supplier and invoice number, against history and inside a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.functions.keys import KEY, with_keys
from docledger.schemas import ACCEPTED_STATUSES

DEDUP_MODES = ("hash", "key", "off")


def accepted_history(ledger: DataFrame, *carried: str) -> DataFrame:
    """Keys and hashes of accepted ledger rows. Blank keys never enter history."""
    accepted = ledger.where(F.col("status").isin(*ACCEPTED_STATUSES))
    keyed = with_keys(accepted).where("supplier_key != '' AND number_key != ''")
    return keyed.select(*KEY, "file_hash", *carried)


def history_index(ledger: DataFrame) -> DataFrame:
    """Per key the number of known hashes, the lowest and the highest.

    `ledger` has one row per hash, so a plain count is the distinct count. A row
    is a duplicate unless all known hashes equal its own, and two bounds tell
    that as well as the set would, at a fixed size per key.
    """
    return accepted_history(ledger).groupBy(*KEY).agg(
        F.count("*").alias("n_hashes"),
        F.min("file_hash").alias("min_hash"),
        F.max("file_hash").alias("max_hash"),
    )


def duplicates_of_history(keyed: DataFrame, index: DataFrame) -> DataFrame:
    """Rows whose key history has under some other hash.

    `index` is a history index, one row per key however many hashes a key has. Staged,
    it and the rows reach the join straight from a shuffle, which is what lets adaptive
    execution split a key that holds a large share of the rows.
    """
    own = F.col("d.file_hash")
    return keyed.alias("d").join(
        index.alias("h"),
        (F.col("d.supplier_key") == F.col("h.supplier_key"))
        & (F.col("d.number_key") == F.col("h.number_key"))
        & ((own != F.col("h.min_hash")) | (own != F.col("h.max_hash"))),
        "left_semi",
    )


def duplicates_by_key(keyed: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Rows whose key is among `known_keys`, whatever their hash."""
    return keyed.join(known_keys.select(*KEY), KEY, "left_semi")


def key_owners(passing: DataFrame, history: DataFrame | None) -> DataFrame:
    """Per key the one hash that may be accepted.

    Without history that is the hash of the first row by name and path; with one
    known hash it is that hash; with several there is none and the key drops out.
    """
    order = Window.partitionBy(*KEY).orderBy("file_name", "file_path")
    firsts = (
        passing.select(*KEY, "file_hash", "file_name", "file_path")
        .withColumn("place", F.row_number().over(order))
        .where("place = 1")
        .select(*KEY, "file_hash")
    )
    if history is None:
        return firsts
    owner = F.when(F.col("min_hash").isNull(), F.col("file_hash")).when(
        F.col("min_hash") == F.col("max_hash"), F.col("min_hash")
    )
    return (
        firsts.join(history.select(*KEY, "min_hash", "max_hash"), KEY, "left")
        .select(*KEY, owner.alias("file_hash"))
        .where("file_hash IS NOT NULL")
    )


def mark_duplicates(
    judged: DataFrame,
    history: DataFrame | None = None,
    mode: str = "hash",
    competes: str = "issue IS NULL",
) -> DataFrame:
    """Add `is_duplicate` to rows that carry `KEY`, name, path and hash.

    Only rows that meet `competes` can own a key or be a duplicate: a rejected or
    skipped copy must not own it. In `hash` mode the owner of a key is found by a grouping that
    keeps one row per key and map task, and goes back over key *and* hash, so the
    rows of a crowded key stay spread over the cluster. `judged` is read twice;
    pass a staged table.
    """
    if mode not in DEDUP_MODES:
        raise ValueError(f"dedup mode must be one of {DEDUP_MODES}, not {mode!r}")
    if mode == "off":
        return judged.withColumn("is_duplicate", F.lit(False))
    if mode == "key":
        return _mark_known_keys(judged, history, competes)
    owners = key_owners(judged.where(competes), history).withColumn("owns", F.lit(True))
    joined = judged.join(owners, [*KEY, "file_hash"], "left")
    lost = F.expr(competes) & F.col("owns").isNull()
    return joined.withColumn("is_duplicate", lost).drop("owns")


def _mark_known_keys(judged: DataFrame, history: DataFrame | None, competes: str) -> DataFrame:
    """Key-only check: known key means duplicate, the hash and the batch do not matter."""
    if history is None:
        return judged.withColumn("is_duplicate", F.lit(False))
    known = duplicates_by_key(judged, history)
    fresh = judged.join(history.select(*KEY), KEY, "left_anti")
    return known.withColumn("is_duplicate", F.expr(competes)).unionByName(
        fresh.withColumn("is_duplicate", F.lit(False))
    )
