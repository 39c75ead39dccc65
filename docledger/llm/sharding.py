"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard follows from the id and the number of shards alone, without a table. Adding a
shard at the end moves 1/n of the rows, all of them into the new shard.

A null id is an id like any other. A null text has no bytes and no checksum. Repeated rows
share their shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import running_start, staged

#: Fixed values of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
            further = np.floor((shard[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
            inside = further < shards
            moving, further = moving[inside], further[inside]
            shard[moving] = further
    return shard


def shard_column(shards: int, key):
    """The shard of a 64-bit key column."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards), dtype="int32")

    return place(key)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: shard, gapless slot in it, and the shard if there were one more.

    Slots are numbered in two levels (`running_start`), so no task holds a whole shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.xxhash64("doc_id")
    rows = staged(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            shard_column(shards, key).alias("shard"),
            shard_column(shards + 1, key).alias("grown_shard"),
            F.xxhash64(F.lit(shards), F.col("doc_id"), F.col("text")).alias("_place"),
        ),
        "shards",
    )
    counts = rows.groupBy("shard").agg(F.count("*").alias("_rows"))
    return running_start(
        rows.join(F.broadcast(counts), "shard"),  # one row per shard
        ["shard"],
        F.col("_rows"),
        F.col("_place"),
        ["_place"],
        F.lit(1),
    ).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("start").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write whole documents as one folder per shard, by any number of tasks each."""
    docs.withColumn("shard", shard_column(shards, F.xxhash64("doc_id"))).write.partitionBy(
        "shard"
    ).parquet(path)
