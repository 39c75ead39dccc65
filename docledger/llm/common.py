"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docledger.session import new_folder, stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the folder all executors share and go on from the written table."""
    return stage(df, new_folder(df.sparkSession, label))


#: Bytes of a table that may be sent to every executor; larger ones are joined by shuffle.
SENT_BYTES = 32 << 20


def sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, marked for broadcast if its counted rows stay within `SENT_BYTES`. Stage it first."""
    return F.broadcast(df) if df.count() * row_bytes <= SENT_BYTES else df


def give_back() -> None:
    """Return memory that Arrow and, where it can be told to, the C library keep for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function):
    """Hand back, when a task ends, the memory it held; workers live on."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % by, F.lit(0))


def running_start(
    df: DataFrame, group: list[str], rows_in_group: Column, spread: Column, order: list, size: Column
) -> DataFrame:
    """Add `start`: the sum of `size` over the rows before this one in its group.

    A group is laid out as about sqrt(rows) buckets of about sqrt(rows) rows each, by
    `spread`, a well mixed integer. Totals of buckets are summed up first, rows inside a
    bucket second, so no task ever holds a crowded group. `df` is read twice: stage it.
    Rows that are equal in all of `order` must be interchangeable. Groups are never null.
    """
    buckets = F.ceil(F.sqrt(rows_in_group.cast("double"))).cast("long")
    df = df.withColumn("_bucket", F.pmod(spread, F.greatest(buckets, F.lit(1))))
    df = df.withColumn("_size", size.cast("long"))
    keys = [*group, "_bucket"]
    earlier = (Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum("_size").alias("_total"))
    across = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(*earlier)
    offsets = totals.select(
        *keys, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
    start = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    return df.join(offsets, keys).withColumn("start", start).drop("_bucket", "_size", "_offset")
