"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# The JVM never compiles methods above 8000 bytes; with this, Spark splits stages that need more.
HUGE_METHOD, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("docledger")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(HUGE_METHOD, COMPILED_BYTES)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="docledger-")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/docledger/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write `df` once and go on from the written table.

    A stage read several times costs narrow column scans instead of a second
    hashing, decoding or model call, and a lost executor costs one task instead
    of the whole lineage.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def split_stages(spark: SparkSession) -> Iterator[None]:
    """Let what runs in the block be compiled, also in a session that keeps Spark's own limit.

    Dates and rules make one method of more bytes than the JVM compiles: interpreted, they
    take several times as long. Nothing but speed depends on it.
    """
    given = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, given)


def _file_system(spark: SparkSession, path: str):
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()), given


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another name on its file system, in one step where that has renames."""
    system, place = _file_system(spark, source)
    goal = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(goal.getParent())
    if not system.rename(place, goal):
        raise OSError(f"cannot move {source} to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def folder_times(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a folder that holds few of them, and when each was last changed, in seconds
    since 1970; none if the folder is not there."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in system.listStatus(place)}
