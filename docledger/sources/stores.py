"""Listing and reading files by path inside tasks, whatever their names and sizes.

Spark's file sources leave out names that begin with `_` or `.` and files without a byte, and
hold a whole content in one value. Here a folder tree is walked in rounds spread over tasks,
and a file is read as a stream, through the file systems that Arrow opens: local and mounted
folders, HDFS, S3, GCS and ABFS. For any other store, pass a function `store` that maps a
path to (file system, path in it); Arrow wraps `fsspec` file systems, for example.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.session import new_folder

Store = Callable[[str], tuple[fs.FileSystem, str]]

#: Names a task lists before it hands folders back for others; bytes read at once.
LISTED, CHUNK = 20_000, 1 << 20
LISTING = "path STRING, length LONG, modified TIMESTAMP, is_folder BOOLEAN"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a qualified path, and the path inside it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^//(?=/)", "", rest)
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's default file system completes it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = given.getFileSystem(spark._jsc.hadoopConfiguration())
    return found.makeQualified(given).toString().rstrip("/")


def _listed(store: Store, folder: str, recursive: bool, budget: int) -> Iterator[tuple]:
    """(path, length, modified, is_folder) of what lies under `folder`.

    Folders that are left when `budget` names have been listed come out as such. A folder
    that is gone by now has nothing in it. Links to folders are not followed.
    """
    system, root = store(folder)
    waiting, seen = [root], 0
    while waiting:
        place = waiting.pop()
        if seen >= budget:
            yield folder + place[len(root) :], None, None, True
            continue
        for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            seen += 1
            if info.type == fs.FileType.File:
                yield folder + info.path[len(root) :], info.size, info.mtime, False
            elif info.type == fs.FileType.Directory and recursive:
                local = isinstance(system, fs.LocalFileSystem)
                if not (local and os.path.islink(info.path)):
                    waiting.append(info.path)


def list_files(
    spark: SparkSession,
    folder: str,
    suffix: str = "",
    recursive: bool = True,
    store: Store = open_store,
    listed: int = LISTED,
) -> DataFrame:
    """Path, length and time of every file under `folder` whose name ends in `suffix`, in any
    case, written down as the files are now.

    Names may begin with `_` or `.`; a name that is nothing but the suffix does not count.
    The walk goes in rounds: a task lists its folders until it has met `listed` names, and the
    folders that are left are dealt out anew. One folder is listed by one task.
    """
    root = qualified(spark, folder)
    try:
        system, path = store(root)
    except (pa.ArrowException, ValueError, OSError) as error:
        raise ValueError(f"Arrow cannot open {root!r}: pass `store`, or use `spark_files`") from error
    if system.get_file_info(path).type != fs.FileType.Directory:
        raise AnalysisException(message=f"[PATH_NOT_FOUND] Input folder does not exist: {root}")
    ending = suffix.lower()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_())
        names = ("path", "length", "modified", "is_folder")

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        rows, budget = [], listed
        for batch in batches:
            for start in batch.column("path").to_pylist():
                for row in _listed(store, start, recursive, max(budget, 1)):
                    budget -= 1
                    name = row[0].rsplit("/", 1)[-1]
                    if row[3] or (name.lower().endswith(ending) and len(name) > len(ending)):
                        rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    base = new_folder(spark, "walk")
    frontier, turn = spark.createDataFrame([(root,)], "path STRING"), 0
    while True:
        target = f"{base}/round={turn}"
        frontier.mapInArrow(walk, LISTING).write.parquet(target)
        left = spark.read.schema(LISTING).parquet(target).filter("is_folder").select("path")
        count = left.count()
        if not count:
            break
        frontier = left.repartition(min(count, 4 * spark.sparkContext.defaultParallelism))
        turn += 1
    found = spark.read.schema(LISTING).option("basePath", base).parquet(base)
    return found.filter("NOT is_folder").select("path", "length", "modified")


def spread_by_size(files: DataFrame, part: int = 128 << 20) -> DataFrame:
    """The rows of a written listing, dealt to tasks of about `part` bytes of contents each."""
    total, rows = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(total // part, rows // 1000, min(rows, files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.repartition(int(tasks), F.xxhash64("file_path"))


class Unreadable(Exception):
    """A file whose content cannot be had; the message says why."""


def read_file(store: Store, path: str, limit: int) -> tuple[str, bytes | None]:
    """SHA-256 of a file in hex and its content, None above `limit` bytes.

    The digest goes over chunks, so a file of any length can be fingerprinted.
    """
    digest, kept, size = hashlib.sha256(), [], 0
    try:
        system, place = store(path)
        with system.open_input_stream(place) as stream:
            while chunk := stream.read(CHUNK):
                digest.update(chunk)
                size += len(chunk)
                if size <= limit:
                    kept.append(chunk)
                else:
                    kept.clear()
    except (OSError, pa.ArrowException) as error:
        raise Unreadable(f"the file cannot be read: {error}") from error
    return digest.hexdigest(), b"".join(kept) if size <= limit else None
