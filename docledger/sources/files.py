"""Documents from a folder of files or from a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docledger.functions.text import file_name
from docledger.sources.stores import (
    Store,
    Unreadable,
    list_files,
    open_store,
    read_file,
    spread_by_size,
)


def name_pattern(suffix: str) -> str:
    """A glob for names that end in `suffix`, in upper or lower case."""
    letters = [f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix]
    return "*" + "".join(letters)


def scan_files(
    spark: SparkSession,
    folder: str,
    suffix: str = ".pdf",
    recursive: bool = True,
    store: Store = open_store,
) -> DataFrame:
    """Every file under `folder` with the suffix, as it is now. A missing folder is an error.

    Names, paths, lengths and times are listed once and written down; contents are read by
    path when a later step asks for them. So a file that goes, changes or cannot be read after
    the scan still is a row and gets an outcome.
    """
    return named_files(list_files(spark, folder, suffix, recursive, store))


def named_files(listing: DataFrame) -> DataFrame:
    return listing.select(
        file_name(F.col("path")).alias("file_name"),
        F.col("path").alias("file_path"),
        "length",
        "modified",
    )


def spark_files(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """The files that Spark's own source lists, with `content`: for stores that only the JVM
    opens. It leaves out names that begin with `_` or `.`, empty files, and those above
    `spark.sql.sources.binaryFile.maxLength`."""
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern(suffix))
        .option("ignoreMissingFiles", "true")
        .load(folder)
        .where(F.col("length") <= limit)
    )
    named = file_name(F.col("path")).alias("file_name")
    return files.select(named, F.col("path").alias("file_path"), "length", "content")


def unread_hash(path: str) -> str:
    """What stands for the hash of a file that cannot be read: such files are no copies."""
    return hashlib.sha256(f"unread:{path}".encode()).hexdigest()


def with_path_hash(docs: DataFrame, store: Store = open_store) -> DataFrame:
    """Add `file_hash` to files that are given by `file_path`, read as streams in tasks."""
    schema = T.StructType([*docs.schema.fields, T.StructField("file_hash", T.StringType())])
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(path: str) -> str:
            try:
                return read_file(store, path, 0)[0]
            except Unreadable:
                return unread_hash(path)

        for batch in batches:
            hashes = pa.array([digest(p) for p in batch.column("file_path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], names.names)

    return spread_by_size(docs).mapInArrow(run, schema)


def with_content_hash(docs: DataFrame, column: str = "content", store: Store = open_store) -> DataFrame:
    """Add `file_hash`, the SHA-256 of the whole content in hex.

    A null text hashes as the empty one. Documents without the column are files, read by path.
    A file that could not be read hashes by its path, so such files are no copies of each other.
    """
    if column == "content" and "content" not in docs.columns:
        return with_path_hash(docs, store)
    absent = F.concat(F.lit("unread:"), "file_path") if column == "content" else F.lit("")
    content = F.coalesce(F.col(column).cast("binary"), absent.cast("binary"))
    return docs.withColumn("file_hash", F.sha2(content, 256))


def table_documents(table: DataFrame, name: str, path: str, text: str) -> DataFrame:
    """Documents whose text is a table column; other columns stay as they are."""
    named = table.withColumns(
        {
            "file_name": F.col(name).cast("string"),
            "file_path": F.col(path).cast("string"),
            "raw_text": F.col(text),
        }
    )
    return with_content_hash(named, "raw_text")
