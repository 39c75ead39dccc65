"""Page texts to one text per document, and the decoders that give page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docledger.functions.text import is_blank, page_text
from docledger.sources.files import unread_hash
from docledger.sources.isolate import Failed, Isolated
from docledger.sources.stores import Store, Unreadable, open_store, read_file, spread_by_size


def assemble_pages(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """One row per document from a table of pages: page count and text, in page order.

    The pages of a document are one string and so go to one task, whatever their number.
    """
    page = F.struct(F.col(page_no).alias("page_no"), F.col(text).alias("text"))
    return (
        pages.groupBy(doc)
        .agg(F.array_sort(F.collect_list(page)).alias("pages"))
        .select(
            doc,
            F.size("pages").cast("long").alias("page_count"),
            page_text(F.col("pages.text")).alias("raw_text"),
        )
    )


def unreadable(text: Column) -> Column:
    """Issue code for a document whose decoded text is blank, else null."""
    return F.when(is_blank(text), F.lit("UNREADABLE_PDF"))


_DECODED = [
    T.StructField("pages", T.ArrayType(T.StringType())),
    T.StructField("decoder", T.IntegerType()),
    T.StructField("decode_error", T.StringType()),
]

Decoder = Callable[[bytes], Sequence[str | None]]


#: Seconds that one call of a decoder may take.
DECODE_SECONDS = 600.0
_CONTENT = "spark.sql.sources.binaryFile.maxLength"


def decode(
    docs: DataFrame,
    decoders: Sequence[Decoder],
    seconds: float = DECODE_SECONDS,
    store: Store = open_store,
) -> DataFrame:
    """Decode each file with the first decoder that gives at least one page.

    A decoder takes the bytes of one file and returns its page texts. Whatever it
    raises, or no pages at all, hands the file to the next one; only when all fail
    does the row carry `decode_error`. Decoders run in a child process of the task, so one
    that hangs for `seconds` or takes its process down has failed like any other, and a bad
    file never fails a task. `decoder` is the position of the one that succeeded.

    `docs` has `content`, or its files are read by `file_path`: then each is read once, one at
    a time, and its `file_hash` is added; content above the limit of Spark's binary source
    (`spark.sql.sources.binaryFile.maxLength`) is hashed but not decoded.
    """
    if not decoders:
        raise ValueError("at least one decoder is needed")
    chain = list(decoders)
    by_path = "content" not in docs.columns
    limit = int(docs.sparkSession.conf.get(_CONTENT))
    carried = [field for field in docs.schema.fields if field.name not in ("content", "file_hash" if by_path else "")]
    hashed = [T.StructField("file_hash", T.StringType())] if by_path else []
    schema = T.StructType(carried + hashed + _DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isolated = Isolated(chain, seconds)

        def first_pages(content):
            if content is None:
                return None, None, "the file is gone or above the size limit"
            errors = []
            for place in range(len(chain)):
                try:
                    pages = isolated.call(place, bytes(content))
                    if pages:
                        return pages, place, None
                    errors.append("no pages")
                except Failed as error:
                    errors.append(str(error))
            return None, None, "; ".join(errors)

        def decoded(path):
            try:
                digest, content = read_file(store, path, limit)
            except Unreadable as error:
                return unread_hash(path), None, None, str(error)
            if content is None:
                return digest, None, None, f"the file is above the size limit of {limit} bytes"
            return digest, *first_pages(content)

        try:
            for batch in batches:
                columns = [batch.column(field.name) for field in carried]
                # A row at a time: what is held is one file, and the pages of one.
                for at in range(batch.num_rows):
                    if by_path:
                        digest, *found = decoded(batch.column("file_path")[at].as_py())
                        found = [digest, *found]
                    else:
                        found = first_pages(batch.column("content")[at].as_py())
                    added = [pa.array([v], kind) for v, kind in zip(found, kinds, strict=True)]
                    own = [column.slice(at, 1) for column in columns]
                    yield pa.RecordBatch.from_arrays(own + added, schema.names)
        finally:
            isolated.close()

    kinds = [field.type for field in to_arrow_schema(T.StructType(hashed + _DECODED))]
    chain = [_listing(decoder) for decoder in chain]
    rows = spread_by_size(docs) if by_path and "length" in docs.columns else docs
    return rows.mapInArrow(run, schema)


def _listing(decoder: Decoder) -> Callable[[bytes], list]:
    return lambda content: list(decoder(content))


def read_text(decoded: DataFrame) -> DataFrame:
    """From page texts to `raw_text`, `page_count` and `unreadable_details`."""
    text = decoded.withColumns(
        {
            "raw_text": page_text(F.col("pages")),
            "page_count": F.coalesce(F.size("pages"), F.lit(0)).cast("long"),
        }
    )
    details = F.when(
        F.col("decode_error").isNotNull(),
        F.concat(F.lit("Cannot read "), F.col("file_name"), F.lit(": "), F.col("decode_error")),
    ).when(
        is_blank(F.col("raw_text")), F.concat(F.lit("No text in "), F.col("file_name"))
    )
    return text.withColumn("unreadable_details", details).drop("pages", "decode_error")
