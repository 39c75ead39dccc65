"""Document tables derived from the order and customer tables.

Every order becomes one invoice document. What its fields hold is decided by its key,
so that each rule, layout and duplicate case occurs, and any engine that follows the
same rules sees the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.text import strip
from docledger.sources.stores import open_store, qualified

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")

# Folders that `write_texts` puts into one folder, at most.
FOLDERS_IN_ONE = 1000

# Currency spelling by order key modulo 11.
CURRENCY_SPELLINGS = ("EUR", "€", "usd", "$", "£", "C$", " aud ", "Fr.", "100 CHF", "EUR", "JPY")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _every(n: int) -> Column:
    return F.col("o_orderkey") % n == 0


def order_fields(orders: DataFrame) -> DataFrame:
    """Every invoice field that an order alone determines."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    spelling = F.element_at(
        F.array(*[F.lit(s) for s in CURRENCY_SPELLINGS]), (key % 11 + 1).cast("int")
    )
    invoice_date = (
        F.when(_every(47), "not-a-date")
        .when(_every(53), None)
        .when(key % 4 == 1, F.date_format(day, "dd.MM.yyyy"))
        .when(key % 4 == 2, F.date_format(day, "yyyy/M/d"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    year_end = F.year(day) - F.when(_every(7), 1).otherwise(0)
    return orders.withColumns(
        {
            "seq": key,
            "file_name": F.concat(F.lit("doc_"), F.lpad(key.cast("string"), 9, "0"), F.lit(".pdf")),
            "file_hash": F.sha2(key.cast("string").cast("binary"), 256),
            "invoice_number": F.when(_every(37), "   ")
            .when(_every(41), None)
            .otherwise(F.concat(F.lit(" INV-"), F.date_format(day, "yyyy-MM"))),
            "invoice_date": invoice_date,
            "due_date": F.when(~_every(5), F.concat(year_end.cast("string"), F.lit("-12-31"))),
            "total_amount": F.when(_every(59), None)
            .when(_every(61), -F.col("o_totalprice"))
            .when(_every(67), 0.0)
            .otherwise(F.col("o_totalprice")),
            "currency": spelling,
            "confidence_score": F.when(_every(13), 0.79).otherwise(0.95),
        }
    ).withColumn("file_path", F.concat(F.lit("intake/"), "file_name"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice fields of every order, without the supplier."""
    return order_fields(read(spark, sf_dir, "orders"))


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice fields of every order, the customer being the supplier."""
    named = order_documents(spark, sf_dir).join(
        read(spark, sf_dir, "customer").select("c_custkey", "c_name"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    return named.withColumn("supplier_name", F.when(_every(43), "").otherwise(F.col("c_name")))


def _was_processed(docs: DataFrame) -> DataFrame:
    """Finished orders were processed by earlier runs."""
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "EXCEPTION")
        .when(F.col("o_orderpriority") == "2-HIGH", "FLAGGED")
        .otherwise("OK")
    )
    return docs.where("o_orderstatus = 'F'").withColumns(
        {
            "status": status,
            "issue_type": F.when(status == "EXCEPTION", "LOW_CONFIDENCE"),
            "processed_at": F.col("o_orderdate"),
        }
    )


LEDGER_COLUMNS = (
    "file_hash",
    "file_name",
    "supplier_name",
    "invoice_number",
    "status",
    "issue_type",
    "processed_at",
)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of earlier runs, one per hash."""
    return _was_processed(raw_invoices(spark, sf_dir)).select(*LEDGER_COLUMNS)


def seen_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the hashes of the ledger; needs no customer."""
    return _was_processed(order_documents(spark, sf_dir)).select("file_hash")


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's first events, and a second one a day later for the rejected ones."""
    first = _was_processed(raw_invoices(spark, sf_dir)).select(*LEDGER_COLUMNS)
    # The second event is made from the first row by row: no second read of the orders.
    later = F.struct(
        F.lit("OK").alias("status"),
        F.lit(None).cast("string").alias("issue_type"),
        (F.col("processed_at") + F.expr("INTERVAL 1 DAY")).alias("processed_at"),
        F.lit(2).cast("long").alias("seq"),
    )
    now = F.struct("status", "issue_type", "processed_at", F.lit(1).cast("long").alias("seq"))
    events = F.when(F.col("status") == "EXCEPTION", F.array(now, later)).otherwise(F.array(now))
    return first.withColumn("event", F.explode(events)).select(
        "file_hash", "file_name", "supplier_name", "invoice_number", "event.*"
    )


def label_text(docs: DataFrame) -> DataFrame:
    """`raw_text`: each invoice as a page of labelled lines; a null field has no line."""

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    amount = F.call_function("format_number", F.col("total_amount"), F.lit("#,##0.00"))
    return docs.withColumn(
        "raw_text",
        F.concat_ws(
            "\n",
            F.col("supplier_name"),
            F.lit("INVOICE"),
            line("Invoice Number", strip(F.col("invoice_number"))),
            line("Invoice Date", F.col("invoice_date")),
            line("Due Date", F.col("due_date")),
            line("Currency", strip(F.col("currency"))),
            line("Total Amount", F.concat(amount, F.lit(" "), strip(F.col("currency")))),
        ),
    )


def model_responses(docs: DataFrame) -> DataFrame:
    """`response`: the JSON a model might answer, with every kind of flaw by order key."""
    key = F.col("o_orderkey")

    def text(name: str) -> Column:
        quoted = F.concat(F.lit('"'), F.col(name), F.lit('"'))
        return F.concat(F.lit(f'"{name}":'), F.coalesce(quoted, F.lit("null")))

    amount = F.col("total_amount").cast("string")
    amount_json = (
        F.when(_every(29), F.concat(F.lit('"'), amount, F.lit('"')))
        .when(_every(31), F.lit('"a lot"'))
        .otherwise(amount)
    )
    confidence = (
        F.when(_every(17), F.lit(',"confidence_score":null'))
        .when(_every(19), F.lit(""))
        .when(_every(23), F.lit(',"confidence_score":1.5'))
        .otherwise(F.concat(F.lit(',"confidence_score":'), F.col("confidence_score").cast("string")))
    )
    number = F.when(_every(71), F.lit('"invoice_number":12')).otherwise(text("invoice_number"))
    body = F.concat(
        F.lit("{"),
        F.concat_ws(",", number, text("supplier_name"), text("invoice_date"), text("due_date")),
        F.lit(',"total_amount":'),
        F.coalesce(amount_json, F.lit("null")),
        F.lit(","),
        text("currency"),
        confidence,
        F.lit(',"page":1}'),
    )
    response = (
        F.when(key % 73 == 1, F.lit(""))
        .when(key % 73 == 2, F.lit("null"))
        .when(key % 73 == 3, F.lit("I cannot read this document"))
        .when(key % 73 == 4, F.lit("[1]"))
        .when(key % 73 == 5, F.lit(None))
        .otherwise(body)
    )
    return docs.withColumn("response", response)


def written_dates(orders: DataFrame) -> DataFrame:
    """`text`: each order date in one of the accepted layouts, by order key modulo 14."""
    day = F.col("o_orderdate")
    week = F.format_string(
        "%04d-W%02d-%d",
        F.extract(F.lit("YEAROFWEEK"), day),
        F.extract(F.lit("WEEK"), day),
        F.extract(F.lit("DOW_ISO"), day),
    )
    forms = [
        F.date_format(day, layout)
        for layout in (
            "yyyy-MM-dd",
            "yyyyMMdd",
            "yyyy/M/d",
            "d.M.yyyy",
            "dd/MM/yyyy",
            "MM/dd/yyyy",
            "d-M-yyyy",
            "d MMM yyyy",
            "dd  MMMM yyyy",
            "MMMM d, yyyy",
            "MMM dd, yyyy",
            "MM-dd-yyyy",
        )
    ]
    forms += [week, F.substring(week, 1, 8)]
    place = (F.col("o_orderkey") % len(forms) + 1).cast("int")
    return orders.withColumn("text", F.element_at(F.array(*forms), place))


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table with a name and a path per document."""
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", "text", name.alias("name"), F.concat(F.lit("texts/"), name).alias("path")
    )


def write_texts(spark: SparkSession, sf_dir: str, folder: str, key: str) -> None:
    """Write every row of the documents table as a file of its own, its text and a newline,
    named `part-*.txt`, into a folder `key=ID`.

    Tasks write the files at their places. Spark's partitioned writer would move each of them
    once more on the driver, one after the other, and list all folders there. A file appears
    complete under a name that follows from its row, so a task run again replaces its files.
    """
    root = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt, serial = context.partitionId(), context.taskAttemptId(), 0
        system, place = open_store(root)
        system.create_dir(place)
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "content"))
            for doc_id, content in zip(*columns, strict=True):
                home = f"{place}/{part}-{serial // FOLDERS_IN_ONE}/{key}={doc_id}"
                path = f"{home}/part-{part:05}-{serial}"
                system.create_dir(home)
                with system.open_output_stream(f"{path}.{attempt}") as stream:
                    stream.write(content)
                system.move(f"{path}.{attempt}", f"{path}.txt")
                serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["files"])

    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content")
    rows = read(spark, sf_dir, "documents").select("doc_id", line)
    rows.mapInArrow(write, "files long").write.format("noop").mode("overwrite").save()


def written_id(key: str) -> Column:
    """The id of the document that `write_texts` wrote to `file_path`."""
    return F.regexp_extract("file_path", rf"/{key}=(-?\d+)/".replace(".", r"\."), 1).try_cast("long")
