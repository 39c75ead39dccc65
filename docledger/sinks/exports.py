"""CSV and JSON outputs of a run. Every write replaces what its path held before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import amount_text
from docledger.schemas import EXCEPTION, INVOICE

# The CSV dialect of common spreadsheet exports. Rows end with a plain
# newline: with any other ending Spark also rewrites the newlines inside values.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def invoice_csv_columns(invoices: DataFrame) -> DataFrame:
    """The nine output fields as text: ISO dates, two decimals, empty for no due date."""
    return invoices.select(
        "file_name",
        "file_hash",
        "invoice_number",
        "supplier_name",
        F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"),
        F.coalesce(F.date_format("due_date", "yyyy-MM-dd"), F.lit("")).alias("due_date"),
        amount_text(F.col("total_amount")).alias("total_amount"),
        "currency",
        "status",
    )


def json_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON object per row, nulls kept, dates in ISO form."""
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}
    return rows.select(F.to_json(F.struct(*columns), options).alias("value"))


def write_csv(rows: DataFrame, path: str) -> str:
    """A folder of CSV files with a header each; no rows still give one header."""
    rows.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def write_json(rows: DataFrame, path: str) -> str:
    """A folder of JSON Lines files."""
    rows.write.mode("overwrite").options(ignoreNullFields=False, dateFormat="yyyy-MM-dd").json(path)
    return path


def export_invoices_csv(invoices: DataFrame, path: str) -> str:
    return write_csv(invoice_csv_columns(invoices), path)


def export_exceptions_csv(exceptions: DataFrame, path: str) -> str:
    return write_csv(exceptions.select(*EXCEPTION.names), path)


def export_invoices_json(invoices: DataFrame, path: str) -> str:
    return write_json(invoices.select(*INVOICE.names), path)


def export_exceptions_json(exceptions: DataFrame, path: str) -> str:
    return write_json(exceptions.select(*EXCEPTION.names), path)


def export_summary(summary: DataFrame, path: str) -> str:
    """The one-row summary as one JSON object with ISO timestamps."""
    return write_json(summary.coalesce(1), path)


def in_document_order(rows: DataFrame) -> DataFrame:
    """Sort by file name, then path. Spark cuts the sort by ranges of that pair, which
    is unique, so the part files follow each other and no range can overflow."""
    return rows.orderBy("file_name", "file_path")
