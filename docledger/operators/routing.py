"""Every scanned document to exactly one outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.operators.rules import invoice_columns, with_clean_names
from docledger.schemas import ACCEPTED_STATUSES, EXCEPTION, INVOICE, RESULT

# What the results table says about documents that raised no issue.
MESSAGES = {
    "SKIPPED_CACHED": "Skipped: this content was processed before",
    "OK": "Accepted",
    "FLAGGED": "Accepted, due date needs review",
}


def _duplicate_issue() -> Column:
    return F.struct(
        F.lit("DUPLICATE_INVOICE").alias("issue_type"),
        F.concat(
            F.lit("Invoice '"),
            F.col("clean_number"),
            F.lit("' of '"),
            F.col("clean_supplier"),
            F.lit("' is already in this batch or the ledger"),
        ).alias("details"),
    )


def final_issue() -> Column:
    """The failing rule, else the duplicate finding, else null."""
    return F.coalesce("issue", F.when(F.col("is_duplicate"), _duplicate_issue()))


def route(judged: DataFrame) -> DataFrame:
    """Results of rows that have `admitted`, `issue`, `is_duplicate` and the judged fields.

    One CASE over one pass: the branches cannot overlap and nothing is left out.
    The raw supplier and number ride along for the ledger.
    """
    found = with_clean_names(judged).withColumn("found", F.when(F.col("admitted"), final_issue()))
    invoice = F.struct(*invoice_columns())
    exception = F.struct(
        "file_name",
        "file_hash",
        F.col("found.issue_type").alias("issue_type"),
        F.col("found.details").alias("details"),
    )
    accepted = F.col("admitted") & F.col("found").isNull()
    shaped = found.withColumns(
        {
            "invoice": F.when(accepted, invoice),
            "exception": F.when(F.col("found").isNotNull(), exception),
        }
    )
    status = (
        F.when(~F.col("admitted"), F.lit("SKIPPED_CACHED"))
        .when(F.col("exception").isNotNull(), F.lit("EXCEPTION"))
        .otherwise(F.col("invoice.status"))
    )
    message = F.col("exception.details")
    for name, text in MESSAGES.items():
        message = F.when(F.col("status") == name, F.lit(text)).otherwise(message)
    return shaped.withColumn("status", status).select(
        "file_name",
        "file_path",
        "file_hash",
        "status",
        F.col("invoice").cast(INVOICE).alias("invoice"),
        F.col("exception").cast(EXCEPTION).alias("exception"),
        message.alias("message"),
        F.col("supplier_name").alias("raw_supplier"),
        F.col("invoice_number").alias("raw_number"),
    )


def result_columns(routed: DataFrame) -> DataFrame:
    return routed.select(*RESULT.names)


def accepted_invoices(results: DataFrame) -> DataFrame:
    """The nine invoice fields of every accepted document."""
    return results.where(F.col("status").isin(*ACCEPTED_STATUSES)).select("file_path", "invoice.*")


def exception_queue(results: DataFrame) -> DataFrame:
    return results.where("status = 'EXCEPTION'").select("file_path", "exception.*")


def summarize(results: DataFrame) -> DataFrame:
    """Counters of a run in one row; the last four add up to the first."""

    def counted(status: str, name: str) -> Column:
        return F.count_if(F.col("status") == status).alias(name)

    return results.agg(
        F.count("*").alias("total_scanned"),
        counted("OK", "processed_ok"),
        counted("FLAGGED", "flagged_review"),
        counted("EXCEPTION", "exceptions_count"),
        counted("SKIPPED_CACHED", "skipped_cached"),
    )


def ledger_events(routed: DataFrame) -> DataFrame:
    """What a run records: one event per processed hash, that of the last document.

    Accepted documents record their cleaned names, rejected ones the raw names, and
    documents that gave no record none. `processed_at` is added by the caller.
    """
    accepted = F.col("invoice").isNotNull()
    last = F.struct("file_name", "file_path")
    event = F.struct(
        F.col("file_name"),
        F.when(accepted, F.col("invoice.supplier_name"))
        .otherwise(F.col("raw_supplier"))
        .alias("supplier_name"),
        F.when(accepted, F.col("invoice.invoice_number"))
        .otherwise(F.col("raw_number"))
        .alias("invoice_number"),
        F.col("status"),
        F.col("exception.issue_type").alias("issue_type"),
    )
    return (
        routed.where("status != 'SKIPPED_CACHED'")
        .groupBy("file_hash")
        .agg(F.max_by(event, last).alias("event"))
        .select("file_hash", "event.*")
    )
