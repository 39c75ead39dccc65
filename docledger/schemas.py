"""Declared schemas. Every reader gets one of these; nothing is inferred."""

from pyspark.sql import types as T

# Codes and field names that appear in the stored tables.
ACCEPTED_STATUSES = ("OK", "FLAGGED")
STATUSES = ("OK", "FLAGGED", "EXCEPTION", "SKIPPED_CACHED")
ISSUE_TYPES = (
    "MISSING_INVOICE_NUMBER",
    "INVALID_AMOUNT",
    "UNKNOWN_CURRENCY",
    "MISSING_INVOICE_DATE",
    "LOW_CONFIDENCE",
    "DUPLICATE_INVOICE",
    "EXTRACTION_FAILED",
    "UNREADABLE_PDF",
)
ALLOWED_CURRENCIES = ("EUR", "USD", "GBP", "CAD", "AUD", "CHF")
DEFAULT_CONFIDENCE_FLOOR = 0.80


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _D = T.StringType(), T.DoubleType()

RAW_EXTRACTION = _struct(
    invoice_number=_S,
    supplier_name=_S,
    invoice_date=_S,
    due_date=_S,
    total_amount=_D,
    currency=_S,
    confidence_score=_D,
)

# What an extractor said about a document: a record, or why there is none.
ANSWER = _struct(
    file_path=_S,
    file_hash=_S,
    record=RAW_EXTRACTION,
    failure=_struct(issue_type=_S, details=_S),
)

INVOICE = _struct(
    file_name=_S,
    file_hash=_S,
    invoice_number=_S,
    supplier_name=_S,
    invoice_date=T.DateType(),
    due_date=T.DateType(),
    total_amount=_D,
    currency=_S,
    status=_S,
)

EXCEPTION = _struct(file_name=_S, file_hash=_S, issue_type=_S, details=_S)

RESULT = _struct(
    file_name=_S,
    file_path=_S,
    file_hash=_S,
    status=_S,
    invoice=INVOICE,
    exception=EXCEPTION,
    message=_S,
)

# One event per document and run. In the ledger `batch` and `bucket` are directory columns.
LEDGER_EVENT = _struct(
    file_hash=_S,
    file_name=_S,
    supplier_name=_S,
    invoice_number=_S,
    status=_S,
    issue_type=_S,
    processed_at=T.TimestampType(),
)
LEDGER = T.StructType(
    LEDGER_EVENT.fields
    + [T.StructField(n, T.StringType()) for n in ("run_id", "batch")]
    + [T.StructField("bucket", T.IntegerType())]
)

# One row per accepted event, by the bucket of its invoice key.
LEDGER_KEY = _struct(supplier_key=_S, number_key=_S, file_hash=_S, run_id=_S)
LEDGER_KEYS = T.StructType(
    [*LEDGER_KEY.fields, T.StructField("batch", _S), T.StructField("bucket", T.IntegerType())]
)

RUN_SUMMARY = _struct(
    total_scanned=T.LongType(),
    processed_ok=T.LongType(),
    flagged_review=T.LongType(),
    exceptions_count=T.LongType(),
    skipped_cached=T.LongType(),
    started_at=T.TimestampType(),
    completed_at=T.TimestampType(),
    duration_seconds=_D,
    output_files=T.MapType(_S, _S),
)
