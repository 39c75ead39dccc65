"""Outcome counts of one run over the invoices at sf0.01, worked out beforehand."""

from pyspark.sql import functions as F

from docledger.operators import copies, dedup, rules
from docledger.plans import recipes
from docledger.plans.batch import judge_documents, route_documents
from docledger.schemas import RAW_EXTRACTION

SF = "/root/testdata/sf0.01"
EXPECTED = {
    "SKIPPED_CACHED": 5000,
    "OK": 4588,
    "FLAGGED": 2078,
    "LOW_CONFIDENCE": 769,
    "UNKNOWN_CURRENCY": 717,
    "MISSING_INVOICE_NUMBER": 468,
    "DUPLICATE_INVOICE": 456,
    "INVALID_AMOUNT": 383,
    "MISSING_INVOICE_DATE": 339,
    "EXTRACTION_FAILED": 202,
}


def test_outcome_counts(spark):
    raw = recipes.raw_invoices(spark, SF)
    place = F.col("seq") % 10
    status = F.when(place == 0, "EXCEPTION").when(place == 1, "FLAGGED").otherwise("OK")
    book = raw.where("seq % 3 = 0").withColumn("status", status)
    docs = raw.select(
        *copies.DOCUMENT,
        F.struct(*RAW_EXTRACTION.names).alias("record"),
        F.lit(None).cast("struct<issue_type: string, details: string>").alias("failure"),
    )
    marked = copies.mark_admitted(judge_documents(docs, rules.default_rules()), book)
    results = route_documents(marked, dedup.history_index(book), "hash")
    outcome = F.coalesce("exception.issue_type", "status").alias("outcome")
    counts = {r.outcome: r["count"] for r in results.groupBy(outcome).count().collect()}
    assert counts == EXPECTED
