"""One row per branch of the rule chain, and the order of the branches."""

import math

import pytest
from pyspark.sql import functions as F

from docledger.operators.rules import default_rules, invoice_columns, judge, review_status
from docledger.schemas import RAW_EXTRACTION

CLEAN = {
    "invoice_number": "INV-1",
    "supplier_name": "Acme Ltd",
    "invoice_date": "2024-03-01",
    "due_date": "2024-03-31",
    "total_amount": 100.0,
    "currency": "EUR",
    "confidence_score": 0.95,
}


def judged(spark, rows, **options):
    full = [{**CLEAN, **row} for row in rows]
    data = [tuple(r[n] for n in RAW_EXTRACTION.names) + (i,) for i, r in enumerate(full)]
    df = spark.createDataFrame(data, _schema())
    df = df.withColumns({"file_name": F.lit("a.pdf"), "file_hash": F.lit("h")})
    return judge(df, default_rules(**options)).orderBy("i")


def _schema():
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_EXTRACTION.fields)
    return f"{fields}, i long"


def codes(spark, rows, **options):
    found = judged(spark, rows, **options).select("issue.issue_type").collect()
    return [row.issue_type for row in found]


CASES = [
    ({}, None),
    ({"confidence_score": 0.79}, "LOW_CONFIDENCE"),
    ({"confidence_score": 0.80}, None),
    ({"confidence_score": None}, "LOW_CONFIDENCE"),
    ({"invoice_number": None}, "MISSING_INVOICE_NUMBER"),
    ({"invoice_number": " \t \n"}, "MISSING_INVOICE_NUMBER"),
    ({"supplier_name": ""}, "EXTRACTION_FAILED"),
    ({"supplier_name": None}, "EXTRACTION_FAILED"),
    ({"invoice_date": None}, "MISSING_INVOICE_DATE"),
    ({"invoice_date": "  "}, "MISSING_INVOICE_DATE"),
    ({"invoice_date": "soon"}, "MISSING_INVOICE_DATE"),
    ({"total_amount": 0.0}, "INVALID_AMOUNT"),
    ({"total_amount": -50.0}, "INVALID_AMOUNT"),
    ({"total_amount": None}, "INVALID_AMOUNT"),
    ({"total_amount": math.nan}, None),
    ({"currency": "JPY"}, "UNKNOWN_CURRENCY"),
    ({"currency": "¥"}, "UNKNOWN_CURRENCY"),
    ({"currency": None}, "UNKNOWN_CURRENCY"),
    ({"currency": ""}, "UNKNOWN_CURRENCY"),
    ({"currency": "  "}, "UNKNOWN_CURRENCY"),
    ({"currency": "BITCOIN"}, "UNKNOWN_CURRENCY"),
    ({"currency": "Fr."}, None),
    ({"currency": "usd"}, None),
]


def test_each_rule(spark):
    assert codes(spark, [row for row, _ in CASES]) == [code for _, code in CASES]


def test_first_failing_rule_names_the_issue(spark):
    broken = {
        "confidence_score": 0.1,
        "invoice_number": None,
        "supplier_name": None,
        "invoice_date": "x",
        "total_amount": -1.0,
        "currency": "XYZ",
    }
    rows, current = [], dict(broken)
    for field in broken:
        rows.append(dict(current))
        del current[field]
    assert codes(spark, rows) == [
        "LOW_CONFIDENCE",
        "MISSING_INVOICE_NUMBER",
        "EXTRACTION_FAILED",
        "MISSING_INVOICE_DATE",
        "INVALID_AMOUNT",
        "UNKNOWN_CURRENCY",
    ]


@pytest.mark.parametrize("floor, code", [(0.0, None), (0.95, None), (0.96, "LOW_CONFIDENCE")])
def test_confidence_floor(spark, floor, code):
    assert codes(spark, [{}], confidence_floor=floor) == [code]


def test_details_name_the_facts(spark):
    rows = [{"confidence_score": 0.5}, {"invoice_date": "soon"}, {"total_amount": -50.0}]
    rows.append({"currency": "1 yen"})
    found = judged(spark, rows).select("issue.details").collect()
    confidence, day, amount, currency = (row.details for row in found)
    assert "0.5" in confidence and "0.8" in confidence
    assert "soon" in day and "-50.0" in amount
    assert "1 yen" in currency and "YEN" in currency and "AUD, CAD, CHF, EUR, GBP, USD" in currency


def test_review_flag_and_output_row(spark):
    rows = [
        {},
        {"due_date": None},
        {"due_date": "whenever"},
        {"due_date": "2024-02-29"},
        {"due_date": "2024-03-01"},
        {"invoice_number": "\tINV-2\n", "total_amount": 2.675, "currency": "$"},
    ]
    df = judged(spark, rows)
    assert [r.s for r in df.select(review_status().alias("s")).collect()] == [
        "OK",
        "FLAGGED",
        "FLAGGED",
        "FLAGGED",
        "OK",
        "OK",
    ]
    out = df.select("i", *invoice_columns()).collect()
    assert str(out[3].due_date) == "2024-02-29"  # kept although it caused the flag
    assert (out[5].invoice_number, out[5].total_amount, out[5].currency) == ("INV-2", 2.67, "USD")
