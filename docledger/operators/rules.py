"""Ordered checks on an extracted record. The first failing check names the issue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import round_amount
from docledger.functions.currency import clean_currency_text, normalize_clean_currency
from docledger.functions.dates import with_parsed_dates
from docledger.functions.text import is_blank, strip
from docledger.schemas import ALLOWED_CURRENCIES, DEFAULT_CONFIDENCE_FLOOR


@dataclass(frozen=True)
class Rule:
    issue_type: str
    fails: Column
    details: Column


def with_clean_names(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "clean_number": strip(F.col("invoice_number")),
            "clean_supplier": strip(F.col("supplier_name")),
        }
    )


def normalize(raw: DataFrame) -> DataFrame:
    """Add the cleaned and parsed forms that the rules and the output need."""
    cleaned = with_clean_names(raw).withColumn(
        "clean_currency", clean_currency_text(F.col("currency"))
    )
    code = F.when(F.col("currency") != "", normalize_clean_currency(F.col("clean_currency")))
    coded = cleaned.withColumn("currency_code", code).drop("clean_currency")
    return with_parsed_dates(coded, parsed_date="invoice_date", parsed_due_date="due_date")


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("none"))


def default_rules(confidence_floor: float = DEFAULT_CONFIDENCE_FLOOR) -> list[Rule]:
    """The six record checks, in contract order, over the columns of `normalize`."""
    confidence, amount = F.col("confidence_score"), F.col("total_amount")
    allowed = ", ".join(sorted(ALLOWED_CURRENCIES))
    return [
        Rule(
            "LOW_CONFIDENCE",
            confidence.isNull() | (confidence < F.lit(float(confidence_floor))),
            F.concat(
                F.lit("Confidence "),
                _shown(confidence.cast("string")),
                F.lit(f" is under the floor of {confidence_floor}"),
            ),
        ),
        Rule(
            "MISSING_INVOICE_NUMBER",
            F.coalesce("clean_number", F.lit("")) == "",
            F.lit("The record has no invoice number"),
        ),
        Rule(
            "EXTRACTION_FAILED",
            F.coalesce("clean_supplier", F.lit("")) == "",
            F.lit("The record has no supplier name"),
        ),
        Rule(
            "MISSING_INVOICE_DATE",
            is_blank(F.col("invoice_date")),
            F.lit("The record has no invoice date"),
        ),
        Rule(
            "MISSING_INVOICE_DATE",
            F.col("parsed_date").isNull(),
            F.concat(F.lit("No calendar date in '"), F.col("invoice_date"), F.lit("'")),
        ),
        Rule(
            "INVALID_AMOUNT",
            amount.isNull() | (amount <= 0),
            F.concat(F.lit("Amount must be above 0.00, found "), _shown(amount.cast("string"))),
        ),
        Rule(
            "UNKNOWN_CURRENCY",
            F.coalesce(~F.col("currency_code").isin(*ALLOWED_CURRENCIES), F.lit(True)),
            F.concat(
                F.lit("Currency '"),
                _shown(F.col("currency")),
                F.lit("' (read as '"),
                _shown(F.col("currency_code")),
                F.lit(f"') is none of {allowed}"),
            ),
        ),
    ]


def first_issue(rules: Sequence[Rule]) -> Column:
    """One CASE chain: struct of issue_type and details, null when every rule passes.

    CASE stops at the first match, so later predicates never see the rows that an
    earlier one rejected. A plain AND would not promise that.
    """
    chain = None
    for rule in rules:
        found = F.struct(F.lit(rule.issue_type).alias("issue_type"), rule.details.alias("details"))
        chain = F.when(rule.fails, found) if chain is None else chain.when(rule.fails, found)
    return chain


def judge(raw: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Normalise `raw` and add `issue`, the first failing rule of each row."""
    rules = default_rules() if rules is None else rules
    return normalize(raw).withColumn("issue", first_issue(rules))


def review_status() -> Column:
    """FLAGGED when the due date is missing, unreadable or before the invoice date."""
    due = F.col("parsed_due_date")
    return F.when(due.isNull() | (due < F.col("parsed_date")), "FLAGGED").otherwise("OK")


def invoice_columns() -> list[Column]:
    """The nine fields of an accepted row, from the columns of `normalize`."""
    return [
        F.col("file_name"),
        F.col("file_hash"),
        F.col("clean_number").alias("invoice_number"),
        F.col("clean_supplier").alias("supplier_name"),
        F.col("parsed_date").alias("invoice_date"),
        F.col("parsed_due_date").alias("due_date"),
        round_amount(F.col("total_amount")).alias("total_amount"),
        F.col("currency_code").alias("currency"),
        review_status().alias("status"),
    ]
