"""Two-decimal amounts, rounded on the exact binary value with ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(amount: Column) -> Column:
    return ~F.isnan(amount) & (F.abs(amount) != float("inf"))


def amount_text(amount: Column) -> Column:
    """`1234.50`. `format_number` rounds the exact value, `format_string` and
    `round` round the shortest decimal and differ on ties such as 2.675."""
    special = F.when(F.isnan(amount), "nan").when(amount > 0, "inf").otherwise("-inf")
    fixed = F.call_function("format_number", amount, F.lit("0.00"))
    return F.when(_finite(amount), fixed).when(amount.isNotNull(), special)


def round_amount(amount: Column) -> Column:
    fixed = F.call_function("format_number", amount, F.lit("0.00"))
    return F.when(_finite(amount), fixed.try_cast("double")).otherwise(amount)
