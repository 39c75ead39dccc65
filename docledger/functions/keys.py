"""The key under which two documents count as the same invoice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import strip

KEY = ["supplier_key", "number_key"]


def key_part(text: Column) -> Column:
    return F.lower(strip(text))


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "supplier_key": key_part(F.col("supplier_name")),
            "number_key": key_part(F.col("invoice_number")),
        }
    )
