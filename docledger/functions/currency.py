"""Currency codes from symbols, words and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.text import strip

# Symbols in upper case and the codes they stand for.
CURRENCY_SYMBOLS = {
    "€": "EUR",
    "$": "USD",
    "£": "GBP",
    "¥": "JPY",
    "C$": "CAD",
    "A$": "AUD",
    "FR.": "CHF",
    "CHF": "CHF",
}
CODE_WORD = r"(?U)\b[A-Z]{3}\b"


def clean_currency_text(text: Column) -> Column:
    return F.upper(strip(text))


def normalize_clean_currency(cleaned: Column) -> Column:
    """Symbol, else first three-letter word, else the cleaned text."""
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    word = F.regexp_substr(cleaned, F.lit(CODE_WORD))
    return F.coalesce(F.try_element_at(symbols, cleaned), word, cleaned)


def normalize_currency(text: Column) -> Column:
    """The currency code that `text` stands for; null when it is empty."""
    return F.when(text != "", normalize_clean_currency(clean_currency_text(text)))
