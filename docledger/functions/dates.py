"""Dates written as text, in the layouts that suppliers use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.text import strip

# Accepted layouts in order of preference, day before month. The
# guards keep out what Spark's formatter would take but the contract refuses
# (missing zeros in ISO dates, two-digit years, the year 0000, days after 9999-12-31,
# trailing text).
_YEAR = r"(?!0000)\d{4}"
ISO_DATE = rf"^{_YEAR}-\d\d-\d\d$"
ISO_WEEK = rf"^(?!9999-?W52-?[67]){_YEAR}(-W\d\d(-[1-7])?|W\d\d[1-7]?)$"
DATE_LAYOUTS = (
    (rf"^{_YEAR}\d{{4}}$", ("yyyyMMdd",)),
    (rf"^{_YEAR}/\d\d?/\d\d?$", ("yyyy/M/d",)),
    (rf"^\d\d?\.\d\d?\.{_YEAR}$", ("d.M.yyyy",)),
    (rf"^\d\d?/\d\d?/{_YEAR}$", ("d/M/yyyy", "M/d/yyyy")),
    (rf"^\d\d?-\d\d?-{_YEAR}$", ("d-M-yyyy",)),
    (rf"^\d\d? [A-Za-z]+ {_YEAR}$", ("d MMM yyyy", "d MMMM yyyy")),
    (rf"^[A-Za-z]+ \d\d?, {_YEAR}$", ("MMMM d, yyyy", "MMM d, yyyy")),
)


def _iso_week_date(text: Column) -> Column:
    """`2024-W03-2`, `2024W032` or without the day, which then is Monday.

    Week 1 is the week of 4 January. A week number that the year does not have gives
    a date in another week, and that gives it away.
    """
    digits = F.rpad(F.translate(text, "-W", ""), 7, "1")
    year, week, day = (
        F.substring(digits, start, length).try_cast("int")
        for start, length in ((1, 4), (5, 2), (7, 1))
    )
    monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    found = F.date_add(monday, week * 7 + day - 8)
    return F.when(F.weekofyear(found) == week, found)


def clean_date_text(text: Column) -> Column:
    """Stripped, with runs of white space as one space.

    The runs only matter for the layouts with a month name: the others have no space
    and fail on any.
    """
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def parse_clean_date(cleaned: Column) -> Column:
    """First layout that yields a calendar date wins; otherwise null."""
    found = F.when(cleaned.rlike(ISO_DATE), cleaned.try_cast("date")).when(
        cleaned.rlike(ISO_WEEK), _iso_week_date(cleaned)
    )
    for guard, layouts in DATE_LAYOUTS:
        dates = [F.try_to_date(cleaned, layout) for layout in layouts]
        found = found.when(cleaned.rlike(guard), F.coalesce(*dates))
    return found


def parse_date(text: Column) -> Column:
    return parse_clean_date(clean_date_text(text))


def with_parsed_dates(df: DataFrame, **columns: str) -> DataFrame:
    """Add a parsed date per `new=source` pair.

    The cleaned texts get a projection of their own, so that the many tests on them
    do not clean the text again each time.
    """
    cleaned = {f"_{new}": clean_date_text(F.col(source)) for new, source in columns.items()}
    parsed = {new: parse_clean_date(F.col(f"_{new}")) for new in columns}
    return df.withColumns(cleaned).withColumns(parsed).drop(*cleaned)
