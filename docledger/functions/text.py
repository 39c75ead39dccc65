"""String helpers: strip, blank test, file names, page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode or ASCII counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def strip(text: Column) -> Column:
    """Strip Unicode white space. Spark's `trim` alone removes only the space."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Null, empty or white space only. Stops at the first visible character."""
    return F.coalesce(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def file_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_suffix(name: Column) -> Column:
    """Lower-case suffix with its dot. A dot that starts or ends the name makes none."""
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1))


def join_pages(pages: Column) -> Column:
    """Pages joined by a blank line; a page without text counts as empty."""
    return F.array_join(F.transform(pages, lambda page: F.coalesce(page, F.lit(""))), "\n\n")


def page_text(pages: Column) -> Column:
    """The text of a whole document: its pages joined, then stripped."""
    return strip(join_pages(pages))
