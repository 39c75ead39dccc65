"""Scalar functions against the standard library."""

import calendar
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from docledger.functions.amounts import amount_text, round_amount
from docledger.functions.currency import normalize_currency
from docledger.functions.dates import parse_date
from docledger.functions.text import file_name, file_suffix, is_blank, page_text, strip


def column(spark, values, dtype, expression):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i long, x {dtype}").repartition(4)
    out = df.select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(out, key=lambda r: r.i)]


def test_strip_agrees_with_python_on_every_space(spark):
    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    values = [f"{c}a{c}b{c}{c}" for c in spaces] + ["", " ", "​ x", "﻿x", None]
    expected = [v.strip() if v is not None else None for v in values]
    assert column(spark, values, "string", strip) == expected
    blank = [v is None or not v.strip() for v in values + spaces]
    assert column(spark, values + spaces, "string", is_blank) == blank


DATES = {
    "2024-01-15": date(2024, 1, 15),
    "20240115": date(2024, 1, 15),
    "2024-W03-1": date(2024, 1, 15),
    "2024W031": date(2024, 1, 15),
    "2024-W03": date(2024, 1, 15),
    "2020-W53-7": date(2021, 1, 3),
    "2024/1/5": date(2024, 1, 5),
    "15.01.2024": date(2024, 1, 15),
    "05/01/2024": date(2024, 1, 5),
    "01/15/2024": date(2024, 1, 15),
    "15-01-2024": date(2024, 1, 15),
    "15 jan 2024": date(2024, 1, 15),
    "15  Jan 2024": date(2024, 1, 15),
    "15 JANUARY 2024": date(2024, 1, 15),
    "may 5, 2024": date(2024, 5, 5),
    "  March 5, 2024\n": date(2024, 3, 5),
    "29.02.2024": date(2024, 2, 29),
    "2024-W53-1": None,
    "2024-W00-1": None,
    "2024-W03-8": None,
    "2024W03-1": None,
    "2024-1-5": None,
    "2024-01-15T00:00:00": None,
    "01-15-2024": None,
    "15.01.24": None,
    "31/02/2024": None,
    "29.02.2023": None,
    "15 Sept 2024": None,
    "March 5,2024": None,
    "0000-01-01": None,
    "2024": None,
    "2024-01": None,
    "not-a-date": None,
    "": None,
    " \t": None,
    None: None,
}


def test_date_layouts(spark):
    assert column(spark, list(DATES), "string", parse_date) == list(DATES.values())


def test_written_dates_are_read_back(spark):
    """Dates written in a known layout, from numbers that need not make a date."""
    rng = random.Random(7)

    def day_of(year, month, day):
        try:
            return date(year, month, day)
        except ValueError:
            return None

    def written():
        y, m, d = rng.choice([1, 1987, 2023, 2024, 9999]), rng.randint(1, 13), rng.randint(1, 32)
        name = rng.choice([calendar.month_name, calendar.month_abbr])[min(m, 12)]
        name = rng.choice([name, name.upper(), name.lower()])
        own, named = day_of(y, m, d), day_of(y, min(m, 12), d)
        return rng.choice(
            [
                (f"{y:04}-{m:02}-{d:02}", own),
                (f"{y:04}{m:02}{d:02}", own),
                (f" {y:04}/{m}/{d}\n", own),
                (f"{d}.{m:02}.{y:04}", own),
                (f"{d:02}-{m}-{y:04}", own),
                (f"{d}/{m}/{y:04}", own or day_of(y, d, m)),
                (f"{d} {name} {y:04}", named),
                (f"{name} {d:02}, {y:04}", named),
                (f"{d}.{m}.{y % 100:02}", None),
                (f"{y:04}-{m:02}", None),
                (f"the {d}.{m}.{y:04}", None),
            ]
        )

    samples = [written() for _ in range(6000)]
    found = column(spark, [text for text, _ in samples], "string", parse_date)
    wrong = [(text, e, f) for (text, e), f in zip(samples, found) if e != f]
    assert wrong == []
    weeks = [(y, w, k) for y in (2020, 2021, 2024) for w in (1, 9, 52) for k in (1, 4, 7)]
    found = column(spark, [f"{y}-W{w:02}-{k}" for y, w, k in weeks], "string", parse_date)
    assert found == [date.fromisocalendar(*week) for week in weeks]


@pytest.mark.parametrize(
    "text, code",
    [
        ("€", "EUR"),
        ("$", "USD"),
        ("£", "GBP"),
        ("¥", "JPY"),
        ("C$", "CAD"),
        ("a$", "AUD"),
        ("Fr.", "CHF"),
        (" usd ", "USD"),
        ("100 EUR", "EUR"),
        ("THE EURO", "THE"),
        ("BITCOIN", "BITCOIN"),
        ("éur eur", "EUR"),
        ("   ", ""),
        ("", None),
        (None, None),
    ],
)
def test_currency(spark, text, code):
    assert column(spark, [text], "string", normalize_currency) == [code]


def test_amounts_round_like_python(spark):
    rng = random.Random(3)
    values = [2.675, 1.005, 0.125, 0.375, 0.005, 2.665, -75.0, -0.004, 1e7, 123456.785, 1e15]
    values += [rng.randrange(10**9) / 1000 for _ in range(3000)]
    values += [rng.random() * 10 ** rng.randrange(9) for _ in range(3000)]
    assert column(spark, values, "double", amount_text) == [f"{v:.2f}" for v in values]
    assert column(spark, values, "double", round_amount) == [round(v, 2) for v in values]
    odd = column(spark, [float("nan"), float("inf"), None], "double", round_amount)
    assert math.isnan(odd[0]) and odd[1:] == [float("inf"), None]
    assert column(spark, [float("nan"), float("-inf"), None], "double", amount_text) == [
        "nan",
        "-inf",
        None,
    ]


def test_file_names(spark):
    paths = ["file:/a/b c.PDF", "x.tar.gz", "/a/.pdf", "/a/noext", "/a/dot."]
    names = column(spark, paths, "string", file_name)
    assert names == ["b c.PDF", "x.tar.gz", ".pdf", "noext", "dot."]
    assert column(spark, names, "string", file_suffix) == [".pdf", ".gz", "", "", ""]


def test_page_text(spark):
    pages = [["\n a", None, "b "], ["", " "], [], None]
    assert column(spark, pages, "array<string>", page_text) == ["a\n\n\n\nb", "", "", None]
