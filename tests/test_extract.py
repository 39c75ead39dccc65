"""Labels, stored responses and custom extractors."""

import json

import pytest
from pyspark.sql import functions as F

from docledger.operators.extract import (
    build_request,
    custom_extractor,
    label_extractor,
    parse_response,
    response_extractor,
)

SAMPLE = """Halden Paper Works
INVOICE #: 20/118-b
Due Date: 2021-12-20
Invoice Date: 2021-11-05
Total Amount: 2,640.75 GBP
Due Date: 1998-02-03"""


def test_labels(spark):
    texts = [
        SAMPLE,
        "\n  Beta GmbH \r\nInvoice Number:  B-7 \r\ncurrency: $\r\nTOTAL AMOUNT: -75\r\nDue Date:\r\n",
        "Just a letter: no labels",
        " \n",
        None,
    ]
    rows = [(i, f"{i}.txt", f"p/{i}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "i int, file_name string, file_path string, raw_text string")
    found = label_extractor().apply(docs).orderBy("i").collect()
    first, second, third, blank, missing = found
    assert tuple(first.record) == (
        "20/118-b",
        "Halden Paper Works",
        "2021-11-05",
        "2021-12-20",
        2640.75,
        "GBP",
        1.0,
    )
    assert tuple(second.record) == ("B-7", "Beta GmbH", None, None, -75.0, "$", 1.0)
    assert third.record.supplier_name == "Just a letter: no labels"
    assert third.record.invoice_number is None and third.extract_error is None
    for row in (blank, missing):
        assert row.record is None and "no text" in row.extract_error


FULL = {
    "invoice_number": "1",
    "supplier_name": "A",
    "invoice_date": "2024-01-01",
    "due_date": None,
    "total_amount": 5,
    "currency": "EUR",
    "confidence_score": 0.5,
}


def response(**changes):
    return json.dumps({**FULL, **changes})


RESPONSES = [
    (response(), ("1", "A", "2024-01-01", None, 5.0, "EUR", 0.5)),
    (response(note={"currency": 1}, total_amount=12.25), ("1", "A", "2024-01-01", None, 12.25, "EUR", 0.5)),
    ("{}", (None, None, None, None, None, None, 1.0)),
    (' {"invoice_number": "é\\n"} ', ("é\n", None, None, None, None, None, 1.0)),
    (response(total_amount="12.5"), ("1", "A", "2024-01-01", None, 12.5, "EUR", 0.5)),
    (response(total_amount=None), ("1", "A", "2024-01-01", None, None, "EUR", 0.5)),
    (response(total_amount=12345678901234567890), ("1", "A", "2024-01-01", None, 1.2345678901234567e19, "EUR", 0.5)),
    (response(confidence_score=1), ("1", "A", "2024-01-01", None, 5.0, "EUR", 1.0)),
    (response(total_amount="12.5d"), "total_amount"),
    (response(total_amount="a lot"), "total_amount"),
    (response(total_amount=[1]), "total_amount"),
    (response(total_amount={"eur": 1}), "total_amount"),
    (response(invoice_number=12), "invoice_number"),
    (response(currency=["EUR"]), "currency"),
    (response(due_date=False), "due_date"),
    (response(confidence_score=None), "confidence_score"),
    (response(confidence_score=1.5), "confidence_score"),
    (response(confidence_score=-0.1), "confidence_score"),
    (response(confidence_score="high"), "confidence_score"),
    ("null", "no record"),
    ("[1]", "no record"),
    ("[" + response() + "]", "no record"),
    ('"text"', "no record"),
    ("I cannot help", "no record"),
    (response()[:-1], "no record"),
    (response() + " and more", "no record"),
    (response() + response(), "no record"),
    (response() + ", " + response(), "no record"),
    ("", "no record"),
    (None, "no record"),
]


def test_responses(spark):
    rows = [(i, text) for i, (text, _) in enumerate(RESPONSES)]
    docs = spark.createDataFrame(rows, "i int, response string")
    found = parse_response(docs, "response").orderBy("i").collect()
    for row, (text, expected) in zip(found, RESPONSES):
        if isinstance(expected, tuple):
            assert row.extract_error is None, text
            assert tuple(row.record) == expected, text
        else:
            assert row.record is None, text
            assert expected in row.extract_error, text


def test_blank_text_fails_before_its_response_counts(spark):
    docs = spark.createDataFrame([(" ", response()), ("x", response())], "raw_text string, response string")
    blank, good = response_extractor().apply(docs).collect()
    assert blank.record is None and "no text" in blank.extract_error
    assert good.record.invoice_number == "1" and good.extract_error is None


def test_custom_extractor(spark):
    def factory():
        built = []

        def extract(text, name):
            built.append(1)
            if "refuse" in text:
                return None
            if "crash" in text:
                raise RuntimeError("line down")
            if not text.strip():
                raise AssertionError("blank text must not get here")
            return {"invoice_number": name, "total_amount": float(len(text)), "other": 1}

        return extract

    texts = ["abc", "refuse", "crash", " ", None]
    rows = [(f"{i}.txt", f"p/{i}", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "file_name string, file_path string, raw_text string")
    extractor = custom_extractor(factory, partitions=3)
    assert not extractor.native
    good, refused, crashed, blank, missing = extractor.apply(docs).orderBy("file_path").collect()
    assert (good.record.invoice_number, good.record.total_amount) == ("0.txt", 3.0)
    assert good.record.confidence_score == 1.0 and good.extract_error is None
    assert "no record" in refused.extract_error
    assert "line down" in crashed.extract_error
    assert "no text" in blank.extract_error and "no text" in missing.extract_error
    with pytest.raises(TypeError):
        custom_extractor(None)


def test_request(spark):
    df = spark.createDataFrame([("a.pdf", "body")], "n string, t string")
    request = df.select(build_request(F.col("n"), F.col("t")).alias("r")).first().r
    assert "a.pdf" in request and request.endswith("body")
