"""From document text to one typed record per document.

Three ways with one output: labels read by regular expressions, stored model
responses, and a user's own extractor. Each adds `record` (the seven fields) and
`extract_error` (null when the record is usable).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docledger.functions.text import is_blank, strip
from docledger.schemas import RAW_EXTRACTION

TEXT_FIELDS = ("invoice_number", "supplier_name", "invoice_date", "due_date", "currency")


@dataclass(frozen=True)
class Extractor:
    """`apply` maps documents to documents with `record` and `extract_error`.

    `native` extractors are Column expressions: cheap enough to run in the scan
    that hashes the text, so the text itself is never shuffled. The others run
    only on documents that the ledger has not seen. `columns` are those it reads
    besides names and text.
    """

    apply: Callable[[DataFrame], DataFrame]
    native: bool
    columns: tuple[str, ...] = ()


def _record(fields: dict[str, Column]) -> Column:
    return F.struct(
        *[fields[f.name].cast(f.dataType).alias(f.name) for f in RAW_EXTRACTION.fields]
    )


def _blank_error() -> Column:
    return F.when(is_blank(F.col("raw_text")), F.lit("The document has no text to extract from"))


# --- stored requests -------------------------------------------------------------------


def build_request(file_name: Column, text: Column) -> Column:
    """The text sent to a model for one document."""
    return F.concat(F.lit("File: "), file_name, F.lit("\n\nText:\n"), text)


# --- labels ----------------------------------------------------------------------------

# The label layout. One label per line, the supplier on the first line.
LABEL_LINE = (
    r"(?im)^[ \t]*(?:invoice (?:number|no\.?|#)|invoice date|due date|currency|total amount)"
    r"[ \t]*:[ \t]*\S[^\r\n]*$"
)
NUMBER_LABELS = ("invoice number", "invoice no", "invoice no.", "invoice #")
FIRST_LINE = r"\S[^\r\n]*"
AMOUNT = r"^(-?[0-9][0-9,]*(?:\.[0-9]+)?)[ \t]*(.*)$"


def with_label_record(docs: DataFrame) -> DataFrame:
    """Add `record` from the labelled lines of `raw_text`; a missing label gives null.

    The first line of each label counts. One pass over the text finds the labelled lines;
    what follows works on those few strings.
    """
    text = F.col("raw_text")
    found = F.regexp_extract_all(text, F.lit(LABEL_LINE), F.lit(0))
    lines = docs.withColumns(
        {
            "_first": strip(F.regexp_substr(text, F.lit(FIRST_LINE))),
            "_lines": F.transform(found, lambda line: F.split(line, ":", 2)),
        }
    ).withColumns(
        {
            "_labels": F.transform("_lines", lambda pair: F.lower(strip(pair[0]))),
            "_values": F.transform("_lines", lambda pair: strip(pair[1])),
        }
    )

    def value(label: str) -> Column:
        place = F.nullif(F.array_position("_labels", F.lit(label)).cast("int"), F.lit(0))
        return F.try_element_at("_values", place)

    labels = {"number": value(NUMBER_LABELS[0]), "amount": value("total amount")}
    found = lines.withColumns({f"_{name}": column for name, column in labels.items()})
    amount = F.regexp_extract("_amount", AMOUNT, 1)
    record = _record(
        {
            "supplier_name": F.col("_first"),
            "invoice_number": F.coalesce("_number", *[value(x) for x in NUMBER_LABELS[1:]]),
            "invoice_date": value("invoice date"),
            "due_date": value("due date"),
            "total_amount": F.translate(amount, ",", "").try_cast("double"),
            "currency": F.coalesce(
                value("currency"),
                F.regexp_substr(F.regexp_extract("_amount", AMOUNT, 2), F.lit(r".+")),
            ),
            "confidence_score": F.lit(1.0),
        }
    )
    return found.withColumn("record", record).select(*docs.columns, "record")


def label_extractor() -> Extractor:
    def apply(docs: DataFrame) -> DataFrame:
        read = with_label_record(docs).withColumn("extract_error", _blank_error())
        usable = F.when(F.col("extract_error").isNull(), F.col("record"))
        return read.withColumn("record", usable)

    return Extractor(apply, native=True)


# --- stored model responses --------------------------------------------------------------

NUMBER_TEXT = r"^\s*(?i:[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan)\s*$"
RESPONSE = ", ".join(f"{name} VARIANT" for name in RAW_EXTRACTION.names) + ", _bad STRING"


def parse_response(docs: DataFrame, response: str) -> DataFrame:
    """Bind a column of JSON responses to the record schema.

    Unknown fields are ignored and absent ones take their default. A response that
    is no JSON object, gives a text field another type, an amount that is no number
    or a confidence outside 0 to 1 (or null) fails as a whole. Variant fields keep
    what the text says: absent is null, JSON null is VOID, and types stay apart.
    """
    parsed = docs.withColumn(
        "_json", F.from_json(response, RESPONSE, {"columnNameOfCorruptRecord": "_bad"})
    )
    body = strip(F.col(response))
    # The parser stops after the first value; as an array the whole text must be one value.
    alone = F.size(F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")) == 1
    is_object = F.col("_json._bad").isNull() & body.startswith("{") & body.endswith("}") & alone

    def field(name: str, dtype: str) -> Column:
        return F.try_variant_get(f"_json.{name}", "$", dtype)

    kinds = {f"_{n}_kind": F.schema_of_variant(f"_json.{n}") for n in RAW_EXTRACTION.names}
    texts = {f"_{n}": field(n, "string") for n in TEXT_FIELDS}
    numbers = {f"_{n}": field(n, "double") for n in ("total_amount", "confidence_score")}
    typed = parsed.withColumns(
        {"_is_object": F.coalesce(is_object, F.lit(False)), **kinds, **texts, **numbers}
    )

    def number(name: str) -> Column:
        quoted = F.col(f"_{name}_kind") == "STRING"
        odd = quoted & ~field(name, "string").rlike(NUMBER_TEXT)
        return F.when(~F.coalesce(odd, F.lit(False)), F.col(f"_{name}"))

    confidence = F.when(F.col("_confidence_score_kind").isNull(), 1.0).otherwise(
        number("confidence_score")
    )
    bound = typed.withColumns({"_amount": number("total_amount"), "_confidence": confidence})
    flaws = [
        F.when(~F.col(f"_{name}_kind").isin("STRING", "VOID"), F.lit(name)) for name in TEXT_FIELDS
    ]
    flaws.append(
        F.when(
            (F.col("_total_amount_kind") != "VOID") & F.col("_amount").isNull(),
            F.lit("total_amount"),
        )
    )
    in_range = F.coalesce(F.col("_confidence").between(0.0, 1.0), F.lit(False))
    flaws.append(F.when(~in_range, F.lit("confidence_score")))
    error = F.when(~F.col("_is_object"), F.lit("The response holds no record")).otherwise(
        F.concat(F.lit("The response has an unusable "), F.coalesce(*flaws))
    )
    fields = {name: F.col(f"_{name}") for name in TEXT_FIELDS}
    fields |= {"total_amount": F.col("_amount"), "confidence_score": F.col("_confidence")}
    usable = F.when(F.col("extract_error").isNull(), _record(fields))
    return bound.withColumn("extract_error", error).select(
        *docs.columns, usable.alias("record"), "extract_error"
    )


def response_extractor(response: str = "response") -> Extractor:
    def apply(docs: DataFrame) -> DataFrame:
        bound = parse_response(docs, response)
        error = F.coalesce(_blank_error(), F.col("extract_error"))
        return bound.withColumn("extract_error", error).withColumn(
            "record", F.when(F.col("extract_error").isNull(), F.col("record"))
        )

    return Extractor(apply, native=True, columns=(response,))


# --- a user's extractor ------------------------------------------------------------------

def custom_extractor(
    factory: Callable[[], Callable[[str, str], dict | None]],
    partitions: int | None = None,
    request: Callable[[Column, Column], Column] | None = None,
) -> Extractor:
    """Run a user's extractor: `factory()` gives a function of text and file name.

    The factory runs once on the driver, where a failure ends the run before anything
    is recorded, and once per task, at its first document, so clients are never pickled;
    a task whose factory fails gives that error for all its documents. The function returns a dict of record fields, or None for a refusal;
    what it raises becomes that document's error and fails nothing else. Its
    answers go through the same binding as stored responses; the text itself is not
    sent back. `request`, such as `build_request`, makes what the function gets in place of
    the text, of file name and text, in the plan. `partitions` spreads the remaining documents evenly, as the new ones
    may sit in a few files.
    """
    if not callable(factory):
        raise TypeError("the extractor factory must be callable")

    def call(batches: Iterator) -> Iterator:
        import json

        import pandas as pd

        extract = broken = None

        def answer(text, name):
            nonlocal extract, broken
            if text is None:
                return None, None
            if broken:
                return None, broken
            if extract is None:
                try:
                    extract = factory()
                except Exception as error:
                    broken = f"The extractor failed: {error}"
                    return None, broken
            try:
                found = extract(text, name)
                if found is None:
                    return None, "The extractor gave no record"
                return json.dumps(found), None
            except Exception as error:
                return None, f"The extractor failed: {error}"

        for batch in batches:
            answers = [answer(t, n) for t, n in zip(batch["raw_text"], batch["file_name"])]
            yield batch.drop(columns="raw_text").assign(
                response=pd.Series([response for response, _ in answers], batch.index, "object"),
                call_error=pd.Series([error for _, error in answers], batch.index, "object"),
            )

    def apply(docs: DataFrame) -> DataFrame:
        factory()
        carried = [field for field in docs.schema.fields if field.name != "raw_text"]
        answered = T.StructType(
            carried
            + [T.StructField("response", T.StringType()), T.StructField("call_error", T.StringType())]
        )
        text = F.col("raw_text") if request is None else request(F.col("file_name"), F.col("raw_text"))
        sent = docs.withColumn("raw_text", F.when(_blank_error().isNull(), text))
        if partitions:
            sent = sent.repartition(partitions, "file_path")
        bound = parse_response(sent.mapInPandas(call, answered), "response")
        blank = F.when(
            F.col("response").isNull() & F.col("call_error").isNull(),
            F.lit("The document has no text to extract from"),
        )
        failure = F.coalesce("call_error", blank, "extract_error")
        return bound.withColumn("extract_error", failure).drop("response", "call_error")

    return Extractor(apply, native=False)
