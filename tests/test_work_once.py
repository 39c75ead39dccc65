"""Work that a run must not do over again, and how its stages are compiled."""

import pytest
from pyspark.sql import functions as F

from docledger.schemas import LEDGER_EVENT
from docledger.session import HUGE_METHOD, split_stages
from docledger.sources.ledger import Ledger


def test_append_makes_its_events_once(spark, folder):
    made, n = spark.sparkContext.accumulator(0), 12_000

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    values = {"file_hash": F.sha2(F.col("id").cast("string"), 256), "status": F.lit("OK")}
    values |= {"supplier_name": F.lit("s"), "invoice_number": F.col("id").cast("string")}
    columns = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_EVENT.fields
    ]
    events = spark.range(n).select(*columns)
    book = Ledger(spark, f"{folder}/ledger")
    book.append(events.mapInArrow(count, events.schema), "r")
    assert made.value == n
    assert book.events().count() == n and book.events().select("file_hash").distinct().count() == n


def test_a_sessions_own_limit_comes_back(spark):
    given = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, "65535")
    try:
        with pytest.raises(ValueError), split_stages(spark):
            assert spark.conf.get(HUGE_METHOD) == "8000"
            raise ValueError
        assert spark.conf.get(HUGE_METHOD) == "65535"
    finally:
        spark.conf.set(HUGE_METHOD, given)
