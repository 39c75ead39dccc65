"""Texts written out as files: every row is a file, in folders of bounded size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from compare import spark_rows, sql_rows
from docledger.plans import recipes

ROWS = [(1, "a"), (1, "bé"), (1, "a"), (-4, "x\ny"), (None, "no id"), (7, None), (8, "")]


@pytest.mark.parametrize("name", ["scan_files", "scanned_file_hashes"])
def test_rows_of_one_id_and_without_are_files_of_their_own(spark, folder, name):
    table = f"{folder}/documents.parquet"
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(table)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}/*.parquet')")
    found = spark_rows(entry_points.queries()[name](spark, folder))
    assert found == sql_rows(db, entry_points.oracle_sql()[name])


def test_folders_stay_small(spark, folder, monkeypatch):
    monkeypatch.setattr(recipes, "FOLDERS_IN_ONE", 3)
    table = spark.range(20).selectExpr("id doc_id", "'x' text")
    table.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    recipes.write_texts(spark, folder, f"{folder}/texts", "doc_id")
    tops = list((Path(folder) / "texts").iterdir())
    assert sorted(len(list(top.iterdir())) for top in tops) == [2, 3, 3, 3, 3, 3, 3]
    assert all(path.suffix == ".txt" for path in (Path(folder) / "texts").glob("*/*/*"))
