"""File scan, hashing, page assembly and decoders."""

import hashlib
import os
import time
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from docledger.sources import files, pages, stores


def test_scan_finds_the_suffix_in_any_case_and_depth(spark, folder):
    root = Path(folder)
    names = ["a.pdf", "sub/B.PDF", "sub/deep/c d.Pdf", "100%20.pdf", "é.pdf"]
    names += [".hidden.pdf", "_x.pdf", ".dir/y.pdf", "_tmp/_deep/z.pdf", "none.pdf"]
    for name in [*names, "x.txt", "sub/pdf", ".pdf", "sub/.PDF"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "none.pdf" else name.encode())
    (root / "folder.pdf").mkdir()
    (root / "sub" / "round").symlink_to(root)
    scanned = files.scan_files(spark, folder)
    found = {r.file_name: r for r in files.with_content_hash(scanned).collect()}
    assert set(found) == {Path(name).name for name in names} and scanned.count() == len(names)
    for name in names:
        row, content = found[Path(name).name], (root / name).read_bytes()
        assert row.file_hash == hashlib.sha256(content).hexdigest()
        assert row.length == len(content) and row.file_path == f"file:{root / name}"
    top = files.scan_files(spark, folder, recursive=False)
    assert {r.file_name for r in top.collect()} == {n for n in names if "/" not in n}
    with pytest.raises(AnalysisException):
        files.scan_files(spark, f"{folder}/missing").collect()


def test_walk_in_many_rounds(spark, folder):
    """Tasks that may list few names hand folders back; nothing is lost or met twice."""
    expected = set()
    for i in range(30):
        place = Path(folder) / f"{i % 3}" / f"{i}" / "deep"
        place.mkdir(parents=True)
        for j in range(i % 4):
            (place / f"{j}.pdf").write_text("x")
            expected.add(f"file:{place / f'{j}.pdf'}")
    found = [r.path for r in stores.list_files(spark, folder, ".pdf", listed=3).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_scan_reads_no_content(spark, folder):
    (Path(folder) / "a.pdf").write_bytes(b"x")
    scanned = files.scan_files(spark, folder)
    (Path(folder) / "a.pdf").unlink()
    assert [(r.file_name, r.length) for r in scanned.collect()] == [("a.pdf", 1)]
    assert files.with_content_hash(scanned).first().file_hash == files.unread_hash(f"file:{folder}/a.pdf")


def test_files_of_any_size_are_hashed_in_pieces(folder):
    path, content = Path(folder) / "big", bytes(range(256)) * 20_000
    path.write_bytes(content)
    digest, kept = stores.read_file(stores.open_store, f"file:{path}", 1 << 20)
    assert digest == hashlib.sha256(content).hexdigest() and kept is None
    assert stores.read_file(stores.open_store, f"file:{path}", len(content))[1] == content


def test_unknown_stores_are_refused_with_advice(spark, folder):
    def closed(path):
        raise ValueError("no such scheme")

    with pytest.raises(ValueError, match="spark_files"):
        files.scan_files(spark, folder, store=closed)
    (Path(folder) / "a.pdf").write_bytes(b"x")
    assert [bytes(r.content) for r in files.spark_files(spark, folder).collect()] == [b"x"]


def test_decoders_that_hang_or_die_cost_one_row(spark, folder):
    def risky(content):
        if content == b"hang":
            time.sleep(600)
        if content == b"die":
            os._exit(9)
        return [content.decode()]

    def careful(content):
        return ["second"] if content == b"die" else []

    for name in ("fine", "hang", "die", "last"):
        (Path(folder) / f"{name}.pdf").write_text(name)
    docs = files.scan_files(spark, folder).coalesce(1)
    found = {r.file_name[:-4]: r for r in pages.decode(docs, [risky, careful], seconds=1.5).collect()}
    assert found["fine"].pages == ["fine"] and found["last"].pages == ["last"]
    assert found["hang"].pages is None and "1.5 seconds" in found["hang"].decode_error
    assert (found["die"].pages, found["die"].decoder) == (["second"], 1)
    alone = pages.decode(docs.where("file_name = 'die.pdf'"), [risky], seconds=5).first()
    assert "code 9" in alone.decode_error
    for name, row in found.items():
        assert row.file_hash == hashlib.sha256(name.encode()).hexdigest()


PAGES = [(1, 2, " b"), (1, 0, "\n a"), (1, 1, None), (2, 0, "  "), (3, 0, "x"), (3, 11, "y")]
PAGES += [(4, i, f"p{i}") for i in range(25)]


def test_assemble_pages(spark):
    df = spark.createDataFrame(PAGES, "doc int, no int, text string").repartition(3)
    whole = {r.doc: r for r in pages.assemble_pages(df, "doc", "no", "text").collect()}
    assert whole[1].raw_text == "a\n\n\n\n b" and whole[1].page_count == 3
    assert whole[2].raw_text == "" and whole[3].raw_text == "x\n\ny"
    assert whole[4].raw_text == "\n\n".join(f"p{i}" for i in range(25))
    assert len(whole) == df.select("doc").distinct().count()


def test_decoders_fall_back_and_errors_stay_rows(spark):
    def first(content):
        if content.startswith(b"crash"):
            raise ValueError("not my format")
        return [] if content.startswith(b"empty") else [content.decode()]

    def second(content):
        if content.endswith(b"!"):
            raise ValueError("nor mine")
        return [None, "second", ""]

    contents = [b"fine", b"crash", b"empty", b"crash!", b" \n "]
    rows = [(f"{i}.pdf", f"p/{i}", bytearray(c)) for i, c in enumerate(contents)]
    docs = spark.createDataFrame(rows, "file_name string, file_path string, content binary")
    read = pages.read_text(pages.decode(docs, [first, second])).orderBy("file_path").collect()
    fine, crash, empty, broken, blank = read
    assert (fine.raw_text, fine.decoder, fine.page_count) == ("fine", 0, 1)
    assert (crash.raw_text, crash.decoder, crash.page_count) == ("second", 1, 3)
    assert empty.decoder == 1 and fine.unreadable_details is None
    assert "not my format" in broken.unreadable_details and "nor mine" in broken.unreadable_details
    assert "4.pdf" in blank.unreadable_details
    with pytest.raises(ValueError):
        pages.decode(docs, [])


def test_unreadable(spark):
    df = spark.createDataFrame([("x",), ("\xa0\n",), (None,)], "t string")
    codes = [r.c for r in df.select(pages.unreadable(F.col("t")).alias("c")).collect()]
    assert codes == [None, "UNREADABLE_PDF", "UNREADABLE_PDF"]
