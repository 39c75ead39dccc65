"""Seconds per headline query, as one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import docledger  # noqa: E402
from docledger.plans import recipes  # noqa: E402
from docledger.plans.queries import QUERIES  # noqa: E402
from docledger.session import local_session, new_folder  # noqa: E402
from docledger.sources.files import table_documents  # noqa: E402

HEADLINE = (
    "rule_chain",
    "dedup_batch",
    "exact_copies",
    "ledger_upsert",
    "run_summary",
    "assemble_pages",
    "batch_results",
    "text_run_summary",
    "parse_model_json",
    "extract_fields_regex",
    "currency_in_text",
    "dry_run",
)


def run_texts(spark, sf_dir):
    """A complete first run over the documents table, outputs and ledger included."""
    docs = table_documents(recipes.text_documents(spark, sf_dir), "name", "path", "text")
    ledger = docledger.Ledger(spark, new_folder(spark, "bench-ledger"))
    docs = docs.select("file_name", "file_path", "raw_text")
    return docledger.run_batch(docs, ledger, new_folder(spark, "bench-out"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["rule_chain"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    if not sys.argv[1:]:
        start = time.perf_counter()
        run = run_texts(spark, sf_dir)
        seconds["run_batch"] = round(time.perf_counter() - start, 3)
        per_second = round(run.summary["total_scanned"] / seconds["run_batch"], 1)
    else:
        per_second = None
    line = {
        "metric": "total seconds of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(Path(sf_dir).name.removeprefix("sf") or 0),
        "run_batch_docs_per_sec": per_second,
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
