"""Incremental document validation, deduplication and routing on PySpark."""

from docledger.plans.batch import BatchRun, dry_run, run_batch
from docledger.sources.ledger import Ledger

__all__ = ["BatchRun", "Ledger", "dry_run", "run_batch"]
