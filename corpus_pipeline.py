"""A corpus pipeline: identify languages, drop near copies, mix sources, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's
result to the shared folder and hands the written table to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docledger.llm import common, langid
from docledger.llm.bpe import encode_texts
from docledger.llm.minhash import without_near_duplicates
from docledger.llm.mixing import mixed_documents
from docledger.llm.queries import VOCABULARY


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those it rejects go."""
    return langid.recognised(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of their sources needs them."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and round trip of each document of the mix."""
    return encode_texts(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_copy_stage),
    ("mix_sources", mixing_stage),
    ("bpe_encode", encoding_stage),
]

#: Samples by seeded hashes and BPE are beyond SQL; no test runs the stages in sequence yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
