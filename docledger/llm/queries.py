"""Each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docledger.llm.bpe import encode_texts
from docledger.llm.common import table
from docledger.llm.conversations import repair_conversations
from docledger.llm.embeddings import near_vectors
from docledger.llm.langid import identify_held_out
from docledger.llm.lm import score_held_out
from docledger.llm.minhash import near_duplicates
from docledger.llm.mixing import mix
from docledger.llm.oracles import ORACLES as ORACLES  # read through this module
from docledger.llm.sharding import shard_documents
from docledger.llm.token_counts import count_tokens
from docledger.llm.topk import top_k
from docledger.llm.toxicity import score_held_out as toxicity_held_out
from docledger.llm.urls import judge
from docledger.llm.whitening import whiten

VOCABULARY = "word_bpe_49k.json"


def op1_language_id(spark, sf_dir):
    return identify_held_out(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("place")


def op4_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def op5_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path(VOCABULARY))


def op6_lm_scores(spark, sf_dir):
    return score_held_out(table(spark, sf_dir, "documents"))


def op7_bpe_encode_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, public_tokenizers.path(VOCABULARY), with_ids=False)


def op8_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_toxicity(spark, sf_dir):
    return toxicity_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mix_sources": op3_mix_sources,
    "op4_url_filters": op4_url_filters,
    "op5_token_counts": op5_token_counts,
    "op6_lm_scores": op6_lm_scores,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_near_vectors": op9_near_vectors,
    "op10_sharding": op10_sharding,
    "op11_toxicity": op11_toxicity,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}
