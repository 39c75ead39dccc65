"""Token counts with a shortcut for words that are one token.

Offline, every vocabulary string with a word end is encoded alone; those that come out as
one token are counted wherever a pre-token equals them. Only the other pre-tokens are
merged, once for each distinct one a Python worker meets; what it remembers is bounded.

A null text counts as an empty one. Repeated rows are counted alike; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docledger.llm.common import tidy
from docledger.llm.pretokens import END_OF_WORD, Splitter, Vocabulary, spelled

#: Distinct merged words a worker remembers; beyond that it forgets all and goes on.
REMEMBERED = 200_000
_merged: dict[str, int] = {}


def merger(source: str):
    """Number of tokens of a spelled pre-token, by the merges of the vocabulary."""
    model = Tokenizer.from_str(source).model
    return lambda letters: len(model.tokenize(letters))


def whole_tokens(vocabulary: Vocabulary) -> set[str]:
    """The spelled pre-tokens that the merges turn into exactly one token."""
    count = merger(vocabulary.source)
    ends = (t.removesuffix(END_OF_WORD) for t in vocabulary.ids if t.endswith(END_OF_WORD))
    return {letters for letters in ends if letters and count(letters) == 1}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: `n_bytes`, `n_tokens` and whether they are over `limit`.

    `n_whole` of the tokens are pre-tokens counted by the shortcut.
    """
    vocabulary = Vocabulary.read(path)
    send = docs.sparkSession.sparkContext.broadcast  # of the vocabulary's fixed size
    shared = send((vocabulary.source, vocabulary.specials, whole_tokens(vocabulary)))

    @tidy
    def count(batches):
        source, specials, whole = shared.value
        splitter, merge = Splitter(specials, source), merger(source)

        def tokens_of(word: str) -> int:
            if word in specials:
                return 1
            letters = spelled(word)
            if letters in whole:
                return 1
            found = _merged.get(letters)
            if found is None:
                if len(_merged) >= REMEMBERED:
                    _merged.clear()
                found = _merged[letters] = merge(letters)
            return found

        for batch in batches:
            n_tokens = np.zeros(batch.num_rows, np.int64)
            n_whole = np.zeros(batch.num_rows, np.int64)
            for first, part in splitter.batches(batch.column("text").to_pylist()):
                each = np.fromiter(map(tokens_of, part.words), np.int64, len(part.words))
                for out, value in ((n_tokens, each), (n_whole, each == 1)):
                    sums = np.append(0, np.cumsum(value[part.places]))
                    out[first : first + len(part.bounds) - 1] = np.diff(sums[part.bounds])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n_tokens), pa.array(n_whole)],
                ["doc_id", "n_bytes", "n_tokens", "n_whole"],
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select("doc_id", size, "text").mapInArrow(
        count,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, n_whole long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
