"""Exact top-k inner products, block at a time, with bounds that leave blocks out.

Vectors become integers, floor(scale * x). Each task lays its vectors out in blocks of
similar ones, a range of documents with a forward index (the block's matrix) and, for every
component ("term"), the block's largest and smallest value. The sum over terms of what a
query can gain at most bounds every score in a block. A query visits the blocks in falling
order of that bound and stops once it falls below its k-th best score so far. A first pass
over a fixed number of stripes gives every query a k-th score to begin with; the second goes
over all, and returns only what reaches that score, so what is merged does not grow with
the number of stripes.

Queries meet stripes in chunks of fixed size. Vectors meet vectors of their own length;
those that are null, empty or hold null or non-finite components take no part, nor do rows
without id. A row is no candidate for a query of its own id. An id asks once, with the least
of its usable vectors (as arrays compare) if it has several; as candidates all its rows count.
Ties go to the smaller id. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import SENT_BYTES, staged, tidy
from docledger.llm.vectors import matrices

BLOCK, STRIPE, CHUNK = 128, 2048, 1024
#: Stripes that meet at one place where queries are too large to be sent to all tasks.
STRIPES_A_PLACE = 16
#: Stripes of the first pass, and vectors that a task orders its rows by.
FIRST_STRIPES, PIVOTS = 4, 64
NONE = -np.inf


def integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * matrix)


def stripes_of(vectors: DataFrame, scale: int) -> DataFrame:
    """Rows of up to `STRIPE` vectors in blocks: ids, matrix, and bounds of the terms."""

    @tidy
    def pack(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, matrix in matrices(batch.column("embedding")):
                matrix = integers(matrix, scale)
                pivots = matrix[:: max(1, len(matrix) // PIVOTS)][:PIVOTS]
                order = np.argsort((matrix @ pivots.T).argmax(axis=1), kind="stable")
                matrix, own = matrix[order], ids[rows[order]].astype("<i8")
                out = []
                for at in range(0, len(own), STRIPE):
                    part = matrix[at : at + STRIPE]
                    heads = np.arange(0, len(part), BLOCK)
                    out.append(
                        {
                            "size": part.shape[1],
                            "ids": own[at : at + STRIPE].tobytes(),
                            "data": part.tobytes(),
                            "high": np.maximum.reduceat(part, heads).tobytes(),
                            "low": np.minimum.reduceat(part, heads).tobytes(),
                        }
                    )
                kinds = [("size", pa.int32())] + [(c, pa.binary()) for c in ("ids", "data", "high", "low")]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return vectors.select("vec_id", "embedding").mapInArrow(
        pack, "size int, ids binary, data binary, high binary, low binary"
    )


def chunks_of(queries: DataFrame, scale: int, chunks: int) -> DataFrame:
    """Rows of about `CHUNK` queries of one length."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, chunk = table["vec_id"].to_numpy(), table["chunk"][0].as_py()
        out = [
            {"chunk": chunk, "size": m.shape[1], "query_ids": ids[r].astype("<i8").tobytes(), "queries": integers(m, scale).tobytes()}
            for r, m in matrices(table["embedding"].combine_chunks())
        ]
        kinds = [("chunk", pa.int32()), ("size", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")
    return (
        queries.select("vec_id", "embedding", chunk)
        .groupBy("chunk")
        .applyInArrow(pack, "chunk int, size int, query_ids binary, queries binary")
    )


def best_of(stripe: dict, query_ids, queries, floor, k: int):
    """(query row, id, score) of each query's best in a stripe that reach its floor."""
    size = stripe["size"]
    ids = np.frombuffer(stripe["ids"], "<i8")
    data = np.frombuffer(stripe["data"]).reshape(-1, size)
    high = np.frombuffer(stripe["high"]).reshape(-1, size)
    low = np.frombuffer(stripe["low"]).reshape(-1, size)
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(queries), k), NONE)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    for turn in range(bound.shape[1]):
        block = order[:, turn]
        kth = np.maximum(score[:, -1], floor)
        active = bound[np.arange(len(queries)), block] >= kth
        if not active.any():
            break
        for b in np.unique(block[active]).tolist():
            own = np.flatnonzero(active & (block == b))
            begin = b * BLOCK
            names = ids[begin : begin + BLOCK]
            scores = queries[own] @ data[begin : begin + BLOCK].T
            scores[query_ids[own][:, None] == names[None, :]] = NONE
            better = scores.max(axis=1) >= kth[own]
            own, scores = own[better], scores[better]
            both = np.concatenate([score[own], scores], axis=1)
            who = np.concatenate([found[own], np.broadcast_to(names, scores.shape)], axis=1)
            first = np.lexsort((who, -both), axis=1)[:, :k]
            score[own] = np.take_along_axis(both, first, axis=1)
            found[own] = np.take_along_axis(who, first, axis=1)
    row, place = np.nonzero((score > NONE) & (score >= floor[:, None]))
    return row, found[row, place], score[row, place]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~odd
    vectors = vectors.select("vec_id", "embedding").filter(usable)
    queries = vectors.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chunks = max(1, -(-queries.count() // CHUNK))
    stripes = staged(stripes_of(vectors, scale), "stripes")
    asked = staged(chunks_of(queries, scale, chunks), "queries")
    # Queries are sent to all tasks if their bytes are few, else to as many places as stripes are
    # dealt to: stripes, which are the larger table, are moved once and never multiplied.
    sent = asked.agg(F.sum(F.length("queries") + 2 * F.length("query_ids"))).first()[0] or 0
    places = 1 if sent <= SENT_BYTES else max(1, stripes.count() // STRIPES_A_PLACE)

    def search(stripes: DataFrame, asked: DataFrame) -> DataFrame:
        @tidy
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["query_ids"], "<i8")
                    own = np.frombuffer(row["queries"]).reshape(-1, row["size"])
                    floor = row["floors"]
                    floor = np.full(len(ids), NONE) if floor is None else np.frombuffer(floor)
                    asker, name, score = best_of(row, ids, own, floor, k)
                    columns = (ids[asker], name, score.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in columns], ["query_id", "vec_id", "score"]
                    )

        if places == 1:
            met = stripes.join(F.broadcast(asked), "size")
        else:
            every = F.explode(F.sequence(F.lit(0), F.lit(places - 1)))
            place = F.pmod(F.xxhash64("ids"), F.lit(places)).cast("int")
            met = stripes.withColumn("place", place).join(asked.withColumn("place", every), ["place", "size"])
        return met.mapInArrow(run, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    no_floor = asked.withColumn("floors", F.lit(None).cast("binary"))
    kth = staged(
        best(search(stripes.limit(FIRST_STRIPES), no_floor))
        .filter(F.col("rank") == k)
        .select("query_id", F.col("score").alias("kth")),
        "floors",
    )

    def set_floors(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right["query_id"].to_pylist(), right["kth"].to_pylist(), strict=True))
        floors = [
            np.array([known.get(i, NONE) for i in np.frombuffer(ids, "<i8").tolist()], float).tobytes()
            for ids in left["query_ids"].to_pylist()
        ]
        return left.append_column("floors", pa.array(floors, pa.binary()))

    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("chunk")
    with_floors = staged(
        asked.groupBy("chunk")
        .cogroup(kth.select("query_id", "kth", chunk).groupBy("chunk"))
        .applyInArrow(
            set_floors, "chunk int, size int, query_ids binary, queries binary, floors binary"
        ),
        "queries",
    )
    return best(search(stripes, with_floors)).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
