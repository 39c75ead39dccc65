"""Near-duplicate vectors by randomised-rotation binary codes (after RaBitQ, 2024).

A unit vector, turned by several random rotations, keeps the signs of its components as
its code, and as correction factor the inner product of the vector with its code. Dividing
by the factor makes code times vector an unbiased estimate of the inner product of two
vectors, with an error of about sqrt(1 / factor^2 - 1) / sqrt(bits - 1); a pair whose
estimate plus `deviations` such errors stays below the threshold is dropped, every other
pair is computed exactly, in doubles.

Which pairs to estimate: signs of vectors at cosine 0.98 differ with probability 0.064, so
the 384 bits form 24 bands of 16, and vectors that agree in a band, under one label, meet.
A pair at the threshold is missed with probability (1 - 0.936^16)^24, about 4 in 100,000,
closer ones more rarely. A pair counts in the first band in which it agrees. Equal vectors
are one node with a number of copies. Buckets go to tasks in tiles of bounded size and
return a count and a link per row, not pairs.

Vectors that are null, zero or hold null or non-finite components, and rows without label
or id, link with nothing. Vectors of different lengths never meet. Rows equal in everything
count as vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import staged, tidy
from docledger.llm.components import components
from docledger.llm.vectors import matrices

BANDS, BAND_BITS = 24, 16
BITS = BANDS * BAND_BITS
#: Rows of a bucket that meet in one task, twice at most; and rows a task gets in all, about.
TILE, GROUP = 1024, 4096


def rotation(size: int, seed: int) -> np.ndarray:
    """size x BITS: random rotations side by side, scaled so that lengths are kept."""
    random = np.random.default_rng(seed + size)
    turns = [np.linalg.qr(random.normal(size=(size, size)))[0] for _ in range(-(-BITS // size))]
    return np.concatenate(turns, axis=1)[:, :BITS] * np.sqrt(size / BITS)


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def encode(vectors: DataFrame, kind: str, seed: int) -> DataFrame:
    """Id, label, vector, its code (packed signs) and its correction factor."""

    @tidy
    def run(batches):
        for batch in batches:
            for rows, matrix in matrices(batch.column("embedding")):
                filled = np.abs(matrix).max(axis=1) > 0
                rows, matrix = rows[filled], matrix[filled]
                turned = unit(matrix) @ rotation(matrix.shape[1], seed)
                factor = np.abs(turned).sum(axis=1) / np.sqrt(BITS)
                code = np.packbits(turned >= 0, axis=1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(take),
                        batch.column("label").take(take),
                        pa.array([v.tobytes() for v in matrix], pa.binary()),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(factor),
                    ],
                    ["vec_id", "label", "vector", "code", "factor"],
                )

    return vectors.mapInArrow(run, f"{kind}, vector binary, code binary, factor double")


def linked_in(part: pa.Table, threshold: float, deviations: float, seed: int):
    """(row, weight of its partners, a row it is tied to) for the rows of some buckets."""
    key = part["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    band, weight = part["band"].to_numpy()[order], part["copies"].to_numpy()[order]
    chunk = part["chunk"].to_numpy()[order]
    factor = part["factor"].to_numpy()[order]
    vectors = [part["vector"][i].as_py() for i in order.tolist()]
    code = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(-1, BITS // 8)[order]
    bands = np.ascontiguousarray(code).view(np.uint16)
    earlier = np.arange(BANDS)[None, :] < band[:, None]
    signs = (np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(BITS))
    sizes = np.array([len(v) // 8 for v in vectors])
    width = int(sizes.max())
    exact = np.zeros((len(order), width))
    turned = np.zeros((len(order), BITS), np.float32)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        exact[own, :size] = unit(np.array([np.frombuffer(vectors[i]) for i in own.tolist()]))
        turned[own] = exact[own, :size] @ rotation(size, seed)
    slack = deviations * np.sqrt(np.maximum(1 / factor**2 - 1, 0)) / np.sqrt(BITS - 1)
    across = np.zeros(len(order), bool)  # rows of tiles of two chunks
    heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
        across[begin:end] = chunk[begin:end].min() < chunk[begin:end].max()
    links = np.zeros(len(order), np.int64)
    tied = np.arange(len(order))
    for step in range(1, int(np.diff([*heads, len(key)]).max())):
        i = np.flatnonzero(key[step:] == key[:-step])
        j = i + step
        fresh = (sizes[i] == sizes[j]) & (~across[i] | (chunk[i] != chunk[j]))
        fresh &= ~((bands[i] == bands[j]) & earlier[i]).any(axis=1)
        i, j = i[fresh], j[fresh]
        for at in range(0, len(i), 8192):
            a, b = i[at : at + 8192], j[at : at + 8192]
            estimate = np.einsum("ij,ij->i", signs[a], turned[b]) / factor[a]
            open_ = estimate + slack[a] >= threshold
            a, b = a[open_], b[open_]
            near = np.einsum("ij,ij->i", exact[a], exact[b]) >= threshold
            a, b = a[near], b[near]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            tie(tied, a, b)
    return order, links, tied


def tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each two rows; afterwards `root` holds the least row of each tree."""
    loose = root[a] != root[b]
    if not loose.any():
        return
    for x, y in np.unique(np.stack([root[a][loose], root[b][loose]], axis=1), axis=0).tolist():
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    while not np.array_equal(root, root[root]):
        root[:] = root[root]


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, deviations: float = 4.0, seed: int = 9
) -> DataFrame:
    """One row per vector: `n_links`, `component_id` and whether it is `kept`."""
    kind = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    node_kind = vectors.schema["vec_id"].dataType.simpleString()
    usable = vectors.select("vec_id", "label", "embedding").filter(
        "vec_id is not null and label is not null"
    )
    coded = staged(encode(usable, kind, seed), "codes")
    # Equal vectors of a label: one node.
    same = ["label", "hash"]
    coded = coded.withColumn("hash", F.sha2("vector", 256))
    groups = coded.groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    members = staged(coded.select("vec_id", *same).join(groups, same), "members")
    nodes = staged(
        coded.join(groups, same)
        .filter("vec_id = node")
        .dropDuplicates(["node", *same])
        .select("node", "label", "copies", "vector", "code", "factor"),
        "nodes",
    )
    piece = F.expr(f"transform(sequence(1, {BITS // 8 - 1}, 2), i -> substring(code, i, 2))")
    entries = nodes.select("node", "label", F.posexplode(piece).alias("band", "bits")).select(
        "node", "band", F.xxhash64("label", "band", "bits").alias("bucket")
    )
    counts = entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    crowded = staged(
        entries.join(counts, "bucket")
        .withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", other)
        .withColumn("key", F.xxhash64("bucket", F.least("chunk", "other"), F.greatest("chunk", "other")))
        .select("node", "band", "chunk", "key"),
        "buckets",
    )
    groups_of_rows = max(1, crowded.count() // GROUP)

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        order, links, tied = linked_in(part, threshold, deviations, seed)
        name = part["node"].take(pa.array(order))
        met = np.flatnonzero((links > 0) | (tied != np.arange(len(tied))))
        return pa.table(
            {
                "node": name.take(pa.array(met)),
                "links": links[met],
                "tied": name.take(pa.array(tied[met])),
            }
        )

    met = staged(
        crowded.join(nodes.drop("label"), "node")
        .groupBy(F.pmod("key", F.lit(groups_of_rows)).alias("group"))
        .applyInArrow(run, f"node {node_kind}, links long, tied {node_kind}"),
        "links",
    )
    classes = components(met.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = (
        members.join(links, "node", "left")
        .join(classes, "node", "left")
        .groupBy("vec_id")
        .agg(
            F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.min(F.coalesce("component", "node")).alias("component_id"),
        )
    )
    return vectors.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
