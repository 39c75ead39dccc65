"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

Sizes are numbers of words. Sources in code point order, null last, weigh `weights`,
repeated as often as needed, and share `share` times all words; no target exceeds
`repeats` times its source, and what that leaves over goes to the others by weight.

The mix is a number of equal blocks of `block_words` words, dealt to the sources by the
highest quotients target / (2k - 1). Output shard s of n gets the seats between rank
(s-1)/n and s/n, so the quotas of all shards add up to the apportionment of the whole.
A source's documents are laid on a line in seeded order, `repeats` times over; its blocks
are cut from the start of that line, shard after shard.

Null and wordless texts have size 0 and nothing is taken of them; a null source is a
source of its own; repeated rows are documents of their own, and ties of the seeded order
are rows that do not differ in id or text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docledger.llm.common import running_start, staged

#: Fixed by the task: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Id, source, size and the seeded place of each document; texts stay where they are."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
        size.alias("size"),
        place(seed).alias("place"),
    )


def place(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def targets(rows: DataFrame, weights: tuple, share: float, repeats: int) -> DataFrame:
    """One row per source: size, rows, target, and how many sources there are.

    Windows without a partition are over this table only, one row per source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1
    )
    # From the source that fills up first to the one that fills up last.
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy("source", "source_key")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
        .withColumn("weight", weight)
        .withColumn("room", F.col("source_size") * repeats)
        .withColumn("full_at", F.col("room") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("sources", F.count("*").over(everything))
        .withColumn("room_before", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.col("weight_before"))
        .withColumn(
            "full",
            (F.col("budget") - F.col("room_before")) / F.col("weight_left") >= F.col("full_at"),
        )
        .withColumn("full_room", F.sum(F.expr("if(full, room, 0)")).over(everything))
        .withColumn("open_weight", F.sum(F.expr("if(full, 0, weight)")).over(everything))
        .withColumn(
            "target",
            F.when(F.col("full"), F.col("room").cast("double")).otherwise(
                (F.col("budget") - F.col("full_room")) / F.col("open_weight") * F.col("weight")
            ),
        )
        .select("source", "source_key", "source_size", "source_rows", "target", "sources")
    )


def quotas(per_source: DataFrame, block_words: int, shards: int) -> DataFrame:
    """source_key, shard (from 1), and the blocks of that source in shards up to this one.

    With R seats, n sources and v votes of T, a source surely gets round(v (R - n) / T)
    seats and at most round(v (R + n) / T), as roundings differ from their sum by n / 2 at
    most. Only the quotients between the two, about 3n, are ranked against each other.
    """
    everything = Window.partitionBy()
    seats = F.round(F.col("votes") / block_words).cast("long")
    rounded = lambda r: F.floor(F.col("target") * r / F.col("votes") + 0.5).cast("long")
    each = (
        per_source.withColumn("votes", F.sum("target").over(everything))
        .filter("votes > 0")
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.floor(seats * F.col("shard") / shards).cast("long"))
        .withColumn("sure", rounded(F.greatest(F.col("seats") - F.col("sources"), F.lit(0))))
        .withColumn("most", rounded(F.col("seats") + F.col("sources")))
        .withColumn("open", F.col("seats") - F.sum("sure").over(Window.partitionBy("shard")))
    )
    ranked = Window.partitionBy("shard").orderBy(F.desc("quotient"), "source_key", "seat")
    won = (
        each.filter("most > sure")
        .withColumn("seat", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))))
        .withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
        .filter("quotient > 0")
        .withColumn("rank", F.row_number().over(ranked))
        .filter("rank <= open")
        .groupBy("source_key", "shard")
        .agg(F.count("*").alias("won"))
    )
    blocks = F.col("sure") + F.coalesce("won", F.lit(0))
    return each.join(won, ["source_key", "shard"], "left").select(
        "source_key", "shard", blocks.alias("blocks")
    )


def mix(
    docs: DataFrame,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    block_words: int = 16,
    shards: int = 8,
    seed: int = 20,
) -> DataFrame:
    """One row per document: `target` of its source, `taken` words, and those by shard."""
    rows = staged(sized(docs, seed), "mix-sizes")
    per_source = staged(targets(rows, weights, share, repeats), "mix-targets")
    ends = (
        quotas(per_source, block_words, shards)
        .groupBy("source_key")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("ends"))
        .withColumn("ends", F.col("ends.blocks"))
    )
    placed = running_start(
        rows.join(per_source.drop("source"), "source_key"),
        ["source_key"],
        F.col("source_rows"),
        F.col("place"),
        ["place", "size"],
        F.col("size"),
    ).join(ends, "source_key", "left")

    def words_in(run: str) -> str:
        """Words of the document, over all its repeats, before the end of that run."""
        return (
            f"aggregate(sequence(0, {repeats - 1}), 0L, (n, e) -> n + greatest(0L, least(size, "
            f"{run} * {block_words} - start - e * source_size)))"
        )

    up_to = F.expr(f"transform(coalesce(ends, array(0L)), b -> {words_in('b')})")
    by_shard = F.expr("transform(up_to, (w, i) -> w - if(i = 0, 0L, up_to[i - 1]))")
    return (
        placed.withColumn("up_to", up_to)
        .withColumn("taken", F.element_at("up_to", -1))
        .withColumn("taken_by_shard", by_shard)
        .select(
            "doc_id", "size", "source_size", "target", "taken", "source", "taken_by_shard", "place"
        )
    )


def mixed_documents(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """The documents of the mix, each as often as its taken words need, rounded up.

    Rows that do not differ in id or text share the mean of their repeats, rounded up.
    """
    copies = (
        mix(docs, seed=seed, **options)
        .filter("taken > 0")
        .groupBy(F.col("place").alias("_place"))
        .agg(F.ceil(F.avg(F.ceil(F.col("taken") / F.col("size")))).cast("int").alias("_copies"))
    )
    return (
        docs.withColumn("_place", place(seed))
        .join(copies, "_place")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*docs.columns)
    )
