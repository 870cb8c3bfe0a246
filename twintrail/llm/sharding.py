"""Shards of a reproducible shuffle: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintrail.llm.common import whole_text

ROUNDS = 4
SEED = 20_261
#: A walk leaves the range with a chance below 1/2 a step, so below 2^-96 all in all; a row
#: that still has not come back stops the query.
WALK_STEPS = 96
#: Row numbers are counted within buckets of the hash, this many bits wide.
BUCKET_BITS = 14


def feistel(x: Column, bits: int, seed: int = SEED) -> Column:
    """A permutation of 0 .. 2^bits - 1 by alternating unequal halves; ``bits`` from 2 on."""
    low_bits = bits // 2
    widths = (bits - low_bits, low_bits)
    left, right = F.shiftright(x, low_bits), x.bitwiseAND(F.lit((1 << low_bits) - 1).cast("long"))
    for k in range(ROUNDS):
        mask = F.lit((1 << widths[k % 2]) - 1).cast("long")
        left, right = right, left.bitwiseXOR(F.xxhash64(F.lit(seed + k), right).bitwiseAND(mask))
    # After an even number of rounds both halves have their first widths again.
    return F.shiftleft(left, low_bits).bitwiseOR(right)


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """A permutation of 0 .. n - 1: walk the cycle of the Feistel permutation until it is in range."""
    if n < 2:
        return x
    bits = max(2, (n - 1).bit_length())
    limit = F.lit(n).cast("long")
    step = lambda v: F.when(v < limit, v).otherwise(feistel(v, bits, seed))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK_STEPS)), feistel(x, bits, seed), lambda v, _: step(v))
    return F.when(walked < limit, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def row_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``row_number`` from 0, global and gapless, in the order of a hash of ``order``.

    Rows are numbered inside buckets of the hash; the buckets' sizes, at most 2^14 numbers,
    are the only thing that one task sums up.
    """
    rows = rows.withColumn("_hash", F.xxhash64(*order)).withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - BUCKET_BITS))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("_hash", *order)
    numbered = rows.withColumn("_place", F.row_number().over(inside)).join(starts, "_bucket")
    return numbered.withColumn("row_number", (F.col("_start") + F.col("_place") - 1).cast("long")).drop("_hash", "_bucket", "_place", "_start")


def shards(docs: DataFrame, n_shards: int = 8, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``rows``: shuffled place p of the row goes to shard p mod n, slot p div n, so shard
    counts differ by one at most and slots have no gaps. Row numbers depend on id and text
    alone, not on files or partitions, so the same table gives the same shards. Equal texts
    with different ids are shuffled apart like any other rows. Null texts have size 1 and the
    checksum of an empty text; null ids are ids of their own; repeated rows take places that
    are theirs together. An empty table gives no row. Other columns are not read.
    """
    text = whole_text()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    n = docs.count()
    place = permuted(F.col("row_number"), n, seed)
    return (
        row_numbers(rows, ["doc_id", "_text", "text_crc32", "size"])
        .withColumn("_place", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_place") % n_shards).cast("int").alias("shard"),
            F.floor(F.col("_place") / n_shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def shard_and_slot(row_number: Column, n: int, n_shards: int = 8, seed: int = SEED) -> tuple[Column, Column]:
    """Where a row goes, computed from its number and the number of rows alone."""
    place = permuted(row_number, n, seed)
    return (place % n_shards).cast("int"), F.floor(place / n_shards).cast("long")


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED) -> None:
    """All columns of ``docs`` below ``path``/shard=k, each file sorted by slot.

    A shard is dealt to as many tasks as its rows need (AQE splits rebalanced partitions).
    """
    own = [c for c in docs.columns if c not in ("row_number", "shard", "slot")]
    rows = docs.select(*own).withColumn("_text", F.xxhash64(whole_text()))
    place = permuted(F.col("row_number"), docs.count(), seed)
    placed = row_numbers(rows, ["doc_id", "_text"]).drop("_text").withColumn("_place", place)
    out = placed.select(*own, (F.col("_place") % n_shards).cast("int").alias("shard"), F.floor(F.col("_place") / n_shards).alias("slot"))
    out.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
