"""Closed line intervals: union length and contiguous id ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def added_lines(keys: list[str], start: str, end: str) -> Column:
    """Lines a row adds beyond all rows of its group that start earlier.

    Needs one row per start line, so the window holds at most one row per line of a file.
    """
    order = W.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    own = F.col(start) - 1
    return F.greatest(F.lit(0), F.col(end) - F.greatest(F.coalesce(reach, own), own))


def merged_lines(df: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Lines covered by the union of the closed intervals of each key group, as ``lines``.

    Only the longest interval per start line can matter: rows collapse to those before the
    window runs, however many copies overlap.
    """
    longest = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    return (
        longest.withColumn("_added", added_lines(keys, start, end))
        .groupBy(*keys)
        .agg(F.sum("_added").cast("bigint").alias("lines"))
    )


def contiguous_ranges(df: DataFrame, keys: list[str], value: str, block: int = 4096) -> DataFrame:
    """Runs of consecutive integers per key group as (range_start, range_end).

    Runs are found within blocks of values. Only those that reach a border of their block can
    go on in the next one; of these a block has two at most, and they alone are put in order
    over the whole group.
    """
    order = W.partitionBy(*keys, "_block").orderBy(value)
    first, last = F.col("range_start"), F.col("range_end")
    runs = (
        df.select(*keys, value).distinct()
        .withColumn("_block", F.floor(F.col(value) / block))
        .withColumn("_run", F.col(value) - F.row_number().over(order))
        .groupBy(*keys, "_block", "_run")
        .agg(F.min(value).alias("range_start"), F.max(value).alias("range_end"))
        .withColumn("_open", (F.pmod(first, F.lit(block)) == 0) | (F.pmod(last + 1, F.lit(block)) == 0))
    )
    chain = W.partitionBy(*keys).orderBy("range_start")
    begins = F.coalesce((first != F.lag("range_end").over(chain) + 1).cast("int"), F.lit(1))
    joined = (
        runs.filter("_open").withColumn("_begins", begins)
        .withColumn("_chain", F.sum("_begins").over(chain.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_chain").agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
        .drop("_chain")
    )
    return runs.filter("NOT _open").select(*keys, "range_start", "range_end").unionByName(joined)


def range_lookup(
    rows: DataFrame, ranges: DataFrame, keys: list[str], value: str, low: str, high: str, block: int = 4096
) -> DataFrame:
    """Rows joined to the closed ranges that hold their value.

    Ranges are spread over blocks of values, so the test is an equi-join on the block and
    only then a comparison.
    """
    blocks = F.sequence(F.floor(F.col(low) / block), F.floor(F.col(high) / block))
    spread = ranges.withColumn("_block", F.explode(blocks))
    return (
        rows.withColumn("_block", F.floor(F.col(value) / block))
        .join(spread, [*keys, "_block"])
        .filter(F.col(value).between(F.col(low), F.col(high)))
        .drop("_block")
    )
