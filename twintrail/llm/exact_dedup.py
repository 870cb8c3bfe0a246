"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import ROW, hold, numbered, whole_text

PREFIX_CHARS = 128


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: (_row, doc_id, keep_id, group_size, kept).

    Rows with the same text form a group and the one with the largest doc_id stays. The
    first two rounds group narrow rows of numbers. Only rows that still share length and
    prefix hash with another row have their text read for the third, a SHA-256, which
    counts as equality. Every group is summed before the shuffle and only its size and its
    largest id travel, so a group with a third of all rows costs one row per task.

    Null texts count as empty, and empty texts are equal to each other. A null doc_id is the
    smallest. Of repeated rows (same id, same text) one stays. An empty table gives no row.
    Columns other than doc_id and text are not read.
    """
    docs = numbered(docs.select("doc_id", "text"))
    text = whole_text()
    narrow = hold(
        docs.select(
            ROW,
            "doc_id",
            F.octet_length(text).alias("n_bytes"),
            F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
        )
    )
    by_length = narrow.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    same_length = narrow.join(by_length, "n_bytes", "left_semi")
    by_prefix = same_length.groupBy("n_bytes", "prefix").count().where("count > 1").select("n_bytes", "prefix")
    survivors = hold(same_length.join(by_prefix, ["n_bytes", "prefix"], "left_semi").select(ROW))

    full = hold(docs.join(survivors, ROW, "left_semi").select(ROW, "doc_id", F.sha2(text, 256).alias("digest")))
    groups = (
        full.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", ROW)).alias("last"))
        .where("group_size > 1")
    )
    copies = full.join(groups, "digest").select(ROW, "group_size", "last")
    return narrow.join(copies, ROW, "left").select(
        ROW,
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("last").isNull() | (F.col(f"last.{ROW}") == F.col(ROW))).alias("kept"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text, all columns as they were; ``docs`` is a stored table."""
    kept = exact_groups(docs).where("kept").select(ROW)
    return numbered(docs).join(kept, ROW, "left_semi").drop(ROW)


def digests(docs: DataFrame) -> DataFrame:
    """(_row, text_sha256) of every row."""
    return numbered(docs.select("doc_id", "text")).select(ROW, F.sha2(whole_text(), 256).alias("text_sha256"))
