"""A text corpus made ready for training: five stages over ``documents``, each one operator.

Each stage gets the table that the one before it wrote and returns the rows it keeps, with the
columns of ``documents``; the last one adds the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintrail.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from twintrail.llm.common import ROW, hold, numbered, reachable

#: Texts with this score or more go.
TOXIC_FROM = 0.5
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits the classifier on the labelled rows among ``docs`` and drops the texts it rejects."""
    reachable(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs, into="_score").where(F.col("_score") < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each text."""
    reachable(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies."""
    reachable(spark)
    kept = near_dedup.near_groups(docs).where("kept").select(ROW)
    return numbered(docs).join(kept, ROW, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold an item of the benchmark."""
    reachable(spark)
    rows = numbered(docs)
    found = decontaminate.contaminated(rows.select(F.col(ROW).alias("row"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(hold(found.select(F.col("row").alias(ROW)).distinct()), ROW, "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each text, decodes the ids into the text that is returned, and adds ``n_tokens`` and ``token_ids``."""
    reachable(spark)
    return bpe.tokenized(docs, public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: SQL expresses neither the trees nor the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's rows are held as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
