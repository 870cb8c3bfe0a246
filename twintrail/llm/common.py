"""What several text operators share: whole texts, row identity and tables held in the shared folder."""

from __future__ import annotations

import gc
import os
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintrail.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names one row of a stored table; the same on each read of the same files.
ROW = "_row"


def whole_text(name: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a column that tells repeated rows apart.

    The number follows from file and place, so ``docs`` has to be a stored table or a
    filter or projection of one; hold() makes one of any other frame. How files are cut into
    tasks must not change between two reads: reachable() sees to that.
    """
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def hold(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that driver and executors share; cuts the lineage."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*held: DataFrame) -> None:
    """Delete tables made by hold() that nothing reads any more, and let Spark drop shuffle files of finished stages.

    Call it after the table that was made from them is held itself.
    """
    spark = SparkSession.getActiveSession()
    for df in held:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # Shuffle files go when the driver's JVM finds that nothing refers to them; what Python let go
    # of, it sees at the second look.
    gc.collect()
    for _ in range(3):
        spark._jvm.System.gc()
        time.sleep(0.2)


#: Rows that a Python worker gets at once. Texts are long, and a batch is held on both sides.
ARROW_ROWS, ARROW_BYTES = 400, 8 << 20
#: Python workers give large arrays back when they are done with them, so idle ones stay small.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20)}


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is installed at the driver's path but not on theirs, bound their batches, and fix how files are cut into tasks."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # By default this follows the cores at hand, so that a lost executor would number rows anew.
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    env.update(WORKER_MEMORY)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)
    return spark
