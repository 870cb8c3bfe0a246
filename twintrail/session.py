"""Session settings the plans rely on.

Joins carry no broadcast hint unless the side has a fixed size: adaptive execution
measures the shuffled side and switches to a broadcast only under its threshold, and
splits a partition that one hot clone set, file or project makes too large.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the plan above has to shuffle once more for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "twintrail", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster; a scratch one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named and (current is None or not current.startswith(named)):
        sc.setCheckpointDir(named)
    elif current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written as a table in the shared checkpoint folder and read back.

    Cuts the lineage, survives lost executors, and lets later reads prune by partition and
    column, which a checkpointed plan cannot.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the staged tables that these frames read, and lets Spark drop the shuffle files of finished stages.

    Call it when what was made from them is staged itself and nothing else reads them.
    """
    for df in frames:
        spark = df.sparkSession
        for name in {found[0] for f in df.inputFiles() if (found := re.match(r".*/staged-[0-9a-f]{32}(?=/)", f))}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    # Shuffle files go when the driver's JVM finds that nothing refers to them; what Python let go of, it sees at the second look.
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.2)
