"""Skip what earlier runs produced, and take in snapshot files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twintrail import schemas as S


def missing_work(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys without an existing result."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def ingest_snapshots(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Append the fragments of snapshot files not seen before and stop when there are none left.

    Files lie at <project>/<sha>/<language>.json. The checkpoint folder remembers what was
    read, so a second run over the same folder adds nothing.
    """
    parts = F.split("_metadata.file_path", "/")
    rows = (
        spark.readStream.schema(S.SNAPSHOT).option("multiLine", True).option("recursiveFileLookup", True).json(source)
        .select(
            F.element_at(parts, -3).alias("project"), F.element_at(parts, -2).alias("sha"),
            F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("language"), "file_data", "clone_sets",
        )
    )
    keys = ["project", "sha", "language"]
    names = F.map_from_entries(F.transform("file_data", lambda f: F.struct(f["file_id"], f["file_path"])))
    fragments = (
        rows.select(*keys, names.alias("names"), F.posexplode("clone_sets").alias("set_order", "s"))
        .select(*keys, "names", "set_order", F.col("s.clone_id").cast("string").alias("clone_id"), F.posexplode("s.fragments").alias("fragment_index", "f"))
        .select(*keys, "set_order", "clone_id", "fragment_index", F.element_at("names", F.col("f.file_id")).alias("file_path"), "f.start_line", "f.end_line")
    )
    return (
        fragments.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .partitionBy("project", "language").trigger(availableNow=True).start()
    )
