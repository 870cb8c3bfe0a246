"""Writers. Tables are partitioned by project and language so readers prune by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.constants import PROJECT_KEYS


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace only the partitions present in the rows; the others stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PROJECT_KEYS, *partitions).parquet(path)
    )


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pair rows split into resolved and unknown ones."""
    _write(pairs.withColumn("resolved", (F.col("relation") != "")), path, "resolved")


def write_pairs_csv(pairs: DataFrame, path: str) -> None:
    flat = pairs.withColumn("comodified_commits", F.to_json("comodified_commits")).withColumn(
        "resolved", F.col("relation") != ""
    )
    flat.write.mode("overwrite").partitionBy(*PROJECT_KEYS, "resolved").option("header", True).option("escape", '"').csv(path)


def write_fragments(fragments: DataFrame, path: str) -> None:
    _write(fragments, path)


def write_fragments_csv(fragments: DataFrame, path: str) -> None:
    flat = fragments.withColumn("modified_commits", F.to_json("modified_commits"))
    flat.write.mode("overwrite").partitionBy(*PROJECT_KEYS).option("header", True).option("escape", '"').csv(path)


def write_metrics(service: DataFrame, clone_set: DataFrame, file: DataFrame, path: str, version: int = 1) -> None:
    """Three metric tables with the schema version they were written under."""
    for name, table in (("service", service), ("clone_set", clone_set), ("file", file)):
        _write(table.withColumn("schema_version", F.lit(version)), f"{path}/{name}")


def read_metrics(spark, path: str, version: int = 1) -> dict[str, DataFrame] | None:
    """Stored metric tables, or None when they are missing or of another version."""
    try:
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("service", "clone_set", "file")}
    except Exception as error:  # the path check of the reader
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    for table in tables.values():
        if "schema_version" not in table.columns or not table.filter(F.col("schema_version") != version).isEmpty():
            return None
    return {n: t.drop("schema_version") for n, t in tables.items()}


def upsert_language_stats(stats: DataFrame, path: str) -> None:
    """Replace the given project-languages and keep all others."""
    _write(stats, path)


def context_document(contexts: DataFrame) -> DataFrame:
    """Contexts of a project with their distinct service names as one JSON document."""
    per = (
        contexts.select("project", "context", "service").distinct()
        .groupBy("project", "context").agg(F.array_sort(F.collect_list("service")).alias("services"))
    )
    return per.groupBy("project").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("context", "services"))))).alias("services")
    )


def write_history_csv(history: DataFrame, path: str) -> None:
    """Head fragments with their history; JSON stays unquoted behind ';'."""
    rows = history.select(
        *PROJECT_KEYS, "clone_id", F.col("fragment_index").alias("index"), "file_path", "start_line", "end_line",
        "start_column", "end_column", F.to_json("modification").alias("modification"),
    )
    (
        rows.write.mode("overwrite").partitionBy(*PROJECT_KEYS)
        .option("header", True).option("sep", ";").option("quote", "").csv(path)
    )
