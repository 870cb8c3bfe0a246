"""Files and their owning services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.constants import PROJECT_KEYS
from twintrail.functions.paths import is_test_path, repo_path
from twintrail.operators.intervals import contiguous_ranges, range_lookup


def path_prefixes(path):
    """Every folder prefix of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def resolve_services(paths: DataFrame, contexts: DataFrame, repo_dir: str | None = None) -> DataFrame:
    """Owning service of each distinct (project, path) by longest context prefix.

    ``contexts``: project, context, service, tier (1 primary, 2 fallback), ordinal. A path is
    split into its folder prefixes, so the match is an equi-join on the prefix instead of a
    comparison with every context. A lower tier number wins, then the longest context, then
    the one listed first. Adds ``service`` ('' for none) and ``tier``.
    """
    relative = paths.select("project", "file_path").distinct().withColumn("_path", repo_path("file_path", repo_dir))
    named = contexts.select(
        "project",
        F.rtrim(F.col("context"), F.lit("/")).alias("_prefix"),
        "service", "tier", "ordinal",
    ).filter(F.col("_prefix") != "")
    # The best entry of each prefix is picked first: one row per prefix meets the paths.
    first = named.groupBy("project", "_prefix").agg(
        F.min(F.struct("tier", "ordinal", "service")).alias("_ctx")
    )
    hits = (
        relative.filter(F.col("_path") != "")
        .select("project", "file_path", F.explode(path_prefixes(F.col("_path"))).alias("_prefix"))
        .join(first, ["project", "_prefix"])
        .groupBy("project", "file_path")
        .agg(
            F.min(
                F.struct(
                    F.col("_ctx.tier").alias("tier"),
                    (-F.length("_prefix")).alias("l"),
                    F.col("_ctx.ordinal").alias("o"),
                    F.col("_ctx.service").alias("service"),
                )
            ).alias("_best")
        )
    )
    return (
        relative.drop("_path")
        .join(hits, ["project", "file_path"], "left")
        .select("project", "file_path", F.coalesce("_best.service", F.lit("")).alias("service"), F.col("_best.tier").alias("tier"))
    )


def with_service(rows: DataFrame, contexts: DataFrame, repo_dir: str | None = None) -> DataFrame:
    """Rows with the service of their file; every distinct path is resolved once."""
    found = resolve_services(rows, contexts, repo_dir).drop("tier")
    return rows.join(found, ["project", "file_path"], "left")


def with_file_id(rows: DataFrame, files: DataFrame) -> DataFrame:
    """File id by path, -1 where the path is not in the file table."""
    ids = files.select(*PROJECT_KEYS, "file_path", "file_id")
    return rows.join(ids, [*PROJECT_KEYS, "file_path"], "left").withColumn(
        "file_id", F.coalesce("file_id", F.lit(-1))
    )


def service_by_id_range(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Service of a file id through id ranges; the range listed first wins, else 'unknown'."""
    ids = files.select(*PROJECT_KEYS, "file_id")
    hits = (
        range_lookup(ids, ranges, PROJECT_KEYS, "file_id", "range_start", "range_end")
        .groupBy(*PROJECT_KEYS, "file_id")
        .agg(F.min_by("service", "ordinal").alias("service"))
    )
    return ids.join(hits, [*PROJECT_KEYS, "file_id"], "left").withColumn(
        "service", F.coalesce("service", F.lit("unknown"))
    )


def service_file_stats(files: DataFrame) -> DataFrame:
    """Files and lines per service with the project-language total and the unresolved share.

    ``files``: project, language, service ('' unresolved), loc. The total row has scope 'total'.
    """
    unresolved = F.col("service") == ""
    return (
        files.withColumn("_scope", F.when(unresolved, "unresolved").otherwise("service"))
        .groupingSets(
            [[*(F.col(c) for c in PROJECT_KEYS), F.col("_scope"), F.col("service")], [*(F.col(c) for c in PROJECT_KEYS)]],
            *PROJECT_KEYS, "_scope", "service",
        )
        .agg(
            F.count(F.lit(1)).alias("file_count"),
            F.sum("loc").cast("bigint").alias("total_loc"),
            F.grouping("_scope").alias("_g"),
        )
        .select(
            *PROJECT_KEYS,
            F.when(F.col("_g") == 1, "total").otherwise(F.col("_scope")).alias("scope"),
            F.coalesce("service", F.lit("")).alias("service"),
            "file_count", "total_loc",
        )
    )


def service_loc(files: DataFrame) -> DataFrame:
    """Lines and files of every resolved service."""
    return (
        files.filter(F.col("service") != "")
        .groupBy(*PROJECT_KEYS, "service")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("loc").cast("bigint").alias("total_loc"))
    )


def service_file_ranges(files: DataFrame) -> DataFrame:
    """Runs of consecutive file ids of every resolved service."""
    return contiguous_ranges(files.filter(F.col("service") != ""), [*PROJECT_KEYS, "service"], "file_id")


def assignment_coverage(paths: DataFrame, contexts: DataFrame, repo_dir: str | None = None) -> DataFrame:
    """Paths, resolved paths and those resolved by the fallback tier, per project and service."""
    found = resolve_services(paths, contexts, repo_dir)
    return found.rollup("project", "service").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("service") != "").alias("resolved"),
        F.count_if(F.col("tier") == 2).alias("by_fallback"),
        F.grouping_id().alias("level"),
    )


def services_by_text_prefix(files: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every service whose context text starts the path: no folder boundary, several matches kept.

    A context matches at its own length only, so a path is cut to the lengths that occur
    among the contexts of its project and joined by equality.
    """
    usable = contexts.filter(F.col("context").isNotNull() & (F.col("context") != ".") & (F.col("context") != "")).select(
        "project", "context", "service"
    ).distinct()
    lengths = usable.groupBy("project").agg(F.collect_set(F.length("context")).alias("_lengths"))
    cut = (
        files.drop("service").join(lengths, "project")
        .withColumn("_n", F.explode("_lengths"))
        .filter(F.col("_n") <= F.length("file_path"))
        .withColumn("context", F.substring(F.col("file_path"), F.lit(1), F.col("_n")))
        .drop("_lengths", "_n")
    )
    return cut.join(usable, ["project", "context"])


def first_codebase(rows: DataFrame, codebases: DataFrame) -> DataFrame:
    """First listed code base whose text starts the path; rows without one have NULL.

    ``codebases``: project, language, context, service, ordinal.
    """
    paths = rows.select(*PROJECT_KEYS, "file_path").distinct()
    bases = codebases.groupBy(*PROJECT_KEYS, "context").agg(F.min("ordinal").alias("ordinal"))
    lengths = bases.groupBy(*PROJECT_KEYS).agg(F.collect_set(F.length("context")).alias("_lengths"))
    hits = (
        paths.join(lengths, PROJECT_KEYS)
        .withColumn("_n", F.explode("_lengths"))
        .filter(F.col("_n") <= F.length("file_path"))
        .withColumn("context", F.substring(F.col("file_path"), F.lit(1), F.col("_n")))
        .join(bases, [*PROJECT_KEYS, "context"])
        .groupBy(*PROJECT_KEYS, "file_path")
        .agg(F.min_by("context", "ordinal").alias("codebase"))
    )
    return rows.join(hits, [*PROJECT_KEYS, "file_path"], "left")


def loc_by_kind(files: DataFrame) -> DataFrame:
    """Production and testing lines of every service with language totals and service counts."""
    test = is_test_path("file_path")
    return (
        files.filter(F.col("service") != "")
        .rollup("language", "service")
        .agg(
            F.coalesce(F.sum(F.when(~test, F.col("loc"))), F.lit(0)).cast("bigint").alias("production_loc"),
            F.coalesce(F.sum(F.when(test, F.col("loc"))), F.lit(0)).cast("bigint").alias("testing_loc"),
            F.countDistinct("service").alias("services"),
            F.grouping_id().alias("level"),
        )
        .filter("level <= 1")
        .select("language", F.coalesce("service", F.lit("*")).alias("service"), "production_loc", "testing_loc", "services")
    )
