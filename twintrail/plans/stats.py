"""Project statistics: languages, services and headline figures from the metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.constants import PROJECT_KEYS
from twintrail.functions.numbers import ratio

SERVICE_KEYS = [*PROJECT_KEYS, "service"]


def _zero(*names):
    return [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names]


def _roc_percent(lines: str, loc: str):
    """Unrounded share first: the percentage is rounded once."""
    return F.bround(ratio(lines, loc, None) * 100, 2).alias("roc_pct")


def language_stats(files: DataFrame, service: DataFrame, clone_set: DataFrame, pair_summary: DataFrame) -> DataFrame:
    """Ten figures per project-language.

    ``files``: project, language, service ('' unresolved), loc. The other tables are the
    service metrics, the clone-set metrics and the pair summary.
    """
    totals = files.groupBy(*PROJECT_KEYS).agg(
        F.countDistinct(F.nullif("service", F.lit(""))).alias("n_services"),
        F.count(F.lit(1)).alias("n_files"),
        F.sum("loc").cast("bigint").alias("total_loc"),
    )
    sets = clone_set.groupBy(*PROJECT_KEYS).agg(
        F.count(F.lit(1)).alias("n_clone_sets"), F.count_if(F.col("comod_count") > 0).alias("n_comod_clone_sets")
    )
    lines = service.groupBy(*PROJECT_KEYS).agg(F.sum("total_clone_line_count").alias("total_clone_loc"))
    pairs = pair_summary.select(
        *PROJECT_KEYS, F.col("clone_pairs").alias("n_clone_pairs"), F.col("comod_pairs").alias("n_comod_clone_pairs")
    )
    return (
        totals.join(sets, PROJECT_KEYS, "left").join(lines, PROJECT_KEYS, "left").join(pairs, PROJECT_KEYS, "left")
        .select(
            *PROJECT_KEYS, "n_services", "n_files", "total_loc",
            *_zero("n_clone_sets", "n_clone_pairs", "n_comod_clone_sets", "n_comod_clone_pairs", "total_clone_loc"),
            _roc_percent("total_clone_loc", "total_loc"),
        )
    )


def service_language_rows(service_loc: DataFrame, service: DataFrame) -> DataFrame:
    """Service statistics and service metrics side by side; either side may be missing."""
    return service_loc.join(
        service.select(*SERVICE_KEYS, "clone_set_count", "total_clone_line_count"), SERVICE_KEYS, "full"
    ).select(
        *SERVICE_KEYS,
        *[
            F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(n)
            for c, n in (
                ("file_count", "n_files"), ("total_loc", "total_loc"),
                ("clone_set_count", "n_clone_sets"), ("total_clone_line_count", "total_clone_loc"),
            )
        ],
    )


def statistics_levels(service_loc: DataFrame, service: DataFrame) -> DataFrame:
    """Figures per service and language, per service and per project out of one aggregation."""
    rows = service_language_rows(service_loc, service)
    p, l, s = F.col("project"), F.col("language"), F.col("service")
    sums = ["n_files", "total_loc", "n_clone_sets", "total_clone_loc"]
    return (
        rows.groupingSets([[p, s, l], [p, s], [p]], "project", "service", "language")
        .agg(
            *[F.sum(c).cast("bigint").alias(c) for c in sums],
            F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
            F.grouping("language").alias("_l"), F.grouping("service").alias("_s"),
        )
        .select(
            F.when(F.col("_s") == 1, "project").when(F.col("_l") == 1, "service").otherwise("service_language").alias("level"),
            "project", F.coalesce("service", F.lit("*")).alias("service"), F.coalesce("language", F.lit("*")).alias("language"),
            "languages", *sums, _roc_percent("total_clone_loc", "total_loc"),
        )
    )


def service_stats(service_loc: DataFrame, service: DataFrame) -> DataFrame:
    return statistics_levels(service_loc, service).filter(F.col("level") == "service").drop("level", "language")


def service_language_stats(service_loc: DataFrame, service: DataFrame) -> DataFrame:
    return (
        statistics_levels(service_loc, service).filter(F.col("level") == "service_language")
        .select("project", "service", "language", "n_files", "total_loc", "n_clone_sets")
    )


def project_kpi(languages: DataFrame, services: DataFrame) -> DataFrame:
    """Headline figures of a project from its language and service rows."""
    sums = languages.groupBy("project").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_files", "n_clone_sets", "total_loc", "total_clone_loc")]
    )
    named = services.groupBy("project").agg(F.countDistinct("service").alias("n_services"))
    return sums.join(named, "project", "left").select(
        "project", *_zero("n_services"), "n_files", "n_clone_sets", "total_loc", "total_clone_loc",
        _roc_percent("total_clone_loc", "total_loc"),
    )


def discovered_languages(declared: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Languages declared for a project or found in its fragments."""
    return declared.select(*PROJECT_KEYS).union(on_disk.select(*PROJECT_KEYS)).distinct()


def language_share(languages: DataFrame) -> DataFrame:
    """Share of lines and the clone-set series per language of a project."""
    totals = languages.groupBy("project").agg(F.sum("total_loc").alias("_all"))
    return languages.join(totals, "project").select(
        *PROJECT_KEYS, "n_files", "total_loc", F.bround(ratio("total_loc", "_all", None) * 100, 1).alias("loc_pct"),
        "n_clone_sets", "n_clone_pairs", "roc_pct",
    )


def services_per_language(ranges: DataFrame) -> DataFrame:
    """Services that own files, per project-language."""
    return ranges.groupBy(*PROJECT_KEYS).agg(F.countDistinct("service").alias("services"))


def language_catalogue(clone_set: DataFrame) -> DataFrame:
    """Projects per language with clone sets, each project with the size of its language."""
    per = clone_set.groupBy("language", "project").agg(F.count(F.lit(1)).alias("clone_sets"))
    count = per.groupBy("language").agg(F.count(F.lit(1)).alias("projects"))
    return per.join(count, "language").select("language", "projects", "project", "clone_sets")
