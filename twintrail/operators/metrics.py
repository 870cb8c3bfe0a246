"""Metrics of services, clone sets and files over the enriched fragment table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.constants import FRAGMENT_KEYS, PROJECT_KEYS, SET_KEYS
from twintrail.functions.numbers import ratio
from twintrail.operators.comod import comod_commits, fragment_commits
from twintrail.operators.intervals import added_lines
from twintrail.session import staged

SERVICE_KEYS = [*PROJECT_KEYS, "service"]
FILE_KEYS = [*PROJECT_KEYS, "file_path"]


def metric_base(fragments: DataFrame) -> DataFrame:
    """The columns that metrics read, staged: every level and branch of the three tables reads these, not the views behind them."""
    commits = F.array_sort(F.array_distinct("modified_commits")).alias("modified_commits")
    return staged(fragments.select(*FRAGMENT_KEYS, "service", "file_path", "start_line", "end_line", "line_count", commits))


def _zero(*names: str):
    return [F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names]


def set_services(fragments: DataFrame) -> DataFrame:
    """Sorted resolved services of every clone set."""
    return (
        fragments.filter(F.col("service") != "")
        .groupBy(*SET_KEYS)
        .agg(F.array_sort(F.collect_set("service")).alias("services"))
    )


def clone_set_metrics(fragments: DataFrame) -> DataFrame:
    resolved = F.col("service") != ""
    spans = fragments.groupBy(*SET_KEYS).agg(
        F.size(F.collect_set(F.when(resolved, F.col("service")))).alias("service_count"),
        F.count(F.lit(1)).alias("fragments"),
        F.count_if(resolved).alias("resolved_fragments"),
        F.coalesce(F.sum(F.when(resolved, F.col("line_count"))), F.lit(0)).alias("resolved_lines"),
    )
    # One row per fragment with at least one shared commit, found without pairing fragments.
    rows = fragment_commits(fragments)
    shared = rows.groupBy(*SET_KEYS, "commit").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    counts = shared.groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("comod_count"))
    touched = (
        rows.join(shared, [*SET_KEYS, "commit"], "left_semi")
        .select(*FRAGMENT_KEYS)
        .distinct()
        .groupBy(*SET_KEYS)
        .agg(F.count(F.lit(1)).alias("comod_fragment_count"))
    )
    cross = F.col("service_count") >= 2

    def if_cross(column: str, name: str):
        return F.when(cross, F.col(column)).otherwise(F.lit(0)).cast("bigint").alias(name)

    return (
        spans.join(counts, SET_KEYS, "left")
        .join(touched, SET_KEYS, "left")
        .select(
            *SET_KEYS,
            F.col("service_count").cast("bigint").alias("service_count"),
            if_cross("resolved_fragments", "cross_service_fragment_count"),
            if_cross("resolved_lines", "cross_service_line_count"),
            if_cross("fragments", "cross_service_element_count"),
            "fragments",
            *_zero("comod_count", "comod_fragment_count"),
        )
        .withColumn("cross_service_scale", F.col("cross_service_fragment_count") * F.col("cross_service_line_count"))
        .withColumn("cross_service_fragment_ratio", ratio("cross_service_fragment_count", "fragments"))
        .withColumn("comod_fragment_ratio", ratio("comod_fragment_count", "fragments"))
        .select(
            *SET_KEYS, "service_count", "cross_service_fragment_count", "cross_service_fragment_ratio",
            "cross_service_line_count", "cross_service_scale", "cross_service_element_count",
            "comod_count", "comod_fragment_count", "comod_fragment_ratio",
        )
    )


def service_clone_lines(fragments: DataFrame) -> DataFrame:
    """Files, fragments, raw and merged clone lines of every service."""
    keys = [*SERVICE_KEYS, "file_path"]
    # Rows collapse to one per start line of a file before the interval window sees them.
    by_start = (
        fragments.filter(F.col("service") != "")
        .groupBy(*keys, "start_line")
        .agg(
            F.max("end_line").alias("end_line"),
            F.count(F.lit(1)).alias("n"),
            F.sum("line_count").alias("raw"),
        )
    )
    per_file = (
        by_start.withColumn("added", added_lines(keys, "start_line", "end_line"))
        .groupBy(*keys)
        .agg(F.sum("added").alias("lines"), F.sum("n").alias("n"), F.sum("raw").alias("raw"))
    )
    return per_file.groupBy(*SERVICE_KEYS).agg(
        F.count(F.lit(1)).alias("clone_file_count"),
        F.sum("lines").cast("bigint").alias("total_clone_line_count"),
        F.sum("n").cast("bigint").alias("fragments"),
        F.sum("raw").cast("bigint").alias("raw_lines"),
    )


def service_set_counts(fragments: DataFrame) -> DataFrame:
    return (
        set_services(fragments)
        .select(*PROJECT_KEYS, F.size("services").alias("span"), F.explode("services").alias("service"))
        .groupBy(*SERVICE_KEYS)
        .agg(
            F.count(F.lit(1)).alias("clone_set_count"),
            F.count_if(F.col("span") >= 2).alias("inter_clone_set_count"),
        )
    )


def service_comod_counts(fragments: DataFrame) -> DataFrame:
    commits = comod_commits(fragments)
    own = (
        commits.select(*PROJECT_KEYS, "commit", F.explode("services").alias("service"))
        .distinct()
        .groupBy(*SERVICE_KEYS)
        .agg(F.count(F.lit(1)).alias("comod_count"))
    )
    # Few distinct service groups exist, however many commits share them.
    groups = commits.select(*PROJECT_KEYS, "services").distinct()
    others = (
        groups.select(*PROJECT_KEYS, F.explode("services").alias("service"), "services")
        .select(*SERVICE_KEYS, F.explode("services").alias("other"))
        .filter(F.col("other") != F.col("service"))
        .distinct()
        .groupBy(*SERVICE_KEYS)
        .agg(F.count(F.lit(1)).alias("comod_other_service_count"))
    )
    return own.join(others, SERVICE_KEYS, "left")


def service_metrics(fragments: DataFrame, service_loc: DataFrame) -> DataFrame:
    """Metrics per service; ``service_loc`` holds (project, language, service, total_loc)."""
    return (
        service_set_counts(fragments)
        .join(service_clone_lines(fragments), SERVICE_KEYS)
        .join(service_comod_counts(fragments), SERVICE_KEYS, "left")
        .join(service_loc.select(*SERVICE_KEYS, "total_loc"), SERVICE_KEYS, "left")
        .select(
            *SERVICE_KEYS, "clone_set_count", "inter_clone_set_count", "total_clone_line_count",
            ratio("raw_lines", "fragments", 2).alias("clone_avg_line_count"),
            "clone_file_count",
            ratio("total_clone_line_count", "total_loc").alias("roc"),
            *_zero("comod_count", "comod_other_service_count"),
        )
    )


def majority_service(fragments: DataFrame) -> DataFrame:
    """Most frequent resolved service of every file, the smallest name on a tie; '' for none."""
    counts = fragments.groupBy(*FILE_KEYS, "service").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("service") != ""
    # Largest count, then smallest name: min over (-count, name).
    best = F.min(F.when(named, F.struct((-F.col("n")).alias("m"), F.col("service").alias("s"))))
    return counts.groupBy(*FILE_KEYS).agg(F.coalesce(best["s"], F.lit("")).alias("service"))


def project_service_counts(fragments: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Services per project-language: the declared ones, else those in the fragments."""
    seen = (
        fragments.filter(F.col("service") != "")
        .groupBy(*PROJECT_KEYS)
        .agg(F.countDistinct("service").alias("seen"))
    )
    if declared is None:
        return seen.select(*PROJECT_KEYS, F.col("seen").alias("total_service_count"))
    known = declared.groupBy(*PROJECT_KEYS).agg(F.countDistinct("service").alias("known"))
    return known.join(seen, PROJECT_KEYS, "full").select(
        *PROJECT_KEYS, F.coalesce(F.nullif("known", F.lit(0)), "seen", F.lit(0)).cast("bigint").alias("total_service_count")
    )


def file_metrics(fragments: DataFrame, declared_services: DataFrame | None = None) -> DataFrame:
    own = majority_service(fragments)
    others = F.array_except("services", F.array("own"))
    named = own.withColumnRenamed("service", "own")
    # One row per (file, set), so a set's copies inside a file are summed before any join.
    in_file = fragments.groupBy(*FILE_KEYS, "clone_id").agg(F.sum("line_count").alias("lines"))
    shares = (
        in_file.join(set_services(fragments), SET_KEYS, "left")
        .join(named, FILE_KEYS)
        .withColumn("others", F.coalesce(others, F.array().cast("array<string>")))
    )
    cross = F.size("others") > 0
    sums = shares.groupBy(*FILE_KEYS).agg(
        F.count(F.lit(1)).alias("sets"),
        F.count_if(cross).alias("cross_service_clone_set_count"),
        F.coalesce(F.sum(F.when(cross, F.col("lines"))), F.lit(0)).cast("bigint").alias("cross_service_line_count"),
    )
    shared = _distinct_others(shares, "sharing_service_count")
    comods = (
        fragment_commits(fragments, "file_path")
        .select(*SET_KEYS, "file_path", "commit")
        .distinct()
        .join(comod_commits(fragments), [*SET_KEYS, "commit"])
        .join(named, FILE_KEYS)
        .withColumn("others", others)
        .filter(cross)
    )
    comod_sums = comods.groupBy(*FILE_KEYS).agg(F.count(F.lit(1)).alias("cross_service_comod_count"))
    comod_shared = _distinct_others(comods, "comod_shared_service_count")
    totals = project_service_counts(fragments, declared_services)
    return (
        sums.join(own, FILE_KEYS)
        .join(shared, FILE_KEYS, "left")
        .join(comod_sums, FILE_KEYS, "left")
        .join(comod_shared, FILE_KEYS, "left")
        .join(totals, PROJECT_KEYS, "left")
        .select(
            *FILE_KEYS, "service", *_zero("sharing_service_count", "total_service_count"),
            "cross_service_clone_set_count",
            ratio("cross_service_clone_set_count", "sets").alias("cross_service_clone_set_ratio"),
            ratio(F.coalesce("sharing_service_count", F.lit(0)), "total_service_count").alias("sharing_service_ratio"),
            "cross_service_line_count",
            *_zero("cross_service_comod_count", "comod_shared_service_count"),
        )
    )


def _distinct_others(rows: DataFrame, name: str) -> DataFrame:
    return (
        rows.select(*FILE_KEYS, "others")
        .distinct()
        .select(*FILE_KEYS, F.explode("others").alias("other"))
        .distinct()
        .groupBy(*FILE_KEYS)
        .agg(F.count(F.lit(1)).alias(name))
    )


# --- views on the metric tables ---------------------------------------------------


def clone_set_labels(fragments: DataFrame) -> DataFrame:
    """File types, involved services and fragment total of every clone set."""
    def joined(column):
        return F.array_join(F.array_sort(F.collect_set(column)), ", ")

    return fragments.groupBy(*SET_KEYS).agg(
        joined(F.nullif("file_type", F.lit(""))).alias("file_types"),
        joined(F.nullif("service", F.lit(""))).alias("involved_services"),
        F.count(F.lit(1)).alias("total_fragments"),
    )


def file_main_type(fragments: DataFrame) -> DataFrame:
    """Most frequent file type of every file over resolved fragments, 'unknown' for none."""
    counts = fragments.groupBy(*FILE_KEYS, "file_type").agg(F.count_if(F.col("service") != "").alias("n"))
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("m"), F.col("file_type").alias("t"))))
    return counts.groupBy(*FILE_KEYS).agg(F.coalesce(best["t"], F.lit("unknown")).alias("file_type"))


def metric_kpis(service: DataFrame, clone_set: DataFrame) -> DataFrame:
    """Inter-service sets, clone lines, mean ROC and co-modified sets per project-language."""
    sets = clone_set.groupBy(*PROJECT_KEYS).agg(
        F.count(F.lit(1)).alias("clone_sets"),
        F.count_if(F.col("service_count") >= 2).alias("inter_clone_sets"),
        F.count_if(F.col("comod_count") > 0).alias("comod_clone_sets"),
    )
    services = service.groupBy(*PROJECT_KEYS).agg(
        F.count(F.lit(1)).alias("services"),
        F.sum("total_clone_line_count").cast("bigint").alias("clone_lines"),
        F.bround(F.avg("roc"), 12).alias("mean_roc"),
    )
    return sets.join(services, PROJECT_KEYS, "left")


def mean_positive_roc(service: DataFrame) -> DataFrame:
    """Mean of the positive clone ratios of a project."""
    return service.groupBy("project").agg(
        F.bround(F.coalesce(F.avg(F.when(F.col("roc") > 0, F.col("roc"))), F.lit(0.0)), 12).alias("average_clone_ratio")
    )


def summary_counts(service: DataFrame, clone_set: DataFrame) -> DataFrame:
    """Number of services and clone sets per project-language for summary cards."""
    a = service.groupBy(*PROJECT_KEYS).agg(F.count(F.lit(1)).alias("services"))
    b = clone_set.groupBy(*PROJECT_KEYS).agg(F.count(F.lit(1)).alias("clone_sets"))
    return a.join(b, PROJECT_KEYS, "full").select(*PROJECT_KEYS, *_zero("services", "clone_sets"))
