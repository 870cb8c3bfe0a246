"""Commits that change several fragments of one clone set together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.constants import FRAGMENT_KEYS, SET_KEYS


def fragment_commits(fragments: DataFrame, *extra: str) -> DataFrame:
    """One row per fragment and commit; a fragment key is unique, so rows are distinct."""
    return fragments.select(
        *FRAGMENT_KEYS, *extra, F.explode(F.array_distinct("modified_commits")).alias("commit")
    )


def comod_commits(fragments: DataFrame) -> DataFrame:
    """Commits with at least two fragments of the set, with the services they touch.

    The service list is bounded by the services of one project, not by the fragments.
    """
    return (
        fragment_commits(fragments, "service")
        .groupBy(*SET_KEYS, "commit")
        .agg(
            F.count(F.lit(1)).alias("fragments"),
            F.array_sort(F.collect_set(F.nullif(F.col("service"), F.lit("")))).alias("services"),
        )
        .filter(F.col("fragments") >= 2)
    )


def comod_fragments(fragments: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Fragments that take part in a co-modification commit, one row per commit."""
    commits = comod_commits(fragments) if commits is None else commits
    rows = fragment_commits(fragments, "service", "file_path")
    return rows.join(commits.select(*SET_KEYS, "commit"), [*SET_KEYS, "commit"], "left_semi")
