"""Runs of commits with an equal state, and which commits to analyse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twintrail.operators.intervals import range_lookup
from twintrail.operators.ranks import dense_index, previous_value, running_total

CHUNK_COMMITS = 4096


def state_chunks(commits: DataFrame) -> DataFrame:
    """Maximal runs of consecutive commits with the same state, as closed ordinal ranges.

    ``commits``: project, ord (dense, oldest first), sha, state.
    """
    block = F.floor(F.col("ord") / CHUNK_COMMITS)
    with_prior = previous_value(commits, ["project"], "ord", block, "state", "_prior")
    changed = (~F.col("state").eqNullSafe(F.col("_prior"))).cast("int")
    marked = running_total(with_prior, ["project"], [F.col("ord")], block, changed, "_run")
    return (
        marked.groupBy("project", "_run")
        .agg(
            F.min("ord").alias("from_n"),
            F.max("ord").alias("to_n"),
            F.min_by("sha", "ord").alias("from_sha"),
            F.max_by("sha", "ord").alias("to_sha"),
            F.min_by("state", "ord").alias("state"),
        )
        .drop("_run")
    )


def group_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of a project gathered by equal state, ranges in order; no state is left out."""
    ranges = F.array_sort(F.collect_list(F.struct("from_n", "to_n")))
    return (
        chunks.filter(F.col("state").isNotNull())
        .groupBy("project", "state")
        .agg(
            F.array_join(
                F.transform(ranges, lambda r: F.concat(r["from_n"].cast("string"), F.lit("-"), r["to_n"].cast("string"))), ","
            ).alias("ranges"),
            F.sum(F.col("to_n") - F.col("from_n") + 1).cast("bigint").alias("commits"),
        )
    )


def chunk_of_commit(commits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Commits with the chunk whose ordinal range holds them; NULL outside every range."""
    held = range_lookup(
        commits.select("project", "ord"), chunks.select("project", "from_n", "to_n"), ["project"], "ord", "from_n", "to_n"
    )
    return commits.join(held, ["project", "ord"], "left")


def state_as_of(commits: DataFrame, states: DataFrame) -> DataFrame:
    """State of the last entry that starts at or before each commit.

    ``states``: project, from_n, state. Each entry holds until the next one starts; the
    window runs over the short list of entries only.
    """
    nxt = F.lead("from_n").over(W.partitionBy("project").orderBy("from_n"))
    last = commits.groupBy("project").agg(F.max("ord").alias("_last"))
    spans = (
        states.withColumn("_next", nxt).join(last, "project")
        .withColumn("to_n", F.coalesce(F.col("_next") - 1, F.greatest("_last", "from_n")))
        .select("project", "from_n", "to_n", "state")
    )
    held = range_lookup(commits.select("project", "ord"), spans, ["project"], "ord", "from_n", "to_n")
    return commits.join(held.select("project", "ord", "state"), ["project", "ord"], "left")


def chunk_choice(chunks: DataFrame, which: str) -> DataFrame:
    """Latest, first or all chunks of each project."""
    if which == "all":
        return chunks
    best = F.max(F.struct("from_n", F.struct("*"))) if which == "latest" else F.min(F.struct("from_n", F.struct("*")))
    return chunks.groupBy("project").agg(best.alias("_b")).select("_b.col2.*")


# --- commit choice -------------------------------------------------------------------


def before_cutoff(committed: Column, cutoff: str | None, zone: str = "Asia/Tokyo") -> Column:
    """Committed at or before a local cut-off; without a cut-off everything is."""
    if not cutoff:
        return F.lit(True)
    return committed <= F.to_utc_timestamp(F.lit(cutoff).cast("timestamp"), zone)


def _month(ts: str) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def _newest(commits: DataFrame, depth: int, cap: int) -> DataFrame:
    limits = [n for n in (depth, cap) if n != -1]
    if not limits:
        return commits
    w = W.partitionBy("project").orderBy(F.col("committed_ts").desc(), "sha")
    return commits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= min(limits)).drop("_n")


def merge_commits(commits: DataFrame, cutoff: str | None = None, depth: int = -1, cap: int = -1) -> DataFrame:
    """Newest merge commits of each project."""
    kept = commits.filter((F.col("n_parents") >= 2) & before_cutoff(F.col("committed_ts"), cutoff))
    return _newest(kept, depth, cap)


def tagged_commits(commits: DataFrame, cutoff: str | None = None, depth: int = -1, cap: int = -1) -> DataFrame:
    """Commits of the newest tags of each project; depth -1 is unlimited."""
    kept = commits.filter(F.col("tag").isNotNull() & before_cutoff(F.col("committed_ts"), cutoff))
    return _newest(kept, depth, cap)


def every_nth_commit(
    commits: DataFrame, step: int, cutoff: str | None = None, depth: int = -1, cap: int = -1
) -> DataFrame:
    """Every step-th commit counted from the newest; depth bounds the commits looked at."""
    kept = commits.filter(before_cutoff(F.col("committed_ts"), cutoff))
    order = [F.col("committed_ts").desc(), F.col("sha")]
    counted = dense_index(kept, ["project"], order, -_month("committed_ts"), "_n")
    hit = F.col("_n") % step == 0
    if depth != -1:
        hit = hit & (F.col("_n") < depth)
    if cap != -1:
        hit = hit & (F.col("_n") < cap * step)
    return counted.filter(hit).drop("_n")


def adjacent_commits(commits: DataFrame) -> DataFrame:
    """(child, parent) pairs of neighbouring analysed commits, the child being newer.

    ``ord`` counts from the newest, so the neighbour is found by equality on ord + 1.
    """
    child = commits.select("project", F.col("ord").alias("step"), F.col("sha").alias("child_sha"))
    parent = commits.select("project", (F.col("ord") - 1).alias("step"), F.col("sha").alias("parent_sha"))
    return child.join(parent, ["project", "step"])
