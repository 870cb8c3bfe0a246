"""Commit-list functions over JSON text and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twintrail.functions.numbers import _col

HISTORY = "array<struct<type:string,commit:string>>"
EMPTY = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(EMPTY)


def _clean(commits: Column) -> Column:
    return F.array_distinct(F.filter(commits, lambda c: c.isNotNull() & (c != "")))


def history(raw) -> Column:
    """Modification history; unreadable text gives an empty list."""
    return F.coalesce(F.from_json(_col(raw), HISTORY), F.array().cast(HISTORY))


def modified_commits(entries) -> Column:
    """Distinct commits of the entries typed 'modified'."""
    kept = F.filter(_col(entries), lambda e: e["type"] == "modified")
    return _clean(F.transform(kept, lambda e: e["commit"]))


def parse_commits(raw) -> Column:
    """Distinct commits of a JSON string array; bad input gives an empty list."""
    return _clean(F.coalesce(F.from_json(_col(raw), EMPTY), _no_strings()))


def parse_commit_list(raw) -> Column:
    """Commits of a JSON array whose items are strings or objects with a commit field."""
    items = F.coalesce(F.from_json(_col(raw), EMPTY), _no_strings())
    names = F.transform(
        items, lambda i: F.when(i.startswith("{"), F.get_json_object(i, "$.commit")).otherwise(i)
    )
    return _clean(names)


def common_commits(left, right, ascending: bool = True) -> Column:
    return F.sort_array(F.array_intersect(_col(left), _col(right)), ascending)


def comodified(left, right) -> Column:
    return F.coalesce(F.arrays_overlap(_col(left), _col(right)), F.lit(False)).cast("int")


def stored_pair_commits(raw, count) -> Column:
    """Commit list kept on a pair row; NULL when the row counts commits but lists none."""
    listed = parse_commit_list(raw)
    return F.when((F.coalesce(_col(count), F.lit(0)) > 0) & (F.size(listed) == 0), F.lit(None).cast(EMPTY)).otherwise(
        listed
    )


def row_is_comodified(count, flag) -> Column:
    return F.coalesce(_col(count) > 0, F.lower(_col(flag).cast("string")).isin("1", "true", "yes"), F.lit(False))


def short_commits(commits, shown: int = 3, width: int = 7) -> Column:
    """First commits in short form, then how many more there are."""
    short = F.transform(_col(commits), lambda c: F.substring(c, 1, width))
    head = F.array_join(F.slice(short, 1, shown), ", ")
    more = F.concat(F.lit(" …+"), (F.size(short) - shown).cast("string"))
    return F.concat(head, F.when(F.size(short) > shown, more).otherwise(""))
