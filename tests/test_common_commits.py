"""Commit lists of a pair meet only where something is in common."""

import re

import pytest

from twintrail.operators import pairs

SCHEMA = (
    "project string, language string, clone_id string, fragment_index int, file_path string, file_id int, service string, "
    "start_line int, end_line int, line_count int, file_type string, modified_commits array<string>, modified_count int"
)


@pytest.fixture(scope="module")
def frags(spark):
    commits = [None, [], ["a"], ["a", "b"], ["b", "c", None]]
    sizes = {"one": 1, "two": 2, "many": 5, "hot": 23}
    rows = [("p", "J", s, i, f"d/f{i % 3}.java", i % 3, "s", 1, 2, 2, "logic", commits[i % 5], 0) for s, n in sizes.items() for i in range(n)]
    rows += [("p", "J", "twice", i // 2, "d/f", 1, "s", 1, 2, 2, "logic", ["a"], 1) for i in range(6)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_commits_are_compared_where_some_are_in_common(frags):
    pairs_of = pairs.clone_pairs(frags, block=4)
    commits = {(r.clone_id, r.fragment_index): r.modified_commits for r in frags.collect()}
    for r in pairs_of.filter("clone_id = 'hot'").collect():
        x, y = commits["hot", r.fragment_index_x], commits["hot", r.fragment_index_y]
        want = None if x is None or y is None else sorted(set(x) & set(y), key=lambda c: (c is not None, c))
        assert r.comodified_commits == want and r.comodification_count == (None if want is None else len(want))
    assert re.search(r"CASE WHEN \([^\n]* = 0\) THEN [^\n]*sort_array", pairs_of._jdf.queryExecution().analyzed().toString())
