"""Staged tables that nothing reads any more."""

import glob
import os
from urllib.parse import urlparse

from twintrail import session
from twintrail.operators import clones, ranks


def _folders(spark):
    return set(glob.glob(os.path.dirname(urlparse(session.ensure_checkpoint_dir(spark)).path) + "/*/staged-*"))


def test_tables_that_nothing_reads_any_more_go(spark):
    before = _folders(spark)
    df = spark.createDataFrame([("p", "J", i, "a b c d e f\ng h i j") for i in range(3)], "project string, language string, file_id long, text string")
    found = clones.clone_fragments(df, 5, mask=False)
    assert len(_folders(spark) - before) == 1 and found.count() == 3
    before = _folders(spark)
    assert sorted(r.place for r in ranks.placed(df, ["project"], [("file_id", "desc")]).collect()) == [0, 1, 2]
    assert len(_folders(spark) - before) == 1


def test_dropping_leaves_tables_of_others(spark):
    one, two = session.staged(spark.range(3)), session.staged(spark.range(4))
    files = [urlparse(t.inputFiles()[0]).path for t in (one, two)]
    session.dropped(one, spark.range(2))
    assert two.count() == 4
    assert [os.path.dirname(f) in _folders(spark) for f in files] == [False, True]
