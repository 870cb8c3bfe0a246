"""Pairs that are made without dealing small sets out again, and the order view they are made of."""

import pytest
from pyspark.sql import functions as F

from twintrail.operators import pairs
from twintrail.sources import star_tables

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


@pytest.mark.parametrize("block", [4, 256])
def test_small_and_large_sets_give_all_their_pairs(frags, block):
    tokens = frags.select("project", "language", "clone_id").distinct().filter("clone_id <> 'two'").withColumn("token_count", F.lit(7))
    got = sorted((r.clone_id, r.fragment_index_x, r.fragment_index_y, r.token_count) for r in pairs.clone_pairs(frags, tokens, block).collect())
    index = {}
    for r in frags.collect():
        index.setdefault(r.clone_id, []).append(r.fragment_index)
    assert got == sorted((s, x, y, 0 if s == "two" else 7) for s, n in index.items() for x in n for y in n if x < y)


def test_sets_of_one_block_are_shuffled_once(spark, frags):
    """Blocks that are dealt to meet each other come from larger sets alone."""
    plan = pairs.clone_pairs(frags)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("RepartitionByExpression") == 2
    assert plan.count("_blocks") and "> 1)" in plan


def test_order_lines_in_place_by_one_shuffle(spark, tmp_path):
    columns = "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_shipdate date"
    lines = [(1, 9, 1, 23, 1.0, 5.0, 0.01, 0.05, "1999-02-03"), (1, 2, 2, 3, 1.0, 6.0, 0.09, 0.01, "1999-12-31"), (1, None, 3, 3, 1.0, 6.0, 0.01, 0.05, "1999-12-31"), (None, 4, 1, 3, 1.0, 6.0, 0.01, 0.05, "1999-12-31"),
             (2, 7, 1, 4, 1.0, 7.0, 0.01, 0.05, None), (2, 2_000_007, 2, 4, 1.0, 7.0, None, 0.05, "2001-10-01"), (2, 2_000_008, 3, 4, 1.0, 7.0, 0.01, None, "2001-10-01")]
    rows = spark.createDataFrame([(*r[:-1], r[-1]) for r in lines], columns.replace("l_shipdate date", "l_shipdate string"))
    rows.withColumn("l_shipdate", F.col("l_shipdate").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = star_tables.order_fragments(spark, str(tmp_path))
    got = sorted((r.clone_id, r.fragment_index, r.file_id, r.service, r.line_count, r.modified_commits) for r in found.collect())
    assert got == [
        ("1", 1, 2, "svc3", 6, []), ("1", 2, 9, "", 5, ["q1999-1", "y1999"]),
        ("2", 0, 7, "svc4", 7, []), ("2", 1, 2_000_007, "svc4", 7, ["y2001"]), ("2", 2, 2_000_008, "svc4", 7, ["q2001-4"]),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
