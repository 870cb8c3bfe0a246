"""Metric tables on small literal frames and against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from twintrail.operators import metrics, pairs
from twintrail.operators.intervals import contiguous_ranges, merged_lines

SCHEMA = (
    "project string, language string, clone_id string, fragment_index int, file_path string, file_id int, service string, "
    "start_line int, end_line int, line_count int, file_type string, modified_commits array<string>, modified_count int"
)


def rows(spark, data):
    return spark.createDataFrame(
        [("p", "Java", c, i, f, n, s, a, b, b - a + 1, "logic", m, len(m)) for n, (c, i, f, s, a, b, m) in enumerate(data)], SCHEMA
    )


FOUR = [
    ("C1", 0, "a/x.java", "svc_a", 1, 10, ["h1"]),
    ("C1", 1, "b/y.java", "svc_b", 5, 14, ["h1"]),
    ("C2", 0, "a/x.java", "svc_a", 8, 12, []),
    ("C2", 1, "a/z.java", "svc_a", 1, 5, []),
]


def test_three_metric_tables(spark):
    df = rows(spark, FOUR)
    loc = spark.createDataFrame([("p", "Java", "svc_a", 500), ("p", "Java", "svc_b", 300)], "project string, language string, service string, total_loc bigint")
    service = {r.service: r for r in metrics.service_metrics(df, loc).collect()}
    assert service["svc_a"].clone_set_count == 2 and service["svc_a"].inter_clone_set_count == 1
    assert service["svc_a"].total_clone_line_count == 12 + 5
    assert service["svc_a"].roc == round(17 / 500, 6)
    assert service["svc_b"].comod_count == 1 and service["svc_b"].comod_other_service_count == 1
    sets = {r.clone_id: r for r in metrics.clone_set_metrics(df).collect()}
    assert (sets["C1"].service_count, sets["C1"].comod_count, sets["C1"].comod_fragment_ratio) == (2, 1, 1.0)
    assert sets["C1"].cross_service_scale == 40 and sets["C2"].cross_service_element_count == 0
    files = {r.file_path: r for r in metrics.file_metrics(df).collect()}
    assert files["a/x.java"].cross_service_clone_set_ratio == 0.5 and files["a/x.java"].cross_service_comod_count == 1
    assert files["a/z.java"].sharing_service_count == 0 and files["b/y.java"].sharing_service_ratio == 0.5


def test_unresolved_services_count_nowhere(spark):
    df = rows(spark, [("C1", 0, "f", "", 1, 2, ["h"]), ("C1", 1, "g", "s", 1, 2, ["h"])])
    assert [r.service for r in metrics.service_set_counts(df).collect()] == ["s"]
    only = metrics.clone_set_metrics(df).first()
    assert only.service_count == 1 and only.cross_service_fragment_count == 0 and only.comod_count == 1
    assert {r.file_path: r.service for r in metrics.majority_service(df).collect()} == {"f": "", "g": "s"}


def test_majority_tie_takes_smallest_name(spark):
    df = rows(spark, [("C", 0, "f", "b", 1, 1, []), ("C", 1, "f", "a", 2, 2, [])])
    assert metrics.majority_service(df).first().service == "a"


def test_merged_lines_and_ranges(spark):
    df = spark.createDataFrame([("f", 1, 10), ("f", 5, 12), ("f", 13, 20), ("f", 2, 3), ("f", 30, 31)], "k string, start_line int, end_line int")
    assert merged_lines(df, ["k"]).first().lines == 22
    ids = spark.createDataFrame([("s", i) for i in (0, 1, 2, 5, 6, 10)], "k string, v int")
    got = sorted((r.range_start, r.range_end) for r in contiguous_ranges(ids, ["k"], "v").collect())
    assert got == [(0, 2), (5, 6), (10, 10)]


def test_merged_lines_against_brute_force(spark):
    rng = random.Random(7)
    data = [(f"k{rng.randrange(4)}", a, a + rng.randrange(12)) for a in (rng.randrange(80) for _ in range(200))]
    want = {}
    for k, a, b in data:
        want.setdefault(k, set()).update(range(a, b + 1))
    df = spark.createDataFrame(data, "k string, start_line int, end_line int")
    assert {r.k: r.lines for r in merged_lines(df, ["k"]).collect()} == {k: len(v) for k, v in want.items()}


def test_pair_counts_without_pairs_match_brute_force(spark):
    rng = random.Random(3)
    data = []
    for c in range(12):
        for i in range(rng.randrange(2, 9)):
            data.append((f"C{c}", i, f"f{i}", rng.choice(["a", "b", "c", ""]), 1, 2, rng.sample(["h1", "h2", "h3", "h4"], rng.randrange(3))))
    df = rows(spark, data)
    by_set = {}
    for r in data:
        by_set.setdefault(r[0], []).append(r)
    shared = [(c, x, y) for c, rs in by_set.items() for x, y in itertools.combinations(rs, 2)]
    comod = [(c, x, y) for c, x, y in shared if set(x[6]) & set(y[6])]
    got = pairs.pair_summary(df).first()
    assert (got.clone_pairs, got.comod_pairs, got.comod_sets) == (len(shared), len(comod), len({c for c, _, _ in comod}))
    table = pairs.clone_pairs(df)
    assert pairs.pair_table_summary(table).first()[2:] == got[2:]
    want = {}
    for _, x, y in shared:
        if x[3] and y[3]:
            key = tuple(sorted((x[3], y[3])))
            want[key] = want.get(key, 0) + 1
    totals = {(r.service_lo, r.service_hi): r.pairs for r in pairs.service_pair_totals(df).collect() if r.pairs}
    assert totals == want


def test_large_sets_keep_all_their_pairs(spark):
    data = [("BIG", i, f"f{i}", "a", 1, 1, []) for i in range(30)] + [("S", i, f"f{i}", "a", 1, 1, []) for i in range(3)]
    df = rows(spark, data)
    for block in (4, 256):
        table = pairs.clone_pairs(df, block=block).select("clone_id", "fragment_index_x", "fragment_index_y")
        assert table.count() == table.distinct().count() == 435 + 3
    assert [(r.clone_id, r.pairs) for r in pairs.oversized_sets(df, 5).collect()] == [("BIG", 435)]


def test_a_hot_set_is_paired_whole(spark):
    n = 3000
    df = rows(spark, [("HOT", i, f"f{i}", "a", 1, 1, []) for i in range(n)])
    assert pairs.clone_pairs(df).count() == n * (n - 1) // 2 == pairs.pair_summary(df).first().clone_pairs


def test_invariants_on_generated_rows(spark, tiny):
    from twintrail.sources import star_tables as T

    frag = T.text_fragments(spark, tiny).cache()
    table = pairs.clone_pairs(frag).cache()
    assert table.count() == pairs.pair_summary(frag).agg(F.sum("clone_pairs")).first()[0]
    comod_sets = metrics.clone_set_metrics(frag).filter("comod_count > 0").count()
    assert comod_sets == table.filter("comodified = 1").select("project", "language", "clone_id").distinct().count()


def test_places_follow_the_whole_sort(spark):
    from twintrail.operators import ranks

    rng = random.Random(11)
    data = [(rng.choice("ab"), rng.randrange(3), f"n{i}") for i in range(200)]
    df = spark.createDataFrame(data, "k string, v int, name string")
    want = {}
    for k in "ab":
        for place, (_, _, name) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (-r[1], r[2]))):
            want[name] = place
    got = ranks.placed(df.repartition(7), ["k"], [("v", "desc"), ("name", "asc")])
    assert {r.name: r.place for r in got.collect()} == want
    by_name = [r[2] for r in sorted(data, key=lambda r: (r[1], r[2]))]
    for number, size in ((0, 7), (3, 50), (27, 7), (40, 7)):
        rows = ranks.page(df.repartition(5), [F.col("v"), F.col("name")], number, size).collect()
        assert [r.name for r in rows] == by_name[number * size : (number + 1) * size]


def test_tied_rows_are_dealt_to_many_ranges(spark):
    from twintrail.operators import ranks

    tied = spark.range(0, 40000, 1, 8).selectExpr("CAST(NULL AS STRING) AS k", "1 AS v")
    # Small ranges would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    places = ranks.positions(tied, ["k"], [F.col("v")], "place")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.place for r in places.collect()) == list(range(40000))
    # The staged rows lie in several sorted files although all of them are equal.
    assert len(places.inputFiles()) > 2


def test_quantiles_against_sorted_lists(spark):
    from twintrail.operators import ranks

    rng = random.Random(13)
    data = [("a", float(rng.randrange(9))) for _ in range(300)] + [("b", rng.random() ** 9 * 1e6) for _ in range(501)] + [("c", 4.0), ("d", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(df, "v", ["k"], points, "q").collect()}
    assert set(got) == {"a", "b", "c"}

    def plain(values, point):
        values, place = sorted(values), point * (len(values) - 1)
        low, high = values[int(place)], values[min(len(values) - 1, int(place) + 1)]
        return low + (place - int(place)) * (high - low)

    for k, q in got.items():
        values = [v for key, v in data if key == k and v is not None and v == v]
        assert all(abs(x - plain(values, p)) <= 1e-9 * max(1.0, abs(x)) for x, p in zip(q, points))
    whole = ranks.quantiles(df, "v", [], [0.5], "q").first().q[0]
    assert abs(whole - plain([v for _, v in data if v is not None and v == v], 0.5)) < 1e-9


def test_ranges_go_on_over_block_borders(spark):
    rng = random.Random(17)
    values = {k: sorted(rng.sample(range(-40, 200), n)) for k, n in (("thin", 30), ("thick", 220), ("one", 1))}
    values["whole"] = list(range(-16, 64))
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs + vs[:3]], "k string, v long")
    want = set()
    for k, vs in values.items():
        start = vs[0]
        for a, b in zip(vs, [*vs[1:], None]):
            if b != a + 1:
                want.add((k, start, a))
                start = b
    for block in (1, 4, 8, 4096):
        rows = contiguous_ranges(df, ["k"], "v", block).collect()
        assert len(rows) == len(want) and {(r.k, r.range_start, r.range_end) for r in rows} == want


def test_display_ids_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(pairs, "IDS_PER_PIECE", 3)
    monkeypatch.setattr(pairs, "IDS_PER_CHUNK", 8)
    ranges = [("p", "J", "b", 5, 14), ("p", "J", "a", 20, 20), ("p", "J", "a", 30, 41), ("p", "J", "b", 60, 63), ("q", "J", "a", 7, 8)]
    df = spark.createDataFrame(ranges, "project string, language string, service string, range_start int, range_end int")
    got = {(r.project, r.file_id): r.display_id for r in pairs.display_ids(df).collect()}
    order = [*range(5, 15), *range(60, 64), 20, *range(30, 42)]
    assert got == {("p", f): 5 + k for k, f in enumerate(order)} | {("q", 7): 7, ("q", 8): 8}


def test_display_ids_close_gaps(spark):
    ranges = spark.createDataFrame(
        [("p", "J", "a", 1, 2), ("p", "J", "b", 10, 11), ("p", "J", "unknown", 4, 5)],
        "project string, language string, service string, range_start int, range_end int",
    )
    ids = {r.file_id: r.display_id for r in pairs.display_ids(ranges).collect()}
    assert ids == {1: 1, 2: 2, 10: 3, 11: 4}


def test_language_figures_read_held_fragments(spark, tiny):
    """Every figure reads the staged fragments: no text is split into lines again for it."""
    from suite.report_queries import a13_language_stats

    assert "posexplode" not in str(a13_language_stats(spark, tiny)._jdf.queryExecution().optimizedPlan())
