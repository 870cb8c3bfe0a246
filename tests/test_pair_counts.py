"""Counts from fragment classes against the same counts over the table of all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twintrail.operators import coordinates, filters, fragments, pair_counts, pairs
from twintrail.operators.pair_view import PairView

SCHEMA = (
    "project string, language string, clone_id string, fragment_index int, file_path string, file_id int, service string, "
    "start_line int, end_line int, line_count int, file_type string, modified_commits array<string>, modified_count int"
)
METHODS = "element_at(array('ccfsw', 'tks', '', 'no-import', CAST(NULL AS STRING)), CAST({} % 5 AS INT) + 1)"


def some_fragments():
    dice = random.Random(31)
    rows = []
    for s in range(45):
        size = dice.choice([1, 2, 3, 5, 9, 30])
        for i in range(size):
            file = dice.randrange(12)
            commits = sorted(dice.sample(["h1", "h2", "h3", "h4"], dice.choice([0, 0, 1, 2, 3])))
            start = dice.randrange(1, 4) * 10
            kind = dice.choice(["logic", "logic", "data", "test", "config", "odd"] if s % 2 else ["logic", "data"])
            rows.append((dice.choice("pq") if size == 1 else "pq"[s % 2], "J", f"c{s}", i, f"d{file}/f{file % 5}.java", file, dice.choice(["", "a", "b", "c", "unknown"]), start, start + dice.randrange(2), 2, kind, commits, len(commits)))
    return rows


@pytest.fixture(scope="module")
def both(spark):
    frags = spark.createDataFrame(some_fragments(), SCHEMA).withColumn("detection_method", F.expr(METHODS.format("file_id"))).cache()
    table = pairs.clone_pairs(frags, block=4).withColumn("detection_method", F.expr(METHODS.format("file_id_x"))).cache()
    return frags, table


def plain(df):
    names = sorted(df.columns)
    return sorted((tuple(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in df.collect()), key=repr)


CASES = {
    "profile": (lambda f: pair_counts.cross_service_profile(f).drop("methods"), pairs.cross_service_profile),
    "unique": (pair_counts.unique_pair_counts, pairs.unique_pair_counts),
    "types": (pair_counts.set_code_types, pairs.set_code_types),
    "options": (pair_counts.clone_options, pairs.clone_options),
    "services": (pair_counts.service_options, pairs.service_options),
    "matrix": (pair_counts.shared_clone_matrix, pairs.shared_clone_matrix),
    "network": (pair_counts.network_edges, pairs.network_edges),
    "overview": (pair_counts.dataset_overview, pairs.dataset_overview),
    "touch": (lambda f: pair_counts.touch_counts(f, "service"), lambda p: pairs.touch_counts(p, "service")),
    "touched files": (lambda f: pair_counts.touch_counts(f, "file_path"), lambda p: pairs.touch_counts(p, "file_path")),
    "pair types": (pair_counts.pair_type_breakdown, pairs.pair_type_breakdown),
    "methods": (pair_counts.method_breakdown, pairs.method_breakdown),
    "across": (lambda f: pair_counts.scope_selectivity(f, "cross"), lambda p: filters.selectivity(p, F.col("relation") == "inter")),
    "within": (lambda f: pair_counts.scope_selectivity(f, "within"), lambda p: filters.selectivity(p, F.col("relation") == "intra")),
    "files": (pair_counts.clone_files, fragments.clone_files),
    "summary": (lambda f: pairs.pair_summary(f).filter("clone_pairs > 0"), pairs.pair_table_summary),
}


@pytest.mark.parametrize("case", CASES)
def test_classes_count_like_pairs(both, case):
    from_classes, from_pairs = CASES[case]
    assert plain(from_classes(both[0])) == plain(from_pairs(both[1]))


def test_methods_of_a_set(both):
    got = {r.clone_id: r.methods for r in pair_counts.cross_service_profile(both[0]).collect()}
    want = {}
    for r in both[1].collect():
        want.setdefault(r.clone_id, set())
        if r.detection_method is not None:
            want[r.clone_id].add(r.detection_method)
    assert {k: v or [] for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_set_of_many_copies_makes_no_pair_rows(spark):
    n = 3000
    hot = spark.range(n).selectExpr(
        "'p' AS project", "'J' AS language", "'hot' AS clone_id", "CAST(id AS INT) AS fragment_index", "concat('f', id % 700) AS file_path", "CAST(id % 700 AS INT) AS file_id",
        "concat('s', id % 3) AS service", "1 AS start_line", "2 AS end_line", "2 AS line_count", "'logic' AS file_type", "array('h') AS modified_commits", "1 AS modified_count",
    )
    row = pair_counts.cross_service_profile(hot).first()
    assert row.total_pair_count == row.comodified_count == row.logic_pairs == n * (n - 1) // 2
    assert row.inter_service_pairs == 3 * 1000 * 1000 and row.file_count == 700
    # Each file has four or five fragments spread over the set, so all ordered pairs of files occur but some at the ends.
    index = [[i for i in range(n) if i % 700 == f] for f in range(700)]
    assert row.pair_count == sum(x[0] < y[-1] for x in index for y in index)
    plan = pair_counts.dataset_overview(hot)._jdf.queryExecution().optimizedPlan().toString()
    assert "fragment_index_x" not in plan


VIEWS = {
    "spread": (lambda v: v.spread(3), lambda p: filters.by_service_spread(p, "3")),
    "code type": (lambda v: v.code_type("mixed"), lambda p: filters.by_set_code_type(p, "mixed")),
    "focus": (lambda v: v.focus("a"), lambda p: filters.by_focus_service(p, "a")),
    "focus on two": (lambda v: v.focus("a", "b"), lambda p: filters.by_focus_service(p, "a", "b")),
    "focus on itself": (lambda v: v.focus("a", "a"), lambda p: filters.by_focus_service(p, "a", "a")),
    "file": (lambda v: v.of_file("d3/f3.java"), lambda p: filters.by_file(p, "d3/f3.java")),
    "one set": (lambda v: v.clone_id("c7"), lambda p: p.filter("clone_id = 'c7'")),
    "sets and a side": (lambda v: v.spread(2).code_type("logic").of_file("d3/f3.java"), lambda p: filters.by_file(filters.by_set_code_type(filters.by_service_spread(p, "2"), "logic"), "d3/f3.java")),
}


@pytest.mark.parametrize("case", VIEWS)
@pytest.mark.parametrize("block", [3, 256])
def test_view_makes_the_pairs_that_a_filter_keeps(both, case, block):
    frags, table = both
    view, kept = VIEWS[case]
    got = view(PairView(frags)).pairs(block)
    want = kept(table).drop("detection_method")
    assert sorted(got.columns) == sorted(want.columns)
    assert got.count() > 0 or case == "sets and a side"
    assert plain(got) == plain(want)


def test_links_of_a_coordinate(both):
    frags, table = both
    rows = table.collect()
    for x, y in [(3, 4), (4, 3), (5, 5)]:
        chosen = {r.clone_id for r in rows if (r.file_id_x, r.file_id_y) == (x, y)}
        want = {(r.clone_id, r.file_id_x, r.file_id_y) for r in rows if r.clone_id in chosen and (r.file_id_x, r.file_id_y) != (x, y)}
        got = pairs.clone_set_links(frags, lambda f: f == x, lambda f: f == y).collect()
        assert len(got) == len(want) and {(r.clone_id, r.file_id_x, r.file_id_y) for r in got} == want


def test_overlap_of_a_coordinate(both):
    rows = both[1].select("project", "file_id_x", "file_id_y").collect()
    for r in pairs.with_overlap(both[1]).collect():
        assert r.overlap == rows.count((r.project, r.file_id_x, r.file_id_y))


def test_carried_columns_replace_a_look_up(both):
    told = pairs.clone_pairs(both[0].withColumn("commits", F.col("modified_commits")), block=4, carry=("commits",))
    assert "commits_x" not in both[1].columns and plain(told.select(*both[1].drop("detection_method").columns)) == plain(both[1].drop("detection_method"))
    # Every other stored list is dropped, so that the sides' commits are needed.
    half = [t.withColumn("comodified_commits", F.when(F.col("fragment_index_x") % 2 == 0, F.col("comodified_commits"))) for t in (told, both[1])]
    found = fragments.pair_history(half[0])
    assert plain(found) == plain(fragments.pair_history(half[1], both[0])) and found.count() > 50


def test_display_ids_before_pairs(both):
    # File 3 has no id.
    ids = both[0].select("project", "language", "file_id").distinct().filter("file_id <> 3").withColumn("display_id", F.col("file_id") + 100)
    before = pairs.clone_pairs(pairs.with_display_coordinates(both[0], ids), block=4, carry=("display_id",))
    keys = ["project", "language", "clone_id", "fragment_index_x", "fragment_index_y", "display_id_x", "display_id_y"]
    assert plain(before.select(*keys)) == plain(pairs.with_display_coordinates(both[1], ids).select(*keys))
    assert 0 < before.count() < both[1].count()


def test_comodified_pairs_of_sets_of_many_histories(spark):
    dice = random.Random(5)
    rows = []
    for s, size in (("few", 6), ("some", 90), ("many", 400)):
        for i in range(size):
            commits = dice.sample([f"h{k}" for k in range(60)], dice.choice([0, 1, 2, 4])) + ([None] if i % 9 == 0 else [])
            rows.append(("p", "J", s, i, commits if i % 7 else ["h1", "h2"]))
    frags = spark.createDataFrame(rows, "project string, language string, clone_id string, fragment_index int, modified_commits array<string>")
    want = {}
    for _, _, s, i, a in rows:
        for _, _, t, j, b in rows:
            want[s] = want.get(s, 0) + (s == t and i < j and bool(set(a) & set(b)))
    for few, block in ((32, 4096), (2, 50), (1000, 4096), (32, 64)):
        got = {r.clone_id: r.pairs for r in pairs.comodified_pairs(frags, few, block).collect()}
        assert got == {s: n for s, n in want.items() if n}, (few, block)


COORDINATES = {
    "overlap": (coordinates.coordinate_overlap, pairs.coordinate_overlap),
    "pairs": (coordinates.pairs_with_overlap, lambda p: pairs.with_overlap(p).select("project", "language", "clone_id", "fragment_index_x", "fragment_index_y", "overlap")),
    "heat": (coordinates.heat_map, pairs.heat_map),
}


@pytest.mark.parametrize("case", COORDINATES)
def test_cells_of_files_count_like_pairs(both, case, files=3):
    frags, table = both
    odd = F.expr("CASE WHEN file_id = 7 THEN NULL ELSE file_id END").alias("file_id")
    line = F.expr("CASE WHEN fragment_index % 3 = 0 THEN NULL ELSE start_line END").alias("start_line")
    from_cells, from_pairs = COORDINATES[case]
    assert plain(from_cells(frags, files=files)) == plain(from_pairs(table)) != []
    holes = frags.select(*[odd if c == "file_id" else line if c == "start_line" else c for c in frags.columns])
    if case == "pairs":
        # A join finds no pairs for a coordinate without a file, a window does.
        assert from_cells(holes, files=files).count() == table.count()
    else:
        assert plain(from_cells(holes, files=files)) == plain(from_pairs(pairs.clone_pairs(holes)))


def test_a_cell_looks_at_some_files_and_pairs_at_a_time(both, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(coordinates, "FILES_PER_STRIP", 2)
    monkeypatch.setattr(coordinates, "PAIRS_AT_ONCE", 7)
    rows = [r.asDict() for r in both[0].filter("project = 'p' AND clone_id = 'c0' OR project = 'p' AND clone_id = 'c2'").collect()]
    places = [{"clone_id": r["clone_id"], "file_id": r["file_id"], "first": r["fragment_index"], "last": r["fragment_index"], "lines": 2, "_block": r["file_id"] % 2} for r in rows]
    key = [pa.scalar("p"), pa.scalar("J")]
    got = {}
    for low, high in [(0, 0), (0, 1), (1, 1)]:
        batch = pa.RecordBatch.from_pylist([p for p in places if p["_block"] in (low, high)])
        for out in coordinates._overlaps((*key, pa.scalar(low), pa.scalar(high)), iter([batch])):
            for r in out.to_pylist():
                assert (r["file_id_y"], r["file_id_x"]) not in got and r["coord_total_lines"] == 4 * r["overlap_count"]
                got[r["file_id_y"], r["file_id_x"]] = r["overlap_count"]
    want = {}
    for x in places:
        for y in places:
            if x["clone_id"] == y["clone_id"] and x["first"] < y["first"]:
                at = y["file_id"], x["file_id"]
                want[at] = want.get(at, 0) + 1
    assert got == want != {}


@pytest.mark.parametrize("more", [{"spread": 2, "code_type": "mixed"}, {"spread": "custom", "spread_min": 3, "clone_id": "c7"}, {"comodified": "any", "code_type": "logic"}])
def test_composed_filter_over_fragments_keeps_the_same_pairs(both, more):
    frags, table = both
    wanted = {"scope": "cross"} | more
    want = filters.filter_pairs(table, **wanted).drop("detection_method")
    assert plain(filters.filter_pairs(PairView(frags), **wanted)) == plain(want)


def test_pairs_of_a_large_set(both, spark):
    """Each two fragments meet once, in a set whose order has gaps too, and their keys are not put together into a few tasks."""
    some = both[0].filter("project = 'p'").limit(1).select(*[c for c in both[0].columns if c != "fragment_index"])
    index = [3 * i + i % 2 for i in range(90)] + [10_000_000]
    hot = some.crossJoin(spark.createDataFrame([(i,) for i in index], "fragment_index int"))
    table = pairs.clone_pairs(hot, block=8)
    got = [(r.fragment_index_x, r.fragment_index_y) for r in table.select("fragment_index_x", "fragment_index_y").collect()]
    order = sorted(index)
    assert sorted(got) == [(x, y) for k, x in enumerate(order) for y in order[k + 1 :] if x < y]
    assert table.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("mode", [("yes",), ("none",), ("once",), ("repeated",), ("custom", "3"), ("custom", "0"), ("custom", "x"), ("all",)])
def test_comodification_of_a_view_keeps_the_same_pairs(both, mode):
    view = filters.by_comodification(PairView(both[0]), *mode)
    table = filters.by_comodification(both[1].drop("detection_method"), *mode)
    kept = plain(view.pairs(block=4))
    assert kept == plain(table) and kept
    flagged = filters.by_comodification(PairView(both[0]).drop("comodification_count"), *mode).pairs(block=4)
    assert "comodification_count" not in flagged.columns
    if mode == ("yes",):
        assert plain(flagged) == plain(table.drop("comodification_count"))


def test_known_services_of_a_view(both):
    kept = plain(filters.known_pairs(PairView(both[0])).pairs(block=4))
    assert kept == plain(filters.known_pairs(both[1].drop("detection_method"))) and kept


@pytest.mark.parametrize("at_once", [1, 7, 1 << 21])
def test_commits_in_common_are_counted_by_blocks(spark, monkeypatch, at_once):
    dice = random.Random(5)
    some = ["a", "b", "c", "d", None]
    lists = [dice.choices(some, k=dice.randrange(6)) if dice.random() < 0.8 else None for _ in range(60)]
    monkeypatch.setattr(pairs, "COUNTS_AT_ONCE", at_once)
    cells = [([dice.choice(lists) for _ in range(dice.randrange(1, 6))], [dice.choice(lists) for _ in range(dice.randrange(1, 6))]) for _ in range(25)]
    kind = pa.list_(pa.struct([("commits", pa.list_(pa.string()))]))
    x, y = (pa.array([[{"commits": c} for c in cell[side]] for cell in cells], kind) for side in (0, 1))
    # Some cells are in front of the slice, as in a batch.
    made = [row for part in pairs.common_counts.func(iter([(x.slice(2), y.slice(2))])) for row in part.to_pylist()]
    assert made == [[None if a is None or b is None else len(set(a) & set(b)) for a in left for b in right] for left, right in cells[2:]]


def test_blocks_of_repeated_places_are_cut(spark):
    rows = [("p", "J", "c", i // 5 if i < 40 else None, f"f{i}", i, "a", 1, 1, 1, "logic", ["h"] if i % 2 else [], 0) for i in range(43)]
    rows += [("p", None, "c", i, "f", i, None, 1, 1, 1, None, None, 0) for i in range(3)]
    rows += [("p", "J", "d", i, None, None, None, 1, 1, 1, None, None, 0) for i in range(3)]
    frags = spark.createDataFrame(rows, SCHEMA)
    made = pairs.clone_pairs(frags, block=3)
    x, y = frags.alias("x"), frags.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("project", "language", "clone_id")]
    wanted = x.join(y, [*same, F.col("x.fragment_index") < F.col("y.fragment_index")]).select(
        "x.clone_id", "x.fragment_index", "y.fragment_index", "x.file_path", "y.file_path", "x.file_id", "y.file_id",
        F.size(F.array_intersect("x.modified_commits", "y.modified_commits")),
    )
    names = ["clone_id", "fragment_index_x", "fragment_index_y", "file_path_x", "file_path_y", "file_id_x", "file_id_y", "comodification_count"]
    assert plain(made.select(*names)) == plain(wanted.toDF(*names))
