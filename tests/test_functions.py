"""Column functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from twintrail.functions import commits, labels, names, numbers, paths
from twintrail.operators import clones, filters, services


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "path, want",
    [
        ("src/test/A.java", "test"), ("pkg/foo_test.go", "test"), ("web/Dockerfile", "config"), ("a/b/app.YML", "config"), ("x/config/A.java", "config"),
        ("x/dto/A.java", "data"), ("schema.sql", "data"), ("src/main/A.java", "logic"), ("src\\entity\\A.java", "data"), ("a.yml/x.java", "logic"),
    ],
)
def test_file_type(spark, path, want):
    assert one(spark, paths.file_type("p"), p=path) == want


def test_paths(spark):
    assert one(spark, paths.file_path("p", "/d/r"), p=" ./a\\b.py") == "a/b.py"
    assert one(spark, paths.repo_path("p", "/d/r"), p="/d/r/a/b/") == "a/b"
    assert one(spark, paths.project_from_url("p"), p="https://github.com/o/r/") == "o.r"
    assert one(spark, paths.loc("p"), p="a\nb\n") == 2
    assert one(spark, paths.service_relative_path("p", "s"), p="mod/orders/app/src/main/A.java", s="x/orders") == "src/main/A.java"
    assert one(spark, paths.service_relative_path("p", "s"), p="mod/A.java", s="orders") == "A.java"
    assert one(spark, paths.detector_language("l"), l="C++") == "cpp"
    assert one(spark, paths.base_url("p"), p="o.r.x") == "https://github.com/o/r.x"


def test_commits(spark):
    raw = '[{"type":"modified","commit":"a"},{"type":"added","commit":"b"},{"type":"modified","commit":"a"}]'
    assert one(spark, commits.modified_commits(commits.history("r")), r=raw) == ["a"]
    assert one(spark, commits.parse_commit_list("r"), r=raw) == ["a", "b"]
    assert one(spark, commits.parse_commit_list("r"), r='["x","","y"]') == ["x", "y"]
    assert one(spark, commits.parse_commits("r"), r="not json") == []
    assert one(spark, commits.short_commits("c"), c=["123456789", "b", "c", "d"]) == "1234567, b, c …+1"


def test_rounding_is_half_even(spark):
    assert one(spark, numbers.percent("x", 2), x=0.16625) == 16.62
    assert one(spark, numbers.ratio("a", "b"), a=1, b=0) == 0.0


def test_run_names(spark):
    run = one(spark, labels.parse_run_name("n"), n="my_repo_RNR05_40_filtered_clonepair_freq20_sd3_20240131_mac9")
    assert (run.repo, run.detection, run.min_tokens, run.comod, run.frequency, run.date, run.search_depth, run.max_commits) == ("my_repo", "RNR05", 40, "clonepair", 20, "20240131", 3, 9)
    assert one(spark, labels.parse_run_name("n"), n="something_else") is None


def test_names(spark):
    assert one(spark, names.names_from_image("i", "u", "r"), i="reg/acme-shop-api", u="Acme", r="Shop") == ["acme-shop-api", "shop-api", "acme-api", "api"]
    assert one(spark, names.names_from_container("n"), n="Orders-Service") == ["orders-service", "orders"]
    assert one(spark, names.compose_path_code("p"), p="deploy/docker/docker-compose.yml") == "ia"
    assert one(spark, names.compose_path_code("p"), p="unrelated/docker-compose.yml") is None
    assert one(spark, names.compose_name_rank("p"), p="docker-compose.prod.yml") == 6


SOURCES = {
    "Java": (["package a;", "import b;", "class C {}"], [True, True, False]),
    "Go": (["package m", "import (", '"fmt"', ")", "func f() {}"], [True, True, True, True, False]),
    "Python": (["from a import (", "b,", "c)", "x = 1"], [True, True, True, False]),
    "JavaScript": (["const {", "a } = require('x')", "const b = require(", "'y');", "export { z } from 'q';", "go();"], [False, False, True, True, True, False]),
    "Ruby": (["require 'x'", "puts 1"], [True, False]),
    "Rust": (["use a::b;", "fn main() {}"], [True, False]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_declaration_lines(spark, language):
    lines, want = SOURCES[language]
    df = spark.createDataFrame([("p", language, 1, "\n".join(lines))], "project string, language string, file_id int, text string")
    rows = sorted(clones.declaration_lines(df).collect(), key=lambda r: r.line_no)
    assert [r.is_declaration for r in rows] == want
    assert len(rows) == len(lines)


def test_clone_grouping_finds_maximal_runs(spark):
    shared = " ".join(f"w{chr(97 + i)}" for i in range(20))
    texts = [f"start one {shared} end", f"other {shared} tail here", f"{shared}", "nothing in common at all with the rest of these words here"]
    df = spark.createDataFrame([("p", "en", i, t) for i, t in enumerate(texts)], "project string, language string, file_id int, text string")
    rows = clones.clone_fragments(df, 8, mask=False).collect()
    assert len({r.clone_id for r in rows}) == 1
    assert sorted((r.file_id, r.start_token, r.token_count) for r in rows) == [(0, 2, 20), (1, 1, 20), (2, 0, 20)]
    indexed = clones.index_fragments(clones.clone_fragments(df, 8, mask=False)).collect()
    assert sorted(r.fragment_index for r in indexed) == [0, 1, 2]


def test_longest_prefix_with_boundary_and_tiers(spark):
    paths_df = spark.createDataFrame([("p", f) for f in ("a/b/x", "a/bc/x", "ab/x", "z/x", "a")], "project string, file_path string")
    contexts = spark.createDataFrame(
        [("p", "a", "outer", 1, 1), ("p", "a/b/", "inner", 1, 2), ("p", "z", "late", 2, 1), ("p", "a/b", "twin", 1, 3), ("p", "a/bc", "fallback", 2, 2)],
        "project string, context string, service string, tier int, ordinal int",
    )
    got = {r.file_path: r.service for r in services.resolve_services(paths_df, contexts).collect()}
    assert got == {"a/b/x": "inner", "a/bc/x": "outer", "ab/x": "", "z/x": "late", "a": "outer"}


def test_filters(spark):
    df = spark.createDataFrame(
        [("p", "J", "1", "a", "b", "logic", "data", 0), ("p", "J", "2", "a", "a", "test", "logic", 2), ("p", "J", "3", "unknown", "b", "config", "config", 1)],
        "project string, language string, clone_id string, service_x string, service_y string, file_type_x string, file_type_y string, comodification_count int",
    ).withColumn("relation", labels.relation("service_x", "service_y"))

    def ids(out):
        return sorted(r.clone_id for r in out.collect())

    assert ids(filters.known_pairs(df)) == ["1", "2"]
    assert ids(filters.by_comodification(df, "repeated")) == ["2"] and ids(filters.by_comodification(df, "custom", "x")) == ["1", "2", "3"]
    assert ids(filters.by_clone_id_text(df, "#3")) == ["3"] and ids(filters.by_clone_id_text(df, "none")) == ["1", "2", "3"]
    assert ids(filters.by_set_code_type(df, "mixed")) == ["2"] and ids(filters.by_set_code_type(df, "logic")) == ["1"]
    assert ids(filters.by_focus_service(df, "b", "a")) == ["1"] and ids(filters.by_service_spread(df, 2)) == ["1"]
    assert filters.metric_catalogue(spark, "service").count() == 8
    label = filters.selectivity(df, F.lit(False)).first().label
    assert label == "0.0%"
