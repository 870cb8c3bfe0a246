"""Metric tables, co-modification and their views."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from twintrail.constants import SET_KEYS
from twintrail.operators import comod, metrics, ranks
from twintrail.operators.intervals import merged_lines
from twintrail.sources import star_tables as T


def flagship(spark, d):
    """Clone-set metrics beside the clone share and size of the services each set spans."""
    rows = metrics.metric_base(T.order_fragments(spark, d))
    sets = metrics.clone_set_metrics(rows)
    services = metrics.service_metrics(rows, T.order_service_loc(spark, d))
    spans = metrics.set_services(rows).withColumn("service", F.explode("services")).drop("services")
    most = spans.join(services, ["project", "language", "service"]).groupBy(*SET_KEYS).agg(
        F.max("roc").alias("highest_roc"), F.max("clone_set_count").alias("widest_service")
    )
    return sets.join(most, SET_KEYS, "left").orderBy(F.col("service_count").desc(), "clone_id")


query(
    "flagship_sets_and_services",
    """SELECT m.*, r.highest_roc, r.widest_service FROM o_set_metrics m LEFT JOIN (
      SELECT project, language, clone_id, max(roc) AS highest_roc, max(clone_set_count) AS widest_service
      FROM o_svc s JOIN o_service_metrics v USING (project, language) WHERE v.service = s.other GROUP BY ALL) r USING (project, language, clone_id)""",
)(flagship)


@query("a1_comod_commits", "SELECT project, language, clone_id, c AS \"commit\", count(DISTINCT fragment_index) AS fragments FROM o_cf GROUP BY ALL")
def a1_comod_commits(spark, d):
    return comod.comod_commits(T.order_fragments(spark, d)).drop("services")


@query("a1_comod_fragments", "SELECT project, language, clone_id, fragment_index, service, file_path, c AS \"commit\" FROM o_cf")
def a1_comod_fragments(spark, d):
    return comod.comod_fragments(T.order_fragments(spark, d))


@query("a2_service_metrics", "SELECT * FROM o_service_metrics")
def a2_service_metrics(spark, d):
    return metrics.service_metrics(metrics.metric_base(T.order_fragments(spark, d)), T.order_service_loc(spark, d))


@query("a2_service_metrics_text", "SELECT * FROM t_service_metrics")
def a2_service_metrics_text(spark, d):
    from twintrail.operators.services import service_loc

    return metrics.service_metrics(metrics.metric_base(T.text_fragments(spark, d)), service_loc(T.text_files(spark, d)))


@query("a3_clone_set_metrics", "SELECT * FROM o_set_metrics")
def a3_clone_set_metrics(spark, d):
    return metrics.clone_set_metrics(metrics.metric_base(T.order_fragments(spark, d)))


@query("a3_clone_set_metrics_text", "SELECT * FROM t_set_metrics")
def a3_clone_set_metrics_text(spark, d):
    return metrics.clone_set_metrics(metrics.metric_base(T.text_fragments(spark, d)))


@query("a4_file_metrics", "SELECT * FROM o_file_metrics")
def a4_file_metrics(spark, d):
    return metrics.file_metrics(metrics.metric_base(T.order_fragments(spark, d)))


@query("a4_file_metrics_text", "SELECT * FROM t_file_metrics")
def a4_file_metrics_text(spark, d):
    return metrics.file_metrics(metrics.metric_base(T.text_fragments(spark, d)))


@query("a5_unique_clone_lines", "SELECT project, language, service, file_path, CAST(sum(e - s + 1) AS BIGINT) AS lines FROM o_islands GROUP BY ALL")
def a5_unique_clone_lines(spark, d):
    rows = T.order_fragments(spark, d).filter("service <> ''")
    return merged_lines(rows, ["project", "language", "service", "file_path"])


@query(
    "a6_service_count_fallback",
    """SELECT project, language, CAST(coalesce(nullif(k, 0), s, 0) AS BIGINT) AS total_service_count FROM
      (SELECT project, language, count(DISTINCT service) AS k FROM order_loc WHERE project <> 'shop3' GROUP BY ALL) a
      FULL JOIN (SELECT project, language, count(DISTINCT service) AS s FROM order_fragments WHERE service <> '' GROUP BY ALL) b USING (project, language)""",
)
def a6_service_count_fallback(spark, d):
    declared = T.order_service_loc(spark, d).filter("project <> 'shop3'")
    return metrics.project_service_counts(T.order_fragments(spark, d), declared)


@query("j5_service_loc_for_roc", """SELECT u.project, u.language, u.service, u.lines, coalesce(l.total_loc, 0) AS total_loc,
  CASE WHEN l.total_loc > 0 THEN round_even(u.lines / l.total_loc::DOUBLE, 6) ELSE 0.0 END AS roc
  FROM o_union u LEFT JOIN (SELECT * REPLACE (CASE WHEN service = 'svc7' THEN 'unlisted' ELSE service END AS service) FROM order_loc) l USING (project, language, service)""")
def j5_service_loc_for_roc(spark, d):
    from twintrail.functions.numbers import ratio

    loc = T.order_service_loc(spark, d).withColumn("service", F.expr("CASE WHEN service = 'svc7' THEN 'unlisted' ELSE service END")).select("project", "language", "service", "total_loc")
    lines = metrics.service_clone_lines(T.order_fragments(spark, d))
    return lines.join(loc, ["project", "language", "service"], "left").select(
        "project", "language", "service", F.col("total_clone_line_count").alias("lines"),
        F.coalesce("total_loc", F.lit(0)).alias("total_loc"), ratio("total_clone_line_count", "total_loc").alias("roc"),
    )


@query("j6_set_services", "SELECT project, language, clone_id, string_agg(other, ',' ORDER BY other) AS services FROM o_svc GROUP BY ALL")
def j6_set_services(spark, d):
    return metrics.set_services(T.order_fragments(spark, d)).withColumn("services", F.array_join("services", ","))


@query("a27_mean_positive_roc", "SELECT project, round_even(coalesce(avg(roc) FILTER (roc > 0), 0.0), 12) AS average_clone_ratio FROM o_service_metrics GROUP BY ALL")
def a27_mean_positive_roc(spark, d):
    return metrics.mean_positive_roc(a2_service_metrics(spark, d))


@query("a40_metric_kpis", """SELECT * FROM (SELECT project, language, count(*) AS clone_sets, count(*) FILTER (service_count >= 2) AS inter_clone_sets,
  count(*) FILTER (comod_count > 0) AS comod_clone_sets FROM o_set_metrics GROUP BY ALL)
  LEFT JOIN (SELECT project, language, count(*) AS services, CAST(sum(total_clone_line_count) AS BIGINT) AS clone_lines, round_even(avg(roc), 12) AS mean_roc
  FROM o_service_metrics GROUP BY ALL) USING (project, language)""")
def a40_metric_kpis(spark, d):
    return metrics.metric_kpis(a2_service_metrics(spark, d), a3_clone_set_metrics(spark, d))


@query("a41_clone_set_labels", """SELECT project, language, clone_id, string_agg(DISTINCT file_type, ', ' ORDER BY file_type) AS file_types,
  coalesce(string_agg(DISTINCT nullif(service, ''), ', ' ORDER BY nullif(service, '')), '') AS involved_services, count(*) AS total_fragments
  FROM order_fragments GROUP BY ALL""")
def a41_clone_set_labels(spark, d):
    return metrics.clone_set_labels(T.order_fragments(spark, d))


@query("a42_file_main_type", """SELECT project, language, file_path, coalesce(arg_min(file_type, (-n, file_type)) FILTER (n > 0), 'unknown') AS file_type FROM
  (SELECT project, language, file_path, file_type, count(*) FILTER (service <> '') AS n FROM text_fragments GROUP BY ALL) GROUP BY ALL""")
def a42_file_main_type(spark, d):
    return metrics.file_main_type(T.text_fragments(spark, d))


@query("a48_summary_counts", """SELECT project, language, coalesce(services, 0) AS services, coalesce(clone_sets, 0) AS clone_sets FROM
  (SELECT project, language, count(*) AS services FROM o_service_metrics GROUP BY ALL)
  FULL JOIN (SELECT project, language, count(*) AS clone_sets FROM o_set_metrics GROUP BY ALL) USING (project, language)""")
def a48_summary_counts(spark, d):
    return metrics.summary_counts(a2_service_metrics(spark, d), a3_clone_set_metrics(spark, d))


@query("f18_percent_columns", """SELECT project, language, service, round_even(roc * 100, 2) AS roc_pct FROM o_service_metrics""")
def f18_percent_columns(spark, d):
    from twintrail.functions.numbers import percent

    return a2_service_metrics(spark, d).select("project", "language", "service", percent("roc", 2).alias("roc_pct"))


# --- rankings ------------------------------------------------------------------------

_RANKINGS = [
    ("k3_top_services_by_sets", "service", "clone_set_count", False),
    ("k3_top_services_by_roc", "service", "roc", False),
    ("k3_top_services_by_lines", "service", "total_clone_line_count", False),
]


def _service_rows(spark, d):
    # One row per service name: the ranking is unambiguous.
    return a2_service_metrics(spark, d).groupBy("service").agg(
        F.sum("clone_set_count").alias("clone_set_count"), F.bround(F.max("roc"), 6).alias("roc"),
        F.sum("total_clone_line_count").alias("total_clone_line_count"),
    )


def _ranking(name, key):
    sql = f"""SELECT service, {key} FROM (SELECT service, CAST(sum(clone_set_count) AS BIGINT) AS clone_set_count, max(roc) AS roc,
      CAST(sum(total_clone_line_count) AS BIGINT) AS total_clone_line_count FROM o_service_metrics GROUP BY ALL)
      ORDER BY {key} DESC, service DESC LIMIT 5"""

    @query(name, sql)
    def run(spark, d):
        return ranks.top_k(_service_rows(spark, d), key, 5, tie="service").select("service", key)

    return run


for _name, _kind, _key, _pos in _RANKINGS:
    _ranking(_name, _key)

for _name, _key in (
    ("k3_top_sets_by_span", "service_count"), ("k3_top_sets_by_ratio", "cross_service_fragment_ratio"), ("k3_top_sets_by_comod", "comod_count"),
):

    def _set_ranking(name, key):
        sql = f"""SELECT project, clone_id, {key} FROM o_set_metrics WHERE {key} > 0 ORDER BY {key} DESC, clone_id DESC LIMIT 5"""

        @query(name, sql)
        def run(spark, d):
            return ranks.top_k(a3_clone_set_metrics(spark, d), key, 5, tie="clone_id", positive_only=True).select("project", "clone_id", key)

    _set_ranking(_name, _key)

for _name, _key in (
    ("k3_top_files_by_sets", "cross_service_clone_set_count"), ("k3_top_files_by_lines", "cross_service_line_count"),
    ("k3_top_files_by_comod", "cross_service_comod_count"),
):

    def _file_ranking(name, key):
        sql = f"""SELECT file_path, {key} FROM t_file_metrics WHERE {key} > 0 ORDER BY {key} DESC, file_path DESC LIMIT 5"""

        @query(name, sql)
        def run(spark, d):
            return ranks.top_k(a4_file_metrics_text(spark, d), key, 5, tie="file_path", positive_only=True).select("file_path", key)

    _file_ranking(_name, _key)
