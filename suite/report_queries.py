"""Project statistics and corpus reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import core
from suite.registry import query
from suite.views import file_type_sql
from twintrail.functions.paths import file_type
from twintrail.operators import clones, metrics, pairs, services
from twintrail.plans import reports, stats
from twintrail.sources import star_tables as T

PAIRS = """SELECT project, language, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS p FROM (SELECT project, language, clone_id, count(*) AS n FROM text_fragments GROUP BY ALL) GROUP BY ALL"""
LANGUAGE = f"""SELECT f.project, f.language, count(DISTINCT nullif(f.service, '')) AS n_services, count(*) AS n_files, CAST(sum(loc) AS BIGINT) AS total_loc,
  coalesce(any_value(s.n), 0) AS n_clone_sets, coalesce(any_value(p.p), 0) AS n_clone_pairs, coalesce(any_value(s.c), 0) AS n_comod_clone_sets,
  coalesce(any_value(cp.n), 0) AS n_comod_clone_pairs, CAST(coalesce(any_value(l.n), 0) AS BIGINT) AS total_clone_loc,
  CASE WHEN sum(loc) > 0 THEN round_even(coalesce(any_value(l.n), 0) / sum(loc)::DOUBLE * 100, 2) ELSE 0.0 END AS roc_pct
  FROM text_files f LEFT JOIN (SELECT project, language, count(*) AS n, count(*) FILTER (comod_count > 0) AS c FROM t_set_metrics GROUP BY ALL) s USING (project, language)
  LEFT JOIN ({PAIRS}) p USING (project, language)
  LEFT JOIN (SELECT project, language, count(*) FILTER (comodification_count > 0) AS n FROM all_text_pairs GROUP BY ALL) cp USING (project, language)
  LEFT JOIN (SELECT project, language, sum(total_clone_line_count) AS n FROM t_service_metrics GROUP BY ALL) l USING (project, language)
  GROUP BY f.project, f.language"""
ROWS = """SELECT project, language, service, CAST(coalesce(file_count, 0) AS BIGINT) AS n_files, CAST(coalesce(total_loc, 0) AS BIGINT) AS total_loc, CAST(coalesce(clone_set_count, 0) AS BIGINT) AS n_clone_sets,
  CAST(coalesce(total_clone_line_count, 0) AS BIGINT) AS total_clone_loc FROM order_loc FULL JOIN o_service_metrics USING (project, language, service)"""


def _service_parts(spark, d):
    return T.order_service_loc(spark, d), core.a2_service_metrics(spark, d)


def _languages(spark, d):
    files, rows = T.text_files(spark, d), metrics.metric_base(T.text_fragments(spark, d))
    service = metrics.service_metrics(rows, services.service_loc(files))
    return stats.language_stats(files, service, metrics.clone_set_metrics(rows), pairs.pair_summary(rows))


@query("a13_language_stats", LANGUAGE)
def a13_language_stats(spark, d):
    return _languages(spark, d)


@query("a14_service_stats", f"""SELECT project, service, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(total_loc) AS BIGINT) AS total_loc,
  CAST(sum(n_clone_sets) AS BIGINT) AS n_clone_sets, CAST(sum(total_clone_loc) AS BIGINT) AS total_clone_loc, round_even(sum(total_clone_loc) / sum(total_loc)::DOUBLE * 100, 2) AS roc_pct FROM ({ROWS}) GROUP BY ALL""")
def a14_service_stats(spark, d):
    return stats.service_stats(*_service_parts(spark, d))


@query("a15_service_language_stats", f"SELECT project, service, language, n_files, total_loc, n_clone_sets FROM ({ROWS})")
def a15_service_language_stats(spark, d):
    return stats.service_language_stats(*_service_parts(spark, d))


@query("a16_statistics_levels", f"""SELECT CASE WHEN GROUPING(service) = 1 THEN 'project' WHEN GROUPING(language) = 1 THEN 'service' ELSE 'service_language' END AS level, project, coalesce(service, '*') AS service,
  coalesce(language, '*') AS language, string_agg(DISTINCT l, ',' ORDER BY l) AS languages, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(total_loc) AS BIGINT) AS total_loc, CAST(sum(n_clone_sets) AS BIGINT) AS n_clone_sets,
  CAST(sum(total_clone_loc) AS BIGINT) AS total_clone_loc, round_even(sum(total_clone_loc) / sum(total_loc)::DOUBLE * 100, 2) AS roc_pct
  FROM (SELECT *, language AS l FROM ({ROWS})) GROUP BY GROUPING SETS ((project, service, language), (project, service), (project))""")
def a16_statistics_levels(spark, d):
    return stats.statistics_levels(*_service_parts(spark, d))


@query("a16_project_kpi", f"""SELECT project, coalesce(any_value(n), 0) AS n_services, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(n_clone_sets) AS BIGINT) AS n_clone_sets, CAST(sum(total_loc) AS BIGINT) AS total_loc,
  CAST(sum(total_clone_loc) AS BIGINT) AS total_clone_loc, round_even(sum(total_clone_loc) / sum(total_loc)::DOUBLE * 100, 2) AS roc_pct FROM ({LANGUAGE})
  LEFT JOIN (SELECT project, count(DISTINCT service) AS n FROM text_loc GROUP BY ALL) USING (project) GROUP BY project""")
def a16_project_kpi(spark, d):
    return stats.project_kpi(_languages(spark, d), services.service_loc(T.text_files(spark, d)))


@query("a17_discovered_languages", "SELECT project, language FROM text_files UNION SELECT project, language FROM order_fragments")
def a17_discovered_languages(spark, d):
    return stats.discovered_languages(T.text_files(spark, d), T.order_fragments(spark, d))


@query("a52_language_share", f"""SELECT project, language, n_files, total_loc, round_even(total_loc / sum(total_loc) OVER (PARTITION BY project)::DOUBLE * 100, 1) AS loc_pct, n_clone_sets, n_clone_pairs, roc_pct FROM ({LANGUAGE})""")
def a52_language_share(spark, d):
    return stats.language_share(_languages(spark, d))


@query("a51_language_catalogue", """SELECT language, count(*) OVER (PARTITION BY language) AS projects, project, n AS clone_sets FROM (SELECT language, project, count(*) AS n FROM o_set_metrics GROUP BY ALL)""")
def a51_language_catalogue(spark, d):
    return stats.language_catalogue(core.a3_clone_set_metrics(spark, d))


# --- taxonomy and ratios --------------------------------------------------------------------


def _located(spark, d):
    return clones.located_fragments(T.text_fragments(spark, d), T.codebases(spark, d))


@query("a18_taxonomy", "SELECT project, language, clone_id, category, count(*) AS fragments FROM located GROUP BY ALL")
def a18_taxonomy(spark, d):
    return clones.taxonomy(T.text_fragments(spark, d), T.codebases(spark, d))


_COVER = "SELECT project, language, category, file_path, count(DISTINCT start_line) AS n FROM located GROUP BY ALL"


@query("a19_codebase_clone_ratio", f"""SELECT t.project, t.language, t.category, CAST(coalesce(c.n, 0) AS BIGINT) AS clone_lines, t.file_lines, CASE WHEN t.file_lines > 0 THEN round_even(coalesce(c.n, 0) / t.file_lines::DOUBLE, 6) ELSE 0.0 END AS clone_ratio FROM (
  SELECT project, language, category, CAST(sum(loc) AS BIGINT) AS file_lines FROM (SELECT f.project, f.language, loc, unnest(CASE WHEN contains(lower(file_path), 'test') THEN ['within-testing', 'within-mixed', 'inter-testing', 'inter-mixed']
    ELSE ['within-production', 'within-mixed', 'inter-production', 'inter-mixed'] END) AS category FROM text_files f
    WHERE EXISTS (SELECT 1 FROM codebases c WHERE c.project = f.project AND c.language = f.language AND starts_with(f.file_path, c.context))) GROUP BY ALL) t
  LEFT JOIN (SELECT project, language, category, sum(n) AS n FROM ({_COVER}) GROUP BY ALL) c USING (project, language, category)""")
def a19_codebase_clone_ratio(spark, d):
    return reports.codebase_clone_ratio(_located(spark, d), T.text_files(spark, d), T.codebases(spark, d))


_TOUCHED = """SELECT project, language, category, CAST(sum(n) AS BIGINT) AS clone_lines, CAST(sum(loc) AS BIGINT) AS file_lines, round_even(sum(n) / sum(loc)::DOUBLE, 6) AS clone_ratio FROM (
  SELECT project, language, category, file_path, count(DISTINCT start_line) AS n FROM (SELECT project, language, file_path, start_line, unnest([category, 'overall']) AS category FROM located) GROUP BY ALL)
  JOIN (SELECT project, language, file_path, loc FROM text_files) USING (project, language, file_path) GROUP BY ALL"""


def _touched(spark, d):
    return reports.touched_clone_ratio(_located(spark, d), T.text_files(spark, d))


@query("a20_touched_clone_ratio", _TOUCHED)
def a20_touched_clone_ratio(spark, d):
    return _touched(spark, d)


_FLAGS = """SELECT project, language, clone_id, any_value(category) AS category, coalesce(bool_or(hit), false) AS comodified FROM located LEFT JOIN
  (SELECT DISTINCT project, language, clone_id, true AS hit FROM (SELECT project, language, clone_id, unnest(modified_commits) AS c FROM located) GROUP BY project, language, clone_id, c HAVING count(*) >= 2)
  USING (project, language, clone_id) GROUP BY ALL"""
_RATES = f"""SELECT project, language, CASE WHEN GROUPING(category) = 1 THEN 'overall' ELSE category END AS category, count(*) AS clone_sets, count(*) FILTER (comodified) AS comod_sets,
  round_even(count(*) FILTER (comodified) / count(*)::DOUBLE, 6) AS rate FROM ({_FLAGS}) GROUP BY GROUPING SETS ((project, language, category), (project, language))"""


@query("a21_comodification_rate", _RATES)
def a21_comodification_rate(spark, d):
    return reports.comodification_rate(reports.comodified_set_flags(_located(spark, d)))


@query("a22_ratio_summary", f"""SELECT category, count(*) AS n, round_even(avg(clone_ratio), 12) AS mean, round_even(var_pop(clone_ratio), 12) AS variance, round_even(median(clone_ratio), 12) AS median,
  min(clone_ratio) AS min, max(clone_ratio) AS max FROM ({_TOUCHED}) GROUP BY ALL""")
def a22_ratio_summary(spark, d):
    return reports.summarize(_touched(spark, d), "clone_ratio", ["category"])


@query("a24_ratio_quartiles", f"""SELECT category, count(*) AS n, min(clone_ratio) AS low, round_even(quantile_cont(clone_ratio, 0.25), 12) AS q1, round_even(quantile_cont(clone_ratio, 0.5), 12) AS median,
  round_even(quantile_cont(clone_ratio, 0.75), 12) AS q3, max(clone_ratio) AS high FROM ({_TOUCHED}) GROUP BY ALL""")
def a24_ratio_quartiles(spark, d):
    return reports.quartiles(_touched(spark, d), "clone_ratio", ["category"])


@query("a53_run_time_quartiles", """SELECT o_orderpriority AS tool, count(*) AS n, min(t) AS low, round_even(quantile_cont(t, 0.25), 12) AS q1, round_even(quantile_cont(t, 0.5), 12) AS median, round_even(quantile_cont(t, 0.75), 12) AS q3, max(t) AS high
  FROM (SELECT o_orderpriority, floor(o_totalprice / 10) AS t FROM orders) GROUP BY ALL""")
def a53_run_time_quartiles(spark, d):
    rows = T.table(spark, d, "orders").selectExpr("o_orderpriority AS tool", "CAST(floor(o_totalprice / 10) AS DOUBLE) AS t")
    return reports.quartiles(rows, "t", ["tool"])


_SHARES = ["within", "inter", "within_modified", "inter_modified", "within_comodified", "inter_comodified"]


@query("a23_corpus_report", f"""WITH pl AS (SELECT project, language, count(*) AS s, sum(n) AS f, sum(m) AS fm, count(*) FILTER (m > 0) AS sm, bool_or(starts_with(category, 'within')) AS within, bool_or(starts_with(category, 'inter')) AS inter,
    bool_or(starts_with(category, 'within') AND m > 0) AS within_modified, bool_or(starts_with(category, 'inter') AND m > 0) AS inter_modified,
    bool_or(starts_with(category, 'within') AND comodified) AS within_comodified, bool_or(starts_with(category, 'inter') AND comodified) AS inter_comodified FROM
    (SELECT project, language, clone_id, count(*) AS n, count(*) FILTER (modified_count > 0) AS m FROM text_fragments GROUP BY ALL) LEFT JOIN ({_FLAGS}) USING (project, language, clone_id) GROUP BY ALL),
  al AS (SELECT * FROM (SELECT DISTINCT project, language FROM text_files UNION SELECT DISTINCT project, 'none' FROM text_files) LEFT JOIN pl USING (project, language))
  SELECT count(*) AS project_languages, count(DISTINCT project) AS projects, count(s) AS with_clones, count(*) - count(s) AS missing, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _SHARES)},
    CAST(coalesce(sum(f), 0) AS BIGINT) AS fragments, CAST(coalesce(sum(fm), 0) AS BIGINT) AS modified_fragments, CAST(coalesce(sum(s), 0) AS BIGINT) AS clone_sets, CAST(coalesce(sum(sm), 0) AS BIGINT) AS modified_sets,
    round_even(count(s) / count(*)::DOUBLE, 4) AS with_clones_share, {', '.join(f'round_even(count(*) FILTER ({c}) / count(*)::DOUBLE, 4) AS {c}_share' for c in _SHARES)} FROM al""")
def a23_corpus_report(spark, d):
    declared = T.text_files(spark, d).select("project", "language").distinct()
    declared = declared.union(declared.select("project", F.lit("none")).distinct())
    return reports.corpus_report(declared, T.text_fragments(spark, d), T.codebases(spark, d))


@query("a23_projects_per_language", "SELECT language, count(DISTINCT project) AS projects FROM text_files GROUP BY ALL")
def a23_projects_per_language(spark, d):
    return reports.projects_per_language(T.text_files(spark, d))


@query("u5_modified_inter_sets", "SELECT s.project, s.language, s.clone_id FROM set_category s WHERE starts_with(category, 'inter') AND (project, language, clone_id) IN (SELECT (project, language, clone_id) FROM text_fragments WHERE modified_count > 0)")
def u5_modified_inter_sets(spark, d):
    rows = T.text_fragments(spark, d)
    keys = ["project", "language", "clone_id"]
    inter = clones.taxonomy(rows, T.codebases(spark, d)).filter(F.col("category").startswith("inter")).select(*keys)
    return inter.intersect(rows.filter("modified_count > 0").select(*keys))


@query("a26_selected_projects", """SELECT project, language, context, service FROM (SELECT DISTINCT project, language, source AS context, service FROM text_files WHERE service <> '')
  QUALIFY len(list_distinct(list(context) OVER (PARTITION BY project, language))) >= 2""")
def a26_selected_projects(spark, d):
    rows = T.text_files(spark, d).filter("service <> ''").selectExpr("project", "language", "source AS context", "service").distinct()
    return reports.select_projects(rows)


def _samples(spark, d):
    rows = T.text_files(spark, d)
    label = F.expr("CASE WHEN file_id % 5 = 0 THEN 'logic' WHEN file_id % 8 IN (1, 6) THEN 'test' WHEN file_id % 8 = 2 THEN 'config' WHEN file_id % 8 IN (3, 4) THEN 'data' ELSE 'logic' END")
    return rows.select(label.alias("label"), file_type("file_path").alias("predicted"))


_SAMPLES = f"""SELECT CASE WHEN file_id % 5 = 0 THEN 'logic' WHEN file_id % 8 IN (1, 6) THEN 'test' WHEN file_id % 8 = 2 THEN 'config' WHEN file_id % 8 IN (3, 4) THEN 'data' ELSE 'logic' END AS label,
  {file_type_sql('file_path')} AS predicted FROM text_files"""


@query("a44_classifier_report", f"""WITH smp AS MATERIALIZED ({_SAMPLES}), sc AS (SELECT k AS category, count(*) FILTER (label = k) AS actual, count(*) FILTER (predicted = k) AS predicted, count(*) FILTER (label = k AND smp.predicted = k) AS hits
   FROM smp, (VALUES ('test'), ('config'), ('data'), ('logic')) v(k) GROUP BY k),
  pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p, CASE WHEN actual > 0 THEN hits / actual::DOUBLE ELSE 0 END AS r FROM sc),
  f AS (SELECT *, CASE WHEN p + r > 0 THEN p * r * 2 / (p + r) ELSE 0 END AS f FROM pr)
  SELECT category, actual, predicted, hits, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(f, 6) AS f1, round_even(avg(f) OVER (), 6) AS macro_f1,
    round_even((SELECT count(*) FILTER (label = smp.predicted) / count(*)::DOUBLE FROM smp), 6) AS accuracy FROM f""")
def a44_classifier_report(spark, d):
    return reports.classifier_report(_samples(spark, d))


@query("a44_confusion_matrix", f"""SELECT label, count(*) FILTER (predicted = 'test') AS test, count(*) FILTER (predicted = 'config') AS config, count(*) FILTER (predicted = 'data') AS data, count(*) FILTER (predicted = 'logic') AS logic FROM ({_SAMPLES}) GROUP BY ALL""")
def a44_confusion_matrix(spark, d):
    return reports.confusion_matrix(_samples(spark, d))


@query("a43_merged_method_counts", """SELECT 'type' AS kind, p_brand AS key, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY ALL UNION ALL SELECT 'method', concat('size', p_size), CAST(sum(p_partkey % 7) AS BIGINT) FROM part GROUP BY ALL""")
def a43_merged_method_counts(spark, d):
    rows = T.table(spark, d, "part")
    stored = rows.selectExpr("'type' AS kind", "map(p_brand, CAST(p_size AS BIGINT)) AS counts").unionByName(
        rows.selectExpr("'method' AS kind", "map(concat('size', p_size), p_partkey % 7) AS counts")
    )
    return reports.merged_method_counts(stored)
