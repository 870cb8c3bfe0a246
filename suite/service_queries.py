"""Service resolution, file statistics, enrichment, column functions and table filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import core
from suite.registry import query
from suite.views import file_type_sql
from twintrail import constants as C
from twintrail.functions import commits, labels, names, numbers, paths
from twintrail.operators import filters, fragments, metrics, ranks, services
from twintrail.sources import readers
from twintrail.sources import star_tables as T

BASE = "list_extract(string_split({c}, '/'), -1)"


@query("j1_service_resolution", """SELECT f.project, f.file_path, coalesce(arg_min(c.service, (c.tier, -length(rtrim(c.context, '/')), c.ordinal)), '') AS service,
  min(c.tier) AS tier FROM text_files f LEFT JOIN contexts c ON c.project = f.project AND (f.file_path = rtrim(c.context, '/') OR starts_with(f.file_path, concat(rtrim(c.context, '/'), '/')))
  GROUP BY ALL""")
def j1_service_resolution(spark, d):
    return services.resolve_services(T.text_files(spark, d), T.service_contexts(spark, d))


@query("j2_file_ids", """SELECT project, language, clone_id, fragment_index, CASE WHEN file_id % 9 = 0 THEN -1 ELSE file_id END AS file_id FROM text_fragments""")
def j2_file_ids(spark, d):
    # Some files are listed under a path that no fragment has.
    files = T.text_files(spark, d).withColumn("file_path", F.expr("CASE WHEN file_id % 9 = 0 THEN concat('gone/', file_path) ELSE file_path END"))
    rows = T.text_fragments(spark, d).drop("file_id")
    return services.with_file_id(rows, files).select("project", "language", "clone_id", "fragment_index", "file_id")


_SERVICE_RANGES = """SELECT project, language, service, min(file_id) AS range_start, max(file_id) AS range_end FROM (
  SELECT *, file_id - row_number() OVER (PARTITION BY project, language, service ORDER BY file_id) AS run FROM text_files WHERE service <> '') GROUP BY project, language, service, run"""


@query("j4_service_by_id_range", f"""SELECT f.project, f.language, f.file_id, coalesce(r.service, 'unknown') AS service FROM text_files f
  LEFT JOIN ({_SERVICE_RANGES}) r ON r.project = f.project AND r.language = f.language AND f.file_id BETWEEN range_start AND range_end""")
def j4_service_by_id_range(spark, d):
    files = T.text_files(spark, d)
    ranges = services.service_file_ranges(files).withColumn("ordinal", F.col("range_start"))
    return services.service_by_id_range(files, ranges)


@query("j15_services_by_text_prefix", """SELECT f.project, f.language, f.file_path, c.context, c.service FROM text_files f
  JOIN (SELECT project, context, service FROM contexts) c ON c.project = f.project AND starts_with(f.file_path, c.context)""")
def j15_services_by_text_prefix(spark, d):
    return services.services_by_text_prefix(T.text_files(spark, d), T.service_contexts(spark, d)).select(
        "project", "language", "file_path", "context", "service"
    )


@query("j16_first_codebase", "SELECT project, language, clone_id, fragment_index, codebase FROM placed")
def j16_first_codebase(spark, d):
    return services.first_codebase(T.text_fragments(spark, d), T.codebases(spark, d)).select(
        "project", "language", "clone_id", "fragment_index", "codebase"
    )


@query("a7_service_file_stats", """SELECT project, language, CASE WHEN service = '' THEN 'unresolved' ELSE 'service' END AS scope, service, count(*) AS file_count, CAST(sum(loc) AS BIGINT) AS total_loc
  FROM text_files GROUP BY ALL UNION ALL SELECT project, language, 'total', '', count(*), CAST(sum(loc) AS BIGINT) FROM text_files GROUP BY project, language""")
def a7_service_file_stats(spark, d):
    return services.service_file_stats(T.text_files(spark, d))


@query("a9_assignment_coverage", """SELECT project, service, count(*) AS total, count(*) FILTER (service <> '') AS resolved, count(*) FILTER (service = 'legacy18') AS by_fallback, 0 AS level FROM text_files GROUP BY project, service
  UNION ALL SELECT project, NULL, count(*), count(*) FILTER (service <> ''), count(*) FILTER (service = 'legacy18'), 1 FROM text_files GROUP BY project
  UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (service <> ''), count(*) FILTER (service = 'legacy18'), 3 FROM text_files""")
def a9_assignment_coverage(spark, d):
    out = services.assignment_coverage(T.text_files(spark, d), T.service_contexts(spark, d))
    return out.withColumn("level", F.col("level").cast("int"))


@query("a25_loc_by_kind", """SELECT language, coalesce(service, '*') AS service, CAST(coalesce(sum(loc) FILTER (NOT contains(lower(file_path), 'test')), 0) AS BIGINT) AS production_loc,
  CAST(coalesce(sum(loc) FILTER (contains(lower(file_path), 'test')), 0) AS BIGINT) AS testing_loc, count(DISTINCT s) AS services
  FROM (SELECT *, service AS s FROM text_files WHERE service <> '') GROUP BY GROUPING SETS ((language, service), (language))""")
def a25_loc_by_kind(spark, d):
    return services.loc_by_kind(T.text_files(spark, d))


@query("a50_services_per_language", "SELECT project, language, count(DISTINCT service) AS services FROM text_files WHERE service <> '' GROUP BY ALL")
def a50_services_per_language(spark, d):
    from twintrail.plans.stats import services_per_language

    return services_per_language(services.service_file_ranges(T.text_files(spark, d)))


@query("h7_enriched_fragments", """SELECT project, language, clone_id, fragment_index, file_path, file_id, service, start_line, end_line, line_count, file_type,
  array_to_string(list_sort(modified_commits), ',') AS modified_commits, modified_count FROM text_fragments""")
def h7_enriched_fragments(spark, d):
    # Paths arrive as a checkout would list them and are normalised on the way.
    raw = T.repeated_lines(spark, d).drop("service", "file_id").withColumn("file_path", F.concat(F.lit(" ./"), "file_path"))
    out = fragments.enrich_fragments(raw, T.service_contexts(spark, d), T.text_files(spark, d))
    return out.withColumn("modified_commits", F.array_join(F.array_sort("modified_commits"), ","))


@query("s11_detected_contexts", """SELECT DISTINCT project, service, coalesce(nullif(context, ''), regexp_extract(dockerfile, '^(.*)/[^/]+$', 1)) AS context FROM (
  SELECT concat('acme.repo', p_partkey % 20) AS project, p_partkey // 500 AS chunk_no, concat('unit', p_partkey % 60) AS service,
    CASE WHEN p_size % 3 = 0 THEN concat('ctx/unit', p_partkey % 60) WHEN p_size % 3 = 1 THEN '' END AS context, concat('services/unit', p_partkey % 60, '/Dockerfile') AS dockerfile FROM part)
  QUALIFY chunk_no = max(chunk_no) OVER (PARTITION BY project)""")
def s11_detected_contexts(spark, d):
    rows = T.table(spark, d, "part").selectExpr(
        "concat('acme.repo', p_partkey % 20) AS project", "CAST(floor(p_partkey / 500) AS BIGINT) AS chunk_no", "concat('unit', p_partkey % 60) AS service",
        "CASE WHEN p_size % 3 = 0 THEN concat('ctx/unit', p_partkey % 60) WHEN p_size % 3 = 1 THEN '' END AS context",
        "concat('services/unit', p_partkey % 60, '/Dockerfile') AS dockerfile",
    )
    return readers.detected_contexts(rows, "latest")


@query("s21_context_document", """SELECT project, concat('{', string_agg(concat('"', context, '":["', s, '"]'), ',' ORDER BY context), '}') AS services FROM
  (SELECT project, context, string_agg(DISTINCT service, '","' ORDER BY service) AS s FROM contexts GROUP BY ALL) GROUP BY project""")
def s21_context_document(spark, d):
    from twintrail.sources.sinks import context_document

    return context_document(T.service_contexts(spark, d))


@query("s9_contexts_from_document", """SELECT project, context, service FROM contexts""")
def s9_contexts_from_document(spark, d):
    from twintrail.schemas import SERVICES
    from twintrail.sources.sinks import context_document

    # The written document is parsed back with the schema the reader uses.
    text = context_document(T.service_contexts(spark, d)).select("project", F.concat(F.lit('{"services":'), "services", F.lit("}")).alias("j"))
    parsed = text.select("project", F.from_json("j", SERVICES).alias("doc")).select("project", "doc.services", "doc.languages")
    return readers.service_contexts(parsed)


# --- functions ---------------------------------------------------------------------------


@query("f1_file_path", """SELECT doc_id, concat(source, '/f', doc_id, '.py') AS a, concat(source, '/f', doc_id, '.py') AS b, concat(source, '/f', doc_id, '.py/') AS c, concat('f', doc_id, '.py') AS name FROM documents""")
def f1_file_path(spark, d):
    raw = T.table(spark, d, "documents").selectExpr(
        "doc_id", "concat(' ./', source, '\\\\f', doc_id, '.py ') AS win", "concat('/data/repo/', source, '/f', doc_id, '.py/') AS abs"
    )
    return raw.select(
        "doc_id", paths.file_path("win").alias("a"), paths.repo_path("abs", "/data/repo").alias("b"),
        paths.file_path("abs", "/data/repo/").alias("c"), paths.base_name(paths.file_path("win")).alias("name"),
    )


@query("f3_drop_leading_slash", "SELECT page_id, concat('a/', page_id) AS p FROM pages")
def f3_drop_leading_slash(spark, d):
    return T.table(spark, d, "pages").select("page_id", paths.drop_leading_slash(F.concat(F.lit("/a/"), "page_id")).alias("p"))


@query("f4_project_from_url", f"""SELECT page_id, concat(list_extract(string_split(rtrim(url, '/'), '/'), -2), '.', list_extract(string_split(rtrim(url, '/'), '/'), -1)) AS project,
  list_extract(string_split(rtrim(url, '/'), '/'), -1) AS repo FROM pages""")
def f4_project_from_url(spark, d):
    return T.table(spark, d, "pages").select("page_id", paths.project_from_url("url").alias("project"), paths.repo_from_url("url").alias("repo"))


@query("f6_file_type", f"SELECT project, path, {file_type_sql('path')} AS file_type FROM listing")
def f6_file_type(spark, d):
    return T.file_listing(spark, d).select("project", "path", paths.file_type("path").alias("file_type"))


@query("f7_extension", f"SELECT project, path, regexp_extract({BASE.format(c='path')}, '(\\.[^.]*)$', 1) AS ext FROM listing")
def f7_extension(spark, d):
    return T.file_listing(spark, d).select("project", "path", paths.extension(paths.base_name("path")).alias("ext"))


@query("f8_loc", "SELECT file_id, loc FROM text_files")
def f8_loc(spark, d):
    return T.text_files(spark, d).select("file_id", "loc")


@query("f9_line_count", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, CAST(l_quantity AS INT) - 5) AS lines FROM lineitem")
def f9_line_count(spark, d):
    return T.table(spark, d, "lineitem").withColumn("end", F.col("l_quantity").cast("int") + 4).withColumn("start", F.lit(10)).select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.line_count("start", "end").alias("lines")
    )


_HISTORY_JSON = "concat('[', array_join(transform(modification, m -> concat('{\"type\":\"', m.type, '\",\"commit\":\"', m.commit, '\"}')), ','), ']')"


@query("f10_modified_commits", """SELECT file_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(modification, lambda m: m.type = 'modified'), lambda m: m."commit"))), ',') AS modified,
  array_to_string(list_sort(list_distinct(list_transform(modification, lambda m: m."commit"))), ',') AS anything, 0 AS broken FROM file_history""")
def f10_modified_commits(spark, d):
    raw = T.file_history(spark, d).select("file_id", F.expr(_HISTORY_JSON).alias("raw"))
    return raw.select(
        "file_id", F.array_join(F.array_sort(commits.modified_commits(commits.history("raw"))), ",").alias("modified"),
        F.array_join(F.array_sort(commits.parse_commit_list("raw")), ",").alias("anything"),
        F.size(commits.parse_commits(F.concat(F.lit("{"), "raw"))).alias("broken"),
    )


@query("f15_stored_pair_commits", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 1 THEN NULL ELSE '' END ELSE concat('c', user_id) END AS commits, user_id % 2 = 1 OR value > 50 AS comodified FROM events""")
def f15_stored_pair_commits(spark, d):
    rows = T.table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN '[]' ELSE concat('[\"c', user_id, '\",\"c', user_id, '\"]') END AS raw", "user_id % 2 AS n",
        "CASE WHEN value > 50 THEN 'True' ELSE 'no' END AS flag",
    )
    return rows.select(
        "event_id", F.array_join(commits.stored_pair_commits("raw", "n"), ",").alias("commits"),
        commits.row_is_comodified(F.nullif("n", F.lit(0)), "flag").alias("comodified"),
    )


@query("f16_service_relative_path", f"""SELECT file_id, CASE WHEN service = '' THEN p WHEN s <> '' AND position(s IN p) > 0 THEN
  CASE WHEN position('/src/' IN ltrim(substr(p, position(s IN p) + length(s)), '/')) > 0 THEN substr(ltrim(substr(p, position(s IN p) + length(s)), '/'), position('/src/' IN ltrim(substr(p, position(s IN p) + length(s)), '/')) + 1)
       ELSE ltrim(substr(p, position(s IN p) + length(s)), '/') END ELSE {BASE.format(c='p')} END AS rel
  FROM (SELECT file_id, service, concat('services/', CASE WHEN file_id % 3 = 0 THEN replace(file_path, '/', '/app/src/') ELSE file_path END) AS p, {BASE.format(c="concat('team/', service)")} AS s FROM text_files)""")
def f16_service_relative_path(spark, d):
    rows = T.text_files(spark, d).selectExpr(
        "file_id", "concat('services/', CASE WHEN file_id % 3 = 0 THEN replace(file_path, '/', '/app/src/') ELSE file_path END) AS p",
        "CASE WHEN service = '' THEN '' ELSE concat('team/', service) END AS s",
    )
    return rows.select("file_id", paths.service_relative_path("p", "s").alias("rel"))


@query("f20_service_cells", """SELECT project, language, clone_id, len(t)::INT AS n, concat(array_to_string(t[1:3], ', '), CASE WHEN len(t) > 3 THEN concat(' (+', len(t) - 3, ')') ELSE '' END) AS shown
  FROM (SELECT project, language, clone_id, list_sort(list(DISTINCT service) FILTER (service <> '')) AS t FROM order_fragments GROUP BY ALL HAVING count(*) FILTER (service <> '') > 0)""")
def f20_service_cells(spark, d):
    cells = metrics.clone_set_labels(T.order_fragments(spark, d)).filter("involved_services <> ''")
    return cells.select(
        "project", "language", "clone_id", F.size(labels.tokens("involved_services")).alias("n"), labels.compact_services("involved_services").alias("shown")
    )


_REPO = "concat('https://github.com/', replace(project, '.', '/'))"


@query("f22_permalinks", f"""SELECT project, file_id, CASE WHEN file_id % 2 = 0 THEN concat('https://example.org/', project) ELSE {_REPO} END AS base,
  concat({_REPO}, '/blob/', CASE WHEN file_id % 3 = 0 THEN 'master' ELSE 'abc' END, '/', file_path, CASE WHEN file_id % 4 = 0 THEN '' WHEN file_id % 4 = 1 OR loc = 1 THEN '#L1' ELSE concat('#L1-L', loc) END) AS file_url,
  concat({_REPO}, '/commit/abc#diff-', sha256(file_path)) AS diff_url FROM text_files""")
def f22_permalinks(spark, d):
    rows = T.text_files(spark, d).selectExpr(
        "*", "concat('/', file_path) AS p", "CASE WHEN file_id % 3 = 0 THEN '' ELSE 'abc' END AS ref", "'abc' AS sha",
        "CASE WHEN file_id % 4 <> 0 THEN 1 END AS a", "CASE WHEN file_id % 4 <> 1 THEN loc END AS b",
        "CASE WHEN file_id % 2 = 0 THEN concat('https://example.org/', project) ELSE '' END AS u", "CAST(NULL AS STRING) AS none",
    )
    plain = paths.base_url("project")
    return rows.select(
        "project", "file_id", paths.base_url("project", "none", "u").alias("base"),
        paths.file_link(plain, "p", "ref", "a", "b").alias("file_url"), paths.diff_link(plain, "sha", "p").alias("diff_url"),
    )


_RUN_COLUMNS = "repo, detection, min_tokens, filter, comod, analysis, frequency, date, search_depth, max_commits"


@query("s14_run_catalogue", f"""SELECT project, language, name, size, {_RUN_COLUMNS}, concat('Language: ', language, ', Detection: ',
  CASE detection WHEN 'normal' THEN 'Normal' WHEN 'TKS12' THEN 'TKS (12)' WHEN 'RNR05' THEN 'RNR (05)' ELSE 'RNR (50)' END, ', Filter: ', CASE filter WHEN 'filtered' THEN 'Import Filtered' ELSE 'No Filter' END,
  ', Analysis: ', CASE analysis WHEN 'merge' THEN 'Merge Commit' WHEN 'tag' THEN 'Tag' ELSE 'Frequency (20)' END, ', Min Tokens: ', min_tokens,
  CASE WHEN search_depth <> -1 THEN ', Search Depth: 7' ELSE '' END, CASE WHEN max_commits <> -1 THEN ', Max Commits: 9' ELSE '' END,
  ', Date: ', substr(date, 1, 4), '/', substr(date, 5, 2), '/', substr(date, 7, 2)) AS label FROM runs""")
def s14_run_catalogue(spark, d):
    return readers.run_catalogue(T.run_files(spark, d))


@query("f25_run_names", """SELECT k, name FROM (SELECT k, ck, regexp_replace(regexp_replace(name, '_[A-Za-z]*(_unknown)?\\.csv$', ''), '(_sd7)(_[0-9]{8})', '\\2\\1') AS name FROM run_files)""")
def f25_run_names(spark, d):
    rows = T.table(spark, d, "orders").selectExpr(
        "o_orderkey AS k", "concat('repo', o_custkey % 40) AS repo",
        "element_at(array('normal', 'tks', 'rnr', 'rnr'), CAST(o_orderkey % 4 AS INT) + 1) AS method", "12 AS tks",
        "CASE WHEN o_orderkey % 4 = 2 THEN 0.05 ELSE 0.5 END AS rnr", "30 + o_orderkey % 3 * 10 AS tokens", "o_orderkey % 2 = 0 AS filtered",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'clone_pair' ELSE 'clone_set' END AS comod",
        "element_at(array('merge_commit', 'tag', 'frequency'), CAST(o_orderkey % 3 AS INT) + 1) AS analysis", "20 AS freq",
        "date_format(o_orderdate, 'yyyyMMdd') AS day", "CASE WHEN o_orderkey % 13 = 0 THEN 7 ELSE -1 END AS depth", "CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE -1 END AS cap",
    )
    return rows.select(
        "k", labels.run_name("repo", labels.detection_token("method", "tks", "rnr"), "tokens", "filtered", "comod", labels.analysis_token("analysis", "freq"), "day", "depth", "cap").alias("name")
    )


@query("w10_latest_run", """SELECT project, lower(language) AS language, arg_max(name, (CAST(date AS BIGINT), CAST(filter = 'filtered' AS INT), CAST(comod = 'cloneset' AS INT), size, name)) AS name FROM runs GROUP BY ALL""")
def w10_latest_run(spark, d):
    return readers.latest_run(s14_run_catalogue(spark, d))


@query("k12_ordered_catalogue", """SELECT project, name, size, language, date,
  CAST(row_number() OVER (PARTITION BY project ORDER BY size DESC, language DESC, date DESC, name DESC) - 1 AS INT) AS place FROM runs""")
def k12_ordered_catalogue(spark, d):
    return readers.placed_catalogue(s14_run_catalogue(spark, d)).select("project", "name", "size", "language", "date", "place")


@query("j18_catalogue_with_rest", """SELECT DISTINCT project, language, 'pairs' AS source FROM runs UNION ALL
  (SELECT DISTINCT project, language, 'services' FROM text_files f WHERE (project, language) NOT IN (SELECT (project, language) FROM runs))""")
def j18_catalogue_with_rest(spark, d):
    return readers.catalogue_with_rest(s14_run_catalogue(spark, d), T.text_files(spark, d))


@query("u6_project_names", "SELECT project FROM runs UNION SELECT project FROM text_files UNION SELECT project FROM order_fragments UNION SELECT project FROM listing")
def u6_project_names(spark, d):
    return readers.project_names(s14_run_catalogue(spark, d), T.text_files(spark, d), T.order_fragments(spark, d), T.file_listing(spark, d))


@query("s23_run_parameters", """SELECT concat('p', o_orderkey) AS project, CASE WHEN o_orderkey % 4 = 0 THEN 'tks' ELSE 'normal' END AS detection_method, CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE 50 END AS min_tokens,
  true AS import_filter, 'clone_set' AS comod_method, 'merge_commit' AS analysis_method, 1 AS analysis_frequency, -1 AS search_depth, -1 AS max_analyzed_commits FROM orders""")
def s23_run_parameters(spark, d):
    return readers.run_parameters(
        T.table(spark, d, "orders").selectExpr(
            "concat('p', o_orderkey) AS project", "CASE WHEN o_orderkey % 4 = 0 THEN 'tks' END AS detection_method", "CASE WHEN o_orderkey % 3 = 0 THEN 30 END AS min_tokens"
        )
    )


@query("f27_detection_names", """SELECT file_id, ['no-import', 'tks', 'ccfsw', 'other'][file_id % 4 + 1] AS method, ['java', 'cpp', 'csharp', 'go'][file_id % 4 + 1] AS detector_language, file_path LIKE '%f1%' AS suspicious FROM text_files""")
def f27_detection_names(spark, d):
    rows = T.text_files(spark, d).selectExpr(
        "file_id", "element_at(array('import', 'TKS', '', 'other'), CAST(file_id % 4 AS INT) + 1) AS prefix", "element_at(array('Java', 'C++', 'C#', 'Go'), CAST(file_id % 4 AS INT) + 1) AS lang",
        "replace(file_path, 'f1', 'Latest1') AS p",
    )
    return rows.select(
        "file_id", labels.detection_from_prefix("prefix").alias("method"), paths.detector_language("lang").alias("detector_language"),
        paths.test_name_false_positive("p").alias("suspicious"),
    )


@query("f30_test_name_probe", "SELECT file_id, regexp_matches(text, '(?i)contest|latest|attest') AS hit, contains(lower(text), 'test') AS test FROM text_files")
def f30_test_name_probe(spark, d):
    return T.text_files(spark, d).select("file_id", paths.test_name_false_positive("text").alias("hit"), paths.is_test_path("text").alias("test"))


@query("f31_safe_numbers", """SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS BIGINT), 0) AS i,
  coalesce(TRY_CAST(CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0.0) AS f, CAST(event_type IN ('click', 'view') AS INT) AS flag FROM events""")
def f31_safe_numbers(spark, d):
    rows = T.table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE event_type END AS a", "CASE WHEN event_id % 2 = 0 THEN event_type ELSE CAST(value AS STRING) END AS b",
        "CASE event_type WHEN 'click' THEN 'YES' WHEN 'view' THEN 'True' WHEN 'error' THEN 'false' ELSE '0' END AS c",
    )
    return rows.select("event_id", numbers.safe_int("a").alias("i"), numbers.safe_number("b").alias("f"), numbers.truthy_count("c").alias("flag"))


@query("f34_candidate_names", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN concat('acme-repo', c_custkey % 20, '-unit', c_custkey // 20 + c_custkey % 2, ',repo', c_custkey % 20, '-unit', c_custkey // 20 + c_custkey % 2, ',acme-unit',
    c_custkey // 20 + c_custkey % 2, ',unit', c_custkey // 20 + c_custkey % 2) END AS image_names,
  CASE WHEN c_custkey % 3 = 0 THEN concat('service-unit', c_custkey // 20, 'x,unit', c_custkey // 20, 'x') ELSE concat('unit', c_custkey // 20, '-service,unit', c_custkey // 20) END AS container_names FROM customer""")
def f34_candidate_names(spark, d):
    base = T.table(spark, d, "customer").selectExpr(
        "c_custkey", "'acme' AS user", "concat('repo', c_custkey % 20) AS repo",
        "CASE WHEN c_custkey % 4 <> 3 THEN concat('Registry/acme-repo', c_custkey % 20, '-unit', CAST(floor(c_custkey / 20) AS BIGINT) + c_custkey % 2) END AS image",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('Service-unit', CAST(floor(c_custkey / 20) AS BIGINT), 'x') ELSE concat('unit', CAST(floor(c_custkey / 20) AS BIGINT), '-service') END AS container_name",
    )
    return base.select(
        "c_custkey", F.when(F.col("image").isNotNull(), F.array_join(names.names_from_image("image", "user", "repo"), ",")).alias("image_names"),
        F.array_join(names.names_from_container("container_name"), ",").alias("container_names"),
    )


# --- table filters ------------------------------------------------------------------------

_SETS = "SELECT project, language, clone_id, service_count, comod_count, cross_service_line_count FROM o_set_metrics"
_SET_COLUMNS = ["project", "language", "clone_id", "service_count", "comod_count", "cross_service_line_count"]
_LABELLED = """SELECT m.project, m.language, m.clone_id, m.service_count, m.comod_count, m.cross_service_line_count FROM o_set_metrics m JOIN
  (SELECT project, language, clone_id, list(DISTINCT file_type) AS types, list(DISTINCT service) AS names FROM order_fragments GROUP BY ALL) l USING (project, language, clone_id)"""


def _labelled(spark, d):
    rows = T.order_fragments(spark, d)
    return metrics.clone_set_metrics(rows).join(metrics.clone_set_labels(rows), ["project", "language", "clone_id"])


@query("p14_numeric_range", "SELECT project, language, clone_id FROM o_set_metrics WHERE cross_service_line_count BETWEEN 50 AND 120")
def p14_numeric_range(spark, d):
    return core.a3_clone_set_metrics(spark, d).filter(filters.in_range("cross_service_line_count", "50", 120)).select("project", "language", "clone_id")


@query("p15_clone_sets_cross2", _SETS + " WHERE service_count >= 2 AND comod_count >= 1 AND contains(clone_id, '10')")
def p15_clone_sets_cross2(spark, d):
    table = core.a3_clone_set_metrics(spark, d)
    return filters.filter_clone_sets(table, preset="cross2", ranges={"comod_count": (1, None)}, clone_id_text=" 10 ").select(*_SET_COLUMNS)


@query("p15_clone_sets_comod1", _LABELLED + " WHERE comod_count >= 1 AND list_has_any(types, ['test', 'data']) AND list_has_any(names, ['svc1', 'svc2'])")
def p15_clone_sets_comod1(spark, d):
    return filters.filter_clone_sets(_labelled(spark, d), preset="comod1", file_types=["Test", "data"], services=["svc1", "svc2"]).select(*_SET_COLUMNS)


@query("p15_clone_sets_top_quartile", _SETS + " WHERE cross_service_line_count >= (SELECT quantile_cont(cross_service_line_count, 0.75) FROM o_set_metrics)")
def p15_clone_sets_top_quartile(spark, d):
    return filters.filter_clone_sets(core.a3_clone_set_metrics(spark, d), preset="top_inter_loc").select(*_SET_COLUMNS)


@query("p16_service_filter", "SELECT project, language, service, clone_set_count, roc FROM o_service_metrics WHERE roc <= 0.33 AND contains(lower(service), 'vc1')")
def p16_service_filter(spark, d):
    table = core.a2_service_metrics(spark, d)
    return filters.filter_services(table, ranges={"roc": (None, 0.33)}, name_text="VC1").select("project", "language", "service", "clone_set_count", "roc")


@query("p17_file_filter", f"""SELECT m.project, m.language, m.file_path, m.service, m.sharing_service_count FROM t_file_metrics m JOIN
  (SELECT project, language, file_path, coalesce(arg_min(file_type, (-n, file_type)) FILTER (n > 0), 'unknown') AS t FROM
  (SELECT project, language, file_path, file_type, count(*) FILTER (service <> '') AS n FROM text_fragments GROUP BY ALL) GROUP BY ALL) USING (project, language, file_path)
  WHERE t = 'logic' AND sharing_service_count >= 1 AND contains({BASE.format(c='file_path')}, 'f1')""")
def p17_file_filter(spark, d):
    rows = T.text_fragments(spark, d)
    table = metrics.file_metrics(rows).join(metrics.file_main_type(rows), ["project", "language", "file_path"]).withColumn("file_name", paths.base_name("file_path"))
    return filters.filter_files(table, ranges={"sharing_service_count": (1, None)}, file_type="logic", name_text="F1").select(
        "project", "language", "file_path", "service", "sharing_service_count"
    )


@query("p18_sets_by_service_and_type", _SETS + " WHERE (project, language, clone_id) IN (SELECT (project, language, clone_id) FROM order_fragments WHERE service = 'svc4' AND file_type = 'config')")
def p18_sets_by_service_and_type(spark, d):
    rows = T.order_fragments(spark, d)
    return filters.sets_touching(metrics.clone_set_metrics(rows), rows, service="svc4", file_type="config").select(*_SET_COLUMNS)


@query("p19_sets_of_file", _SETS + " WHERE (project, language, clone_id) IN (SELECT (project, language, clone_id) FROM order_fragments WHERE file_path = 'mod1/config/f50.java')")
def p19_sets_of_file(spark, d):
    rows = T.order_fragments(spark, d)
    return filters.sets_touching(metrics.clone_set_metrics(rows), rows, path="mod1/config/f50.java").select(*_SET_COLUMNS)


@query("p20_services_by_language", "SELECT * FROM o_service_metrics WHERE language = 'Go'")
def p20_services_by_language(spark, d):
    return filters.by_language(core.a2_service_metrics(spark, d), "Go")


@query("p21_known_ranges", _SERVICE_RANGES.replace("service <> ''", "service NOT IN ('', 'src3')"))
def p21_known_ranges(spark, d):
    from twintrail.operators.intervals import contiguous_ranges

    # One service is renamed to an unknown marker and has to fall out with the unresolved ones.
    files = T.text_files(spark, d).withColumn("service", F.when(F.col("service") == "src3", " Unresolved ").otherwise(F.col("service")))
    ranges = contiguous_ranges(files, ["project", "language", "service"], "file_id")
    return filters.known_ranges(ranges)


@query("p22_column_bounds", """SELECT 'service_count' AS "column", CAST(min(service_count) AS DOUBLE) AS low, CAST(max(service_count) AS DOUBLE) AS high FROM o_set_metrics UNION ALL
  SELECT 'cross_service_fragment_ratio', round_even(min(cross_service_fragment_ratio), 2), round_even(max(cross_service_fragment_ratio), 2) FROM o_set_metrics""")
def p22_column_bounds(spark, d):
    return filters.column_bounds(core.a3_clone_set_metrics(spark, d), {"service_count": 1, "cross_service_fragment_ratio": 0.01})


@query("p23_token_options", "SELECT DISTINCT file_type AS value FROM order_fragments")
def p23_token_options(spark, d):
    return filters.token_options(metrics.clone_set_labels(T.order_fragments(spark, d)), "file_types")


@query("p23_value_options", "SELECT DISTINCT service AS value FROM text_files WHERE service <> ''")
def p23_value_options(spark, d):
    return filters.value_options(T.text_files(spark, d), "service")


@query("p24_metric_columns", """SELECT 'clone_set' AS granularity, count(*) AS sets, 7 AS metrics FROM o_set_metrics UNION ALL SELECT 'file', count(*), 8 FROM o_file_metrics UNION ALL SELECT 'service', count(*), 8 FROM o_service_metrics""")
def p24_metric_columns(spark, d):
    """Rows of each metric table beside the catalogue metrics its columns cover."""
    tables = {"service": core.a2_service_metrics(spark, d), "clone_set": core.a3_clone_set_metrics(spark, d), "file": core.a4_file_metrics(spark, d)}
    out = None
    for kind, table in tables.items():
        listed = [m[1] for m in C.METRIC_CATALOGUE if m[0] == kind]
        row = table.agg(F.count(F.struct(*listed)).alias("sets")).select(F.lit(kind).alias("granularity"), "sets", F.lit(len(listed)).alias("metrics"))
        out = row if out is None else out.union(row)
    return out


@query("p25_eligible_repositories", """SELECT project, contributors, commits FROM (SELECT concat('team', user_id % 7) AS project, count(DISTINCT user_id) AS contributors, count(*) AS commits FROM events GROUP BY ALL)
  WHERE contributors > 5 AND contributors <= 30 AND commits BETWEEN 250 AND 1600""")
def p25_eligible_repositories(spark, d):
    rows = T.contributors(spark, d)
    return filters.eligible_repositories(rows, rows)


@query("k1_multi_column_sort", """SELECT project, language, file_path, service, sharing_service_count,
  CAST(row_number() OVER (PARTITION BY project, language ORDER BY sharing_service_count DESC, service, file_path) - 1 AS INT) AS place FROM t_file_metrics""")
def k1_multi_column_sort(spark, d):
    table = core.a4_file_metrics_text(spark, d)
    order = [("sharing_service_count", "desc"), ("service", "asc"), ("file_path", "asc")]
    return ranks.placed(table, ["project", "language"], order).select("project", "language", "file_path", "service", "sharing_service_count", "place")


@query("k9_table_page", "SELECT project, language, clone_id, comod_count FROM o_set_metrics ORDER BY comod_count DESC, project, language, clone_id LIMIT 20 OFFSET 40")
def k9_table_page(spark, d):
    order = [F.col("comod_count").desc(), F.col("project"), F.col("language"), F.col("clone_id")]
    return ranks.page(core.a3_clone_set_metrics(spark, d), order, 2, 20).select("project", "language", "clone_id", "comod_count")


@query("h9_target_languages", "SELECT language, count(*) AS files FROM (SELECT ['Java','Python','Kotlin','Swift','C','HTML'][doc_id % 6 + 1] AS language FROM documents) WHERE language IN ('Java', 'Python', 'C') GROUP BY ALL")
def h9_target_languages(spark, d):
    rows = T.table(spark, d, "documents").selectExpr("element_at(array('Java','Python','Kotlin','Swift','C','HTML'), CAST(doc_id % 6 AS INT) + 1) AS language")
    return readers.target_languages(rows).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
