"""Parse steps on exchange text that Spark writes out of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from twintrail.sources import readers, text_rows
from twintrail.sources import star_tables as T

_FILE = ["project", "language"]
_HEADS = {
    "raw": ["clone_id", "index", "file_path", "start_line", "end_line", "start_column", "end_column", "modification"],
    "enriched": ["clone_id", "fragment_index", "file_path", "file_id", "service", "start_line", "end_line", "line_count", "file_type", "modified_commits", "modified_count"],
}


def _quoted(text):
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def _with_header(rows, head):
    """The lines of each file behind a header, numbered so that only the header is line 0."""
    heads = rows.select(*_FILE).distinct().select(*_FILE, F.lit(0).alias("line_no"), head.alias("line"))
    return heads.unionByName(rows)


def _raw_lines(spark, d):
    """Two shops write ';' with bare JSON, the others ',' with quotes. Rows without a service come without a clone id."""
    semi = F.col("project").isin("shop1", "shop4")
    history = F.to_json(F.transform("modified_commits", lambda c: F.struct(F.lit("modified").alias("type"), c.alias("commit"))))
    name = F.when(F.col("service") != "", F.col("clone_id")).otherwise("")
    cells = [name, F.col("fragment_index").cast("string"), F.col("file_path"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.lit("1"), F.col("line_count").cast("string")]
    line = F.when(semi, F.concat_ws(";", *cells, history)).otherwise(F.concat_ws(",", *cells, _quoted(history)))
    rows = T.order_fragments(spark, d).select(*_FILE, (F.col("fragment_index") + 1).alias("line_no"), line.alias("line"))
    # The heads of shop4 hold both marks, so that its lines have to tell.
    head = F.when(F.col("project") == "shop4", ";".join(_HEADS["raw"]) + ",type,commit").when(semi, ";".join(_HEADS["raw"])).otherwise(",".join(_HEADS["raw"]))
    return _with_header(rows, head)


def _enriched_lines(spark, d):
    commits = F.when(F.size("modified_commits") > 0, _quoted(F.to_json("modified_commits"))).otherwise("")
    kind = F.when(F.col("file_type") == "logic", "").otherwise(F.col("file_type"))
    cells = ["clone_id", "fragment_index", "file_path", "file_id", "service", "start_line", "end_line", "line_count"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in cells], kind, commits, F.col("modified_count").cast("string"))
    rows = T.order_fragments(spark, d).select(*_FILE, (F.col("fragment_index") + 1).alias("line_no"), line.alias("line"))
    return _with_header(rows, F.lit(",".join(_HEADS["enriched"])))


def _snapshots(spark, d):
    """One snapshot an order: its files, and its lines as one clone set."""
    place = ["fragment_index", F.col("file_id").cast("int").alias("file_id"), "file_path", "start_line", "end_line", "line_count"]
    one = T.order_fragments(spark, d).groupBy(*_FILE, "clone_id").agg(F.sort_array(F.collect_list(F.struct(*place))).alias("f"))
    files = F.array_distinct(F.transform("f", lambda f: F.struct(f.file_id.alias("file_id"), f.file_path.alias("file_path"), F.lit(100).alias("loc"), F.lit(900).alias("token_count"))))
    fragments = F.transform("f", lambda f: F.struct(f.file_id.alias("file_id"), f.start_line.alias("start_line"), f.end_line.alias("end_line"), F.lit(1).alias("start_col"), f.line_count.alias("end_col")))
    sets = F.array(F.struct(F.col("clone_id").cast("int").alias("clone_id"), F.size("f").alias("token_count"), fragments.alias("fragments")))
    documents = one.select("project", F.col("clone_id").alias("sha"), "language", F.to_json(F.struct(files.alias("file_data"), sets.alias("clone_sets"))).alias("document"))
    return text_rows.snapshot_rows(documents, ["project", "sha", "language"])


@query("s1_raw_fragment_rows", """SELECT project, language, clone_id, fragment_index, file_path, start_line, end_line, 1 AS start_column, line_count AS end_column,
  array_to_string(modified_commits, ',') AS commits, CAST(len(modified_commits) AS INT) AS entries FROM order_fragments WHERE service <> ''""")
def s1_raw_fragment_rows(spark, d):
    rows = text_rows.raw_fragment_rows(_raw_lines(spark, d), _FILE)
    return rows.withColumn("commits", F.array_join(F.transform("modification", lambda m: m["commit"]), ",")).withColumn("entries", F.size("modification")).drop("modification")


@query("s1_separators", """SELECT DISTINCT project, language, CASE WHEN project IN ('shop1', 'shop4') THEN ';' ELSE ',' END AS sep FROM order_fragments""")
def s1_separators(spark, d):
    return text_rows.separators(_raw_lines(spark, d), _FILE)


_ENRICHED_SQL = """SELECT project, language, clone_id, fragment_index, file_path, CAST(file_id AS INT) AS file_id, service, start_line, end_line, line_count,
  {kind} AS file_type, array_to_string(modified_commits, ',') AS modified_commits, modified_count FROM order_fragments"""


@query("s2_enriched_rows", _ENRICHED_SQL.format(kind="nullif(file_type, 'logic')"))
def s2_enriched_rows(spark, d):
    return text_rows.enriched_rows(_enriched_lines(spark, d), _FILE).withColumn("modified_commits", F.array_join("modified_commits", ","))


@query("s3_enriched_rows_lenient", _ENRICHED_SQL.format(kind="CASE WHEN file_type = 'logic' THEN 'unknown' ELSE file_type END"))
def s3_enriched_rows_lenient(spark, d):
    return text_rows.enriched_rows(_enriched_lines(spark, d), _FILE, lenient=True).withColumn("modified_commits", F.array_join("modified_commits", ","))


@query("s4_pair_rows", """SELECT CAST(l_orderkey AS VARCHAR) AS clone_id, CAST(l_linenumber AS INT) AS start_line_x, l_partkey AS file_id_x, l_suppkey AS file_id_y,
  CASE WHEN l_returnflag = 'A' OR l_suppkey % 5 = 0 THEN 'unknown' ELSE concat('svc', l_suppkey % 5) END AS service_y, concat('svc', l_partkey % 5) AS service_x,
  CASE WHEN l_returnflag = 'R' THEN 'given' WHEN l_returnflag <> 'A' AND l_suppkey % 5 <> 0 AND l_suppkey % 5 = l_partkey % 5 THEN 'intra' ELSE 'inter' END AS relation,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END ELSE CAST(l_quantity > 25 AS INT) END AS comodified,
  CASE WHEN l_returnflag = 'A' THEN '[]' ELSE concat('["c', l_linenumber, '"]') END AS comodified_commits,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END ELSE CAST(l_quantity AS BIGINT) END AS comodification_count,
  CASE WHEN l_returnflag = 'A' THEN 'tks' ELSE 'no-import' END AS detection_method
  FROM lineitem WHERE l_linenumber <> 3""")
def s4_pair_rows(spark, d):
    """Rows of two detectors in two layouts: the older one knows neither the other service nor the commits. Third lines come without their first file."""
    rows = T.table(spark, d, "lineitem")
    common = [
        "CAST(l_orderkey AS STRING) AS clone_id", "CAST(l_linenumber AS STRING) AS start_line_x", "CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey AS STRING) END AS file_id_x",
        "CAST(l_suppkey AS STRING) AS file_id_y", "concat('svc', l_partkey % 5) AS service_x", "CASE WHEN l_returnflag = 'R' THEN 'given' ELSE '' END AS relation",
    ]
    old = rows.filter("l_returnflag = 'A'").selectExpr(*common, "CASE WHEN l_linestatus = 'F' THEN 'True' ELSE 'no' END AS comodified")
    new = rows.filter("l_returnflag <> 'A'").selectExpr(
        *common, "CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('svc', l_suppkey % 5) END AS service_y", "CASE WHEN l_quantity > 25 THEN 'yes' ELSE '0' END AS comodified",
        "concat('[\"c', l_linenumber, '\"]') AS comodified_commits", "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS comodification_count",
    )
    pairs = readers.tagged_pairs([(old, "tks"), (new, "no-import")])
    return pairs.select("clone_id", "start_line_x", "file_id_x", "file_id_y", "service_x", "service_y", "relation", "comodified", "comodified_commits", "comodification_count", "detection_method")


@query("s6_snapshot_fragments", """SELECT project, clone_id AS sha, language, 0 AS set_order, clone_id, CAST(count(*) OVER (PARTITION BY project, language, clone_id) AS INT) AS token_count, fragment_index,
  CAST(file_id AS INT) AS file_id, start_line, end_line, 1 AS start_col, line_count AS end_col, file_path FROM order_fragments""")
def s6_snapshot_fragments(spark, d):
    return readers.snapshot_fragments(_snapshots(spark, d))


@query("s6_snapshot_files", "SELECT DISTINCT project, clone_id AS sha, language, CAST(file_id AS INT) AS file_id, file_path, 100 AS loc, 900 AS token_count FROM order_fragments")
def s6_snapshot_files(spark, d):
    return readers.snapshot_files(_snapshots(spark, d))


@query("s7_snapshot_pairs", """SELECT project, language, clone_id, fragment_index_x, fragment_index_y, file_path_x, file_path_y, CAST(file_id_x AS INT) AS file_id_x, CAST(file_id_y AS INT) AS file_id_y,
  split_part(file_path_x, '/', 1) AS service_x, split_part(file_path_y, '/', 1) AS service_y, file_type_x, file_type_y, start_line_x, end_line_x, start_line_y, end_line_y,
  CASE WHEN split_part(file_path_x, '/', 1) = split_part(file_path_y, '/', 1) THEN 'intra' ELSE 'inter' END AS relation, n AS token_count
  FROM order_pairs JOIN (SELECT project, language, clone_id, CAST(count(*) AS INT) AS n FROM order_fragments GROUP BY ALL) USING (project, language, clone_id)""")
def s7_snapshot_pairs(spark, d):
    services = T.order_fragments(spark, d).select("project", "file_path").distinct().withColumn("service", F.substring_index("file_path", "/", 1))
    sides = [f"{c}_{s}" for c in ("fragment_index", "file_path", "file_id", "service", "file_type", "start_line", "end_line") for s in "xy"]
    return readers.snapshot_pairs(_snapshots(spark, d), services).select("project", "language", "clone_id", *sides, "relation", "token_count")


def _map(rows, keys, key, value):
    """Rows folded to a map from ``key`` to ``value`` under the name ``entries``; services of a project are few."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), value.alias("value")))).alias("entries"))


def _url():
    """One project's address ends in a slash."""
    return F.concat(F.lit("https://host.example/"), F.col("project"), F.when(F.col("project") == "shop2", "/main/").otherwise("/main")).alias("URL")


_URL_SQL = "concat('https://host.example/', project, CASE WHEN project = 'shop2' THEN '/main/' ELSE '/main' END)"


def _service_documents(spark, d):
    """One document a project: files and lines of its services, and the ids their files span."""
    totals = _map(T.order_service_loc(spark, d), _FILE, "service", F.struct(F.col("file_count").cast("int").alias("file_count"), F.col("total_loc").cast("int").alias("total_loc")))
    spans = T.order_fragments(spark, d).filter("service <> ''").groupBy(*_FILE, "service").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high"))
    ranges = _map(spans, _FILE, "service", F.array(F.array("low", "high"))).withColumnRenamed("entries", "file_ranges")
    stats = totals.withColumnRenamed("entries", "services").join(ranges, _FILE)
    whole = _map(stats, ["project"], "language", F.struct("services", "file_ranges"))
    return text_rows.service_documents(whole.select(F.to_json(F.struct(_url(), F.col("entries").alias("language_stats"))).alias("document")))


def _selection(spark, d):
    """One entry a project: languages, contexts and their services."""
    context = F.concat(F.lit("apps/"), F.substring("service", 4, 9).cast("int") % 3)
    named = T.order_service_loc(spark, d).withColumn("context", context).groupBy(*_FILE, "context").agg(F.sort_array(F.collect_list("service")).alias("names"))
    contexts = _map(named, _FILE, "context", F.col("names")).withColumnRenamed("entries", "contexts")
    whole = _map(contexts, ["project"], "language", F.col("contexts"))
    return text_rows.selection_documents(whole.select(F.to_json(F.struct(_url(), F.col("entries").alias("languages"))).alias("document")))


@query("s10_service_totals", "SELECT concat(project, '.main') AS project, language, service, CAST(file_count AS INT) AS file_count, CAST(total_loc AS INT) AS total_loc FROM order_loc")
def s10_service_totals(spark, d):
    return readers.service_totals(readers.language_stats(_service_documents(spark, d)))


@query("s10_one_language", "SELECT concat(project, '.main') AS project, language, service, CAST(file_count AS INT) AS file_count, CAST(total_loc AS INT) AS total_loc FROM order_loc WHERE language = 'JavaScript'")
def s10_one_language(spark, d):
    return readers.service_totals(readers.language_stats(_service_documents(spark, d), "jaVAscript"))


@query("s10_service_ranges", """SELECT concat(project, '.main') AS project, language, service, 0 AS place, CAST(min(file_id) AS INT) AS range_start, CAST(max(file_id) AS INT) AS range_end
  FROM order_fragments WHERE service <> '' GROUP BY ALL""")
def s10_service_ranges(spark, d):
    rows = readers.service_ranges(readers.language_stats(_service_documents(spark, d)))
    return rows.withColumn("place", F.col("ordinal.i")).drop("ordinal")


@query("s12_selected_contexts", f"SELECT concat(project, '.main') AS project, {_URL_SQL} AS \"URL\", language, concat('apps/', CAST(substr(service, 4) AS INT) % 3) AS context, service FROM order_loc")
def s12_selected_contexts(spark, d):
    return readers.selected(_selection(spark, d))


@query("s15_project_urls", f"SELECT concat(project, '.main') AS project, {_URL_SQL} AS \"URL\", string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM order_loc GROUP BY ALL")
def s15_project_urls(spark, d):
    return readers.named_urls(_selection(spark, d)).withColumn("languages", F.array_join(F.sort_array("languages"), ","))


_LINES_SQL = ", ".join(f"array_to_string(list_transform(list_sort({c}), lambda v: CAST(v AS VARCHAR)), ',') AS {c}_lines" for c in ("inserted", "deleted", "modified"))


@query("s13_hunk_rows", f"SELECT project, child_sha, parent_sha, path AS child_path, path AS parent_path, {_LINES_SQL} FROM hunk_table")
def s13_hunk_rows(spark, d):
    parts = ["child_path", "parent_path", "inserted_lines", "deleted_lines", "modified_lines"]
    files = T.hunk_table(spark, d).select("project", F.concat("child_sha", F.lit("-"), "parent_sha", F.lit(".json")).alias("name"), F.to_json(F.array(F.struct(*parts))).alias("document"))
    return text_rows.hunk_rows(files).withColumns({c: F.array_join(c, ",") for c in parts[2:]})


@query("s16_gold_rows", "SELECT CAST(file_id AS VARCHAR) AS id, file_path, language, md5(text) AS text_md5, service AS label, CASE WHEN loc > 3 THEN concat(loc, ' lines') END AS rationale FROM text_files")
def s16_gold_rows(spark, d):
    """Each sample has a blank line behind it."""
    rationale = F.when(F.col("loc") > 3, F.concat(F.col("loc").cast("string"), F.lit(" lines")))
    sample = F.struct(F.col("file_id").cast("string").alias("id"), "file_path", "language", F.col("text").alias("file_text"), F.col("service").alias("label"), rationale.alias("rationale"))
    lines = T.text_files(spark, d).select(F.explode(F.array(F.to_json(sample), F.lit(" \r"))).alias("line"))
    return text_rows.gold_rows(lines).withColumn("text_md5", F.md5("file_text")).drop("file_text")
