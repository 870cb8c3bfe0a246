"""Views that turn the star-schema tables into fragments, files, commits and listings.

Every view is arithmetic on the table rows, so its size follows the tables. Projects,
languages, services and clone sets of very different sizes come out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twintrail.constants import SET_KEYS
from twintrail.functions import commits, paths
from twintrail.operators.chunks import adjacent_commits
from twintrail.operators.ranks import dense_index

LANGUAGES = "array('Java','JavaScript','Go','Python')"
FOLDERS = "array('src','test','config','dto','migrations','src/main','specs','src/lib')"
ENDINGS = "array('.java','.py','.js','.go','.sql')"
VERSIONS = 4
IDS_PER_CHUNK = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fragments out of order lines (volume) ---------------------------------------------


def order_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched fragments: an order is a clone set, a part is a file, a supplier names the service."""
    # Numbered on the narrow integer key first, beside small numbers; names are spelt out afterwards. An order has few
    # lines, so they are put in place by one shuffle. Lines without an order or a part are no fragments; the latter have a place.
    w = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "CAST(l_quantity AS INT) AS line_count",
        "CASE WHEN l_discount < 0.075 THEN year(l_shipdate) * 4 + quarter(l_shipdate) - 1 END AS quarters",
        "CASE WHEN l_tax > 0.035 THEN year(l_shipdate) END AS years",
    )
    return lines.withColumn("fragment_index", F.row_number().over(w) - 1).filter("l_partkey IS NOT NULL").selectExpr(
        "concat('shop', l_orderkey % 5) AS project",
        f"element_at({LANGUAGES}, CAST(l_orderkey % 4 AS INT) + 1) AS language",
        "CAST(l_orderkey AS STRING) AS clone_id", "fragment_index",
        f"concat('mod', l_partkey % 7, '/', element_at({FOLDERS}, CAST(l_partkey % 8 AS INT) + 1), '/f', l_partkey,"
        f" element_at({ENDINGS}, CAST(l_partkey % 5 AS INT) + 1)) AS file_path",
        "l_partkey AS file_id",
        "CASE WHEN l_suppkey % 23 = 0 THEN '' ELSE concat('svc', l_suppkey % 20) END AS service",
        "CAST((l_suppkey * 7 + l_linenumber * 13) % 400 + 1 AS INT) AS start_line",
        "line_count",
        "array_compact(array(concat('q', floor(quarters / 4), '-', pmod(quarters, 4) + 1), concat('y', years))) AS modified_commits",
    ).select(
        *SET_KEYS, "fragment_index", "file_path", "file_id", "service", "start_line",
        (F.col("start_line") + F.col("line_count") - 1).alias("end_line"), "line_count",
        paths.file_type("file_path").alias("file_type"), "modified_commits",
        F.size("modified_commits").alias("modified_count"),
    )


def order_service_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines of each service of the order view."""
    return (
        table(spark, sf_dir, "lineitem").filter("l_suppkey % 23 <> 0")
        .selectExpr(
            "concat('shop', l_orderkey % 5) AS project",
            f"element_at({LANGUAGES}, CAST(l_orderkey % 4 AS INT) + 1) AS language",
            "concat('svc', l_suppkey % 20) AS service", "CAST(l_quantity AS BIGINT) * 3 AS loc",
        )
        .groupBy("project", "language", "service")
        .agg(F.count(F.lit(1)).alias("file_count"), F.sum("loc").alias("total_loc"))
    )


# --- files and fragments out of documents ------------------------------------------------


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of three projects; services by folder."""
    folder = f"element_at({FOLDERS}, CAST(doc_id % 8 AS INT) + 1)"
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('acme.repo', doc_id % 3) AS project", "lang AS language", "doc_id AS file_id",
        f"concat(source, '/', {folder}, '/f', doc_id, element_at({ENDINGS}, CAST(doc_id % 5 AS INT) + 1)) AS file_path",
        "CASE WHEN source = 'src19' THEN '' WHEN source = 'src18' THEN 'legacy18'"
        f" WHEN {folder} = 'test' THEN concat(source, '-test') ELSE source END AS service",
        "source", "text",
    ).withColumn("loc", paths.loc("text"))


def service_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts: a folder per source, a nested test folder, one source only in the fallback tier, one where no file is."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("concat('acme.repo', doc_id % 3) AS project", "source").distinct()
        .selectExpr("project", "source", "CASE WHEN source = 'src19' THEN concat('moved/', source) ELSE source END AS folder")
        .selectExpr(
            "project",
            "inline(CASE WHEN source = 'src18'"
            " THEN array(struct(source AS context, 'legacy18' AS service, 2 AS tier, 1 AS ordinal))"
            " ELSE array(struct(folder AS context, source AS service, 1 AS tier, 1 AS ordinal),"
            " struct(concat(folder, '/test/') AS context, concat(source, '-test') AS service, 1 AS tier, 2 AS ordinal)) END)",
        )
    )


def file_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each file with their type; ten events fall on a file."""
    return (
        table(spark, sf_dir, "events")
        .selectExpr(
            "CAST(floor(event_id / 10) AS BIGINT) AS file_id",
            "CASE WHEN event_type = 'signup' THEN 'added' ELSE 'modified' END AS type",
            "CASE WHEN event_type IN ('click', 'view') THEN concat('u', user_id % 40) ELSE concat('c', date_format(ts, 'yyyyMMdd')) END AS commit",
        )
        .groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct("type", "commit"))).alias("modification"))
    )


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal lines of a project-language as raw fragments with the history of their file."""
    lines = (
        text_files(spark, sf_dir)
        .select("project", "language", "file_id", "file_path", "service", "loc", F.posexplode(F.split("text", "\n")).alias("p", "line"))
        .select(
            "project", "language", F.md5("line").alias("clone_id"), "file_id", "file_path", "service", "loc",
            (F.col("p") + 1).alias("start_line"),
        )
    )
    shared = lines.groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = lines.join(shared, SET_KEYS, "left_semi")
    chunk = F.floor(F.col("file_id") / IDS_PER_CHUNK)
    indexed = dense_index(kept, SET_KEYS, [F.col("file_id"), F.col("start_line")], chunk, "fragment_index")
    empty = F.array().cast(commits.HISTORY)
    return indexed.join(file_history(spark, sf_dir), "file_id", "left").select(
        *SET_KEYS, "fragment_index", "file_id", "file_path", "service", "start_line",
        F.col("start_line").alias("end_line"), F.coalesce("modification", empty).alias("modification"),
    )


def text_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched fragments of the document view."""
    return repeated_lines(spark, sf_dir).select(
        *SET_KEYS, "fragment_index", "file_path", "file_id", "service", "start_line", "end_line",
        F.lit(1).alias("line_count"), paths.file_type("file_path").alias("file_type"),
        commits.modified_commits("modification").alias("modified_commits"), "modification",
    ).withColumn("modified_count", F.size("modified_commits"))


def codebases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code bases of the project selection: one per source, listed in name order; two lie where no file is."""
    return (
        table(spark, sf_dir, "documents")
        .selectExpr(
            "concat('acme.repo', doc_id % 3) AS project", "lang AS language",
            "CASE WHEN source IN ('src17', 'src19') THEN concat('moved/', source) ELSE source END AS context", "source AS service",
        )
        .distinct()
        .withColumn("ordinal", F.expr("CAST(substring(service, 4) AS INT)"))
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files of fourteen languages, with import statements put between the lines."""
    names = "array('Java','Python','JavaScript','Go','PHP','TypeScript','Rust','C++','C#','Ruby','Scala','C','Kotlin','Swift')"
    statement = (
        "CASE WHEN (i + doc_id) % 11 = 0 THEN concat('import ', x)"
        " WHEN (i + doc_id) % 11 = 2 THEN 'import ('"
        " WHEN (i + doc_id) % 11 = 4 THEN ')'"
        " WHEN (i + doc_id) % 11 = 5 THEN concat('from lib import (', x)"
        " WHEN (i + doc_id) % 11 = 7 THEN concat('const a = require(', x)"
        " WHEN (i + doc_id) % 11 = 8 THEN concat(x, ');')"
        " WHEN (i + doc_id) % 11 = 9 THEN concat('use ', x)"
        " ELSE x END"
    )
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('acme.repo', doc_id % 3) AS project", f"element_at({names}, CAST(doc_id % 14 AS INT) + 1) AS language",
        "doc_id AS file_id", f"array_join(transform(split(text, '\n'), (x, i) -> {statement}), '\n') AS text",
    )


# --- commits out of events -----------------------------------------------------------------


def commit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly commits per project, numbered from the oldest, with parents, tag and a state."""
    hourly = (
        table(spark, sf_dir, "events")
        .selectExpr("concat('acme.repo', user_id % 3) AS project", "date_trunc('HOUR', ts) AS committed_ts", "user_id")
        .groupBy("project", "committed_ts").agg(F.count(F.lit(1)).alias("touches"))
        .withColumn("hour_no", F.expr("CAST(unix_timestamp(committed_ts) / 3600 AS BIGINT)"))
        .selectExpr(
            "project", "committed_ts", "touches", "hour_no", "md5(concat(project, '@', hour_no)) AS sha",
            "CAST(1 + hour_no % 2 AS INT) AS n_parents",
            "CASE WHEN hour_no % 24 = 0 THEN concat('v', CAST(hour_no / 24 AS BIGINT)) END AS tag",
            "concat('state', CAST(floor(hour_no / 7) AS BIGINT) % 4) AS state",
        )
    )
    day = F.expr("CAST(floor(hour_no / 24) AS BIGINT)")
    return dense_index(hourly, ["project"], [F.col("hour_no")], day, "ord")


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('team', user_id % 7) AS project", "user_id AS contributor")


# --- document versions -----------------------------------------------------------------------


def line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document in each version: present or not, and whether the next newer one differs.

    Version 0 is the newest. A line is absent where its number, the file and the version
    meet a remainder of 11; it changes towards the older version on a remainder of 13.
    """
    return (
        text_files(spark, sf_dir)
        .select("project", "language", "file_id", "file_path", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
        .selectExpr(
            "project", "language", "file_id", "file_path", "i + 1 AS i", "line", "k",
            "(i + 1 + file_id + k * 3) % 11 <> 0 AS present", "(i + 1 + file_id * 5 + k) % 13 = 0 AS changes",
        )
    )


def version_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present lines with their number inside the version."""
    w = W.partitionBy("file_id", "k").orderBy("i")
    return (
        line_versions(spark, sf_dir).filter("present")
        .withColumn("line_no", F.row_number().over(w))
    )


def version_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        line_versions(spark, sf_dir).groupBy("project", "language", "file_id", "file_path", "k")
        .agg(F.count_if("present").cast("int").alias("loc"))
        .withColumn("sha", F.concat(F.lit("v"), F.col("k")))
    )


def version_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed commits, counted from the newest."""
    return (
        table(spark, sf_dir, "documents").selectExpr("concat('acme.repo', doc_id % 3) AS project").distinct()
        .withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
        .withColumn("sha", F.concat(F.lit("v"), F.col("ord")))
    )


def version_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacent_commits(version_commits(spark, sf_dir))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified patch from each older version to the next newer one, whole files as context.

    Two hunks per file: the lines up to number 40, and those behind it.
    """
    child = line_versions(spark, sf_dir).filter(F.col("k") < VERSIONS - 1)
    # Presence in the older version follows from the same arithmetic, so nothing is joined.
    rows = child.selectExpr(
        "project", "file_path", "k", "i", "line", "present AS c", "changes",
        "(i + file_id + (k + 1) * 3) % 11 <> 0 AS p", "CASE WHEN i <= 40 THEN 0 ELSE 1 END AS part",
    ).selectExpr(
        "project", "file_path", "k", "i", "part", "c", "p",
        "CASE WHEN c AND p AND changes THEN concat('-', line, '\n+', line, ' ~')"
        " WHEN c AND p THEN concat(' ', line) WHEN c THEN concat('+', line) WHEN p THEN concat('-', line) END AS body",
    )
    parts = rows.groupBy("project", "file_path", "k", "part").agg(
        F.count_if("p").alias("old_n"), F.count_if("c").alias("new_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "body"))), lambda r: r["body"]), "\n").alias("body"),
    )
    # array_join skips NULL bodies: lines absent on both sides leave no trace.
    before = W.partitionBy("project", "file_path", "k").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    heads = parts.withColumn("old_at", F.coalesce(F.sum("old_n").over(before), F.lit(0)) + 1).withColumn(
        "new_at", F.coalesce(F.sum("new_n").over(before), F.lit(0)) + 1
    ).withColumn("text", F.expr("concat('@@ -', old_at, ',', old_n, ' +', new_at, ',', new_n, ' @@\n', body)"))
    return heads.groupBy("project", "file_path", "k").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda r: r["text"]), "\n").alias("patch")
    ).selectExpr("project", "concat('v', k) AS child_sha", "concat('v', k + 1) AS parent_sha", "file_path AS path", "patch")


def hunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, deleted and modified line numbers between neighbouring versions, from the arithmetic."""
    rows = line_versions(spark, sf_dir).filter(F.col("k") < VERSIONS - 1).selectExpr(
        "project", "file_path", "file_id", "k", "i", "present AS c", "changes", "(i + file_id + (k + 1) * 3) % 11 <> 0 AS p"
    )
    w = W.partitionBy("file_id", "k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    numbered = rows.withColumn("cn", F.sum(F.col("c").cast("int")).over(w).cast("int")).withColumn(
        "pn", F.sum(F.col("p").cast("int")).over(w).cast("int")
    )
    plus = F.collect_set(F.expr("CASE WHEN c AND (NOT p OR changes) THEN cn END"))
    minus = F.collect_set(F.expr("CASE WHEN p AND (NOT c OR changes) THEN pn END"))
    return numbered.groupBy("project", "file_path", "k").agg(plus.alias("plus"), minus.alias("minus")).select(
        "project", F.expr("concat('v', k)").alias("child_sha"), F.expr("concat('v', k + 1)").alias("parent_sha"),
        F.col("file_path").alias("child_path"), F.col("file_path").alias("parent_path"),
        F.array_sort(F.array_except("plus", "minus")).alias("inserted_lines"),
        F.array_sort(F.array_except("minus", "plus")).alias("deleted_lines"),
        F.array_sort(F.array_intersect("plus", "minus")).alias("modified_lines"),
    )


def version_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone fragments of every version: the repeated line with the four lines behind it."""
    base = repeated_lines(spark, sf_dir).select(
        *SET_KEYS, "fragment_index", "file_id", "file_path", F.explode(F.sequence(F.col("start_line"), F.col("start_line") + 4)).alias("i")
    )
    lines = version_lines(spark, sf_dir).select("file_id", "k", "i", "line_no")
    return (
        base.join(lines, ["file_id", "i"])
        .groupBy(*SET_KEYS, "fragment_index", "file_path", "k")
        .agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
        .select(
            "project", F.concat(F.lit("v"), F.col("k")).alias("sha"), "language", "clone_id", "fragment_index",
            F.col("clone_id").alias("set_order"), "file_path", "start_line", "end_line",
        )
    )


# --- runs, listings and containers ----------------------------------------------------------


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair-file names with size and rows, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('acme.repo', o_custkey % 40) AS project",
        "concat('repo', o_custkey % 40, '_',"
        " element_at(array('normal','TKS12','RNR05','RNR50'), CAST(o_orderkey % 4 AS INT) + 1), '_', 30 + o_orderkey % 3 * 10, '_',"
        " CASE WHEN o_orderkey % 2 = 0 THEN 'filtered' ELSE 'nofilter' END, '_',"
        " CASE WHEN o_orderkey % 5 = 0 THEN 'clonepair' ELSE 'cloneset' END, '_',"
        " element_at(array('merge','tag','freq20'), CAST(o_orderkey % 3 AS INT) + 1), '_',"
        " CASE WHEN o_orderkey % 13 = 0 THEN 'sd7_' ELSE '' END, date_format(o_orderdate, 'yyyyMMdd'),"
        " CASE WHEN o_orderkey % 7 = 0 THEN '_mac9' ELSE '' END, '_',"
        f" element_at({LANGUAGES}, CAST(o_custkey % 4 AS INT) + 1),"
        " CASE WHEN o_orderkey % 17 = 0 THEN '_unknown' ELSE '' END, '.csv') AS name",
        "CAST(floor(o_totalprice) AS BIGINT) AS size", "o_orderkey % 19 AS n_rows",
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the repositories of the detector view, one per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('acme.repo', p_partkey % 20) AS project",
        "concat(element_at(array('', 'docker/', 'deploy/', 'src/', 'vendor/', 'docs/'), CAST(p_partkey % 6 AS INT) + 1),"
        " CASE WHEN p_partkey % 4 = 0 THEN concat('svc', p_partkey % 90, '/') ELSE '' END,"
        " element_at(array('docker-compose.yml', 'docker-compose.prod.yml', 'docker-compose.override.yml', 'Dockerfile',"
        " 'Dockerfile.dev', 'compose-dev.yaml', 'Dockerfile.txt', 'main.py', 'Docker-Compose.test.yml'),"
        " CAST(floor(p_partkey / 6) AS INT) % 9 + 1)) AS path",
        "p_size % 5 <> 0 AS has_code",
    )


def service_dockerfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container files of the services, one folder per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('acme.repo', p_partkey % 20) AS project",
        "concat('services/unit', CAST(floor(p_partkey / 20) AS BIGINT), CASE WHEN p_partkey % 3 = 0 THEN '/Dockerfile.dev' ELSE '/Dockerfile' END) AS path",
        "p_size % 5 <> 0 AS has_code",
    )


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with an image or an explicit build, one per customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('acme.repo', c_custkey % 20) AS project", "'acme' AS user", "concat('repo', c_custkey % 20) AS repo",
        "CASE WHEN c_custkey % 3 = 0 THEN concat('service-unit', CAST(floor(c_custkey / 20) AS BIGINT), 'x')"
        " ELSE concat('unit', CAST(floor(c_custkey / 20) AS BIGINT), '-service') END AS container_name",
        "CASE WHEN c_custkey % 4 <> 3 THEN concat('registry/acme-repo', c_custkey % 20, '-unit',"
        " CAST(floor(c_custkey / 20) AS BIGINT) + c_custkey % 2) END AS image",
        "CASE WHEN c_custkey % 5 = 0 THEN concat('services/unit', CAST(floor(c_custkey / 20) AS BIGINT), '/Dockerfile') END AS build_path",
        "c_custkey % 10 <> 5 AS is_local",
    )
