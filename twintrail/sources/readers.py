"""Readers for the exchange files: fragments, pairs, snapshots, services, history, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintrail import constants as C
from twintrail import schemas as S
from twintrail.functions import commits, labels, paths
from twintrail.functions.numbers import truthy_count
from twintrail.operators import ranks
from twintrail.operators.pairs import PAIR_SIDES, clone_pairs
from twintrail.session import staged
from twintrail.sources.text_rows import SAMPLE_LINES, separators


def detect_separator(spark: SparkSession, path: str) -> str:
    """';' or ',': by the header, else by the first lines; see text_rows.separators."""
    first = [(i, r[0]) for i, r in enumerate(spark.read.text(path).take(SAMPLE_LINES))]
    told = separators(spark.createDataFrame(first, "line_no int, line string"), []).first() if first else None
    return told.sep if told else ","


def raw_fragments(spark: SparkSession, path: str, project: str, language: str, sep: str | None = None) -> DataFrame:
    """Raw clone fragments; a number that is none stops the job. Blank clone ids are skipped."""
    sep = sep or detect_separator(spark, path)
    reader = spark.read.schema(S.RAW_FRAGMENT_TEXT).option("header", True).option("sep", sep).option("mode", "FAILFAST")
    # With ';' the history column is unquoted JSON, so quotes are plain text there.
    reader = reader.option("quote", "") if sep == ";" else reader.option("escape", '"')
    return reader.csv(path).filter(F.trim(F.coalesce("clone_id", F.lit(""))) != "").select(
        F.lit(project).alias("project"), F.lit(language).alias("language"),
        "clone_id", F.col("index").alias("fragment_index"), "file_path", "start_line", "end_line",
        "start_column", "end_column", commits.history("modification").alias("modification"),
    )


def enriched_fragments(spark: SparkSession, path: str, project: str, language: str, lenient: bool = False) -> DataFrame:
    """Enriched fragments; missing services read '' and missing commit lists read empty."""
    mode = "PERMISSIVE" if lenient else "FAILFAST"
    rows = (
        spark.read.schema(S.ENRICHED_TEXT).option("header", True).option("escape", '"').option("mode", mode).csv(path)
        .withColumn("service", F.coalesce("service", F.lit("")))
        .withColumn("modified_commits", commits.parse_commits("modified_commits"))
        .withColumn("project", F.lit(project)).withColumn("language", F.lit(language))
    )
    return rows.withColumn("file_type", F.coalesce("file_type", F.lit("unknown"))) if lenient else rows


def back_fill_comodification(pairs: DataFrame) -> DataFrame:
    """Commit list, count and flag for files written before these columns existed."""
    have = set(pairs.columns)
    listed = F.col("comodified_commits") if "comodified_commits" in have else F.lit(None).cast("string")
    flag = truthy_count("comodified") if "comodified" in have else F.lit(0)
    count = F.col("comodification_count").try_cast("bigint") if "comodification_count" in have else F.lit(None).cast("bigint")
    out = pairs.withColumn("_flag", flag).withColumn("_count", F.coalesce(count, F.col("_flag").cast("bigint")))
    return out.withColumns(
        {
            "comodified_commits": F.coalesce(listed, F.lit("[]")),
            "comodification_count": F.col("_count"),
            "comodified": F.col("_flag") if "comodified" in have else (F.col("_count") > 0).cast("int"),
        }
    ).drop("_flag", "_count")


def tidy_pairs(pairs: DataFrame) -> DataFrame:
    """Typed pair rows: named unknown services, repaired relation, both file ids present."""
    rows = back_fill_comodification(pairs)
    # A column an old file lacks reads NULL; services then read 'unknown'.
    rows = rows.withColumns(
        {
            c: (F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t))
            for c, t in S.PAIR_COLUMNS.items() if c != "comodified"
        }
    )
    rows = rows.withColumn("service_x", labels.service_or_unknown("service_x")).withColumn(
        "service_y", labels.service_or_unknown("service_y")
    )
    repaired = F.when(F.col("service_x") == F.col("service_y"), "intra").otherwise("inter")
    return rows.withColumn("relation", F.coalesce(F.nullif("relation", F.lit("")), repaired)).na.drop(
        subset=["file_id_x", "file_id_y"]
    )


def clone_pair_files(spark: SparkSession, sources: list[tuple[str, str]], project: str, language: str) -> DataFrame:
    """Pair files of several detection methods, each tagged with its method, under one schema.

    Columns are matched by header name, so older layouts line up with newer ones.
    """
    frames = [(spark.read.option("header", True).option("escape", '"').csv(path), method) for path, method in sources]
    return tagged_pairs(frames).withColumn("project", F.lit(project)).withColumn("language", F.lit(language))


def tagged_pairs(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """Pair rows of text columns, each frame tagged with its method, under one schema."""
    tagged = [rows.withColumn("detection_method", F.lit(method)) for rows, method in frames]
    return tidy_pairs(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged))


def snapshot(spark: SparkSession, path: str, project: str, sha: str, language: str) -> DataFrame:
    """One detection snapshot; a document without a file list stops the job."""
    rows = spark.read.schema(S.SNAPSHOT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col("file_data").isNull(), F.raise_error(F.lit("file_data is not a list"))).otherwise(F.col("file_data"))
    return rows.withColumn("file_data", checked).select(
        F.lit(project).alias("project"), F.lit(sha).alias("sha"), F.lit(language).alias("language"), "file_data", "clone_sets"
    )


def snapshot_files(snapshots: DataFrame) -> DataFrame:
    keys = ["project", "sha", "language"]
    return snapshots.select(*keys, F.explode("file_data").alias("f")).select(*keys, "f.*")


def snapshot_fragments(snapshots: DataFrame) -> DataFrame:
    """Fragments with their set's place in the list, their index and their path."""
    keys = ["project", "sha", "language"]
    sets = snapshots.select(*keys, F.posexplode("clone_sets").alias("set_order", "s"))
    rows = sets.select(
        *keys, "set_order", F.col("s.clone_id").cast("string").alias("clone_id"), F.col("s.token_count").alias("token_count"),
        F.posexplode("s.fragments").alias("fragment_index", "f"),
    ).select(*keys, "set_order", "clone_id", "token_count", "fragment_index", "f.*")
    files = snapshot_files(snapshots).select(*keys, "file_id", "file_path")
    return rows.join(files, [*keys, "file_id"])


def snapshot_pairs(snapshots: DataFrame, services: DataFrame) -> DataFrame:
    """Pair rows straight from a snapshot; ``services``: project, file_path, service.

    Documents are parsed once and the fragments looked up once, for they are read by both sides of the pairs.
    """
    rows = staged(
        snapshot_fragments(staged(snapshots)).join(services, ["project", "file_path"], "left")
        .withColumn("service", F.coalesce("service", F.lit("")))
        .withColumn("file_type", paths.file_type("file_path"))
        .withColumn("modified_commits", F.array().cast("array<string>"))
        .select(*C.FRAGMENT_KEYS, *PAIR_SIDES, "modified_commits", "token_count")
    )
    tokens = rows.select("project", "language", "clone_id", "token_count").distinct()
    return clone_pairs(rows, tokens)


def service_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SERVICES).option("multiLine", True).json(path).withColumn("project", paths.project_from_url("URL"))


def service_contexts(document: DataFrame) -> DataFrame:
    """Contexts of a service document, the older per-language wrapper merged in."""
    current = document.select("project", F.explode("services").alias("context", "names"))
    wrapped = document.select("project", F.explode("languages").alias("l", "contexts")).select(
        "project", F.explode("contexts").alias("context", "names")
    )
    return current.unionByName(wrapped).select("project", "context", F.explode("names").alias("service")).distinct()


def language_stats(document: DataFrame, language: str | None = None) -> DataFrame:
    """Per-language statistics; language names match without regard to case."""
    rows = document.select("project", F.explode("language_stats").alias("language", "stats"))
    return rows if language is None else rows.filter(F.lower("language") == language.lower())


def service_totals(stats: DataFrame) -> DataFrame:
    return stats.select("project", "language", F.explode("stats.services").alias("service", "v")).select(
        "project", "language", "service", F.col("v.file_count").alias("file_count"), F.col("v.total_loc").alias("total_loc")
    )


def service_ranges(stats: DataFrame) -> DataFrame:
    """File-id ranges with the position they are listed at: that of the service, then that of the range."""
    ranges = stats.select("project", "language", F.posexplode("stats.file_ranges").alias("n", "service", "r"))
    return ranges.select("project", "language", "service", "n", F.posexplode("r").alias("i", "range")).select(
        "project", "language", "service", F.struct("n", "i").alias("ordinal"),
        F.col("range")[0].alias("range_start"), F.col("range")[1].alias("range_end"),
    )


def first_present(candidates: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first source, in order of priority, that has the key."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(candidates)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = union.groupBy(*keys).agg(F.min("_source").alias("_source"))
    return union.join(best, [*keys, "_source"], "left_semi").drop("_source")


def detected_contexts(detections: DataFrame, which: str = "latest") -> DataFrame:
    """Contexts of detected services: the build context, else the folder of the container file.

    ``detections``: project, chunk_no, service, context, dockerfile; latest, first or all chunks.
    """
    rows = detections
    if which != "all":
        pick = F.max if which == "latest" else F.min
        chosen = detections.groupBy("project").agg(pick("chunk_no").alias("chunk_no"))
        rows = detections.join(chosen, ["project", "chunk_no"], "left_semi")
    folder = F.nullif(F.regexp_extract("dockerfile", "^(.*)/[^/]+$", 1), F.lit(""))
    return rows.select(
        "project", "service", F.coalesce(F.nullif("context", F.lit("")), folder).alias("context")
    ).filter(F.col("context").isNotNull()).distinct()


def selection(spark: SparkSession, path: str) -> DataFrame:
    """Selected projects: one row per project, language, context and service."""
    return selected(spark.read.schema(S.DATASET).option("multiLine", True).json(path))


def selected(rows: DataFrame) -> DataFrame:
    return (
        rows.select(paths.project_from_url("URL").alias("project"), "URL", F.explode("languages").alias("language", "c"))
        .select("project", "URL", "language", F.explode("c").alias("context", "names"))
        .select("project", "URL", "language", "context", F.explode("names").alias("service"))
    )


def hunks(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Hunk files; both commits stand in the file name."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.schema(S.HUNK).option("multiLine", True).json(path).select(
        F.lit(project).alias("project"),
        F.regexp_extract(name, r"^([^-]+)-([^.]+)\.json$", 1).alias("child_sha"),
        F.regexp_extract(name, r"^([^-]+)-([^.]+)\.json$", 2).alias("parent_sha"),
        "*",
    )


def transition_files(spark: SparkSession, path: str, project: str, language: str) -> DataFrame:
    """Transition files: one row per child fragment with its optional parent."""
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return spark.read.schema(S.TRANSITION).option("multiLine", True).json(path).select(
        F.lit(project).alias("project"), F.lit(language).alias("language"),
        F.regexp_extract(folder, "^([^-]+)-(.+)$", 1).alias("parent_sha"),
        F.regexp_extract(folder, "^([^-]+)-(.+)$", 2).alias("child_sha"),
        F.explode("fragments").alias("f"),
    ).select(
        "project", "language", "child_sha", "parent_sha", F.col("f.type").alias("type"),
        F.col("f.child.clone_id").cast("string").alias("clone_id"), F.col("f.child.index").alias("fragment_index"),
        F.col("f.child.file_path").alias("path"),
        F.col("f.parent.clone_id").cast("string").alias("parent_clone_id"), F.col("f.parent.index").alias("parent_index"),
    )


def run_catalogue(files: DataFrame) -> DataFrame:
    """Runs described by pair-file names: project, name, size and rows of each file.

    ``files``: project, name, size, n_rows. Unknown-side files, other names and files
    without rows are left out.
    """
    split = files.filter(~F.col("name").endswith("_unknown.csv") & F.col("name").endswith(".csv") & (F.col("n_rows") > 0))
    stem = F.regexp_replace("name", r"\.csv$", "")
    language = F.element_at(F.split(stem, "_"), -1)
    run = labels.parse_run_name(F.regexp_replace(stem, "_[^_]*$", ""))
    return (
        split.withColumn("language", language).withColumn("run", run).filter(F.col("run.date").isNotNull())
        .select("project", "language", "name", "size", "run.*", labels.run_label("language", "run").alias("label"))
    )


def pair_file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and data rows of the pair files below a folder, without reading columns."""
    meta = F.col("_metadata")
    return (
        spark.read.option("header", True).csv(path)
        .groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("size"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(
            F.element_at(F.split("path", "/"), -3).alias("project"), paths.base_name("path").alias("name"), "size", "n_rows"
        )
    )


def latest_run(catalogue: DataFrame) -> DataFrame:
    """Newest run per project-language; then filtered, set-wise and larger files first."""
    rank = F.struct(
        F.col("date").cast("bigint"), (F.col("filter") == "filtered").cast("int"),
        (F.col("comod") == "cloneset").cast("int"), "size", "name",
    )
    return catalogue.groupBy("project", F.lower("language").alias("language")).agg(F.max_by("name", rank).alias("name"))


def ordered_catalogue(catalogue: DataFrame) -> DataFrame:
    return catalogue.orderBy(*[F.col(c).desc() for c in ("size", "language", "date", "label")])


def placed_catalogue(catalogue: DataFrame) -> DataFrame:
    """All runs with their place among the runs of the project, largest first."""
    return ranks.placed(catalogue, ["project"], [(c, "desc") for c in ("size", "language", "date", "name")])


def catalogue_with_rest(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Projects with pair files first, then those only known from a service document."""
    keys = ["project", "language"]
    have = runs.select(*keys).distinct().withColumn("source", F.lit("pairs"))
    rest = documents.select(*keys).distinct().join(have, keys, "left_anti").withColumn("source", F.lit("services"))
    return have.unionByName(rest)


def project_names(*sources: DataFrame) -> DataFrame:
    """Projects named by any source."""
    return reduce(lambda a, b: a.union(b), [s.select("project") for s in sources]).distinct()


def project_urls(spark: SparkSession, path: str) -> DataFrame:
    return named_urls(spark.read.schema(S.DATASET).option("multiLine", True).json(path))


def named_urls(rows: DataFrame) -> DataFrame:
    return rows.select(paths.project_from_url("URL").alias("project"), "URL", F.map_keys("languages").alias("languages"))


def gold_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples, one JSON object per line; an empty file is an error."""
    rows = spark.read.schema(S.GOLD).json(path).filter(F.col("file_path").isNotNull())
    if rows.isEmpty():
        raise ValueError(f"no samples in {path}")
    return rows


def run_parameters(rows: DataFrame) -> DataFrame:
    """Analysis parameters with defaults for what a record leaves out."""
    def filled(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name) if name in rows.columns else F.lit(value).alias(name)

    return rows.select("project", *[filled(n, v) for n, v in C.DEFAULT_RUN_PARAMETERS.items()])


def read_run_parameters(spark: SparkSession, path: str) -> DataFrame:
    return run_parameters(spark.read.schema(S.RUN_PARAMETERS).json(path))


def target_languages(file_languages: DataFrame) -> DataFrame:
    """File-language rows of the supported languages."""
    return file_languages.filter(F.col("language").isin(C.TARGET_LANGUAGES))


