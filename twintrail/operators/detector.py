"""Service detection over tables of file listings, containers and container files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twintrail.constants import CONFIDENCE
from twintrail.functions import names


def best_compose_file(listing: DataFrame) -> DataFrame:
    """Compose file to analyse per project: best folder group, then name order, then shortest.

    ``listing``: project, path. A folder group without an acceptable name is passed over.
    """
    ranked = (
        listing.filter(names.is_compose_file("path"))
        .withColumn("code", names.compose_path_code("path"))
        .withColumn("rank", names.compose_name_rank("path"))
        .filter(F.col("code").isNotNull() & F.col("rank").isNotNull())
    )
    # The best file is a minimum: it combines inside each task before the shuffle.
    return ranked.groupBy("project").agg(
        F.min(F.struct("code", "rank", F.length("path").alias("length"), "path"))["path"].alias("compose_file")
    )


def dockerfiles(listing: DataFrame) -> DataFrame:
    return listing.filter(names.is_dockerfile("path"))


def shortest_siblings(files: DataFrame) -> DataFrame:
    """One container file per folder: the shortest name."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return (
        files.withColumn("folder", folder).groupBy("project", "folder")
        .agg(F.min(F.struct(F.length("path").alias("l"), "path"))["path"].alias("path"))
    )


def detect_services(containers: DataFrame, files: DataFrame, confidence: int = CONFIDENCE["name_matched"]) -> DataFrame:
    """Containers that are services of the project, with how sure the match is.

    ``containers``: project, user, repo, container_name, image, build_path, is_local.
    ``files``: project, path, has_code. An explicit build decides first; then a single file
    whose folder holds a candidate name, image names before container names and longer names
    before shorter ones. Each file serves one container: the one with the longest name.
    """
    explicit = (F.col("build_path").isNotNull()) & F.col("is_local")
    known = files.select("project", F.col("path").alias("build_path"), "has_code", F.lit(True).alias("found"))
    built = (
        containers.filter(explicit)
        .join(known, ["project", "build_path"], "left")
        .withColumn(
            "confidence",
            F.when(F.col("found").isNull(), CONFIDENCE["build_unverified"])
            .when(F.col("has_code"), CONFIDENCE["build_verified"]),
        )
        .filter(F.col("confidence").isNotNull())
        .select("project", "container_name", F.col("build_path").alias("dockerfile"), "confidence")
    )
    taken = built.filter(F.col("confidence") == CONFIDENCE["build_verified"]).select(
        "project", F.col("dockerfile").alias("path")
    )
    free = files.join(taken, ["project", "path"], "left_anti")
    kept = shortest_siblings(free).join(free, ["project", "path"])
    candidates = containers.filter(~explicit & F.col("image").isNotNull()).select(
        "project", "container_name", F.length("image").alias("size"),
        F.explode(
            F.concat(
                F.transform(
                    names.names_from_image("image", "user", "repo"),
                    lambda n: F.struct(F.lit(CONFIDENCE["image_matched"]).alias("c"), n.alias("name")),
                ),
                F.transform(
                    names.names_from_container("container_name"),
                    lambda n: F.struct(F.lit(CONFIDENCE["name_matched"]).alias("c"), n.alias("name")),
                ),
            )
        ).alias("n"),
    ).select("project", "container_name", "size", "n.c", "n.name")
    # A name may sit anywhere inside the folder text: all substrings of a folder as long as
    # some candidate of the project turn the containment test into an equi-join.
    lengths = candidates.groupBy("project").agg(F.collect_set(F.length("name")).alias("lengths"))
    folder = F.lower("folder")
    places = F.sequence(F.lit(1), F.length(folder) - F.col("len") + 1)
    grams = (
        kept.join(lengths, "project").withColumn("len", F.explode("lengths"))
        .filter((F.col("len") > 0) & (F.length(folder) >= F.col("len")))
        .withColumn("name", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(folder, i, F.col("len"))))))
        .select("project", "name", "path", "has_code")
    )
    single = (
        candidates.join(grams, ["project", "name"])
        .groupBy("project", "container_name", "size", "c", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.bool_and("has_code").alias("has_code"))
        .filter((F.col("n") == 1) & F.col("has_code"))
    )
    first = single.groupBy("project", "container_name", "size").agg(
        F.min(F.struct("c", (-F.length("name")).alias("l"), "name", "path")).alias("m")
    )
    winner = W.partitionBy("project", "m.path").orderBy(F.col("size").desc(), "container_name")
    matched = (
        first.withColumn("r", F.row_number().over(winner)).filter("r = 1")
        .select("project", "container_name", F.col("m.path").alias("dockerfile"), F.col("m.c").alias("confidence"))
    )
    return built.unionByName(matched).filter(F.col("confidence") <= confidence)


def weighted_errors(chunks: DataFrame, *columns: str) -> DataFrame:
    """Mean of chunk values weighted by the commits of the chunk; nothing is expanded."""
    weight = F.col("to_n") - F.col("from_n") + 1
    return chunks.agg(
        F.sum(weight).cast("bigint").alias("commits"),
        *[F.bround(F.sum(weight * F.col(c)) / F.sum(weight), 6).alias(c) for c in columns],
    )


def language_extensions(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Distinct file extensions per language, optionally limited to target languages."""
    ext = F.regexp_extract("file_path", r"[^/]\.([^./]+)$", 1)
    rows = files if languages is None else files.filter(F.col("language").isin(languages))
    return (
        rows.select("language", ext.alias("ext")).filter(F.col("ext") != "").distinct()
        .groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("ext")), ",").alias("extensions"), F.count(F.lit(1)).alias("n"))
    )
