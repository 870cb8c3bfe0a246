"""Corpus reports: taxonomy shares, clone ratios, co-modification rates, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from twintrail.constants import PROJECT_KEYS, SET_KEYS
from twintrail.functions.numbers import ratio
from twintrail.functions.paths import is_test_path
from twintrail.operators import ranks
from twintrail.operators.clones import located_fragments
from twintrail.operators.intervals import merged_lines
from twintrail.operators.services import first_codebase


def _clipped(located: DataFrame, files: DataFrame) -> DataFrame:
    """Fragments with their line range cut to the length of the file; unknown files fall out."""
    return located.join(files.select(*PROJECT_KEYS, "file_path", "loc"), [*PROJECT_KEYS, "file_path"]).select(
        *PROJECT_KEYS, "category", "file_path", "loc",
        F.greatest("start_line", F.lit(1)).alias("start_line"), F.least("end_line", "loc").alias("end_line"),
    )


def touched_clone_ratio(located: DataFrame, files: DataFrame) -> DataFrame:
    """Cloned share of the files a category touches, per category and overall.

    The overall row comes from the union over categories, so each fragment counts for its
    category and for 'overall' before the intervals are merged.
    """
    rows = _clipped(located, files).withColumn("category", F.explode(F.array("category", F.lit("overall"))))
    keys = [*PROJECT_KEYS, "category", "file_path"]
    # A range past the end of the file covers nothing but still touches the file.
    lines = merged_lines(rows, [*keys, "loc"])
    return (
        lines.groupBy(*PROJECT_KEYS, "category")
        .agg(F.sum("lines").cast("bigint").alias("clone_lines"), F.sum("loc").cast("bigint").alias("file_lines"))
        .withColumn("clone_ratio", ratio("clone_lines", "file_lines"))
    )


def codebase_clone_ratio(located: DataFrame, files: DataFrame, codebases: DataFrame) -> DataFrame:
    """Cloned share of all files in the code bases, per category, for every category.

    Test files count for testing and mixed categories, other files for production and mixed.
    """
    kind = F.when(is_test_path("file_path"), "testing").otherwise("production")
    placed = first_codebase(files, codebases).filter(F.col("codebase").isNotNull())
    slots = F.explode(
        F.array(*[F.concat_ws("-", F.lit(span), k) for span in ("within", "inter") for k in (kind, F.lit("mixed"))])
    )
    totals = (
        placed.select(*PROJECT_KEYS, "loc", slots.alias("category"))
        .groupBy(*PROJECT_KEYS, "category").agg(F.sum("loc").cast("bigint").alias("file_lines"))
    )
    covered = (
        merged_lines(_clipped(located, files), [*PROJECT_KEYS, "category", "file_path"])
        .groupBy(*PROJECT_KEYS, "category").agg(F.sum("lines").cast("bigint").alias("clone_lines"))
    )
    return totals.join(covered, [*PROJECT_KEYS, "category"], "left").select(
        *PROJECT_KEYS, "category", F.coalesce("clone_lines", F.lit(0)).cast("bigint").alias("clone_lines"), "file_lines",
        ratio("clone_lines", "file_lines").alias("clone_ratio"),
    )


def comodified_set_flags(located: DataFrame) -> DataFrame:
    """Located clone sets with whether some commit modified two of their entries."""
    commits = (
        located.select(*SET_KEYS, F.explode("modification").alias("m"))
        .filter(F.col("m.type") == "modified")
        .groupBy(*SET_KEYS, F.col("m.commit").alias("commit")).agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= 2)
        .select(*SET_KEYS).distinct().withColumn("_hit", F.lit(True))
    )
    sets = located.select(*SET_KEYS, "category").distinct()
    return sets.join(commits, SET_KEYS, "left").withColumn("comodified", F.coalesce("_hit", F.lit(False))).drop("_hit")


def comodification_rate(flags: DataFrame) -> DataFrame:
    """Sets, co-modified sets and their rate per category with an overall row."""
    return (
        flags.groupingSets(
            [[*(F.col(k) for k in PROJECT_KEYS), F.col("category")], [F.col(k) for k in PROJECT_KEYS]],
            *PROJECT_KEYS, "category",
        )
        .agg(
            F.count(F.lit(1)).alias("clone_sets"), F.count_if("comodified").alias("comod_sets"),
            F.grouping("category").alias("_g"),
        )
        .select(
            *PROJECT_KEYS, F.when(F.col("_g") == 1, "overall").otherwise(F.col("category")).alias("category"),
            "clone_sets", "comod_sets", ratio("comod_sets", "clone_sets").alias("rate"),
        )
    )


def summarize(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, population variance, median, minimum and maximum."""
    v = F.col(value)
    aggs = [
        F.count(v).alias("n"), F.bround(F.avg(v), 12).alias("mean"), F.bround(F.var_pop(v), 12).alias("variance"),
        F.bround(F.median(v), 12).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Five-number summary per group, exact and without putting a group in order."""
    points = ranks.quantiles(df, value, by, [0.0, 0.25, 0.5, 0.75, 1.0], "p")
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return points.join(sizes, by).select(
        *by, "n", *[F.bround(F.col("p")[i], 12).alias(name) for i, name in enumerate(("low", "q1", "median", "q3", "high"))]
    )


def corpus_report(declared: DataFrame, fragments: DataFrame, codebases: DataFrame) -> DataFrame:
    """Corpus totals and the project-languages that show each property, as one row.

    ``declared``: project, language of the selected data set. ``fragments`` carry
    ``modification``. Properties become flags per project-language before anything is counted.
    """
    modified = F.exists("modification", lambda m: m["type"] == "modified")
    frag = fragments.withColumn("modified", modified)
    sets = frag.groupBy(*SET_KEYS).agg(
        F.count(F.lit(1)).alias("fragments"), F.count_if("modified").alias("modified_fragments")
    )
    located = comodified_set_flags(located_fragments(fragments, codebases))
    inter = F.col("category").startswith("inter")
    joined = sets.join(located, SET_KEYS, "left").withColumn("is_mod", F.col("modified_fragments") > 0)

    def has(test: Column, name: str) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False)).alias(name)

    per_language = joined.groupBy(*PROJECT_KEYS).agg(
        F.sum("fragments").alias("fragments"), F.sum("modified_fragments").alias("modified_fragments"),
        F.count(F.lit(1)).alias("clone_sets"), F.count_if("is_mod").alias("modified_sets"),
        has(~inter, "within"), has(inter, "inter"),
        has(~inter & F.col("is_mod"), "within_modified"), has(inter & F.col("is_mod"), "inter_modified"),
        has(~inter & F.col("comodified"), "within_comodified"), has(inter & F.col("comodified"), "inter_comodified"),
    )
    flags = ["within", "inter", "within_modified", "inter_modified", "within_comodified", "inter_comodified"]
    all_rows = declared.select(*PROJECT_KEYS).distinct().join(per_language, PROJECT_KEYS, "left")
    total = all_rows.agg(
        F.count(F.lit(1)).alias("project_languages"),
        F.countDistinct("project").alias("projects"),
        F.count("clone_sets").alias("with_clones"),
        F.count_if(F.col("clone_sets").isNull()).alias("missing"),
        *[F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags],
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("fragments", "modified_fragments", "clone_sets", "modified_sets")
        ],
    )
    share = [ratio(f, "project_languages", 4).alias(f"{f}_share") for f in ["with_clones", *flags]]
    return total.select("*", *share)


def projects_per_language(declared: DataFrame) -> DataFrame:
    return declared.groupBy("language").agg(F.countDistinct("project").alias("projects"))


def select_projects(services: DataFrame) -> DataFrame:
    """Services of the languages that have at least two contexts in a project.

    ``services``: project, language, context, service.
    """
    wide = (
        services.groupBy(*PROJECT_KEYS).agg(F.countDistinct("context").alias("contexts")).filter(F.col("contexts") >= 2)
    )
    return services.join(wide, PROJECT_KEYS, "left_semi")


def classifier_report(samples: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 per category, macro F1 and accuracy.

    ``samples``: label, predicted. Confusion cells are counted once; the rest is arithmetic on
    at most sixteen cells.
    """
    cells = samples.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    kinds = ["test", "config", "data", "logic"]

    def cell(test: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint").alias(name)

    label, predicted = F.col("label"), F.col("predicted")
    one = cells.agg(
        *[cell((label == k) & (predicted == k), f"{k}_tp") for k in kinds],
        *[cell(label == k, f"{k}_actual") for k in kinds],
        *[cell(predicted == k, f"{k}_predicted") for k in kinds],
        cell(label == predicted, "hits"), cell(F.lit(True), "total"),
    )

    def scores(k: str) -> Column:
        precision, recall = ratio(f"{k}_tp", f"{k}_predicted", None), ratio(f"{k}_tp", f"{k}_actual", None)
        both = precision + recall
        f1 = F.when(both > 0, precision * recall * 2 / both).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(k).alias("category"), F.col(f"{k}_actual").alias("actual"), F.col(f"{k}_predicted").alias("predicted"),
            F.col(f"{k}_tp").alias("hits"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        )

    table = one.select("hits", "total", F.array(*[scores(k) for k in kinds]).alias("rows"))
    macro = reduce(lambda a, b: a + b, [F.col("rows")[i]["f1"] for i in range(len(kinds))]) / len(kinds)
    return (
        table.withColumn("macro_f1", macro).withColumn("accuracy", ratio("hits", "total", None))
        .select(F.explode("rows").alias("r"), "macro_f1", "accuracy")
        .select(
            "r.category", "r.actual", "r.predicted", "r.hits",
            *[F.bround(c, 6).alias(n) for c, n in (
                (F.col("r.precision"), "precision"), (F.col("r.recall"), "recall"), (F.col("r.f1"), "f1"),
                (F.col("macro_f1"), "macro_f1"), (F.col("accuracy"), "accuracy"),
            )],
        )
    )


def confusion_matrix(samples: DataFrame) -> DataFrame:
    kinds = ["test", "config", "data", "logic"]
    return samples.groupBy("label").pivot("predicted", kinds).agg(F.count(F.lit(1))).na.fill(0)


def merged_method_counts(stored: DataFrame) -> DataFrame:
    """Stored per-method count maps added up: kind, key, total. ``stored``: kind, counts map."""
    return (
        stored.select("kind", F.explode("counts").alias("key", "n"))
        .groupBy("kind", "key").agg(F.sum("n").cast("bigint").alias("total"))
    )


