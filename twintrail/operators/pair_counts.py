"""Counts over all clone pairs without a pair: fragments of a set that agree are counted together.

n fragments make n(n-1)/2 pairs among themselves, and n and m of two classes n*m. Where a count
looks at one side only, a fragment is the first side of as many pairs as fragments follow it
in its set; indices inside a set run from 0 without gaps. Every total is a sum over classes,
so a set of any size costs what its fragments cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail.constants import PROJECT_KEYS, SET_KEYS
from twintrail.functions import labels
from twintrail.functions.paths import base_name
from twintrail.operators.pairs import comodified_pairs, service_pair_totals, set_sizes, share_of
from twintrail.operators.ranks import running_total

TYPES = ("logic", "data", "test", "config")
#: Fragments of one set that are put in order together.
INDICES_PER_CHUNK = 65536


def among(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("bigint")


def _paired(fragments: DataFrame) -> DataFrame:
    """Fragments of sets that have a pair, with ``set_size``."""
    sizes = set_sizes(fragments).filter("fragments > 1").withColumnRenamed("fragments", "set_size")
    return fragments.join(sizes, SET_KEYS)


def set_counts(fragments: DataFrame) -> DataFrame:
    """Per clone set: pairs, pairs across and inside services, pairs by the type of their first side, services, mixed flag."""
    kind, index = F.col("file_type"), F.col("fragment_index")
    by_service = fragments.groupBy(*SET_KEYS, "service").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "test").alias("tests"),
        F.count_if(kind != "test").alias("others"),
        *[F.count_if(kind == t).alias(f"n_{t}") for t in TYPES],
        *[F.coalesce(F.sum(F.when(kind == t, index)), F.lit(0)).alias(f"i_{t}") for t in TYPES],
    )
    n, size = F.col("n"), F.col("set_size")
    sums = by_service.groupBy(*SET_KEYS).agg(
        F.sum(n).alias("set_size"),
        F.sum(F.when(F.col("service") != "", among(n)).otherwise(0)).alias("intra_pairs"),
        F.sum(F.when(F.col("service") == "", n).otherwise(0)).alias("nowhere"),
        F.array_sort(F.collect_set("service")).alias("services"),
        *[F.sum(c).alias(c) for c in ["tests", "others", *[f"{k}_{t}" for t in TYPES for k in "ni"]]],
    )
    nowhere = F.col("nowhere")
    open_pairs = nowhere * (size - nowhere) + among(nowhere)
    return sums.filter("set_size > 1").select(
        *SET_KEYS, "set_size", among(size).alias("pairs"), "intra_pairs",
        (among(size) - F.col("intra_pairs") - open_pairs).alias("inter_pairs"),
        *[(F.col(f"n_{t}") * (size - 1) - F.col(f"i_{t}")).alias(f"{t}_pairs") for t in TYPES],
        ((F.col("tests") > 0) & (F.col("others") > 0)).alias("is_mixed"), "services",
    )


def unique_pair_counts(fragments: DataFrame) -> DataFrame:
    """Pairs per set that differ in file, base name or lines of a side.

    Fragments that agree in these are one class. A class comes before another if its first
    fragment precedes the other's last one, and before itself if it has two; so all that is
    needed is, for each first fragment, how many classes have ended by then.
    """
    whole = [*SET_KEYS, "file_id", "name", "start_line", "end_line"]
    index = F.col("fragment_index")
    spans = _paired(fragments.withColumn("name", base_name("file_path"))).groupBy(*whole).agg(
        F.min(index).alias("first"), F.max(index).alias("last")
    )
    ends = F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("ends")), F.struct(F.col("last").alias("at"), F.lit(1).alias("ends")))
    events = spans.select(*SET_KEYS, F.explode(ends).alias("e")).select(*SET_KEYS, "e.*")
    # At one index an end counts before the beginning: there both are of the same, single fragment.
    ended = running_total(
        events, SET_KEYS, [F.col("at"), F.col("ends").desc()], F.floor(F.col("at") / INDICES_PER_CHUNK), F.col("ends").cast("bigint"), "ended"
    )
    begins = F.col("ends") == 0
    return ended.groupBy(*SET_KEYS).agg(
        (F.count_if(begins) * F.count_if(begins) - F.sum(F.when(begins, F.col("ended")).otherwise(0))).alias("pair_count")
    )


def cross_service_profile(fragments: DataFrame) -> DataFrame:
    """Per clone set: services, pairs, co-modified pairs, type counts, mixed flag, files, methods where there are any."""
    methods = ["methods"] if "detection_method" in fragments.columns else []
    files = fragments.select(*SET_KEYS, "file_path").distinct().groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("file_count"))
    comod = comodified_pairs(fragments).withColumnRenamed("pairs", "comodified_count")
    profile = (
        set_counts(fragments)
        .join(unique_pair_counts(fragments), SET_KEYS)
        .join(files, SET_KEYS)
        .join(comod, SET_KEYS, "left")
    )
    if methods:
        profile = profile.join(set_methods(fragments), SET_KEYS, "left")
    return profile.select(
        *SET_KEYS, F.col("pairs").alias("total_pair_count"), F.coalesce("comodified_count", F.lit(0).cast("bigint")).alias("comodified_count"),
        F.col("inter_pairs").alias("inter_service_pairs"), *[f"{t}_pairs" for t in TYPES], "is_mixed", "pair_count", "file_count", "services",
        F.size("services").cast("bigint").alias("service_count"), *methods,
    )


def set_methods(fragments: DataFrame) -> DataFrame:
    """Per clone set the detection methods of its pairs as they are stored, in order; a pair has that of its first side."""
    # The last fragment is first in no pair.
    first = _paired(fragments).filter((F.col("fragment_index") < F.col("set_size") - 1) & F.col("detection_method").isNotNull())
    return (
        first.select(*SET_KEYS, F.col("detection_method").alias("method")).distinct()
        .groupBy(*SET_KEYS).agg(F.array_sort(F.collect_list("method")).alias("methods"))
    )


def comodification_sums(fragments: DataFrame) -> DataFrame:
    """Per clone set the common commits summed over its pairs: each commit counts for each two fragments that have it."""
    commits = fragments.select(*SET_KEYS, F.explode(F.array_distinct("modified_commits")).alias("commit"))
    return (
        commits.groupBy(*SET_KEYS, "commit").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*SET_KEYS).agg(F.sum(among(F.col("n"))).alias("comod_count"))
    )


def set_code_types(fragments: DataFrame) -> DataFrame:
    """Code-type label and pairs of every clone set that has a pair."""
    kind = F.col("file_type")
    odd = ~F.coalesce(kind, F.lit("")).isin("", "nan", *TYPES)
    return (
        fragments.groupBy(*SET_KEYS)
        .agg(
            F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bool_or(kind == t), F.lit(False)).alias(f"has_{t}") for t in TYPES],
            F.bool_or(odd).alias("has_other"),
        )
        .filter("n > 1")
        .select(
            *SET_KEYS, labels.set_code_type("has_test", "has_data", "has_config", "has_logic", "has_other").alias("code_type"),
            among(F.col("n")).alias("pairs"),
        )
    )


def clone_options(fragments: DataFrame) -> DataFrame:
    """Option rows of the clone selector: span over known services, pairs, label, co-mod sum."""
    services = (
        fragments.filter(labels.known_service("service")).groupBy(*SET_KEYS).agg(F.array_sort(F.collect_set("service")).alias("services"))
    )
    return (
        set_code_types(fragments)
        .join(comodification_sums(fragments), SET_KEYS, "left")
        .join(services, SET_KEYS)
        .select(
            *SET_KEYS, F.size("services").cast("bigint").alias("service_count"), F.col("pairs").alias("pair_count"), "code_type",
            F.coalesce("comod_count", F.lit(0).cast("bigint")).alias("comod_count"), F.array_join("services", " ").alias("services"),
        )
    )


def service_options(fragments: DataFrame) -> DataFrame:
    """Clone sets and pairs each known service takes part in."""
    n, size = F.col("n"), F.col("set_size")
    return (
        _paired(fragments).filter(labels.known_service("service"))
        .groupBy(*SET_KEYS, "set_size", "service").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*PROJECT_KEYS, "service")
        .agg(F.count(F.lit(1)).alias("clone_sets"), F.sum(n * (size - n) + among(n)).cast("bigint").alias("pairs"))
    )


def shared_clone_matrix(fragments: DataFrame) -> DataFrame:
    """Service by service: clone sets holding both, and pairs between the two."""
    totals = service_pair_totals(_paired(fragments))
    there = totals.select(*PROJECT_KEYS, F.col("service_lo").alias("service_a"), F.col("service_hi").alias("service_b"), "shared_sets", F.col("pairs").alias("shared_pairs"))
    back = there.filter("service_a <> service_b").select(
        *PROJECT_KEYS, F.col("service_b").alias("service_a"), F.col("service_a").alias("service_b"), "shared_sets", "shared_pairs"
    )
    return there.unionByName(back)


def network_edges(fragments: DataFrame) -> DataFrame:
    """Weighted undirected edges between distinct known services."""
    return service_pair_totals(fragments).filter("service_lo <> service_hi").select(
        *PROJECT_KEYS, "service_lo", "service_hi", F.col("pairs").alias("weight")
    )


def dataset_overview(fragments: DataFrame) -> DataFrame:
    """Headline counts of a project-language."""
    main = set_counts(fragments).groupBy(*PROJECT_KEYS).agg(
        F.sum("pairs").alias("clone_pairs"), F.count(F.lit(1)).alias("clone_sets"),
        F.sum("intra_pairs").alias("intra_pairs"), F.sum("inter_pairs").alias("inter_pairs"),
    )
    comod = comodified_pairs(fragments).groupBy(*PROJECT_KEYS).agg(F.sum("pairs").alias("comod_pairs"))
    paired = _paired(fragments)

    def distinct(column, name):
        return paired.select(*PROJECT_KEYS, column).filter(F.col(column) != "").distinct().groupBy(*PROJECT_KEYS).agg(F.count(F.lit(1)).alias(name))

    zero = F.lit(0).cast("bigint")
    joined = main.join(comod, PROJECT_KEYS, "left").join(distinct("service", "services"), PROJECT_KEYS, "left").join(distinct("file_path", "files"), PROJECT_KEYS, "left")
    return joined.select(
        *PROJECT_KEYS, "clone_pairs", "clone_sets", "intra_pairs", "inter_pairs",
        *[F.coalesce(c, zero).alias(c) for c in ("comod_pairs", "services", "files")],
    ).withColumn("comod_rate", F.bround(F.col("comod_pairs") / F.col("clone_pairs"), 6))


def touch_counts(fragments: DataFrame, column: str) -> DataFrame:
    """How often each service or file is a side of a pair, with its clone sets."""
    return (
        _paired(fragments)
        .groupBy(*SET_KEYS, column).agg(F.sum(F.col("set_size") - 1).alias("n"))
        .groupBy(column)
        .agg(F.sum("n").cast("bigint").alias("pairs"), F.count(F.lit(1)).alias("clone_sets"))
    )


def pair_type_breakdown(fragments: DataFrame) -> DataFrame:
    """Pairs by the label of their two types; sets with the same types are folded together first."""
    counts = fragments.groupBy(*SET_KEYS, F.lower(F.coalesce("file_type", F.lit(""))).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    profile = F.array_sort(F.collect_list(F.struct("t", "n")))
    folded = counts.groupBy(*SET_KEYS).agg(profile.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("sets"))
    both = folded.select("sets", "p", F.explode("p").alias("a")).select("sets", "a", F.explode("p").alias("b")).filter("a.t <= b.t")
    n = F.when(F.col("a.t") == F.col("b.t"), among(F.col("a.n"))).otherwise(F.col("a.n") * F.col("b.n"))
    return (
        both.groupBy(labels.pair_code_type("a.t", "b.t").alias("code_type"))
        .agg(F.sum(n * F.col("sets")).alias("pairs")).filter("pairs > 0")
    )


def method_breakdown(fragments: DataFrame) -> DataFrame:
    """Pairs by the detection method of their first side."""
    later = F.col("set_size") - 1 - F.col("fragment_index")
    return (
        _paired(fragments).groupBy(labels.detection_label("detection_method").alias("method"))
        .agg(F.sum(later).cast("bigint").alias("pairs")).filter("pairs > 0")
    )


def scope_selectivity(fragments: DataFrame, scope: str) -> DataFrame:
    """Pairs within or across services beside all pairs, with their share."""
    kept = {"within": "intra_pairs", "cross": "inter_pairs"}[scope]
    zero = F.lit(0).cast("bigint")
    return share_of(set_counts(fragments).agg(F.coalesce(F.sum(kept), zero).alias("kept"), F.coalesce(F.sum("pairs"), zero).alias("total")))


def clone_files(fragments: DataFrame) -> DataFrame:
    """Distinct files that are a side of any pair."""
    return _paired(fragments).select(*PROJECT_KEYS, "file_path").distinct()
