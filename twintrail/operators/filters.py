"""Filters over pairs and metric tables. Row filters first, set-level filters after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail import constants as C
from twintrail.constants import SET_KEYS
from twintrail.functions import labels
from twintrail.functions.numbers import threshold, truthy_count
from twintrail.operators import ranks
from twintrail.operators.pairs import set_code_types, share_of
from twintrail.session import staged

COUNT_COLUMNS = ["coModificationCount", "comodification_count", "comodified_count"]
COMOD_MODES = ["any", "none", "once", "repeated", "custom"]
MODE_SYNONYMS = {"yes": "any", "true": "any", "1": "any", "no": "none", "false": "none", "0": "none"}


# --- pairs ---------------------------------------------------------------------------


def known_pairs(pairs):
    """Pairs of two known services; of a view of pairs not made yet, a view."""
    if not isinstance(pairs, DataFrame):
        return pairs.known()
    return pairs.filter(labels.known_service("service_x") & labels.known_service("service_y"))


def comod_count(pairs: DataFrame) -> Column:
    """Co-modification count from the first count column there is, else from the flag."""
    for column in COUNT_COLUMNS:
        if column in pairs.columns:
            return F.coalesce(F.col(column).try_cast("bigint"), F.lit(0))
    return truthy_count("comodified") if "comodified" in pairs.columns else F.lit(0)


def by_comodification(pairs, mode: str = "all", minimum=None):
    """Pairs by the commits their sides have in common; of a view of pairs not made yet, a view.

    A fragment with fewer commits than a pair needs in common is in no such pair.
    """
    mode = MODE_SYNONYMS.get(str(mode), mode)
    least = threshold(minimum, 0)
    if not isinstance(pairs, DataFrame):
        needed = {"any": 1, "once": 1, "repeated": 2, "custom": least}.get(mode)
        return pairs.of_commits(needed or 0, lambda p: by_comodification(p, mode, minimum))
    count = comod_count(pairs)
    tests = {"any": count >= 1, "none": count == 0, "once": count == 1, "repeated": count >= 2}
    if mode == "custom" and least is not None:
        return pairs.filter(count >= least)
    return pairs.filter(tests[mode]) if mode in tests else pairs


def by_scope(pairs: DataFrame, scope: str = "all") -> DataFrame:
    relation = {"within": "intra", "cross": "inter"}.get(scope)
    return pairs.filter(F.col("relation") == relation) if relation else pairs


def by_resolution(pairs: DataFrame, scope: str = "all") -> DataFrame:
    both = labels.known_service("service_x") & labels.known_service("service_y")
    return {"resolved": pairs.filter(both), "unknown": pairs.filter(~both)}.get(scope, pairs)


def by_service_spread(pairs: DataFrame, spread="all", minimum=None) -> DataFrame:
    """Pairs of sets that reach a number of known services within the pairs given."""
    if spread in (None, "all"):
        return pairs
    least = threshold(minimum if spread == "custom" else spread, 1)
    if least is None:
        return pairs
    sides = F.explode(F.array_distinct(F.array("service_x", "service_y"))).alias("service")
    wide = (
        pairs.select(*SET_KEYS, sides).filter(labels.known_service("service")).distinct()
        .groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    )
    return pairs.join(wide, SET_KEYS, "left_semi")


def by_clone_id_text(pairs: DataFrame, text) -> DataFrame:
    """Digits of a free text as the clone id; no digits or 'all' keeps everything."""
    digits = "".join(ch for ch in str(text or "") if ch.isdigit())
    if not digits or text == "all":
        return pairs
    return pairs.filter(F.col("clone_id").try_cast("bigint") == int(digits))


def by_clone_id(pairs: DataFrame, clone_id) -> DataFrame:
    return pairs if clone_id in (None, "", "all") else pairs.filter(F.col("clone_id") == str(clone_id))


def by_set_code_type(pairs: DataFrame, code_type: str = "all") -> DataFrame:
    """Pairs of the clone sets that carry the label within the pairs given."""
    if code_type not in C.CODE_TYPES:
        return pairs
    chosen = set_code_types(pairs).filter(F.col("code_type") == code_type)
    return pairs.join(chosen, SET_KEYS, "left_semi")


def by_pair_code_type(pairs: DataFrame, code_type: str = "all") -> DataFrame:
    if code_type not in C.CODE_TYPES:
        return pairs
    return pairs.filter(labels.pair_code_type("file_type_x", "file_type_y") == code_type)


def by_focus_service(pairs: DataFrame, focus: str | None, related: str | None = None) -> DataFrame:
    """Pairs touching a service; with a related service, pairs between the two in any order."""
    if not focus:
        return pairs
    x, y = F.col("service_x"), F.col("service_y")
    if related:
        return pairs.filter(((x == focus) & (y == related)) | ((x == related) & (y == focus)))
    return pairs.filter((x == focus) | (y == focus))


def by_method(pairs: DataFrame, method: str = "all") -> DataFrame:
    """Detection method; 'import' and 'no-import' name the same method."""
    if method in (None, "all"):
        return pairs
    column = next((c for c in ("detection_method", "clone_type") if c in pairs.columns), None)
    if column is None:
        return pairs
    names = ["import", "no-import"] if method in ("import", "no-import") else [method]
    return pairs.filter(F.col(column).isin(names))


def by_file(pairs: DataFrame, path: str) -> DataFrame:
    return pairs.filter((F.col("file_path_x") == path) | (F.col("file_path_y") == path))


def at_coordinate(pairs: DataFrame, file_id_y: int, file_id_x: int) -> DataFrame:
    return pairs.filter((F.col("file_id_y") == file_id_y) & (F.col("file_id_x") == file_id_x))


def filter_pairs(
    pairs, *, method="all", comodified="all", comod_min=None, scope="all", clone_id=None,
    spread="all", spread_min=None, code_type="all",
) -> DataFrame:
    """Composed pair filter. Spread and code type look at what the row filters left over;
    a spread is not applied to a within-service view.

    ``pairs`` is a pair table, or a view of pairs not made yet: its fragments meet what they can
    of the conditions, and only the pairs that are kept are made.
    """
    if not isinstance(pairs, DataFrame):
        if scope != "cross" or method not in (None, "all") or MODE_SYNONYMS.get(str(comodified), comodified) in COMOD_MODES:
            # What a set keeps then depends on its pairs.
            return filter_pairs(
                staged(pairs.pairs()), method=method, comodified=comodified, comod_min=comod_min, scope=scope, clone_id=clone_id,
                spread=spread, spread_min=spread_min, code_type=code_type,
            )
        view = (pairs if clone_id in (None, "", "all") else pairs.clone_id(clone_id)).across()
        least = None if spread in (None, "all") else threshold(spread_min if spread == "custom" else spread, 1)
        view = view if least is None else view.spread(least)
        return (view.code_type(code_type) if code_type in C.CODE_TYPES else view).pairs()
    rows = by_method(known_pairs(pairs), method)
    rows = by_clone_id(by_scope(by_comodification(rows, comodified, comod_min), scope), clone_id)
    if scope != "within":
        rows = by_service_spread(rows, spread, spread_min)
    return by_set_code_type(rows, code_type)


def selectivity(pairs: DataFrame, condition: Column) -> DataFrame:
    """Kept and total pairs with the kept share in percent; a tiny share shows as '< 0.1%'."""
    return share_of(pairs.agg(F.count_if(condition).alias("kept"), F.count(F.lit(1)).alias("total")))


# --- metric tables ---------------------------------------------------------------------


def in_range(column: str, low=None, high=None) -> Column:
    """Closed range with open ends; a cell that is no number never passes a bound."""
    value = F.col(column).try_cast("double")
    test = F.lit(True)
    if low is not None:
        test = test & (value >= float(low))
    if high is not None:
        test = test & (value <= float(high))
    return test


def _ranges(df: DataFrame, ranges: dict | None) -> DataFrame:
    for column, (low, high) in (ranges or {}).items():
        if column in df.columns and (low is not None or high is not None):
            df = df.filter(in_range(column, low, high))
    return df


def _contains(column: str, text: str) -> Column:
    return F.lower(F.col(column)).contains(text.strip().lower())


def filter_clone_sets(
    table: DataFrame, *, preset: str | None = None, ranges: dict | None = None, file_types: list[str] | None = None,
    services: list[str] | None = None, clone_id_text: str | None = None, ordered: bool = True,
) -> DataFrame:
    """Clone-set table: preset, ranges, any-of file types and services, id text, default order."""
    if preset == "cross2":
        table = table.filter(in_range("service_count", 2))
    elif preset == "comod1":
        table = table.filter(in_range("comod_count", 1))
    elif preset == "top_inter_loc":
        # The quartile is one row.
        bound = ranks.quantiles(table, "cross_service_line_count", [], [0.75], "_q").select(F.col("_q")[0].alias("_bound"))
        table = (
            table.crossJoin(F.broadcast(bound))
            .filter(F.col("cross_service_line_count") >= F.col("_bound"))
            .drop("_bound")
        )
    table = _ranges(table, ranges)
    if file_types:
        wanted = F.array(*[F.lit(t.lower()) for t in file_types])
        table = table.filter(F.arrays_overlap(labels.tokens(F.lower("file_types")), wanted))
    if services:
        wanted = F.array(*[F.lit(s) for s in services])
        table = table.filter(F.arrays_overlap(labels.tokens("involved_services"), wanted))
    if clone_id_text and clone_id_text.strip():
        table = table.filter(_contains("clone_id", clone_id_text))
    return _ordered(table, ["comod_count", "service_count", "cross_service_line_count"]) if ordered else table


def filter_services(
    table: DataFrame, *, ranges: dict | None = None, name_text: str | None = None, ordered: bool = True
) -> DataFrame:
    table = _ranges(table, ranges)
    if name_text and name_text.strip():
        table = table.filter(_contains("service", name_text))
    return _ordered(table, ["clone_set_count", "inter_clone_set_count"]) if ordered else table


def filter_files(
    table: DataFrame, *, ranges: dict | None = None, file_type: str | None = None, services: list[str] | None = None,
    name_text: str | None = None, ordered: bool = True,
) -> DataFrame:
    table = _ranges(table, ranges)
    if file_type and file_type != "all":
        table = table.filter(F.lower("file_type") == file_type.lower())
    if services:
        table = table.filter(F.col("service").isin(services))
    if name_text and name_text.strip():
        table = table.filter(_contains("file_name", name_text))
    return _ordered(table, ["sharing_service_count", "cross_service_clone_set_count"]) if ordered else table


def _ordered(table: DataFrame, columns: list[str]) -> DataFrame:
    """Largest first by the columns that the table has; rows that agree in them by what names them."""
    names = [c for c in ("project", "language", "service", "file_path", "clone_id") if c in table.columns]
    return table.orderBy(*[F.col(c).desc_nulls_last() for c in columns if c in table.columns], *names)


def sets_touching(
    table: DataFrame, fragments: DataFrame, *, service: str | None = None, path: str | None = None,
    file_type: str | None = None,
) -> DataFrame:
    """Drill-down: clone sets with a fragment in the service, file or category."""
    rows = fragments
    for column, value in (("service", service), ("file_path", path), ("file_type", file_type)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return table.join(rows.select(*SET_KEYS).distinct(), SET_KEYS, "left_semi")


def by_language(table: DataFrame, language: str | None) -> DataFrame:
    return table if language in (None, "", "all") else table.filter(F.col("language") == language)


def known_ranges(ranges: DataFrame) -> DataFrame:
    return ranges.filter(labels.known_service("service"))


def column_bounds(table: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Observed (low, high) of each column for a range control with the given step.

    No values give (0, 1); a single value is widened; whole steps round outward.
    """
    numbers = {c: F.col(c).try_cast("double") for c in columns}
    stats = table.agg(
        *[F.min(v).alias(f"{c}_lo") for c, v in numbers.items()], *[F.max(v).alias(f"{c}_hi") for c, v in numbers.items()]
    )

    def bounds(c: str, step: float) -> Column:
        lo, hi = F.col(f"{c}_lo"), F.col(f"{c}_hi")
        hi = F.when(lo == hi, lo + (1.0 if step >= 1 else 0.1)).otherwise(hi)
        # Towards zero, as an integer cast does.
        low = F.signum(lo) * F.floor(F.abs(lo)) if step >= 1 else F.bround(lo, 2)
        high = F.ceil(hi).cast("double") if step >= 1 else F.bround(hi, 2)
        return F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(f"{c}_lo").isNull(), 0.0).otherwise(low).alias("low"),
            F.when(F.col(f"{c}_hi").isNull(), 1.0).otherwise(high).alias("high"),
        )

    return stats.select(F.explode(F.array(*[bounds(c, s) for c, s in columns.items()])).alias("b")).select("b.*")


def token_options(table: DataFrame, column: str) -> DataFrame:
    """Distinct tokens of a comma-separated column."""
    return table.select(F.explode(labels.tokens(column)).alias("value")).distinct()


def value_options(table: DataFrame, column: str) -> DataFrame:
    return table.filter(F.col(column) != "").select(F.col(column).alias("value")).distinct()


def metric_catalogue(spark, granularity: str | None = None, key: str | None = None) -> DataFrame:
    """The fixed list of metrics, whole, by granularity or by key."""
    rows = spark.createDataFrame(
        C.METRIC_CATALOGUE, "granularity string, key string, label string, filter_type string, unit string"
    )
    if granularity:
        rows = rows.filter(F.col("granularity") == granularity)
    return rows.filter(F.col("key") == key) if key else rows


def eligible_repositories(commits: DataFrame, contributors: DataFrame) -> DataFrame:
    """Projects inside the contributor range (low excluded) and the commit range (closed)."""
    few, many = C.CONTRIBUTOR_RANGE
    low, high = C.COMMIT_COUNT_RANGE
    people = contributors.groupBy("project").agg(F.countDistinct("contributor").alias("contributors"))
    size = commits.groupBy("project").agg(F.count(F.lit(1)).alias("commits"))
    return people.join(size, "project").filter(
        (F.col("contributors") > few) & (F.col("contributors") <= many) & F.col("commits").between(low, high)
    )


