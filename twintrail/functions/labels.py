"""Labels, token cells, run names and known-service tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from twintrail import constants as C
from twintrail.functions.numbers import _col


def _mapped(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda acc, kv: F.when(value == kv[0], kv[1]).otherwise(acc), table.items(), otherwise)


def known_service(service) -> Column:
    return ~F.lower(F.trim(F.coalesce(_col(service), F.lit("")))).isin(C.UNKNOWN_SERVICES)


def service_or_unknown(service) -> Column:
    return F.coalesce(F.nullif(_col(service), F.lit("")), F.lit("unknown"))


def relation(left, right) -> Column:
    """'' while a side is unresolved, else intra or inter."""
    a, b = _col(left), _col(right)
    return F.when((a == "") | (b == ""), "").when(a == b, "intra").otherwise("inter")


def tokens(cell) -> Column:
    """Non-empty trimmed tokens of a comma-separated cell."""
    parts = F.transform(F.split(F.coalesce(_col(cell), F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def compact_services(cell, shown: int = 3) -> Column:
    """First names of a service cell, then how many were left out."""
    names = tokens(cell)
    more = F.concat(F.lit(" (+"), (F.size(names) - shown).cast("string"), F.lit(")"))
    return F.concat(
        F.array_join(F.slice(names, 1, shown), ", "), F.when(F.size(names) > shown, more).otherwise("")
    )


def pair_code_type(left, right) -> Column:
    """Label of one pair: both sides equal in a special type, test against non-test, else logic."""
    a, b = F.lower(F.coalesce(_col(left), F.lit(""))), F.lower(F.coalesce(_col(right), F.lit("")))
    return (
        F.when((a == "test") & (b == "test"), "test")
        .when((a == "data") & (b == "data"), "data")
        .when((a == "config") & (b == "config"), "config")
        .when((a == "test") != (b == "test"), "mixed")
        .otherwise("logic")
    )


def set_code_type(has_test, has_data, has_config, has_logic, has_other) -> Column:
    """Label of a clone set from the categories that occur in it."""
    test, data, config, logic, other = (_col(c) for c in (has_test, has_data, has_config, has_logic, has_other))
    product = data | config | logic
    return (
        F.when(test & (product | other), "mixed")
        .when(test, "test")
        .when(data & ~config & ~logic & ~other, "data")
        .when(config & ~data & ~logic & ~other, "config")
        .when(product & ~other, "logic")
        .otherwise("mixed")
    )


def service_pair_label(left, right) -> Column:
    return F.when(_col(left) == _col(right), _col(left)).otherwise(
        F.concat(_col(right), F.lit(" ↔ "), _col(left))
    )


def detection_from_prefix(prefix) -> Column:
    p = F.coalesce(F.lower(_col(prefix)), F.lit(""))
    return _mapped(p, C.DETECTION_PREFIXES, p)


def detection_label(method) -> Column:
    raw = F.trim(F.coalesce(_col(method), F.lit("unknown")))
    low = F.lower(raw)
    return (
        F.when(low.isin("ccfsw", "normal"), "Normal")
        .when(low == "tks", "TKS")
        .when(low.isin("import", "no-import"), low)
        .when(raw == "", "Unknown")
        .otherwise(raw)
    )


def category_of_codebase(n_codebases, has_test, has_production) -> Column:
    """within / inter crossed with testing / production / mixed."""
    span = F.when(_col(n_codebases) >= 2, "inter").otherwise("within")
    kind = (
        F.when(_col(has_test) & ~_col(has_production), "testing")
        .when(_col(has_production) & ~_col(has_test), "production")
        .otherwise("mixed")
    )
    return F.concat_ws("-", span, kind)


# --- run names ------------------------------------------------------------------


def detection_token(method, tks, rnr) -> Column:
    """normal, TKS<n> or RNR<two decimals without the point>."""
    # 0.50 -> "50": the integer part of zero and the point are left out.
    digits = F.replace(F.replace(F.format_number(_col(rnr), 2), F.lit("0."), F.lit("")), F.lit("."), F.lit(""))
    return (
        F.when(_col(method) == "normal", "normal")
        .when(_col(method) == "tks", F.concat(F.lit("TKS"), _col(tks).cast("string")))
        .when(_col(method) == "rnr", F.concat(F.lit("RNR"), digits))
    )


def analysis_token(method, frequency) -> Column:
    return (
        F.when(_col(method) == "merge_commit", "merge")
        .when(_col(method) == "tag", "tag")
        .when(_col(method) == "frequency", F.concat(F.lit("freq"), _col(frequency).cast("string")))
    )


def run_name(repo, detection, min_tokens, import_filter, comod_method, analysis, date, depth, cap) -> Column:
    """File stem of a run; depth and cap appear only where they are limited."""
    return F.concat_ws(
        "_",
        _col(repo),
        _col(detection),
        _col(min_tokens).cast("string"),
        F.when(_col(import_filter), "filtered").otherwise("nofilter"),
        F.replace(_col(comod_method), F.lit("_"), F.lit("")),
        _col(analysis),
        _col(date),
        F.when(_col(depth) != -1, F.concat(F.lit("sd"), _col(depth).cast("string"))),
        F.when(_col(cap) != -1, F.concat(F.lit("mac"), _col(cap).cast("string"))),
    )


def parse_run_name(name) -> Column:
    """Run name without language -> struct of its parameters; NULL fields on other names.

    The name is matched once and cut into its parts; the struct is built from those.
    """
    stem = F.regexp_replace(_col(name), r"\.csv$", "")
    parts = F.split(F.regexp_replace(stem, C.RUN_NAME_PATTERN, "$1\t$2\t$3\t$4\t$5\t$6\t$7"), "\t")

    def fields(p: Column) -> Column:
        # Options may stand on either side of the date.
        options = F.split(p[6], "_")

        def option(pattern: str) -> Column:
            return F.try_element_at(F.filter(options, lambda o: o.rlike(pattern)), F.lit(-1))

        def limit(prefix: str) -> Column:
            hit = option(f"^{prefix}[0-9]+$")
            return F.coalesce(F.substring(hit, len(prefix) + 1, 99).try_cast("int"), F.lit(-1))

        date = option("^[0-9]{8}$")
        frequency = F.when(p[5].startswith("freq"), F.substring(p[5], 5, 99).try_cast("int")).otherwise(F.lit(50))
        built = F.struct(
            p[0].alias("repo"), p[1].alias("detection"), p[2].try_cast("int").alias("min_tokens"), p[3].alias("filter"),
            p[4].alias("comod"), p[5].alias("analysis"), frequency.alias("frequency"), date.alias("date"),
            limit("sd").alias("search_depth"), limit("mac").alias("max_commits"),
        )
        return F.when((F.size(p) == 7) & date.isNotNull(), built)

    return F.transform(F.array(parts), fields)[0]


def run_label(language, run) -> Column:
    """Readable label of a parsed run."""
    r = _col(run)
    detection = (
        F.when(F.lower(r["detection"]).startswith("tks"), F.concat(F.lit("TKS ("), F.substring(r["detection"], 4, 99), F.lit(")")))
        .when(F.lower(r["detection"]).startswith("rnr"), F.concat(F.lit("RNR ("), F.substring(r["detection"], 4, 99), F.lit(")")))
        .otherwise(_mapped(r["detection"], C.DETECTION_LABELS, r["detection"]))
    )
    analysis = F.when(
        r["analysis"].startswith("freq"), F.concat(F.lit("Frequency ("), F.substring(r["analysis"], 5, 99), F.lit(")"))
    ).otherwise(_mapped(r["analysis"], C.ANALYSIS_LABELS, r["analysis"]))
    date = F.regexp_replace(r["date"], r"^(\d{4})(\d{2})(\d{2})$", "$1/$2/$3")
    return F.concat_ws(
        ", ",
        F.concat(F.lit("Language: "), _col(language)),
        F.concat(F.lit("Detection: "), detection),
        F.concat(F.lit("Filter: "), _mapped(r["filter"], C.FILTER_LABELS, r["filter"])),
        F.concat(F.lit("Analysis: "), analysis),
        F.concat(F.lit("Min Tokens: "), r["min_tokens"].cast("string")),
        F.when(r["search_depth"] != -1, F.concat(F.lit("Search Depth: "), r["search_depth"].cast("string"))),
        F.when(r["max_commits"] != -1, F.concat(F.lit("Max Commits: "), r["max_commits"].cast("string"))),
        F.concat(F.lit("Date: "), date),
    )
