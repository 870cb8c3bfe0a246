"""URL verdicts: host and path rules, and for the rest trust and distrust spread over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import ascii_lower, hold

#: (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING = 0.85
#: Rounds end when no host's trust or distrust changes by more than this share of itself, so not before every
#: host that links lead to is reached.
TOLERANCE = 1e-4
#: Values closer than this share differ by the order of summing only.
NOISE = 1e-9
#: A host is blocked when its distrust is over this many times its trust.
DISTRUST_RATIO = 1.0
#: Rounds between two cuts of the lineage.
CUT_EVERY = 4


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from the absolute links of ``pages`` (host, html), summed per pair of hosts.

    A host also has an edge to the domain above it and back, with the weight of one link:
    subdomains share their owner.
    """
    linked = F.regexp_extract_all("html", F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(linked).alias("dst")).withColumn("dst", ascii_lower(F.col("dst")))
    links = links.where("src != '' AND src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = links.select("src").union(links.select(F.col("dst"))).union(pages.select("host")).where("src != ''").distinct()
    above = hosts.select("src", F.regexp_replace("src", r"^[^.]*\.", "").alias("dst")).where("src != dst AND instr(dst, '.') > 0")
    both = above.union(above.select("dst", "src")).withColumn("weight", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread_trust(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``seeds`` (host, good, bad) are shares that sum to one each, or to zero. Trust follows
    links from the good seeds; distrust runs against them from the bad ones, since a host
    answers for what it links to. What hosts without links hold is let go, which scales all
    values alike. Without a number of ``iterations`` rounds go on until all values settle.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into"))
    shares = edges.join(out, "src").join(into, "dst")
    # One row for each flow: trust from src to dst, distrust from dst to src.
    flows = hold(
        shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("out")).alias("good"), F.lit(0.0).alias("bad")).unionByName(
            shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("good"), (F.col("weight") / F.col("into")).alias("bad"))
        )
    )
    seeds = hold(seeds.select("host", "good", "bad"))
    state = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    zero = F.lit(0.0)
    k = 0
    while k != iterations:
        k += 1
        moved = flows.join(state, "host").select(
            F.col("to").alias("host"),
            (damping * F.col("trust") * F.col("good")).alias("trust"),
            (damping * F.col("distrust") * F.col("bad")).alias("distrust"),
        )
        again = seeds.select("host", ((1 - damping) * F.col("good")).alias("trust"), ((1 - damping) * F.col("bad")).alias("distrust"))
        now, sums = moved.unionByName(again), [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
        if k % CUT_EVERY:
            state = now.groupBy("host").agg(*sums)
            continue
        before = state.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"))
        both = now.withColumn("old_trust", zero).withColumn("old_distrust", zero).unionByName(before).groupBy("host")
        both = hold(both.agg(*sums, F.sum("old_trust").alias("old_trust"), F.sum("old_distrust").alias("old_distrust")))
        state = both.select("host", "trust", "distrust")
        if iterations is None:
            moves = [F.abs(F.col(c) - F.col(f"old_{c}")) > tolerance * F.greatest(c, f"old_{c}") for c in ("trust", "distrust")]
            if both.where(moves[0] | moves[1]).isEmpty():
                break
    return state


def _digits(name: str) -> Column:
    """The value by nine significant digits, null as zero: shares shrink as the table grows."""
    return F.format_string("%.8e", F.coalesce(name, F.lit(0.0))).cast("double")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, ratio: float = DISTRUST_RATIO) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of ``pages``.

    The longest rule that fits decides. Pages without a rule get the verdict of their host,
    whose trust and distrust spread from the pages that rules allow and block. A host that
    neither reaches, over links of any number, is allowed; a share that links split as often as
    it may be still counts. Null urls and urls without ``://`` have an empty host and path;
    null html has no links. Repeated rows are judged each. An empty table gives no row. Columns
    other than page_id, url and html are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"))

    edges = hold(host_edges(named))
    counts = judged.where("host != ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    counts = hold(counts.where("good + bad > 0"))
    all_good, all_bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()  # two numbers
    seeds = counts.select("host", (F.col("good") / max(1, all_good)).alias("good"), (F.col("bad") / max(1, all_bad)).alias("bad"))
    hosts = hold(spread_trust(edges, seeds))
    bad_host = F.col("distrust") > ratio * F.col("trust") * (1 + NOISE)
    return judged.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad_host, "block").otherwise("allow")).alias("verdict"),
        _digits("trust").alias("trust"),
        _digits("distrust").alias("distrust"),
    )
