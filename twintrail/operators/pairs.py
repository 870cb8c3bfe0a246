"""Clone pairs and what is counted over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from twintrail.constants import PAIR_BLOCK, PROJECT_KEYS, SET_KEYS
from twintrail.functions import labels
from twintrail.functions.commits import common_commits
from twintrail.functions.numbers import heat_class
from twintrail.functions.paths import base_name
from twintrail.operators.ranks import running_total
from twintrail.session import staged

#: File ids that one chunk of ranges spans, and that are counted up in one array.
IDS_PER_CHUNK, IDS_PER_PIECE = 1 << 20, 4096
#: Distinct histories of a set that meet by a join; above that, histories in a block, and commits in it per history.
FEW_HISTORIES, HISTORY_BLOCK, ENTRIES_PER_HISTORY, HISTORIES_AT_ONCE = 32, 4096, 16, 512
#: Counts of commits in common that are made at once.
COUNTS_AT_ONCE = 1 << 21
PAIR_SIDES = ["file_path", "file_id", "service", "file_type", "start_line", "end_line"]


def set_sizes(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("fragments"))


def oversized_sets(fragments: DataFrame, limit: int) -> DataFrame:
    """Sets of more than ``limit`` fragments, with the pairs they make."""
    n = F.col("fragments")
    return set_sizes(fragments).filter(n > limit).withColumn("pairs", (n * (n - 1) / 2).cast("bigint"))


def clone_pairs(
    fragments: DataFrame, token_counts: DataFrame | None = None, block: int = PAIR_BLOCK, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Unordered fragment pairs of each clone set, ordered by fragment index.

    Columns named in ``carry`` come along for both sides, so that nothing has to be looked up
    for a pair: a join on pairs shuffles every pair, one on fragments only the fragments.

    A set is dealt into blocks of ``block`` fragments that follow its order, and a block is one
    row of lists. Each two of its blocks meet as one row under a key of their own, the earlier
    one as x and the later one as y: a hot set is spread over many tasks, no join makes a row
    for a pair, and hardly two fragments meet that are no pair. What their pairs have in common
    is counted for two blocks at once.
    Keys are dealt to a number of tasks: by their bytes, which say little about their pairs,
    they would be put together into a few. A set of one block meets itself where it lies and is
    not shuffled for it. Token counts come along with x.
    """
    sides = [*PAIR_SIDES, "modified_commits", *carry]
    tasks = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = F.col("fragment_index").cast("bigint")
    spans = fragments.groupBy(*SET_KEYS).agg(
        F.ceil(F.count(F.lit(1)) / block).alias("_blocks"), F.min(index).alias("_from"), (F.max(index) - F.min(index) + 1).alias("_span")
    )
    rows = fragments.filter(index.isNotNull()).select(*SET_KEYS, "fragment_index", *sides).join(spans, SET_KEYS).withColumn(
        "_block", F.floor((index - F.col("_from")) * F.col("_blocks") / F.col("_span"))
    )
    # The lists of one aggregate have one order. A null has no place in a list, but a struct around it has.
    lists = ["_indices", *[f"_{c}_list" for c in sides]]
    blocks = rows.groupBy(*SET_KEYS, "_blocks", "_block").agg(
        F.collect_list("fragment_index").alias("_indices"), *[F.collect_list(F.struct(c)).alias(f"_{c}_list") for c in sides]
    )
    # Indices that repeat fall into one block, which is cut then.
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.size("_indices") - 1) / block).cast("int"))).alias("_piece")
    cut = blocks.select("*", piece).withColumns({c: F.slice(c, F.col("_piece") * block + 1, F.lit(block)) for c in lists})
    keys = [*SET_KEYS, "_low", "_high"]

    def side(some, tag, low, high, *once):
        dealt = some.withColumn("_low", low).withColumn("_high", high).repartition(tasks, *keys)
        return dealt.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in lists], *once)

    own = F.col("_block")
    counted = [] if token_counts is None else [F.coalesce("token_count", F.lit(0)).alias("_tokens")]
    named = cut.join(token_counts.select(*SET_KEYS, "token_count"), SET_KEYS, "left") if counted else cut
    several = F.col("_blocks") > 1
    first = side(named.filter(several), "x", own, F.explode(F.sequence(own, F.col("_blocks") - 1)), *counted)
    second = side(cut.filter(several), "y", F.explode(F.sequence(F.lit(0).cast("bigint"), own)), own)
    alone = named.filter("_blocks = 1").select(
        *SET_KEYS, own.alias("_low"), own.alias("_high"), *[F.col(c).alias(f"{c}_{tag}") for tag in "xy" for c in lists], *counted
    )
    met = first.join(second, keys).unionByName(alone).withColumn("_counts", common_counts("_modified_commits_list_x", "_modified_commits_list_y"))
    for tag in "xy":
        met = met.select("*", F.posexplode(f"_indices_{tag}").alias(f"_at_{tag}", f"fragment_index_{tag}"))

    def of(tag):
        return [F.col(f"fragment_index_{tag}"), *[F.col(f"_{c}_list_{tag}")[F.col(f"_at_{tag}")][c].alias(f"{c}_{tag}") for c in sides]]

    count = F.col("_counts")[F.col("_at_x") * F.size("_indices_y") + F.col("_at_y")].alias("_count")
    ordered = met.filter(F.col("fragment_index_x") < F.col("fragment_index_y"))
    paired = compared(ordered.select(*SET_KEYS, *of("x"), *(["_tokens"] if counted else []), *of("y"), count))
    return paired.withColumn("token_count", F.col("_tokens")).drop("_tokens") if counted else paired


@F.arrow_udf(returnType=ArrayType(IntegerType()))
def common_counts(cells: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """For lists of commit lists x and y: how many commits each of x has in common with each of y, those of the first of x in front."""
    for x, y in cells:
        made = np.cumsum(x.value_lengths().to_numpy().astype(np.int64) * y.value_lengths().to_numpy())
        done = 0
        while done < len(x):
            end = max(done + 1, int(np.searchsorted(made, (made[done - 1] if done else 0) + COUNTS_AT_ONCE, "right")))
            yield _counted(x.slice(done, end - done), y.slice(done, end - done))
            done = end


def _counted(x: pa.ListArray, y: pa.ListArray) -> pa.ListArray:
    sizes = [side.value_lengths().to_numpy().astype(np.int64) for side in (x, y)]
    starts = [np.cumsum(n) - n for n in sizes]
    cells = [np.repeat(np.arange(len(n)), n) for n in sizes]
    commits = [pc.struct_field(side.flatten(), [0]) for side in (x, y)]
    words = pa.concat_arrays([c.flatten() for c in commits]).dictionary_encode(null_encoding="encode")
    kinds, codes = max(1, len(words.dictionary)), words.indices.to_numpy().astype(np.int64)
    owners = [np.repeat(np.arange(len(c)), c.value_lengths().fill_null(0).to_numpy()) for c in commits]
    # A commit that a list names twice counts once.
    ours, theirs = (np.unique(own * kinds + code) for own, code in zip(owners, np.split(codes, [len(owners[0])])))
    (i, code), (j, other) = divmod(ours, kinds), divmod(theirs, kinds)
    key, met = cells[0][i] * kinds + code, cells[1][j] * kinds + other
    turn = np.argsort(met, kind="stable")
    met, place = met[turn], (j - starts[1][cells[1][j]])[turn]
    low = np.searchsorted(met, key)
    many = np.searchsorted(met, key, "right") - low

    total = sizes[0] * sizes[1]
    ends = np.cumsum(total)
    rows = (ends - total)[cells[0]] + (np.arange(len(cells[0])) - starts[0][cells[0]]) * sizes[1][cells[0]]
    base = rows[i]
    counts = np.zeros(int(ends[-1]), np.int32)
    upto = np.cumsum(many)
    done = 0
    while done < len(many):
        # Entries follow the rows of x, so some of them touch a stretch of the counts.
        end = max(done + 1, int(np.searchsorted(upto, upto[done] - many[done] + COUNTS_AT_ONCE, "right")))
        n = many[done:end]
        at = np.repeat(low[done:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = np.bincount(np.repeat(base[done:end] - base[done], n) + place[at])
        counts[base[done] : base[done] + len(found)] += found.astype(np.int32)
        done = end
    unknown = None
    if commits[0].null_count or commits[1].null_count:
        # What an unknown list has in common is not known.
        own = np.repeat(np.arange(len(rows)), sizes[1][cells[0]])
        facing = starts[1][cells[0][own]] + np.arange(len(counts)) - rows[own]
        unknown = commits[0].is_null().to_numpy(False)[own] | commits[1].is_null().to_numpy(False)[facing]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(counts, mask=unknown))


def compared(sides: DataFrame) -> DataFrame:
    """Both sides of pairs with what they have in common, counted as ``_count`` where that is there; no token count is known."""
    counted = "_count" in sides.columns
    count = F.col("_count") if counted else F.size("comodified_commits")
    common = common_commits("modified_commits_x", "modified_commits_y")
    # Where nothing is in common, which most pairs have counted before, the lists need not meet again.
    common = F.when(count == 0, F.array().cast("array<string>")).otherwise(common) if counted else common
    return (
        sides.withColumn("comodified_commits", common)
        .withColumn("comodification_count", count)
        .withColumn("comodified", (F.col("comodification_count") > 0).cast("int"))
        .withColumn("relation", labels.relation("service_x", "service_y"))
        .drop("modified_commits_x", "modified_commits_y", "_count")
        .withColumn("token_count", F.lit(0))
    )


# --- exact pair counts without pairs -----------------------------------------------


def pair_summary(fragments: DataFrame) -> DataFrame:
    """Pairs, co-modified pairs and co-modified sets per project-language, for sets of any size.

    Fragments of a set with the same commit list behave alike, so they are counted together
    and only distinct commit lists that share a commit are matched with each other.
    """
    n = F.col("n")
    totals = (
        set_sizes(fragments).withColumnRenamed("fragments", "n").groupBy(*PROJECT_KEYS)
        .agg(F.sum(n * (n - 1) / 2).cast("bigint").alias("clone_pairs"))
    )
    comod = comodified_pairs(fragments).groupBy(*PROJECT_KEYS).agg(
        F.sum("pairs").cast("bigint").alias("comod_pairs"), F.count(F.lit(1)).alias("comod_sets")
    )
    zero = F.lit(0).cast("bigint")
    return totals.join(comod, PROJECT_KEYS, "left").select(
        *PROJECT_KEYS, "clone_pairs",
        F.coalesce("comod_pairs", zero).alias("comod_pairs"),
        F.coalesce("comod_sets", zero).alias("comod_sets"),
    )


def comodified_pairs(fragments: DataFrame, few: int = FEW_HISTORIES, block: int = HISTORY_BLOCK) -> DataFrame:
    """Co-modified pairs of each clone set that has any.

    Fragments with the same commits count together. In a set of up to ``few`` histories those
    that share a commit meet by a join; a larger set is dealt into blocks of histories, each
    two blocks meet under a key of their own, and no row is made for two histories that meet.
    """
    n = F.col("n")

    def named(commit):
        """A name that is never null: as in the pair table, a null is in common with a null."""
        return F.coalesce(F.concat(F.lit("c"), commit), F.lit("n"))

    alike = staged(
        fragments.filter(F.size("modified_commits") > 0)
        .select(*SET_KEYS, F.array_sort(F.array_distinct(F.transform("modified_commits", named))).alias("commits"))
        .groupBy(*SET_KEYS, "commits")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    within = alike.filter(n > 1).select(*SET_KEYS, (n * (n - 1) / 2).cast("bigint").alias("pairs"))
    sizes = alike.groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("_histories"), F.sum(F.size("commits")).alias("_entries"))
    sized = alike.join(sizes, SET_KEYS)
    by_commit = sized.filter(F.col("_histories").between(2, few)).select(
        *SET_KEYS, F.array_join("commits", "\n").alias("history"), "n", F.explode("commits").alias("commit")
    )
    other = by_commit.select(*SET_KEYS, "commit", F.col("history").alias("history_y"), F.col("n").alias("n_y"))
    across = (
        by_commit.join(other, [*SET_KEYS, "commit"])
        .filter(F.col("history") < F.col("history_y"))
        .select(*SET_KEYS, "history", "history_y", (n * F.col("n_y")).alias("pairs"))
        .distinct()
        .select(*SET_KEYS, "pairs")
    )
    blocks = F.greatest(F.ceil(F.col("_histories") / block), F.ceil(F.col("_entries") / (block * ENTRIES_PER_HISTORY))).cast("int")
    dealt = (
        sized.filter(F.col("_histories") > few)
        .select(*SET_KEYS, "commits", "n", blocks.alias("_blocks"))
        .withColumn("_block", F.pmod(F.xxhash64("commits"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(*SET_KEYS, F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_block", "commits", "n")
    )
    keys = ", ".join(f"{k} string" for k in SET_KEYS)
    met = dealt.groupBy(*SET_KEYS, "_low", "_high").applyInArrow(_sharing, f"{keys}, pairs bigint")
    return (
        within.unionByName(across).unionByName(met).groupBy(*SET_KEYS).agg(F.sum("pairs").alias("pairs"))
        .filter("pairs > 0")
    )


def _sharing(key: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of two blocks of histories that share a commit: for each history the bits of those it meets, counted."""
    low, high = (k.as_py() for k in key[-2:])
    block, weight = (rows.column(c).to_numpy() for c in ("_block", "n"))
    commits = rows.column("commits").combine_chunks()
    owner = pc.list_parent_indices(commits).to_numpy()
    words = pc.list_flatten(commits).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)

    there = block == high
    weights = weight[there]
    width = -(-len(weights) // 64) * 8
    place = (np.cumsum(there) - 1)[owner]
    hit = there[owner]
    bits = np.zeros((len(words.dictionary), width), np.uint8)
    np.bitwise_or.at(bits.reshape(-1), code[hit] * width + place[hit] // 8, (1 << place[hit] % 8).astype(np.uint8))
    bits = bits.view(np.uint64)
    # A history that counts n times is in the planes of the bits of n.
    planes = []
    for k in range(int(weights.max(initial=0)).bit_length()):
        plane = np.packbits((weights >> k & 1).astype(np.uint8), bitorder="little")
        planes.append(np.pad(plane, (0, width - len(plane))).view(np.uint64))

    here = (block == low)[owner]
    code, owner = code[here], owner[here]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    pairs = 0
    for at in range(0, len(first), HISTORIES_AT_ONCE):
        some = first[at : at + HISTORIES_AT_ONCE]
        end = first[at + HISTORIES_AT_ONCE] if at + HISTORIES_AT_ONCE < len(first) else len(code)
        shared = np.bitwise_or.reduceat(bits[code[some[0] : end]], some - some[0], axis=0)
        for k, plane in enumerate(planes):
            counts = np.bitwise_count(shared & plane).sum(axis=1, dtype=np.int64)
            pairs += int((counts * weight[owner[some]]).sum()) << k
    if low == high:
        pairs = (pairs - int((weight * weight).sum())) // 2
    names = [pa.array([k.as_py()], pa.string()) for k in key[:-2]]
    return pa.Table.from_arrays([*names, pa.array([pairs], pa.int64())], names=[*SET_KEYS, "pairs"])


def service_pair_totals(fragments: DataFrame) -> DataFrame:
    """Pairs per unordered pair of known services over sets of any size, from counts alone."""
    counts = (
        fragments.filter(labels.known_service("service"))
        .groupBy(*SET_KEYS, "service")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Sets with the same service counts are folded together before services are matched.
    profile = F.array_sort(F.collect_list(F.struct("service", "n")))
    sets = counts.groupBy(*SET_KEYS).agg(profile.alias("profile"))
    folded = sets.groupBy(*PROJECT_KEYS, "profile").agg(F.count(F.lit(1)).alias("sets"))
    a = folded.select(*PROJECT_KEYS, "sets", "profile", F.explode("profile").alias("a"))
    ab = a.select(*PROJECT_KEYS, "sets", "a", F.explode("profile").alias("b"))
    same = F.col("a.service") == F.col("b.service")
    pairs = F.when(same, F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    return (
        ab.filter(F.col("a.service") <= F.col("b.service"))
        .groupBy(*PROJECT_KEYS, F.col("a.service").alias("service_lo"), F.col("b.service").alias("service_hi"))
        .agg(F.sum(pairs * F.col("sets")).cast("bigint").alias("pairs"), F.sum("sets").cast("bigint").alias("shared_sets"))
    )


# --- counts over the pair table -----------------------------------------------------


def pair_table_summary(pairs: DataFrame) -> DataFrame:
    comod = F.col("comodified") == 1
    return pairs.groupBy(*PROJECT_KEYS).agg(
        F.count(F.lit(1)).alias("clone_pairs"),
        F.count_if(comod).alias("comod_pairs"),
        F.countDistinct(F.when(comod, F.col("clone_id"))).alias("comod_sets"),
    )


def coordinate_overlap(pairs: DataFrame) -> DataFrame:
    """Pairs and total lines on each (file_id_y, file_id_x) coordinate."""
    lines = F.col("end_line_x") - F.col("start_line_x") + F.col("end_line_y") - F.col("start_line_y") + 2
    return pairs.groupBy(*PROJECT_KEYS, "file_id_y", "file_id_x").agg(
        F.count(F.lit(1)).alias("overlap_count"), F.sum(lines).cast("bigint").alias("coord_total_lines")
    )


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs distinct on coordinate, set, base names and line ranges."""
    return pairs.select(
        *SET_KEYS, "file_id_y", "file_id_x",
        base_name("file_path_x").alias("name_x"), "start_line_x", "end_line_x",
        base_name("file_path_y").alias("name_y"), "start_line_y", "end_line_y",
    ).distinct()


def unique_overlap(pairs: DataFrame) -> DataFrame:
    return (
        unique_pairs(pairs)
        .groupBy(*PROJECT_KEYS, "file_id_y", "file_id_x")
        .agg(F.count(F.lit(1)).alias("filtered_overlap_count"))
    )


def unique_pair_counts(pairs: DataFrame) -> DataFrame:
    return unique_pairs(pairs).groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("pair_count"))


def _sides(pairs: DataFrame, *columns: str) -> DataFrame:
    """Both sides of each pair below each other, still one row per side."""
    structs = [
        F.struct(*[F.col(f"{c}_{tag}").alias(c) for c in columns]) for tag in ("x", "y")
    ]
    return pairs.select(*SET_KEYS, F.explode(F.array(*structs)).alias("s")).select(*SET_KEYS, "s.*")


def cross_service_profile(pairs: DataFrame) -> DataFrame:
    """Per clone set: services, pairs, co-modified pairs, type counts, mixed flag, files."""
    test_x, test_y = F.col("file_type_x") == "test", F.col("file_type_y") == "test"
    base = pairs.groupBy(*SET_KEYS).agg(
        F.count(F.lit(1)).alias("total_pair_count"),
        F.count_if(F.col("comodified") == 1).alias("comodified_count"),
        F.count_if(F.col("relation") == "inter").alias("inter_service_pairs"),
        *[F.count_if(F.col("file_type_x") == t).alias(f"{t}_pairs") for t in ("logic", "data", "test", "config")],
        F.bool_or(test_x != test_y).alias("is_mixed"),
    )
    # Sides are made distinct first: no set-valued buffer grows with the pairs.
    files = _sides(pairs, "file_path").distinct().groupBy(*SET_KEYS).agg(F.count(F.lit(1)).alias("file_count"))
    services = (
        _sides(pairs, "service").distinct().groupBy(*SET_KEYS)
        .agg(F.array_sort(F.collect_set("service")).alias("services"))
    )
    return (
        base.join(unique_pair_counts(pairs), SET_KEYS)
        .join(files, SET_KEYS)
        .join(services, SET_KEYS)
        .withColumn("service_count", F.size("services").cast("bigint"))
    )


def span_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy(*PROJECT_KEYS, "service_count").agg(F.count(F.lit(1)).alias("clone_sets"))


def service_options(pairs: DataFrame) -> DataFrame:
    """Clone sets and pairs each known service takes part in."""
    touched = F.array_distinct(F.array("service_x", "service_y"))
    return (
        pairs.select(*SET_KEYS, F.explode(touched).alias("service"))
        .filter(labels.known_service("service"))
        .groupBy(*SET_KEYS, "service")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*PROJECT_KEYS, "service")
        .agg(F.count(F.lit(1)).alias("clone_sets"), F.sum("n").cast("bigint").alias("pairs"))
    )


def shared_clone_matrix(pairs: DataFrame) -> DataFrame:
    """Service by service: clone sets holding both, and pairs between the two."""
    known = labels.known_service("service")
    groups = (
        _sides(pairs, "service").filter(known).groupBy(*SET_KEYS)
        .agg(F.array_sort(F.collect_set("service")).alias("services"))
        .groupBy(*PROJECT_KEYS, "services")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sets = (
        groups.select(*PROJECT_KEYS, "n", "services", F.explode("services").alias("service_a"))
        .select(*PROJECT_KEYS, "n", "service_a", F.explode("services").alias("service_b"))
        .groupBy(*PROJECT_KEYS, "service_a", "service_b")
        .agg(F.sum("n").cast("bigint").alias("shared_sets"))
    )
    lo, hi = F.least("service_x", "service_y"), F.greatest("service_x", "service_y")
    edges = pairs.groupBy(*PROJECT_KEYS, lo.alias("lo"), hi.alias("hi")).agg(F.count(F.lit(1)).alias("pairs"))
    return (
        sets.withColumn("lo", F.least("service_a", "service_b"))
        .withColumn("hi", F.greatest("service_a", "service_b"))
        .join(edges, [*PROJECT_KEYS, "lo", "hi"], "left")
        .select(
            *PROJECT_KEYS, "service_a", "service_b", "shared_sets",
            F.coalesce("pairs", F.lit(0)).cast("bigint").alias("shared_pairs"),
        )
    )


def network_edges(pairs: DataFrame) -> DataFrame:
    """Weighted undirected edges between distinct known services over inter pairs."""
    lo, hi = F.least("service_x", "service_y"), F.greatest("service_x", "service_y")
    return (
        pairs.filter(
            (F.col("relation") == "inter")
            & labels.known_service("service_x")
            & labels.known_service("service_y")
            & (F.col("service_x") != F.col("service_y"))
        )
        .groupBy(*PROJECT_KEYS, lo.alias("service_lo"), hi.alias("service_hi"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def set_code_types(pairs: DataFrame) -> DataFrame:
    """Code-type label of every clone set over both sides of its pairs."""
    def has(kind):
        return F.bool_or((F.col("file_type_x") == kind) | (F.col("file_type_y") == kind)).alias(f"has_{kind}")

    def odd(c):
        return ~F.coalesce(F.col(c), F.lit("")).isin("", "nan", "test", "data", "config", "logic")

    return (
        pairs.groupBy(*SET_KEYS)
        .agg(
            has("test"), has("data"), has("config"), has("logic"),
            F.bool_or(odd("file_type_x") | odd("file_type_y")).alias("has_other"),
            F.count(F.lit(1)).alias("pairs"),
        )
        .withColumn("code_type", labels.set_code_type("has_test", "has_data", "has_config", "has_logic", "has_other"))
        .select(*SET_KEYS, "code_type", "pairs")
    )


def code_type_counts(typed: DataFrame) -> DataFrame:
    """Sets and pairs per code type with an 'all' row, zero rows for types that do not occur; ``typed``: code_type, pairs of each set."""
    counted = (
        typed.rollup("code_type")
        .agg(F.count(F.lit(1)).alias("sets"), F.sum("pairs").alias("pairs"), F.grouping("code_type").alias("g"))
        .select(F.when(F.col("g") == 1, "all").otherwise(F.col("code_type")).alias("code_type"), "sets", "pairs")
    )
    wanted = typed.sparkSession.createDataFrame(
        [(t,) for t in ("all", "logic", "data", "test", "config", "mixed")], "code_type string"
    )
    return F.broadcast(wanted).join(counted, "code_type", "left").select(
        "code_type", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("sets", "pairs")]
    )


def clone_options(pairs: DataFrame) -> DataFrame:
    """Option rows of the clone selector: span over known services, pairs, label, co-mod sum."""
    sums = pairs.groupBy(*SET_KEYS).agg(F.sum("comodification_count").cast("bigint").alias("comod_count"))
    services = (
        _sides(pairs, "service").filter(labels.known_service("service")).groupBy(*SET_KEYS)
        .agg(F.array_sort(F.collect_set("service")).alias("services"))
    )
    return (
        set_code_types(pairs)
        .join(sums, SET_KEYS)
        .join(services, SET_KEYS)
        .select(
            *SET_KEYS, F.size("services").cast("bigint").alias("service_count"),
            F.col("pairs").alias("pair_count"), "code_type", "comod_count",
            F.array_join("services", " ").alias("services"),
        )
    )


def dataset_overview(pairs: DataFrame) -> DataFrame:
    """Headline counts of a pair data set."""
    main = pairs.groupBy(*PROJECT_KEYS).agg(
        F.count(F.lit(1)).alias("clone_pairs"),
        F.countDistinct("clone_id").alias("clone_sets"),
        F.count_if(F.col("relation") == "intra").alias("intra_pairs"),
        F.count_if(F.col("relation") == "inter").alias("inter_pairs"),
        F.count_if(F.col("comodification_count") >= 1).alias("comod_pairs"),
    )

    def sides(column, name):
        both = F.explode(F.array(f"{column}_x", f"{column}_y")).alias("v")
        return (
            pairs.select(*PROJECT_KEYS, both).filter(F.col("v") != "").distinct()
            .groupBy(*PROJECT_KEYS).agg(F.count(F.lit(1)).alias(name))
        )

    zero = F.lit(0).cast("bigint")
    return (
        main.join(sides("service", "services"), PROJECT_KEYS, "left")
        .join(sides("file_path", "files"), PROJECT_KEYS, "left")
        .withColumn("services", F.coalesce("services", zero))
        .withColumn("files", F.coalesce("files", zero))
        .withColumn("comod_rate", F.bround(F.col("comod_pairs") / F.col("clone_pairs"), 6))
    )


def touch_counts(pairs: DataFrame, column: str) -> DataFrame:
    """How often each service or file is a side of a pair, with its clone sets."""
    return (
        _sides(pairs, column)
        .groupBy(*SET_KEYS, column).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(column)
        .agg(F.sum("n").cast("bigint").alias("pairs"), F.count(F.lit(1)).alias("clone_sets"))
    )


def pair_type_breakdown(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(labels.pair_code_type("file_type_x", "file_type_y").alias("code_type")).agg(
        F.count(F.lit(1)).alias("pairs")
    )


def method_breakdown(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(labels.detection_label("detection_method").alias("method")).agg(
        F.count(F.lit(1)).alias("pairs")
    )


def clone_set_links(fragments: DataFrame, on_x, on_y) -> DataFrame:
    """Other coordinates holding a pair of a clone set that has one on the chosen coordinates.

    ``on_x`` and ``on_y`` tell the chosen file ids of the two sides. A set has a pair on two
    files if its first fragment in the one precedes its last in the other, so one row for
    each set and file is enough.
    """
    index = F.col("fragment_index")
    spans = fragments.groupBy(*SET_KEYS, "file_id").agg(F.min(index).alias("first"), F.max(index).alias("last"))
    x = spans.select(*SET_KEYS, F.col("file_id").alias("file_id_x"), "first")
    y = spans.select(*SET_KEYS, F.col("file_id").alias("file_id_y"), "last")
    here_x, here_y = on_x(F.col("file_id_x")), on_y(F.col("file_id_y"))
    chosen = (
        x.filter(here_x).groupBy(*SET_KEYS).agg(F.min("first").alias("first"))
        .join(y.filter(here_y).groupBy(*SET_KEYS).agg(F.max("last").alias("last")), SET_KEYS)
        .filter("first < last").select(*SET_KEYS)
    )
    linked = x.join(chosen, SET_KEYS, "left_semi").join(y.join(chosen, SET_KEYS, "left_semi"), SET_KEYS)
    return linked.filter((F.col("first") < F.col("last")) & ~(here_x & here_y)).select(*SET_KEYS, "file_id_x", "file_id_y")


def with_overlap(pairs: DataFrame) -> DataFrame:
    """Each pair with the number of pairs on its coordinate."""
    keys = [*PROJECT_KEYS, "file_id_y", "file_id_x"]
    here = coordinate_overlap(pairs).select(*keys, F.col("overlap_count").alias("overlap"))
    return pairs.join(here, keys)


def share_of(counts: DataFrame) -> DataFrame:
    """``kept`` and ``total`` with the kept share in percent; a tiny share shows as '< 0.1%'."""
    share = F.when(F.col("total") > 0, F.col("kept") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    return counts.withColumn("percent", F.bround(share, 1)).withColumn(
        "label",
        F.when((share > 0) & (share < 0.1), "< 0.1%").otherwise(F.concat(F.format_number("percent", 1), F.lit("%"))),
    )


# --- coordinates ---------------------------------------------------------------------


def display_ids(file_ranges: DataFrame) -> DataFrame:
    """Gap-free ids of all files of known services, ordered by the service's first id.

    Offsets are a running total over the ranges, chunk by chunk; a range is then counted up
    in pieces, so neither a window nor an array ever holds all files of a service.
    """
    known = file_ranges.filter(labels.known_service("service") & (F.col("range_end") >= F.col("range_start")))
    services = known.groupBy(*PROJECT_KEYS, "service").agg(F.min("range_start").alias("first_id"))
    lowest = services.groupBy(*PROJECT_KEYS).agg(F.min("first_id").alias("base"))
    length = F.col("range_end") - F.col("range_start") + 1
    order = [F.col(c) for c in ("first_id", "service", "range_start", "range_end")]
    chunk = F.struct("first_id", "service", F.floor(F.col("range_start") / IDS_PER_CHUNK).alias("part"))
    total = running_total(known.join(services, [*PROJECT_KEYS, "service"]), PROJECT_KEYS, order, chunk, length, "upto")
    shift = F.col("base") + F.col("upto") - length - F.col("range_start")
    pieces = total.join(lowest, PROJECT_KEYS).select(
        *PROJECT_KEYS, "service", "range_end", shift.alias("shift"), F.explode(F.sequence(F.col("range_start").cast("bigint"), F.col("range_end").cast("bigint"), F.lit(IDS_PER_PIECE).cast("bigint"))).alias("first")
    )
    ids = pieces.select(
        *PROJECT_KEYS, "service", "shift", F.explode(F.sequence("first", F.least(F.col("range_end"), F.col("first") + (IDS_PER_PIECE - 1)))).alias("file_id")
    )
    return ids.select(*PROJECT_KEYS, "service", "file_id", (F.col("file_id") + F.col("shift")).cast("bigint").alias("display_id"))


def with_display_coordinates(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Attach display ids to fragments, or to both sides of pairs; what has an unmapped side falls out.

    On fragments this is done before pairs are made, so that no pair is shuffled for it.
    """
    sides = [""] if "file_id" in rows.columns else ["_x", "_y"]
    for tag in sides:
        names = ids.select(*PROJECT_KEYS, F.col("file_id").alias(f"file_id{tag}"), F.col("display_id").alias(f"display_id{tag}"))
        rows = rows.join(names, [*PROJECT_KEYS, f"file_id{tag}"])
    return rows


def heat_map(pairs: DataFrame) -> DataFrame:
    """Unique overlap per coordinate with its density class; bounds are one aggregated row."""
    overlap = unique_overlap(pairs)
    bounds = overlap.groupBy(*PROJECT_KEYS).agg(
        F.min("filtered_overlap_count").alias("lo"), F.max("filtered_overlap_count").alias("hi")
    )
    return overlap.join(bounds, PROJECT_KEYS).select(
        *PROJECT_KEYS, "file_id_y", "file_id_x", "filtered_overlap_count",
        heat_class("filtered_overlap_count", "lo", "hi").alias("heat"),
    )
