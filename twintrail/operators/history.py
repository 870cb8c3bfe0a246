"""Lines and fragments followed back through adjacent commits.

Commit pairs carry (project, child_sha, parent_sha); the child is the newer commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twintrail.constants import FRAGMENT_KEYS, PROJECT_KEYS
from twintrail.session import staged

PAIR_KEYS = ["project", "child_sha", "parent_sha"]
HUNK_HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
INTS = "array<int>"
LINE_BLOCK = 64
#: A fragment at a step of the history.
NODE_KEYS = [*PROJECT_KEYS, "at", "clone_id", "fragment_index"]


def parse_patches(patches: DataFrame) -> DataFrame:
    """Unified patches -> inserted, deleted and modified line numbers per file.

    ``patches``: PAIR_KEYS, path, patch; '-' is the parent side, '+' the child side. Every
    hunk is numbered from its own header. A number on both sides is a modified line.
    """
    keys = [*PAIR_KEYS, "path"]
    order = W.partitionBy(*keys).orderBy("pos")
    in_hunk = W.partitionBy(*keys, "hunk").orderBy("pos")
    header = F.regexp_extract("line", HUNK_HEADER, 1) != ""
    mark = F.substring("line", 1, 1)
    lines = (
        patches.select(*keys, F.posexplode(F.split("patch", "\n")).alias("pos", "line"))
        .withColumn("header", header)
        .withColumn("hunk", F.sum(F.col("header").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .filter((F.col("hunk") > 0) & ~F.col("line").startswith("\\"))
    )

    def counter(group: int, skip: str) -> Column:
        first = F.first(F.regexp_extract("line", HUNK_HEADER, group).try_cast("int")).over(
            in_hunk.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        )
        passed = F.sum((~F.col("header") & (mark != skip)).cast("int")).over(
            in_hunk.rowsBetween(W.unboundedPreceding, -1)
        )
        return (first + F.coalesce(passed, F.lit(0))).cast("int")

    numbered = (
        lines.withColumn("old_no", counter(1, "+")).withColumn("new_no", counter(2, "-")).filter(~F.col("header"))
    )
    plus = F.collect_set(F.when(mark == "+", F.col("new_no")))
    minus = F.collect_set(F.when(mark == "-", F.col("old_no")))
    return (
        numbered.groupBy(*keys)
        .agg(plus.alias("plus"), minus.alias("minus"))
        .select(
            *PAIR_KEYS, F.col("path").alias("child_path"), F.col("path").alias("parent_path"),
            F.array_sort(F.array_except("plus", "minus")).alias("inserted_lines"),
            F.array_sort(F.array_except("minus", "plus")).alias("deleted_lines"),
            F.array_sort(F.array_intersect("plus", "minus")).alias("modified_lines"),
        )
    )


def _file_hunks(hunks: DataFrame) -> DataFrame:
    """Line sets per commit pair and path; renames are left aside."""
    def union(column):
        return F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast(INTS))))).alias(column)

    return (
        hunks.filter(F.col("child_path") == F.col("parent_path"))
        .groupBy(*PAIR_KEYS, F.col("child_path").alias("path"))
        .agg(union("inserted_lines"), union("deleted_lines"), union("modified_lines"))
    )


def changed_files(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Line sets of changed files found in both snapshots, with both line counts.

    ``files``: project, sha, file_path, loc. Pairs without any such file have no transition.
    """
    child = files.select("project", F.col("sha").alias("child_sha"), F.col("file_path").alias("path"), F.col("loc").alias("child_loc"))
    parent = files.select("project", F.col("sha").alias("parent_sha"), F.col("file_path").alias("path"), F.col("loc").alias("parent_loc"))
    return _file_hunks(hunks).join(child, ["project", "child_sha", "path"]).join(parent, ["project", "parent_sha", "path"])


def pairs_with_changes(hunks: DataFrame, files: DataFrame) -> DataFrame:
    return changed_files(hunks, files).select(*PAIR_KEYS).distinct()


def _kept(count: Column, gone: Column) -> Column:
    """Line numbers 1..count without the ones that exist on this side only, in order."""
    everything = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast(INTS))
    return F.array_except(everything, gone)


def line_map(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Child line -> parent line (NULL for none) of every changed file.

    The k-th child line that was not inserted is the k-th parent line that was not deleted.
    Both survivor lists are built inside the file's row and zipped; nothing is ranked or
    joined line by line.
    """
    return _map_rows(changed_files(hunks, files))


def _map_rows(changed: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(
        _kept(F.col("child_loc"), F.col("inserted_lines")).alias("c"),
        _kept(F.col("parent_loc"), F.col("deleted_lines")).alias("p"),
    )
    matched = F.transform(zipped, lambda z: F.struct(z["c"].alias("child_line"), z["p"].alias("parent_line")))
    inserted = F.filter("inserted_lines", lambda i: i.between(F.lit(1), F.col("child_loc")))
    new = F.transform(inserted, lambda i: F.struct(i.alias("child_line"), F.lit(None).cast("int").alias("parent_line")))
    return (
        changed.select(*PAIR_KEYS, "path", F.explode(F.concat(matched, new)).alias("m"))
        .filter(F.col("m.child_line").isNotNull())
        .select(*PAIR_KEYS, "path", "m.child_line", "m.parent_line")
    )


def line_changes(hunks: DataFrame) -> DataFrame:
    """One row per changed line: kind added (child side), deleted (parent side) or modified."""
    return _change_rows(_file_hunks(hunks), ["added", "deleted", "modified"])


def _change_rows(rows: DataFrame, kinds: list[str]) -> DataFrame:
    lists = {"added": "inserted_lines", "deleted": "deleted_lines", "modified": "modified_lines"}

    def tagged(kind: str) -> Column:
        return F.transform(lists[kind], lambda l: F.struct(l.alias("line"), F.lit(kind).alias("kind")))

    return rows.select(*PAIR_KEYS, "path", F.explode(F.concat(*[tagged(k) for k in kinds])).alias("r")).select(*PAIR_KEYS, "path", "r.*")


def _upto(lines: str, x: Column) -> Column:
    """How many numbers of a sorted array are ``x`` or less, found by halving."""
    bits = F.reverse(F.sequence(F.lit(0), F.length(F.bin(F.size(lines))) - 1))

    def further(at: Column, bit: Column) -> Column:
        there = at + F.call_function("shiftleft", F.lit(1), bit)
        # Beyond the end there is no number, which compares as unknown.
        return F.when(F.get(lines, there - 1) <= x, there).otherwise(at)

    return F.aggregate(bits, F.lit(0), further)


def line_offsets(changed: DataFrame, side: str) -> DataFrame:
    """The line map of each changed file as seen from one side, in one row and without a row a line.

    PAIR_KEYS, path, ``loc``; ``own``, the lines that exist on this side only; ``shift``, for
    each line that exists on the other side only the number of common lines before it;
    ``left``, the common lines of the other side; ``edits``, the lines that count as touched.
    All arrays rise.
    """
    other = {"child": "parent", "parent": "child"}[side]
    lists = {"child": "inserted_lines", "parent": "deleted_lines"}

    def within(lines: str, loc: Column) -> Column:
        return F.array_sort(F.filter(lines, lambda x: x.between(F.lit(1), loc)))

    loc, other_loc = F.col(f"{side}_loc"), F.col(f"{other}_loc")
    edits = F.array_sort(F.array_union(lists[side], "modified_lines"))
    return (
        changed.withColumn("own", within(lists[side], loc))
        .withColumn("theirs", within(lists[other], other_loc))
        .select(
            *PAIR_KEYS, "path", loc.alias("loc"), "own", F.transform("theirs", lambda x, k: x - k - 1).alias("shift"),
            (other_loc - F.size("theirs")).alias("left"),
            # A touched line of the child has to exist; what the parent lost counts wherever it is said to be.
            (F.filter(edits, lambda x: x.between(F.lit(1), loc)) if side == "child" else edits).alias("edits"),
        )
    )


def _side(fragments: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return fragments.withColumnRenamed("sha", f"{side}_sha").withColumnRenamed("file_path", "path").join(
        pairs, ["project", f"{side}_sha"]
    )


def _mapped(side_rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Fragments of one side with the other side's line at both ends and what happened inside.

    Common lines are counted: the k-th of one side is the k-th of the other. Fragments of
    files without a change keep their lines.
    """
    whole = [*PAIR_KEYS, "language", "clone_id", "fragment_index", "set_order", "path", "start_line", "end_line"]
    start, end, loc, left = (F.col(c) for c in ("start_line", "end_line", "loc", "left"))
    same = loc.isNull()
    at = {"s": start, "e": end, "s0": start - 1, "e0": end - 1}
    rows = side_rows.join(offsets, [*PAIR_KEYS, "path"], "left")
    # Lines up to a place that this side shares; ``own`` and ``edits`` are searched, never spread.
    rows = rows.select("*", *[(x - _upto("own", x)).alias(f"_{n}") for n, x in at.items()])
    rows = rows.select("*", *[(F.col(f"_{n}") + _upto("shift", F.col(f"_{n}") - 1)).alias(f"_to_{n}") for n in ("s", "e")])

    def other(n: str) -> Column:
        known = at[n].between(F.lit(1), loc) & (F.col(f"_{n}") > F.col(f"_{n}0")) & (F.col(f"_{n}") <= left)
        return F.when(known, F.col(f"_to_{n}"))

    def common(n: str) -> Column:
        shared = F.when(at[n] > loc, loc - F.size("own")).otherwise(F.col(f"_{n}"))
        return F.greatest(F.lit(0), F.least(shared, left))

    inside = _upto("edits", end) > _upto("edits", start - 1)
    return rows.select(
        *whole,
        F.when(same, start).otherwise(other("s")).alias("other_start"),
        F.when(same, end).otherwise(other("e")).alias("other_end"),
        F.when(same, end - start + 1).otherwise(common("e") - common("s0")).alias("survivors"),
        F.when(same, F.lit(False)).otherwise(inside).alias("touched"),
    )


def surviving_lines(fragments: DataFrame, pairs: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Parent lines that survive inside each child fragment; 0 means the fragment is new."""
    child = _mapped(_side(fragments, pairs, "child"), line_offsets(changed_files(hunks, files), "child"))
    return child.select(*PAIR_KEYS, "language", "clone_id", "fragment_index", F.col("survivors").cast("bigint").alias("survivors"))


def _blocks(low: str, high: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / LINE_BLOCK), F.floor(F.col(high) / LINE_BLOCK)))


def transitions(fragments: DataFrame, pairs: DataFrame, hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Parent of every child fragment and what happened to it: added, modified or stable.

    ``fragments``: project, sha, language, clone_id, fragment_index, set_order, file_path,
    start_line, end_line. A parent on the same path fits when both ends map onto its ends;
    or it is shorter and both its ends lie inside the child; or it is longer and both child
    ends map inside it. The parent listed first wins. Since the line map rises, these tests
    need the four mapped end points only, and candidates meet on line blocks.
    """
    keys = [*PAIR_KEYS, "language", "path"]
    # Each is read several times below; staged, the views behind them are planned and run once.
    changed = staged(changed_files(hunks, files))
    live = pairs.select(*PAIR_KEYS).join(changed.select(*PAIR_KEYS).distinct(), PAIR_KEYS, "left_semi")
    child, parent = (staged(_mapped(_side(fragments, live, side), line_offsets(changed, side))) for side in ("child", "parent"))
    child_id = ["clone_id", "fragment_index"]

    def named(df, tag, *columns):
        return df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in columns])

    cols = ["clone_id", "fragment_index", "set_order", "start_line", "end_line", "other_start", "other_end", "touched"]
    c = named(child.filter(F.col("survivors") > 0), "c", *cols)
    p = named(parent, "p", *cols)
    c_len = F.col("c_end_line") - F.col("c_start_line")
    p_len = F.col("p_end_line") - F.col("p_start_line")

    # The child's first line lands inside the parent: equal ends, or a longer parent.
    onto = (
        c.filter(F.col("c_other_start").isNotNull())
        .withColumn("_b", F.floor(F.col("c_other_start") / LINE_BLOCK))
        .join(p.withColumn("_b", _blocks("p_start_line", "p_end_line")), [*keys, "_b"])
        .filter(
            ((F.col("c_other_start") == F.col("p_start_line")) & (F.col("c_other_end") == F.col("p_end_line")))
            | (
                (p_len > c_len)
                & F.col("c_other_start").between(F.col("p_start_line"), F.col("p_end_line"))
                & F.col("c_other_end").between(F.col("p_start_line"), F.col("p_end_line"))
            )
        )
    )
    # The parent's first line lands inside a longer child.
    inside = (
        p.filter(F.col("p_other_start").isNotNull())
        .withColumn("_b", F.floor(F.col("p_other_start") / LINE_BLOCK))
        .join(c.withColumn("_b", _blocks("c_start_line", "c_end_line")), [*keys, "_b"])
        .filter(
            (p_len < c_len)
            & F.col("p_other_start").between(F.col("c_start_line"), F.col("c_end_line"))
            & F.col("p_other_end").between(F.col("c_start_line"), F.col("c_end_line"))
        )
    )
    best = F.min(
        F.struct(
            F.col("p_set_order").alias("o"), F.col("p_fragment_index").alias("fragment_index"),
            F.col("p_clone_id").alias("clone_id"), F.col("p_touched").alias("touched"),
        )
    )
    found = (
        onto.unionByName(inside, allowMissingColumns=True)
        .groupBy(*keys, F.col("c_clone_id").alias("clone_id"), F.col("c_fragment_index").alias("fragment_index"))
        .agg(best.alias("parent"))
    )
    kind = (
        F.when(F.col("parent").isNull(), "added")
        .when(F.col("touched") | F.col("parent.touched"), "modified")
        .otherwise("stable")
    )
    return child.join(found, [*keys, *child_id], "left").select(
        *PAIR_KEYS, "language", "path", *child_id, "set_order", "start_line", "end_line",
        F.col("parent.clone_id").alias("parent_clone_id"),
        F.col("parent.fragment_index").alias("parent_index"),
        kind.alias("type"),
    )


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _reached(heads: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """The nodes that moves lead to from ``heads``, themselves included.

    Moves are composed for 1, 2, 4, ... steps; each round doubles the steps that are known.
    """
    found, jumps = heads, edges
    for k in range(rounds):
        onward = found.join(jumps, NODE_KEYS).select(
            *PROJECT_KEYS, (F.col("at") + (1 << k)).alias("at"), F.col("to_id").alias("clone_id"), F.col("to_index").alias("fragment_index")
        )
        found = staged(found.unionByName(onward).distinct())
        if k + 1 < rounds:
            middle = _renamed(jumps, {"clone_id": "to_id", "fragment_index": "to_index", "to_id": "far_id", "to_index": "far_index"})
            there = middle.withColumn("at", F.col("at") - (1 << k))
            jumps = staged(_renamed(jumps.join(there, [*PROJECT_KEYS, "at", "to_id", "to_index"]).drop("to_id", "to_index"), {"far_id": "to_id", "far_index": "to_index"}))
    return found


def _first_of_chain(links: DataFrame, rounds: int) -> DataFrame:
    """Where each node's chain of ``links`` (node -> from_at, from_id, from_index) begins, by doubling the links."""
    pointers = ["from_at", "from_id", "from_index"]
    for _ in range(rounds):
        before = links.select(
            *PROJECT_KEYS, F.col("at").alias("from_at"), F.col("clone_id").alias("from_id"), F.col("fragment_index").alias("from_index"),
            *[F.col(p).alias(f"_{p}") for p in pointers],
        )
        # A node without a link is the first of its chain.
        links = staged(
            links.join(before, [*PROJECT_KEYS, *pointers], "left").select(*NODE_KEYS, *[F.coalesce(f"_{p}", p).alias(p) for p in pointers])
        )
    return links


def head_history(head: DataFrame, moves: DataFrame, steps: int) -> DataFrame:
    """Modification history of the head fragments, newest entry first.

    ``head``: FRAGMENT_KEYS of the newest snapshot. ``moves``: transitions with ``step``, the
    ordinal of the child commit counted from the head; a project-language without moves in a
    step keeps its mapping. When several children that the head leads to meet in one parent,
    the last child in list order carries on. Both types log the newer commit.

    Which fragments the head leads to is found by composing moves for 1, 2, 4, ... steps.
    Among those, the children that carry on form chains, and a fragment's head is the first
    of its chain, found in the same way: some three joins for each doubling of the steps,
    each staged in the shared folder, so neither jobs nor plan grow with the commits.
    """
    kept = ["step", *FRAGMENT_KEYS, "set_order", "parent_clone_id", "parent_index", "type", "child_sha"]
    moves = staged(moves.filter(F.col("step").between(0, steps - 1)).select(*kept))
    # Only steps in which a project-language has moves take it further.
    busy = moves.select(*PROJECT_KEYS, "step").distinct().withColumn("at", F.row_number().over(W.partitionBy(*PROJECT_KEYS).orderBy("step")) - 1)
    moves = moves.join(busy, [*PROJECT_KEYS, "step"])
    rounds = max(0, steps - 1).bit_length()
    heads = head.select(*PROJECT_KEYS, F.lit(0).alias("at"), "clone_id", "fragment_index").distinct()
    edges = moves.filter(F.col("type") != "added").select(*NODE_KEYS, F.col("parent_clone_id").alias("to_id"), F.col("parent_index").alias("to_index"))
    live = staged(moves.join(_reached(heads, edges, rounds), NODE_KEYS))
    last = F.max(F.struct("set_order", "fragment_index", "clone_id"))
    links = (
        live.filter(F.col("type") != "added")
        .groupBy(*PROJECT_KEYS, (F.col("at") + 1).alias("at"), "parent_clone_id", "parent_index")
        .agg(last.alias("_c"))
        .select(
            *PROJECT_KEYS, "at", F.col("parent_clone_id").alias("clone_id"), F.col("parent_index").alias("fragment_index"),
            (F.col("at") - 1).alias("from_at"), F.col("_c.clone_id").alias("from_id"), F.col("_c.fragment_index").alias("from_index"),
        )
    )
    firsts = _first_of_chain(links, rounds).drop("from_at")
    named = live.filter(F.col("type") != "stable").join(firsts, NODE_KEYS, "left").select(
        *PROJECT_KEYS, F.coalesce("from_id", "clone_id").alias("clone_id"), F.coalesce("from_index", "fragment_index").alias("fragment_index"),
        F.struct("step", F.struct("type", F.col("child_sha").alias("commit")).alias("e")).alias("entry"),
    )
    logs = named.groupBy(*FRAGMENT_KEYS).agg(
        F.transform(F.array_sort(F.collect_list("entry")), lambda x: x["e"]).alias("modification")
    )
    empty = F.array().cast("array<struct<type:string,commit:string>>")
    return head.join(logs, FRAGMENT_KEYS, "left").withColumn("modification", F.coalesce("modification", empty))


def head_state(snapshot: DataFrame) -> DataFrame:
    """Head fragments before any history is known."""
    return snapshot.withColumn("modification", F.array().cast("array<struct<type:string,commit:string>>"))
