"""Merkle manifest of a table: one binary hash tree per language, one tree over their roots.

A tree is built in aligned blocks of 2^bits nodes. A block keeps each level as one string of
concatenated hex digests; fixed-width substrings of it are a parent's children, and the
substring that flanks a node's is its sibling. The blocks' roots are the nodes of the next
round, until one node is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintrail.llm.common import ROW, hold

#: A block has 2^BLOCK_BITS nodes, so one row holds 2^(BLOCK_BITS + 1) digests of 64 letters at most.
BLOCK_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A position in a sorted partition is the part of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33

# Levels are kept as the bytes of their letters: a substring of bytes is found without counting characters.
_LAST = "element_at(done, -1)"
_PARENTS = f"transform(sequence(0, cast((octet_length({_LAST}) - 1) div 128 as int)), i -> sha2(substring({_LAST}, 1 + 128 * i, 128), 256))"
_LEVELS = f"aggregate(filter(sequence(1, {{bits}}), k -> k <= height), array(base), (done, k) -> concat(done, array(cast(array_join({_PARENTS}, '') as binary))))"
_SIBLING = "cast(substring(element_at(levels, l + 1), 1 + 64 * (shiftright(p, l) ^ 1), 64) as string)"
_SEGMENT = f"transform(filter(sequence(0, {{bits}}), l -> l < height), l -> struct({_SIBLING} as sibling, shiftright(p, l) % 2 = 1 as left))"
_FOLD = "aggregate(path, {leaf}, (node, s) -> sha2(if(s.left, concat(s.sibling, node), concat(node, s.sibling)), 256))"


def digest(*fields: Column) -> Column:
    """SHA-256 in lower-case hex over the fields: ``-`` for null, else byte count, colon and value."""
    said = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*said), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, doc_id, node, seen): a row's language, nulls before all others, its leaf, and the leaf as it is after tampering, null where it is not touched.

    Tampering adds 1 to ``n_chars`` of the rows whose id has a CRC-32 that 7 divides. A null id is not touched.
    """
    known = [F.col(c) for c in FIELDS]
    # Wide enough for the largest count plus one.
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"), "doc_id", digest(*known).alias("node"), F.when(hit, digest(*tampered)).alias("seen")
    )


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within ``grp`` by ``order``, and ``n``, the rows of that group.

    Rows are sorted by ranges of (grp, order), so that a group of any size is spread over as
    many tasks as it needs; only one count for each group and range is summed up by one task
    a group. Rows that agree in all of ``order`` are told apart by where they are stored.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    by = ["grp", *order]
    numbered = rows.withColumn(ROW, F.monotonically_increasing_id())
    ordered = hold(
        numbered.repartitionByRange(*by, ROW).sortWithinPartitions(*by, ROW).drop(ROW).withColumn("_part", F.spark_partition_id()).withColumn("_place", place)
    )
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("grp", "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
        .select("grp", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(whole).alias("n"))
    )
    return ordered.join(starts, ["grp", "_part"]).withColumn("pos", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """(grp, block, n, height, levels, members) of (grp, pos, n, node, ...), held; ``n`` counts the nodes of the whole group."""
    others = [c for c in nodes.columns if c not in ("grp", "n")]
    # A group of more than one block goes all the way up in each of them, also where a block is short.
    height = F.expr(f"CASE WHEN n <= 1 THEN 0 WHEN n > {1 << bits} THEN {bits} ELSE length(bin(n - 1)) END")
    return hold(
        nodes.groupBy("grp", "n", F.shiftright("pos", bits).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in others if c != "pos"]))).alias("members"))
        .withColumn("height", height)
        .withColumn("base", F.array_join("members.node", "").cast("binary"))
        .withColumn("levels", F.expr(_LEVELS.format(bits=bits)))
        .drop("base")
    )


def _top(blocks: DataFrame) -> Column:
    return F.element_at("levels", -1).cast("string")


def tree(nodes: DataFrame, bits: int = BLOCK_BITS) -> list[DataFrame]:
    """The rounds of blocks over ``nodes`` (grp, pos, n, node, ...); in the last one each group has one block."""
    rounds = [_blocks(nodes, bits)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > 1 << bits:
        below = rounds[-1]
        parents = F.ceil(F.col("n") / (1 << bits)).cast("long")
        rounds.append(_blocks(below.select("grp", F.col("block").alias("pos"), parents.alias("n"), _top(below).alias("node")), bits))
        most = -(-most // (1 << bits))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(grp, node): the root of each group."""
    return rounds[-1].select("grp", _top(rounds[-1]).alias("node"))


def paths(rounds: list[DataFrame], above: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The members of the first round, each with ``path``: its siblings up to its group's root, then those of ``above`` (grp, path, ...).

    One row of siblings is joined to a whole block, from the last round down to the first.
    """
    keep = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        own = [f"members[p].{f.name} as {f.name}" for f in blocks.schema["members"].dataType.elementType.fields]
        each = f"inline(transform(sequence(0, size(members) - 1), p -> struct({', '.join(own)}, concat({_SEGMENT.format(bits=bits)}, path) as path)))"
        upper = blocks.join(upper, ["grp", "block"]).selectExpr("grp", *keep, each)
        if blocks is not rounds[0]:
            upper = upper.select("grp", *keep, F.col("pos").alias("block"), "path")
    return upper


def manifest(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves of a language ascend by doc_id, nulls first; equal ids by their leaf, so that the
    tree depends on the rows alone. Repeated rows are leaves of their own. A null field counts
    as ``-``, an empty one as ``0:``; the null language comes first and is not the empty one.
    An empty table gives no row. Other columns are neither read nor hashed.
    """
    per_lang = tree(positions(leaves(docs), ["doc_id", "node"]), bits)
    over_langs = tree(positions(roots(per_lang).select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "node"), ["lang"]), bits)
    top = roots(over_langs).first()
    nothing = F.array().cast("array<struct<sibling:string,left:boolean>>")
    langs = paths(over_langs, roots(over_langs).select("grp", nothing.alias("path")), bits)
    above = langs.select(F.col("lang").alias("grp"), "path", F.col("node").alias("subroot"))
    root = F.lit(top["node"] if top else "")
    folded = F.expr(_FOLD.format(leaf="coalesce(seen, node)"))
    return (
        paths(per_lang, above, bits)
        .select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), F.sha2(F.array_join("path.sibling", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
