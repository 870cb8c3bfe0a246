"""Clone grouping over text, and the clone-set taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twintrail.constants import MIN_CLONE_TOKENS, PROJECT_KEYS, SET_KEYS
from twintrail.functions import source_lines as S
from twintrail.functions.labels import category_of_codebase
from twintrail.functions.paths import is_test_path
from twintrail.operators.ranks import dense_index
from twintrail.operators.services import first_codebase
from twintrail.session import dropped, staged

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
FILES_PER_CHUNK = 65536
#: A token's place takes so many bits of an anchor's rank; later ones in a longer file only settle ties otherwise.
PLACE_BITS = 28
#: Files are hashed together until they have so many tokens; a file is never cut.
TOKENS_AT_ONCE = 1 << 20
_LOW64 = (1 << 64) - 1
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def declaration_lines(files: DataFrame) -> DataFrame:
    """Lines of every file with a declaration flag and the commented-out text.

    ``files``: project, language, file_id, text. The number of lines never changes.
    """
    lines = F.split("text", "\n")
    in_block = F.exists("_blocks", lambda b: F.col("line_no").between(b["first"], b["last"]))
    flag = in_block | S.single_line_declaration(F.trim("line"), F.col("language"))
    return (
        files.withColumn("_blocks", S.declaration_blocks(lines, F.col("language")))
        .select(*PROJECT_KEYS, "file_id", "_blocks", F.posexplode(lines).alias("p", "line"))
        .withColumn("line_no", F.col("p") + 1)
        .withColumn("is_declaration", flag)
        .select(
            *PROJECT_KEYS, "file_id", "line_no", "line", "is_declaration",
            F.when(F.col("is_declaration"), F.concat(S.comment_prefix("language"), F.col("line")))
            .otherwise(F.col("line")).alias("masked_line"),
        )
    )


def _line_tokens(line: Column, normalise: bool) -> Column:
    text = F.regexp_replace(line, r"[0-9]+", "0") if normalise else line
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _tokens(files: DataFrame, mask: bool, normalise: bool) -> DataFrame:
    """(PROJECT_KEYS, file_id, one, two, at): two hashes of each token of the files, and its line."""
    lines = F.split("text", "\n")

    def tokens_of(line: Column, i: Column) -> Column:
        found = _line_tokens(line, normalise)
        if not mask:
            return found
        hidden = S.single_line_declaration(F.trim(line), F.col("language")) | F.exists(
            "_blocks", lambda b: (i + 1).between(b["first"], b["last"])
        )
        return F.when(hidden, F.slice(found, 1, 0)).otherwise(found)

    # Dealt by id first: how many files a task reads says little about how many tokens they have. The number of
    # tasks is given, for few bytes make much work here and would be put together.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = files.select(*PROJECT_KEYS, "file_id", "text").repartition(tasks, "file_id")
    base = base.withColumn("_blocks", S.declaration_blocks(lines, F.col("language"))) if mask else base
    at = F.flatten(F.transform("found", lambda w, i: F.array_repeat(i + 1, F.size(w))))
    return (
        base.select(*PROJECT_KEYS, "file_id", F.transform(lines, tokens_of).alias("found"))
        .select(*PROJECT_KEYS, "file_id", F.flatten("found").alias("words"), at.alias("at"))
        .select(
            *PROJECT_KEYS, "file_id", F.transform("words", lambda w: F.xxhash64(w)).alias("one"),
            F.transform("words", lambda w: F.xxhash64(F.lit(2), w)).alias("two"), "at",
        )
    )


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of two hashes each, in this order."""
    found = (a ^ np.uint64(seed * 0x9E3779B97F4A7C15 & _LOW64)) * np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(31)
    found += b
    found *= np.uint64(0x94D049BB133111EB)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xFF51AFD7ED558CCD)
    found ^= found >> np.uint64(32)
    return found


def _turned(values: np.ndarray, by: int) -> np.ndarray:
    return values << np.uint64(by) | values >> np.uint64(64 - by)


def _xxhash64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``F.xxhash64`` gives for two long columns: anchors, and so the sets of files under one id, follow from it."""
    found = np.uint64(42)
    for part in (a, b):
        found = found + _PRIMES[4] + np.uint64(8) ^ _turned(part * _PRIMES[1], 31) * _PRIMES[0]
        found = _turned(found, 27) * _PRIMES[0] + _PRIMES[3]
        found = (found ^ found >> np.uint64(33)) * _PRIMES[1]
        found = (found ^ found >> np.uint64(29)) * _PRIMES[2]
        found = found ^ found >> np.uint64(32)
    return found


def _doubled(values: np.ndarray, length: int, combine: Callable) -> np.ndarray:
    """The combination of ``length`` neighbours from each place on, in log2(length) steps.

    ``combine`` of two values may see the same neighbour twice, so it has to allow for that.
    """
    reach = 1
    while reach < length:
        apart = min(reach, length - reach)
        values = combine(values[:-apart], values[apart:])
        reach += apart
    return values


def _numbers(batch: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return pc.list_flatten(batch[name]).to_numpy(zero_copy_only=False).view(kind)


def _some(batches: Iterator[pa.RecordBatch], min_tokens: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Files with enough tokens that are taken together, and where each begins in the tokens of all of them."""
    for batch in batches:
        # Here, for a filter in the plan would be met below the shuffle too, by tokens made for it alone.
        batch = batch.filter(pc.greater_equal(pc.list_value_length(batch["one"]), min_tokens))
        ends = np.cumsum(pc.list_value_length(batch["one"]).to_numpy().astype(np.int64))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
            yield batch.slice(first, last - first), np.concatenate([[0], ends[first:last] - before])
            first = last


def _anchored(min_tokens: int):
    gram_length = min_tokens // 2 + 1
    places = np.int64((1 << PLACE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in _some(batches, min_tokens):
            grams = _doubled(_numbers(batch, "one", np.uint64), gram_length, _xxhash64).view(np.int64)
            sizes = np.diff(begins)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            place = (np.arange(begins[-1]) - begins[owner])[: len(grams)]
            least = _doubled(grams & ~places | place, min_tokens - gram_length + 1, np.minimum)
            # Windows that end in their file; those of a file lie together.
            inside = np.flatnonzero(place[: len(least)] <= sizes[owner[: len(least)]] - min_tokens)
            least, place, owner = least[inside], place[inside], owner[inside]
            opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]))
            last = place[np.append(opens[1:], len(place)) - 1]
            key = grams[begins[owner[opens]] + (least[opens] & places)]
            found = pa.StructArray.from_arrays(
                [pa.array(key), pa.array(place[opens].astype(np.int32)), pa.array(last.astype(np.int32))], names=["key", "first", "last"]
            )
            starts = np.searchsorted(owner[opens], np.arange(len(sizes) + 1)).astype(np.int32)
            yield batch.append_column("anchors", pa.ListArray.from_arrays(pa.array(starts), found))

    return run


def with_anchors(tokens: DataFrame, min_tokens: int) -> DataFrame:
    """The files with a window, with ``anchors``: (key, first, last), windows first..last share the anchor ``key``.

    Half a window's tokens and one make a gram. A window's anchor is the gram of least hash
    among those inside it, the leftmost where several are equal. Equal windows have equal
    anchors at equal distances, so a window whose anchor occurs once has no copy. Neighbouring
    windows mostly share theirs: a file has some 4 anchors for 50 windows of 50 tokens.
    """
    anchor = T.StructType().add("key", "long").add("first", "integer").add("last", "integer")
    schema = T.StructType([*tokens.schema.fields, T.StructField("anchors", T.ArrayType(anchor))])
    return tokens.mapInArrow(_anchored(min_tokens), schema)


def _windows(min_tokens: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in _some(batches, min_tokens):
            sizes = np.diff(begins)
            halves = [_doubled(_numbers(batch, n, np.uint64), min_tokens, lambda a, b, k=k: _mixed(a, b, k)).view(np.int64) for k, n in ((1, "one"), (2, "two"))]
            at = _numbers(batch, "at", np.int32)
            first, last = (pc.struct_field(pc.list_flatten(batch["ranges"]), n).to_numpy().astype(np.int64) for n in ("first", "last"))
            owner = pc.list_parent_indices(batch["ranges"]).to_numpy()
            # All places of the ranges, one range behind the other.
            counts = last - first + 1
            ends = np.cumsum(counts)
            pos = np.arange(counts.sum()) - np.repeat(ends - counts - first, counts)
            owner = np.repeat(owner, counts)
            # A range of another file under the same id may lie behind this one's end.
            here = pos <= sizes[owner] - min_tokens
            window = np.where(here, begins[owner] + pos, 0)
            found = {n: pa.array(h[window], mask=~here) for n, h in zip(("h1", "h2"), halves)}
            after = np.append((owner[1:] == owner[:-1]) & (pos[1:] == pos[:-1] + 1), False)
            before = np.concatenate([[False], after[:-1]])
            columns = {"pos": pa.array(pos.astype(np.int32))} | found
            for name, beside, step in (("before", before & (pos - 1 <= sizes[owner] - min_tokens), -1), ("after", after & (pos + 1 <= sizes[owner] - min_tokens), 1)):
                index = np.where(beside, begins[owner] + pos + step, 0)
                columns |= {f"{name}{k + 1}": pa.array(h[index], mask=~beside) for k, h in enumerate(halves)}
            for name, step in (("first_line", 0), ("last_line", min_tokens - 1)):
                known = pos + step < sizes[owner]
                columns[name] = pa.array(at[np.where(known, begins[owner] + pos + step, 0)], mask=~known)
            rows = pa.array(owner)
            made = [batch[n].take(rows) for n in names] + list(columns.values())
            yield pa.record_batch(made, [*names, *columns])

    return run


def repeated_windows(
    files: DataFrame, min_tokens: int = MIN_CLONE_TOKENS, mask: bool = True, normalise: bool = True
) -> DataFrame:
    """Every run of ``min_tokens`` tokens that may have a copy, with its neighbours and its lines.

    (PROJECT_KEYS, file_id, pos, h1, h2, before1, before2, after1, after2, first_line,
    last_line): h1 and h2 are the halves of a 128-bit hash. Only anchors are shuffled; windows
    are made for anchors that occur twice. A neighbour that has no copy is NULL.
    """
    anchored = staged(with_anchors(_tokens(files, mask, normalise), min_tokens))
    file = [*PROJECT_KEYS, "file_id"]
    anchors = anchored.select(*file, F.inline("anchors"))
    common = anchors.groupBy(*PROJECT_KEYS, "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ranges = anchors.join(common, [*PROJECT_KEYS, "key"]).groupBy(*file).agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")
    )
    hits = anchored.drop("anchors").join(ranges, file)
    schema = T.StructType(list(hits.select(*file).schema.fields)).add("pos", "integer")
    for name in ("h1", "h2", "before1", "before2", "after1", "after2"):
        schema.add(name, "long")
    return hits.mapInArrow(_windows(min_tokens, file), schema.add("first_line", "integer").add("last_line", "integer"))


def clone_fragments(
    files: DataFrame, min_tokens: int = MIN_CLONE_TOKENS, mask: bool = True, normalise: bool = True
) -> DataFrame:
    """Clone sets of equal token runs, extended while every copy agrees.

    Windows with the same hash form a class. Two classes are linked when each copy of the
    one is followed by the other and each copy of the other is preceded by the one; linked
    classes belong to the same, longer clone set. A class never has to be gathered: counts
    and smallest/largest neighbours decide the links, and they combine before the shuffle.
    """
    made = repeated_windows(files, min_tokens, mask, normalise)
    windows = staged(made)
    dropped(made)
    keys = [*PROJECT_KEYS, "h1", "h2"]

    def only(*columns):
        """The neighbour every copy has, by its two halves; NULL if they differ or one has none."""
        agree = [(F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))) for c in columns]
        return [F.when(agree[0] & agree[1], F.min(c)).alias(c) for c in columns]

    # Repeated classes are few beside the windows; staged, they are counted only once.
    classes = staged(
        windows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"), *only("before1", "before2"), *only("after1", "after2"))
        .filter(F.col("copies") >= 2)
    )
    # A link has to hold from both ends, so the two keys are compared together.
    back = ["before1", "before2"]
    forward = classes.select(
        *PROJECT_KEYS, F.col("h1").alias("before1"), F.col("h2").alias("before2"), F.col("after1").alias("h1"), F.col("after2").alias("h2")
    ).filter("h1 IS NOT NULL")
    linked = classes.join(forward.withColumn("joins", F.lit(True)), [*keys, *back], "left").select(
        *keys, F.col("joins").isNull().alias("opens")
    )
    order = W.partitionBy(*PROJECT_KEYS, "file_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    # By whole numbers, so that no run is sorted for it; both halves are those of the same row.
    identity = F.concat(*[F.lpad(F.lower(F.hex(F.min_by(c, "pos"))), 16, "0") for c in ("h1", "h2")])
    fragments = (
        windows.select(*keys, "file_id", "pos", "first_line", "last_line")
        .join(linked, keys)
        .withColumn("run", F.sum(F.col("opens").cast("int")).over(order))
        .groupBy(*PROJECT_KEYS, "file_id", "run")
        .agg(
            identity.alias("clone_id"),
            F.min("pos").alias("start_token"),
            (F.max("pos") + min_tokens - 1).alias("end_token"),
            F.min("first_line").alias("start_line"),
            F.max("last_line").alias("end_line"),
        )
        .drop("run")
    )
    # Staged, for whoever numbers or names the sets reads them more than once.
    found = staged(fragments.withColumn("token_count", F.col("end_token") - F.col("start_token") + 1))
    dropped(fragments)
    return found


def index_fragments(fragments: DataFrame) -> DataFrame:
    """0-based fragment index inside each set, by file and position; hot sets stay split."""
    chunk = F.floor(F.col("file_id") / FILES_PER_CHUNK)
    return dense_index(fragments, SET_KEYS, [F.col("file_id"), F.col("start_token")], chunk, "fragment_index")


# --- taxonomy ------------------------------------------------------------------------


def located_fragments(fragments: DataFrame, codebases: DataFrame) -> DataFrame:
    """Fragments with their code base and the category of their clone set.

    Test and production paths are looked at over the whole set, the span over located
    fragments; sets with fewer than two located fragments fall out.
    """
    placed = first_codebase(fragments, codebases)
    test = is_test_path("file_path")
    sets = (
        placed.groupBy(*SET_KEYS)
        .agg(
            F.bool_or(test).alias("has_test"),
            F.bool_or(~test).alias("has_production"),
            F.count("codebase").alias("located"),
            F.count_distinct("codebase").alias("codebases"),
        )
        .filter(F.col("located") >= 2)
        .select(*SET_KEYS, category_of_codebase("codebases", "has_test", "has_production").alias("category"))
    )
    return placed.filter(F.col("codebase").isNotNull()).join(sets, SET_KEYS)


def taxonomy(fragments: DataFrame, codebases: DataFrame) -> DataFrame:
    """Clone sets with their category and located fragments."""
    return (
        located_fragments(fragments, codebases)
        .groupBy(*SET_KEYS, "category")
        .agg(F.count(F.lit(1)).alias("fragments"))
    )
