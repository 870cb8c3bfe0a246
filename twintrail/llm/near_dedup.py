"""Near-dedup: b-bit MinHash signatures, a multi-index Hamming join by pigeonhole, exact confirmation on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import ROW, hold, numbered, release
from twintrail.llm.components import components
from twintrail.llm.words import PLACES, chunks, mixed, run_hashes, word_hashes

WORDS = 5
#: Texts are linked from this similarity on, as a ratio of whole numbers.
SIMILAR, OF = 75, 100
#: A signature has 16 chunks of 4 slots of 16 bits. Signatures that differ in 31 slots or fewer
#: share, in some chunk, all but one slot: 31 errors over 16 chunks leave one with at most one. At
#: a similarity of 0.75 a slot differs with chance 0.25, so more than 31 of 64 do with chance 2e-5.
CHUNKS, SLOTS, BITS = 16, 4, 16
MAX_DISTANCE = 2 * CHUNKS - 1
#: Bytes of a shingle's hash in the sets that links are confirmed on.
HASH_BYTES = 6

_RANDOM = np.random.Generator(np.random.PCG64(75))
_FLIP = _RANDOM.integers(0, 2**63, CHUNKS * SLOTS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, CHUNKS * SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES = [f"code{c}" for c in range(CHUNKS)]
#: Before two nodes are compared on their sets, sketches of 512 further slots of 8 bits have to differ in
#: at most 175: at a similarity of 0.75, 128 do on average, and more than 175 with chance 1e-6.
SKETCH, MAX_SKETCH_DISTANCE = 512, 175
#: The nearest node of another component is compared first if its sketch is so near.
NEAREST_DISTANCE = 128
_SKETCH_FLIP = _RANDOM.integers(0, 2**63, SKETCH, dtype=np.uint64)
_SKETCH_TIMES = _RANDOM.integers(0, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Nodes on one key that are compared by one task at once; more are dealt into blocks, and pairs of blocks are compared.
BLOCK_NODES = 1024
_SHIFT = np.uint64(64 - 8 * HASH_BYTES)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of WORDS words; of all words where there are fewer."""
    if len(words) >= WORDS:
        return np.unique(run_hashes(words, WORDS) >> _SHIFT)
    if len(words):
        return mixed((words * PLACES[: len(words)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words))) >> _SHIFT
    return np.zeros(0, np.uint64)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in chunks(texts):
        words, firsts = word_hashes(data, offsets)
        for i in range(len(offsets) - 1):
            yield shingles(words[firsts[i] : firsts[i + 1]])


def _minima(found: np.ndarray, flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The smallest of a set's values under each hash function, mixed."""
    low = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    spread = mixed(found)
    for at in range(0, len(spread), 1024):
        np.minimum(low, ((spread[at : at + 1024, None] ^ flip) * times).min(axis=0), out=low)
    return mixed(low)


def signature(found: np.ndarray) -> np.ndarray:
    """The CHUNKS codes of a set: its minima under 64 hash functions, cut to BITS bits."""
    slots = (_minima(found, _FLIP, _TIMES) >> np.uint64(64 - BITS)).reshape(CHUNKS, SLOTS)
    return (slots << (np.arange(SLOTS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """The set's minima under SKETCH more hash functions, cut to 8 bits."""
    return (_minima(found, _SKETCH_FLIP, _SKETCH_TIMES) >> np.uint64(56)).astype(np.uint8).tobytes()


def digest(found: np.ndarray) -> tuple[int, int]:
    """Two sums over the set that tell sets apart, 128 bits."""
    if not len(found):
        return 0, 0
    one = mixed(found + np.uint64(0x9E3779B97F4A7C15))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(mixed(one * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).view(np.int64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, first, second, codes = [], [], [], []
        for found in sets_of(batch["text"]):
            d = digest(found)
            sizes.append(len(found))
            first.append(d[0])
            second.append(d[1])
            codes.append(signature(found) if len(found) else np.zeros(CHUNKS, np.int64))
        table = np.array(codes, np.int64).reshape(-1, CHUNKS)
        columns = [batch[ROW], batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, first, second)), *(pa.array(np.ascontiguousarray(table[:, c])) for c in range(CHUNKS))]
        yield pa.record_batch(columns, [ROW, "doc_id", "n_shingles", "d0", "d1", *CODES])


def features(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, n_shingles, d0, d1, code0 .. code15) of each text: set size, set digest, signature."""
    schema = ", ".join(f"{c} long" for c in [ROW, "doc_id", "n_shingles", "d0", "d1", *CODES])
    return numbered(docs.select("doc_id", "text")).select(ROW, "doc_id", "text").mapInArrow(_features, schema)


def chunk_keys() -> Column:
    """The signature's 64 keys: each chunk with each one of its slots left out, and which those are."""
    keys = []
    for c, code in enumerate(CODES):
        for left_out in range(SLOTS):
            low = F.col(code).bitwiseAND(F.lit((1 << BITS * left_out) - 1).cast("long"))
            high = F.shiftleft(F.shiftrightunsigned(code, BITS * (left_out + 1)), BITS * left_out) if left_out < SLOTS - 1 else F.lit(0).cast("long")
            tag = F.lit((c * SLOTS + left_out) << BITS * (SLOTS - 1)).cast("long")
            keys.append(low.bitwiseOR(high).bitwiseOR(tag))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    """Slots in which the signatures of two aliased rows differ."""
    total = F.lit(0)
    for code in CODES:
        other = F.col(f"{a}.{code}").bitwiseXOR(F.col(f"{b}.{code}"))
        for k in range(SLOTS):
            mask = ((1 << BITS) - 1) << BITS * k
            total = total + (other.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) != 0).cast("int")
    return total


def near_sizes(a: str, b: str) -> Column:
    """Set sizes that leave the similarity possible."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return OF * F.least(x, y) >= SIMILAR * F.greatest(x, y)


def _pack(found: np.ndarray) -> bytes:
    return np.ascontiguousarray(found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return wide.view("<u8").ravel()


def _packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(sets_of(batch["text"]))
        both = [digest(x) for x in found]
        columns = [pa.array([d[0] for d in both], pa.int64()), pa.array([d[1] for d in both], pa.int64()), pa.array([_pack(x) for x in found], pa.binary())]
        columns.append(pa.array([sketch(x) for x in found], pa.binary()))
        yield pa.record_batch(columns, ["d0", "d1", "shingles", "sketch"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            one, two = _unpack(x.as_py()), _unpack(y.as_py())
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(OF * both >= SIMILAR * (len(one) + len(two) - both))
        yield pa.record_batch([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets, ``sets`` (node, shingles), are similar enough."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _comparer(nearest: bool):
    """A function over rows of (key, pair of blocks) that come together: pairs (a, b, far) of different components that may be similar enough.

    With ``nearest``, for each component but the one with most of the rows, its nearest pair.
    Else all of them, a pair that meets on several keys from the first of these only.
    """
    marks = ("key", "low", "high")

    def compare(table: pa.Table) -> tuple[list, list, list]:
        node, component, size, block = (table[c].to_numpy() for c in ("node", "component", "n_shingles", "block"))
        key, low, high = (table[c][0].as_py() for c in marks)
        slots = np.ascontiguousarray(np.stack([table[c].to_numpy() for c in CODES], axis=1)).view(np.uint16)
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
        tag = key >> BITS * (SLOTS - 1)
        first, second, far = [], [], []
        names, counts = np.unique(component, return_counts=True)
        major, closest = names[counts.argmax()], {}
        for i in range(len(node)):
            if nearest and component[i] == major:
                continue
            apart = component != component[i]
            if low != high:
                apart &= (block != block[i]) if nearest else (block > block[i])
            elif not nearest:
                apart &= node > node[i]
            others = np.flatnonzero(apart)
            others = others[OF * np.minimum(size[others], size[i]) >= SIMILAR * np.maximum(size[others], size[i])]
            distance = (sketches[others] != sketches[i]).sum(axis=1)
            within = distance <= (NEAREST_DISTANCE if nearest else MAX_SKETCH_DISTANCE)
            others, distance = others[within], distance[within]
            if nearest:
                if len(others):
                    best = np.lexsort((node[others], distance))[0]
                    pair = (int(distance[best]), int(node[i]), int(node[others[best]]))
                    closest[component[i]] = min(pair, closest.get(component[i], pair))
                continue
            if len(others):
                same = (slots[others] == slots[i]).reshape(-1, CHUNKS, SLOTS)
                at = (same.sum(axis=2) >= SLOTS - 1).argmax(axis=1)
                left_out = (~same[np.arange(len(others)), at]).argmax(axis=1)
                own = (at * SLOTS + left_out == tag) & (same.sum(axis=(1, 2)) >= CHUNKS * SLOTS - MAX_DISTANCE)
                others, distance = others[own], distance[own]
            first += [node[i]] * len(others)
            second += node[others].tolist()
            far += distance.tolist()
        for distance, one, other in closest.values():
            first.append(one)
            second.append(other)
            far.append(distance)
        return first, second, far

    def finish(table: pa.Table) -> pa.RecordBatch:
        places = np.stack([table[c].to_numpy() for c in marks])
        bounds = np.append(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1, table.num_rows)
        columns, start = ([], [], []), 0
        for bound in bounds.tolist():
            if bound - start > 1:
                for column, found in zip(columns, compare(table.slice(start, bound - start))):
                    column += found
            start = bound
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["a", "b", "far"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last key may go on in the next batch: its rows wait.
            ends = [[b[c][k].as_py() for c in marks] for b, k in ((batch, 0), (batch, batch.num_rows - 1))]
            if waiting and ends[0] == ends[1] == [waiting[-1][c][waiting[-1].num_rows - 1].as_py() for c in marks]:
                waiting.append(batch)
                continue
            table = pa.Table.from_batches([*waiting, batch])
            same = np.logical_and.reduce([table[c].to_numpy() == v for c, v in zip(marks, ends[1])])
            done = int(np.argmax(same))
            if done:
                yield finish(table.slice(0, done))
            waiting = table.slice(done).to_batches()
        if waiting:
            yield finish(pa.Table.from_batches(waiting))

    return run


def pairs_apart(placed: DataFrame, info: DataFrame, nearest: bool = False) -> DataFrame:
    """(a, b, far): pairs that meet on a key in ``placed`` (key, node, component), from different components, whose signatures and sketches are near."""
    keys = placed.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"), F.count(F.lit(1)).alias("n")).where("one <> other")
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("int")
    rows = placed.join(keys.select("key", blocks.alias("blocks")), "key").join(info, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    rows = rows.select("key", "low", "high", "block", "node", "component", "n_shingles", "sketch", *CODES)
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_comparer(nearest), "a long, b long, far long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, kept) of every row of ``docs``, a stored table.

    Two texts are linked when 100 * shared >= 75 * all of their distinct 5-word shingles. The
    component is the smallest doc_id that links lead to; that row is kept.

    1. Texts with the same set are one node, so copies cost nothing further.
    2. Nodes whose signatures may be within the distance meet on one of 64 keys.
    3. Each node is compared with its most similar first node of a key, and then with the most
       similar node of a key that is in another component. This joins most of a large group of
       near copies, in as many comparisons as it has nodes.
    4. All other pairs that meet on a key, from different components of step 3, are compared,
       unless set sizes, the whole signatures or a longer sketch rule them out. That is decided
       where the key's nodes lie, in blocks, so that no row is made for a pair that is ruled
       out. Every pair within the signature distance is compared on its full sets, joined
       already, or surely not similar enough.

    A text without words has no shingle and is linked with nothing. Rows without a doc_id are
    linked with nothing either; their component is null and they are kept. Repeated rows share
    a component. Null texts count as empty, an empty table gives no row, other columns are not
    read. The digests that stand for equal sets have 128 bits, the hashes that stand for
    shingles within a pair 48.
    """
    spark = docs.sparkSession
    told = hold(features(docs))
    nodes = told.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("d0", "d1")
    nodes = nodes.agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), *(F.max(c).alias(c) for c in CODES))
    nodes = hold(nodes.withColumn("node", F.monotonically_increasing_id()))

    keys = nodes.select("node", F.explode(chunk_keys()).alias("key"))
    met = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = hold(keys.join(met.select("key", "lead"), "key"))
    release()

    # The sets of all nodes that meet another one, from the text of one row each.
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "d0", "d1")
    wanted = hold(wanted)
    # Documents whose id is surely not wanted are left out before the shuffle, by a filter of bounded size.
    before = {k: spark.conf.get(k) for k in BLOOM}
    for k, v in BLOOM.items():
        spark.conf.set(k, v)
    try:
        texts = docs.select("doc_id", "text").join(wanted.where("node >= 0").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        found = texts.select("text").mapInArrow(_packed_sets, "d0 long, d1 long, shingles binary, sketch binary")
        sets = found.join(wanted.select("node", "d0", "d1"), ["d0", "d1"]).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
        sets = hold(sets)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    release(wanted)

    info = nodes.select("node", "n_shingles", *CODES)
    star = met.where("node <> lead").select("lead", "node").distinct().alias("s")
    near = (
        star.join(info.alias("x"), F.col("s.lead") == F.col("x.node"))
        .join(info.alias("y"), F.col("s.node") == F.col("y.node"))
        .select(F.col("s.lead").alias("a"), F.col("s.node").alias("b"), distance("x", "y").alias("far"), near_sizes("x", "y").alias("possible"))
        .where(F.col("possible") & (F.col("far") <= MAX_DISTANCE))
    )
    best = near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    first_links = hold(confirmed(hold(best), sets))
    release()

    info = info.join(sets.select("node", "sketch"), "node")

    def placed(links: DataFrame) -> DataFrame:
        found = met.select("key", "node").join(components(links), "node", "left")
        return hold(found.select("key", "node", F.coalesce("component", "node").alias("component")))

    place = placed(first_links)
    best = pairs_apart(place, info, nearest=True).groupBy("a").agg(F.min(F.struct("far", "b")).alias("best"))
    best = hold(best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct())
    release(place)
    links = hold(first_links.unionByName(confirmed(best, sets)))
    release(best)

    place = placed(links)
    others = hold(pairs_apart(place, info).select("a", "b"))
    release(place)
    links = hold(links.unionByName(confirmed(others, sets)))
    release(others)

    labels = nodes.select("d0", "d1", "doc_id", "node").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(lowest, "component").select("d0", "d1", "component_id")
    linked = told.select(ROW, "doc_id", "n_shingles", "d0", "d1").join(named, ["d0", "d1"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select(ROW, "doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


#: Let Spark's run-time filter go before the join that fetches texts, whatever the table's size.
BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}
