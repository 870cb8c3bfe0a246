"""Suffix-array dedup: removes bytes covered by long strings that a text with a smaller id has too.

The suffix order of a collection of strings is built column by column (Bauer, Cox and Rosone; common
prefixes as by Cox, Garofalo, Rosone and Sciortino): each round inserts one symbol of every
string into the collection's Burrows-Wheeler transform and updates the common prefixes, in
sequential passes over both. Spark makes the collections: texts are cut into short strings such
that equal windows always meet in the same collection, so rounds are few and every collection is
small, however long a text or large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twintrail.llm.common import ROW, hold, numbered, release, whole_text
from twintrail.llm.words import POWERS, byte_values, chunks, mixed

DEPTH = 50
#: A window's anchor is the smallest hash among its strings of so many bytes.
ANCHOR_BYTES = 24
#: A string has so many windows at most, so there are DEPTH + 63 rounds at most.
MAX_WINDOWS = 64
#: Strings are taken in until they have so many bytes, and collections are ordered together up to so many.
BATCH_BYTES, ORDER_BYTES = 2_500_000, 250_000
#: An anchor with more distinct strings than this has its windows dealt one by one.
MAX_STRINGS = 20_000


def anchor_runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, number of windows, anchor) of the runs of windows with one anchor.

    A window's anchor depends on its bytes alone, so equal windows have equal anchors.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < depth:
        return none, none, none, none
    up, down = POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_values(data) * up[:n], out=sums[1:])
    low = mixed((sums[ANCHOR_BYTES:] - sums[:-ANCHOR_BYTES]) * down[: n - ANCHOR_BYTES + 1])
    width, have = depth - ANCHOR_BYTES + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    whole = np.flatnonzero(np.arange(len(low)) + depth <= offsets[text + 1])
    low, text = low[whole], text[whole]
    if not len(low):
        return none, none, none, none
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(low)))
    # Long runs, as in a text that repeats itself, are cut by the number of windows.
    pieces = -(-lengths // MAX_WINDOWS)
    run = np.repeat(np.arange(len(starts)), pieces)
    inside = (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * MAX_WINDOWS
    first = starts[run] + inside
    return text[first], whole[first], np.minimum(MAX_WINDOWS, lengths[run] - inside), low[first].view(np.int64)


def suffix_order(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes of the strings in sorted order, and what each has in common with the one before, up to ``depth``.

    Column-wise: round j inserts the suffixes of length j. The transform tells where: the
    suffix that symbol c makes in front of an entry goes behind all that c makes in front of
    earlier entries. The empty suffixes come first, in the order of the strings.
    """
    m, sizes = len(offsets) - 1, np.diff(offsets)
    symbols = data.astype(np.uint8) + np.uint8(1)  # UTF-8 has no byte 255; 0 is the start of a string
    # An entry holds the place, the common prefix and the symbol in front, from high bits to low.
    entries = (offsets[1:] << 16) | symbols[offsets[1:] - 1]
    # Entries of the last round, in order, and whose they are.
    latest, strings = np.arange(m), np.arange(m)
    for length in range(1, int(sizes.max(initial=0)) + 1):
        transform, common = entries.astype(np.uint8), (entries >> 8).astype(np.uint8)
        order = np.argsort(transform, kind="stable")
        going = transform[latest] > 0
        latest, strings = latest[going], strings[going]
        done = m - len(latest)  # entries of strings that are all in: no symbol in front
        new = np.zeros(len(entries), bool)
        new[latest] = True
        turn = np.flatnonzero(new[order])
        strings = strings[np.searchsorted(latest, order[turn])]
        at = turn + (m - done)
        start = offsets[strings + 1] - length
        before = np.where(start > offsets[strings], symbols[np.maximum(start - 1, 0)], 0)

        old = np.ones(len(entries) + len(at), bool)
        old[at] = False
        again = np.empty(len(old), np.int64)
        again[old] = entries
        again[at] = (start << 16) | before

        # New entries and those right behind them: one more than what the suffixes behind their first symbol have in common.
        fresh = ~old
        fresh[1:] |= ~old[:-1]
        touched = np.flatnonzero(fresh)
        turn = touched - (m - done)
        here, previous = order[turn], order[np.maximum(turn - 1, 0)]
        same = (turn > done) & (transform[here] == transform[previous])
        prefix = np.zeros(len(touched), np.int64)
        prefix[same] = np.minimum(_range_minimum(common, previous[same] + 1, here[same]), depth - 1) + 1
        again[touched] = (again[touched] & ~np.int64(0xFF00)) | (prefix << 8)
        entries, latest = again, at
    return entries >> 16, (entries >> 8).astype(np.uint8)


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low .. high] for many ranges, by minima over powers of two."""
    out = np.zeros(len(low), values.dtype)
    if not len(low):
        return out
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    table = values
    for k in range(int(level.max()) + 1):
        own = order[cuts[k] : cuts[k + 1]]
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        if k < level.max():
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def lowest_of_windows(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place in ``data`` the smallest ``low`` of the strings that have the window starting there."""
    out = np.full(len(data), np.iinfo(np.int64).max)
    place, common = suffix_order(data, offsets, depth)
    m = len(offsets) - 1
    place, common = place[m:], common[m:]
    string = np.searchsorted(offsets, place, "right") - 1
    starts = np.flatnonzero(common < depth)
    smallest = np.minimum.reduceat(low[string], starts)
    out[place] = np.repeat(smallest, np.diff(np.append(starts, len(place))))
    return out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["doc_id"].to_numpy()
        for first, data, offsets in chunks(batch["text"]):
            text, _, _, anchor = anchor_runs(data, offsets)
            yield pa.record_batch([pa.array(anchor), pa.array(ids[first + text])], ["anchor", "doc_id"])


def _told_apart(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for a text of a chunk and an anchor; two pairs that share one cost some work, nothing else."""
    return mixed(text.astype(np.uint64)) ^ anchor.view(np.uint64)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch[ROW].to_numpy(), batch["doc_id"].to_numpy()
        lists, first_lists = batch["anchors"], batch["firsts"]
        for first, data, offsets in chunks(batch["text"]):
            n = len(offsets) - 1
            text, start, windows, anchor = anchor_runs(data, offsets)
            known = []
            for column in (lists, first_lists):
                own = column.slice(first, n)
                known.append(_told_apart(np.repeat(np.arange(n), own.value_lengths().to_numpy()), own.flatten().to_numpy()))
            here = _told_apart(text, anchor)
            later = np.isin(here, known[0])
            keep = np.flatnonzero(later | np.isin(here, known[1]))
            text, start, windows, anchor = text[keep], start[keep], windows[keep], anchor[keep]
            raw = data.tobytes()
            pieces = [raw[a:b] for a, b in zip(start.tolist(), (start + windows + DEPTH - 1).tolist())]
            yield pa.record_batch(
                [pa.array(rows[first + text]), pa.array(ids[first + text]), pa.array((start - offsets[text]).astype(np.int64)), pa.array(anchor), pa.array(later[keep]), pa.array(pieces, pa.binary())],
                [ROW, "doc_id", "at", "anchor", "later", "string"],
            )


def _collections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s0, s1, first, last, low): runs of windows of a string that a smaller id has; the rows come sorted by anchor."""
    waiting: list[pa.RecordBatch] = []
    size = 0

    def ordered(table: pa.Table) -> pa.RecordBatch:
        strings = table["string"].combine_chunks()
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        low, high = table["low"].to_numpy(), table["high"].to_numpy()
        lowest = np.repeat(low, np.diff(offsets))
        sizes, anchors = np.diff(offsets), table["anchor"].to_numpy()
        firsts = np.append(0, np.flatnonzero(anchors[1:] != anchors[:-1]) + 1)
        counts = np.diff(np.append(firsts, len(anchors)))
        # A string that is alone with its anchor has nothing to be ordered with. The others are
        # ordered with strings about as long, since a collection has a round for each byte of its longest.
        rounds = np.repeat(np.where(counts > 1, np.maximum.reduceat(sizes, firsts), 0), counts)
        turn = np.argsort(rounds, kind="stable")
        turn = turn[np.searchsorted(rounds[turn], 1) :]
        ends = np.cumsum(sizes[turn])
        while len(turn):
            cut = int(np.searchsorted(ends, ends[0] + ORDER_BYTES))
            while cut < len(turn) and anchors[turn[cut]] == anchors[turn[cut - 1]]:
                cut += 1
            own, turn, ends = turn[:cut], turn[cut:], ends[cut:]
            cuts = np.append(0, np.cumsum(sizes[own]))
            place = np.arange(cuts[-1]) + np.repeat(offsets[own] - cuts[:-1], sizes[own])
            lowest[place] = lowest_of_windows(data[place], cuts, low[own])
        owner = np.repeat(np.arange(len(strings)), np.diff(offsets))
        at = np.arange(len(data)) - offsets[owner]
        useful = (at + DEPTH <= np.diff(offsets)[owner]) & (lowest < high[owner])
        where = np.flatnonzero(useful)
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1] + 1) | (owner[where[1:]] != owner[where[:-1]]) | (lowest[where[1:]] != lowest[where[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(where)) - 1 if len(first) else first
        first, last = where[first], where[last]
        mine = owner[first]
        return pa.record_batch(
            [pa.array(table["s0"].to_numpy()[mine]), pa.array(table["s1"].to_numpy()[mine]), pa.array(at[first]), pa.array(at[last]), pa.array(lowest[first])],
            ["s0", "s1", "first", "last", "low"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch["string"].nbytes
        if size < BATCH_BYTES:
            continue
        # An anchor may go on in the next batch: its rows wait.
        table = pa.Table.from_batches(waiting)
        anchors = table["anchor"].to_numpy()
        bounds = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
        lengths = np.cumsum(pc.binary_length(table["string"]).to_numpy())
        done = 0
        for bound in bounds[:-1].tolist():
            if lengths[bound - 1] - (lengths[done - 1] if done else 0) >= BATCH_BYTES:
                yield ordered(table.slice(done, bound - done))
                done = bound
        waiting = table.slice(done).to_batches()
        size = int(lengths[-1] - (lengths[done - 1] if done else 0))
    if waiting:
        yield ordered(pa.Table.from_batches(waiting))


def covered(docs: DataFrame) -> DataFrame:
    """(_row, spans): the bytes, as [first, end) and perhaps overlapping, of each row of ``docs`` (_row, doc_id, text) that has some to remove."""
    texts = docs.where("doc_id IS NOT NULL").select(ROW, "doc_id", whole_text().alias("text"))

    # Anchors that texts of different ids have, by id; the smallest id of an anchor has nothing to
    # lose there. A frequent anchor is one row for each text, and Spark spills it.
    anchors = texts.select("doc_id", "text").mapInArrow(_anchors, "anchor long, doc_id long")
    together = Window.partitionBy("anchor")
    shared = anchors.withColumn("low", F.min("doc_id").over(together)).withColumn("high", F.max("doc_id").over(together)).where("low <> high")
    lists = shared.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("doc_id") > F.col("low"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("doc_id") == F.col("low"), F.col("anchor"))).alias("firsts")
    )
    lists = hold(lists)
    release()

    # Strings around them, and each distinct one with the smallest and largest id that has it.
    strings = texts.join(lists, "doc_id").select(ROW, "doc_id", "text", "anchors", "firsts")
    strings = hold(strings.mapInArrow(_strings, f"{ROW} long, doc_id long, at long, anchor long, later boolean, string binary"))
    release(lists)
    key0, key1 = F.xxhash64(F.lit(0), "string").alias("s0"), F.xxhash64(F.lit(1), "string").alias("s1")
    distinct = strings.groupBy("anchor", "string").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    distinct = hold(distinct.select("anchor", "string", "low", "high", key0, key1))

    release()

    often = hold(distinct.groupBy("anchor").count().where(F.col("count") > MAX_STRINGS).select("anchor"))
    collections = distinct.join(often, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    runs = collections.mapInArrow(_collections, "s0 long, s1 long, first long, last long, low long")
    # Windows of the most frequent anchors, each dealt by its own bytes.
    windows = distinct.join(often, "anchor", "left_semi").select(
        "s0", "s1", "low", "high", "string", F.explode(F.sequence(F.lit(1), F.octet_length("string") - DEPTH + 1)).alias("k")
    )
    windows = windows.select("s0", "s1", "low", "high", (F.col("k") - 1).cast("long").alias("first"), F.substring("string", F.col("k"), F.lit(DEPTH)).alias("window"))
    lowest = windows.groupBy("window").agg(F.min("low").alias("lowest"))
    single = windows.join(lowest, "window").where("lowest < high").select("s0", "s1", "first", F.col("first").alias("last"), F.col("lowest").alias("low"))
    runs = hold(runs.unionByName(single))
    release(distinct)

    found = strings.where("later").select(ROW, "doc_id", "at", key0, key1).join(runs, ["s0", "s1"]).where("low < doc_id")
    span = F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + DEPTH).alias("end"))
    spans = hold(found.groupBy(ROW).agg(F.collect_list(span).alias("spans")))
    release(strings, runs, often)
    return spans


def _union(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of overlapping or touching spans."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    return first[new], end[np.append(new[1:], True)]


def _cut(data: bytes, first: np.ndarray, end: np.ndarray) -> bytes:
    """What is left of the text without the spans, which are in order."""
    return b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: spans that go, as [first, end) in bytes, and the bytes that stay.

    A byte goes if a 50-byte string that covers it also starts in a text with a smaller
    doc_id. What is left of a text need not be valid UTF-8, so it is binary.

    Null texts count as empty; shorter texts than 50 bytes stay. Rows without a doc_id stay
    and take nothing from others. Rows with the same doc_id take nothing from each other. An
    empty table gives no row. Other columns are not read. ``docs`` is a stored table.
    """
    rows = numbered(docs.select("doc_id", "text"))
    spans = covered(rows)
    both = rows.join(spans, ROW, "left").select("doc_id", whole_text().alias("text"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch["spans"].fill_null([])
            ends = np.append(0, np.cumsum(spans.value_lengths().to_numpy()))
            flat = spans.flatten()
            first, end = flat.field("first").to_numpy(), flat.field("end").to_numpy()
            sizes, counts, firsts, lasts, kept = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                data = text.as_py().encode("utf-8")
                sizes.append(len(data))
                if ends[i] < ends[i + 1]:
                    a, b = _union(first[ends[i] : ends[i + 1]], end[ends[i] : ends[i + 1]])
                    firsts.append(a)
                    lasts.append(b)
                    counts.append(len(a))
                    kept.append(_cut(data, a, b))
                else:
                    counts.append(0)
                    kept.append(data)
            cuts = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (firsts, lasts)], ["first", "end"])
            yield pa.record_batch([batch["doc_id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, runs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<first: long, end: long>>, kept binary")
