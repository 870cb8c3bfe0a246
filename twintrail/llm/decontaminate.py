"""Benchmark decontamination by template canonicalisation: typed placeholders, a hash join of template windows, slot consistency."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import hold, whole_text
from twintrail.llm.words import PLACES, POWERS, byte_values, chunks, mixed, powers_down

#: Template words in a window.
WINDOW = 5
#: A document is contaminated by an item if this share of the item's windows turns up in it, consistently.
SHARE = 0.5
#: Windows of the benchmark are sent to all tasks up to this number (16 bytes each); beyond it
#: Spark joins all windows of the documents with them. Both ways give the same rows.
MAX_SENT_WINDOWS = 1_000_000
# Units of measure and currency, as whole words.
UNITS = """mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl dl l s sec secs min mins h hr hrs ms w kw mw v kv a j kj cal kcal hz khz mhz ghz pa kpa
    metre metres meter meters kilometre kilometres kilometer kilometers centimetre centimetres centimeter centimeters inch inches foot feet yard yards
    mile miles gram grams kilogram kilograms tonne tonnes ton tons pound pounds ounce ounces litre litres liter liters gallon gallons second seconds
    minute minutes hour hours day days week weeks month months year years percent degree degrees watt watts volt volts euro euros dollar dollars cent cents
    eur usd gbp""".split()
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARKS = mixed(np.arange(1, 5, dtype=np.uint64) << np.uint64(40))


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 256)))
_DIGIT, _INNER, _SIGN, _ENDS = _class(b"0123456789"), _class(b".,:/-"), _class(b"%$"), _class(b".!?:\n\r")


@dataclass
class Tokens:
    """The words of a chunk of texts: where they start and end, their types, hashes of the lower-case words."""

    starts: np.ndarray
    ends: np.ndarray
    kinds: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray  # for each text the number of its first word, one more at the end


def canonical(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Words, numbers and signs of the texts in a chunk, with their types.

    Letters are ASCII letters and all further characters but punctuation of Latin-1 and of the
    general block. A number may have marks between its digits. A name is a capital followed by
    small letters that does not open a sentence. A unit is one of UNITS right behind a number,
    or a sign. Case is that of ASCII and Latin-1.
    """
    n = len(data)
    if not n:
        return Tokens(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    letter, digit = _LETTER[data], _DIGIT[data]
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = data[:-1], data[1:]
    latin = data == 0xC2
    letter &= ~latin
    letter[1:] &= ~latin[:-1]
    general = (data == 0xE2) & ((after == 0x80) | (after == 0x81))
    for k in range(3):
        letter[k:] &= ~general[: n - k]
    digit |= _INNER[data] & _DIGIT[before] & _DIGIT[after]
    sign = _SIGN[data]
    kind = letter + 2 * digit.astype(np.int8) + 4 * sign
    begins = kind > 0
    begins[1:] &= (kind[1:] != kind[:-1]) | sign[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = kind[edges] > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Tokens(starts, starts, starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = kind > 0
    sizes = np.add.reduceat(inside.astype(np.int64), starts)
    ends = starts + sizes
    # Small letters: ASCII, and the second byte of Latin-1 capitals.
    capital = (data >= 65) & (data <= 90)
    second = (before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    low = data + (capital | second).astype(np.uint8) * np.uint8(32)
    values = byte_values(low) * POWERS.upto(n + 1)[0][:n]
    values[~inside] = 0
    hashes = mixed(np.add.reduceat(values, starts) * powers_down(n + 1)[starts] + sizes.astype(np.uint64))

    capitals = np.add.reduceat((capital | second).astype(np.int64), starts)
    opens_high = capital[starts] | ((data[starts] == 0xC3) & second[np.minimum(starts + 1, n - 1)])
    firsts = np.searchsorted(starts, offsets)
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    previous = np.concatenate([[0], ends[:-1]])
    opens = stops[starts] > stops[previous]
    opens[firsts[:-1][firsts[:-1] < len(starts)]] = True
    kinds = np.where(digit[starts], NUMBER, np.where(sign[starts], UNIT, WORD))
    behind_number = np.concatenate([[False], kinds[:-1] == NUMBER])
    behind_number[firsts[:-1][firsts[:-1] < len(starts)]] = False
    word = kinds == WORD
    known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, hashes), len(_UNIT_HASHES) - 1)] == hashes if len(_UNIT_HASHES) else np.zeros(len(starts), bool)
    kinds[word & opens_high & (capitals == 1) & (sizes > 1) & ~opens] = NAME
    kinds[word & known & behind_number] = UNIT
    return Tokens(starts, ends, kinds, hashes, firsts)


_UNIT_HASHES = np.zeros(0, np.uint64)
_UNIT_HASHES = np.sort(canonical(np.frombuffer(" ".join(UNITS).encode(), np.uint8), np.array([0, len(" ".join(UNITS))])).hashes)


def windows(found: Tokens, template: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the first word in it, hash) of each window inside a text.

    As templates, or by the plain words: a name may be a common word in a text without
    capitals, so each text has both readings. A text of fewer words is one window of its own
    size; longer texts meet it by short_windows().
    """
    h = np.where(found.kinds > 0, _MARKS[found.kinds], found.hashes) if template else found.hashes
    counts = np.diff(found.firsts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    if len(h) >= WINDOW:
        total = np.full(len(h) - WINDOW + 1, 2 * WINDOW + template, np.uint64)
        for k in range(WINDOW):
            total += h[k : len(h) - WINDOW + 1 + k] * PLACES[k]
        whole = np.flatnonzero(text_of[: len(total)] == text_of[WINDOW - 1 :])
        texts, at, hashes = text_of[whole], whole, mixed(total[whole])
    else:
        texts, at, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < WINDOW))
    if len(short):
        own = [h[found.firsts[i] : found.firsts[i + 1]] for i in short]
        sums = np.array([(x * PLACES[: len(x)]).sum(dtype=np.uint64) + np.uint64(2 * len(x) + template) for x in own], np.uint64)
        texts, at, hashes = np.concatenate([texts, short]), np.concatenate([at, found.firsts[short]]), np.concatenate([hashes, mixed(sums)])
    return texts, at, hashes


def short_windows(found: Tokens, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the first word in it, hash) of each window of so many words in a text that has more.

    By the plain words only: so few have to be the same, numbers and names too.
    """
    counts = np.diff(found.firsts)
    text_of = np.repeat(np.arange(len(counts)), counts)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for size in lengths:
        n = len(text_of) - size + 1
        if n < 1:
            continue
        total = np.full(n, 2 * size, np.uint64)
        for k in range(size):
            total += found.hashes[k : n + k] * PLACES[k]
        at = np.flatnonzero((text_of[:n] == text_of[size - 1 :]) & (counts[text_of[:n]] > size))
        out.append((text_of[at], at, mixed(total[at])))
    texts, at, hashes = (np.concatenate(x) for x in zip(*out))
    return texts, at, hashes


def slots(data: np.ndarray, found: Tokens, text: int, at: int) -> list[str]:
    """The values in a window's placeholders, in lower case, each with its type."""
    last = min(at + WINDOW, int(found.firsts[text + 1]))
    return [f"{found.kinds[k]}{data[found.starts[k] : found.ends[k]].tobytes().decode('utf-8', 'replace').lower()}" for k in range(at, last) if found.kinds[k]]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, place, hash, size, words, slots) of every window of every item; size is the item's number of windows, words that of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch["item_id"].to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch["text"]):
                found = canonical(data, offsets)
                for template in (True, False):
                    texts, at, hashes = windows(found, template)
                    counts = np.bincount(texts, minlength=len(offsets) - 1)
                    words = np.minimum(np.diff(found.firsts), WINDOW)
                    values = [slots(data, found, t, a) if template else [] for t, a in zip(texts.tolist(), at.tolist())]
                    yield pa.record_batch(
                        [pa.array(items[first + texts]), pa.array(at - found.firsts[texts], pa.int32()), pa.array(hashes.view(np.int64)), pa.array(counts[texts], pa.int32()), pa.array(words[texts], pa.int32()), pa.array(values, pa.list_(pa.string()))],
                        ["item_id", "place", "hash", "size", "words", "slots"],
                    )

    return benchmark.select("item_id", whole_text().alias("text")).mapInArrow(run, "item_id long, place int, hash long, size int, words int, slots array<string>")


def document_windows(docs: DataFrame, known: list[int] | None, lengths: list[int]) -> DataFrame:
    """(row, place, hash, slots) of the windows of ``docs`` (row, text), or of those whose hash is known; of fewer words by ``lengths``."""
    sent = None if known is None else docs.sparkSession.sparkContext.broadcast(np.sort(np.array(known, np.int64).view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch["row"].to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(batch["text"]):
                found = canonical(data, offsets)
                for template in (True, False, None):
                    texts, at, hashes = short_windows(found, lengths) if template is None else windows(found, template)
                    if sent is not None:
                        hit = np.zeros(0, np.int64)
                        if len(sent.value):
                            hit = np.flatnonzero(sent.value[np.minimum(np.searchsorted(sent.value, hashes), len(sent.value) - 1)] == hashes)
                        texts, at, hashes = texts[hit], at[hit], hashes[hit]
                    values = [slots(data, found, t, a) if template else [] for t, a in zip(texts.tolist(), at.tolist())]
                    yield pa.record_batch(
                        [pa.array(rows[first + texts]), pa.array(at - found.firsts[texts], pa.int32()), pa.array(hashes.view(np.int64)), pa.array(values, pa.list_(pa.string()))],
                        ["row", "place", "hash", "slots"],
                    )

    return docs.mapInArrow(run, "row long, place int, hash long, slots array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, max_sent: int = MAX_SENT_WINDOWS) -> DataFrame:
    """(row, item_id, shared, size, changed) of ``docs`` (row, text): windows of an item in a row.

    An item of fewer words than a window is found where these words stand in a row. Windows are
    joined by hash and laid along diagonals: all places of one copy have the same
    distance from their places in the item. On a diagonal each value of a slot in the item has
    to stand for one value in the document, else the windows that hold that slot do not count.
    ``shared`` is the number of the item's windows that are left, over all diagonals;
    ``changed`` tells whether some slot has another value than in the item.
    """
    items = hold(benchmark_windows(benchmark))
    hashes = items.select("hash").distinct()
    small = items.count() <= max_sent
    known = [r[0] for r in hashes.collect()] if small else None  # at most max_sent numbers
    lengths = [r[0] for r in items.where(F.col("words") < WINDOW).select("words").distinct().collect()]  # at most four
    met = document_windows(docs, known, lengths).alias("d").join(items.alias("i"), "hash")
    met = hold(
        met.select(
            "row", "item_id", F.col("d.place").alias("place"), F.col("i.place").alias("item_place"), "size", F.col("d.slots").alias("said"), F.col("i.slots").alias("asked"),
            (F.col("d.place") - F.col("i.place")).alias("diagonal"),
        )
    )
    on = ["row", "item_id", "diagonal"]
    pairs = met.where("size(asked) > 0").select(*on, "item_place", F.explode(F.arrays_zip("asked", "said")).alias("slot")).select(*on, "item_place", "slot.asked", "slot.said")
    bad = pairs.groupBy(*on, "asked").agg(F.min("said").alias("low"), F.max("said").alias("high")).where("low <> high").select(*on, "asked")
    torn = pairs.join(bad, [*on, "asked"], "left_semi").select(*on, "item_place").distinct()
    # Windows without slots, and the plain reading, have nothing to tear.
    plain = met.where("size(asked) = 0")
    slotted = met.where("size(asked) > 0").join(torn, [*on, "item_place"], "left_anti")
    good = plain.select("row", "item_id", "item_place", "size", F.lit(False).alias("changed")).unionByName(slotted.select("row", "item_id", "item_place", "size", (F.col("asked") != F.col("said")).alias("changed")))
    places = good.groupBy("row", "item_id", "item_place").agg(F.max("size").alias("size"), F.min("changed").alias("changed"))
    return places.groupBy("row", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"), F.max("changed").alias("changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, max_sent: int = MAX_SENT_WINDOWS) -> DataFrame:
    """(row, item_id, shared, size, changed): rows of ``docs`` (row, text) that hold at least ``share`` of an item.

    Null and empty texts hold nothing; empty items are in nothing. Items and rows that repeat
    are told apart by item_id and row only. Empty tables give no row.
    """
    return matches(docs.select("row", whole_text().alias("text")), benchmark.where("item_id IS NOT NULL"), max_sent).where(F.col("shared") >= share * F.col("size"))
