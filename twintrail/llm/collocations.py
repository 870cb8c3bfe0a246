"""Phrases whose words occur together more often than their parts do: two passes, the first one by Misra-Gries summaries.

Pass one: each block of texts tells every hash partition its n-grams as sorted 32-bit
fingerprints with counts. A partition merges them into a Misra-Gries summary whose capacity
exceeds its mass divided by the threshold, so that no n-gram of that frequency is lost, and
answers each block with one bit a fingerprint. Pass two: the blocks count the n-grams that
survived, as words, and Spark sums them exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twintrail.llm.common import hold, release, whole_text
from twintrail.llm.words import LOWER, PLACES, mixed, word_hashes

#: Texts are taken together until they have so many bytes; one text is never cut.
BLOCK_BYTES = 8 << 20
#: N-grams (with repeats) that a hash partition is meant for; its summary has a tenth as many counters.
PARTITION_MASS = 1 << 22
LONGEST = 3
MIN_COUNT, TOP = 10, 2000
#: A candidate goes if a longer one that holds it has so many hundredths of its occurrences.
ABSORBED = 50
#: Parts of a language that are ranked apart before its best phrases meet.
RANK_PARTS = 64
OUT_ROWS = 50_000
UNKNOWN_LANG = "und"

_WORD, _BLANK, _BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = _BLANK
# The bytes that end a piece.
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers, their first bytes together, then their second ones, and so on."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def words_of(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Word numbers in the order of the texts, -1 where a piece ends, and the words that they number."""
    data = LOWER[np.frombuffer("\n".join(texts).encode("utf-8"), np.uint8)]
    kind = KIND[data]
    inside = kind == _WORD
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = pa.py_buffer(data[inside].tobytes())
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), letters).dictionary_encode()
    pieces = np.cumsum(kind == _BREAK)[starts]
    numbers = words.indices.to_numpy()
    return np.insert(numbers, np.flatnonzero(np.diff(pieces)) + 1, -1), words.dictionary.cast(pa.string())


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, n_words, numbers, words) over all texts, held: word numbers and the words of each block and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        waiting: dict[str, list[str]] = defaultdict(list)

        def flush():
            nonlocal made, size
            for lang in sorted(waiting):
                numbers, words = words_of(waiting.pop(lang))
                if len(words):
                    yield pa.record_batch(
                        [pa.array([task << 32 | made]), pa.array([lang]), pa.array([int((numbers >= 0).sum())]), pa.array([pack(numbers)], pa.binary()), pa.array([words.to_pylist()], pa.list_(pa.string()))],
                        ["block", "lang", "n_words", "numbers", "words"],
                    )
                    made += 1
            size = 0

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                waiting[lang].append(text)
                size += len(text)
                if size >= block_bytes:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"), whole_text().alias("text"))
    return hold(rows.mapInArrow(run, "block long, lang string, n_words long, numbers binary, words array<string>"))


def order_of(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys. Where key and place fit into one number, only numbers are sorted, which is much faster."""
    bits = max(1, len(keys) - 1).bit_length()
    if len(keys) and int(keys.max()) >> (63 - bits):
        return np.argsort(keys, kind="stable")
    packed = keys.astype(np.int64) << bits | np.arange(len(keys))
    packed.sort()
    return packed & ((1 << bits) - 1)


class Grams:
    """The distinct n-grams of one block and language, by number of words: hash, count and a place where each occurs."""

    def __init__(self, lang: str, numbers: np.ndarray, words: pa.Array):
        self.numbers, self.words = numbers, words
        line = "\x20".join([lang.translate(str.maketrans("\t\n\v\f\r ", "______")) or "_", *words.to_pylist()]).encode("utf-8")
        hashes = word_hashes(np.frombuffer(line, np.uint8), np.array([0, len(line)]))[0]
        salt, hashes = hashes[0], hashes[1:]
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        # An n-gram is told by the number of its first words and its last word, so counts are exact within a block.
        named = numbers.astype(np.int64)
        fits = named >= 0
        for size in range(1, LONGEST + 1):
            if size > 1:
                last = numbers[size - 1 :]
                fits = fits[: len(last)] & (last >= 0)
                named = named[: len(last)] * len(words) + last
            at = np.flatnonzero(fits)
            order = order_of(named[at])
            ordered = named[at[order]]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            n = np.diff(first, append=len(order))
            places = at[order[first]]
            total = np.full(len(places), salt)
            for k in range(size):
                total += hashes[numbers[places + k]] * PLACES[k]
            self.hashes.append(mixed(total * np.uint64(2 * size + 1)))
            self.counts.append(n)
            self.places.append(places)
            named = np.full(len(fits), -1, np.int64)
            named[at[order]] = np.cumsum(new) - 1

    def keys(self, partitions: int) -> list[np.ndarray]:
        """Hash partition in the upper and fingerprint in the lower 32 bits."""
        low = np.uint64(0xFFFFFFFF)
        return [((h >> np.uint64(32)) % np.uint64(partitions)) << np.uint64(32) | (h & low) for h in self.hashes]

    def phrases(self, size: int, chosen: np.ndarray) -> pa.Array:
        at = self.places[size - 1][chosen]
        parts = [self.words.take(pa.array(self.numbers[at + k])) for k in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = order_of(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, none further below the truth than mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add the counters of another summary. Those are added up, many small ones at once, before any is cut."""
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c.astype(np.int64) for _, c in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        self.keys, self.counts = _summed(keys, counts)
        if len(self.keys) > self.capacity:
            # Each cut takes as much from capacity + 1 counters, which bounds all cuts together.
            cut = -np.partition(-self.counts, self.capacity)[self.capacity]
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut


def _told(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, grams in _grams_of(batches):
            keys = np.concatenate(grams.keys(partitions))
            keys, counts = _summed(keys, np.concatenate(grams.counts))
            parts = (keys >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            rows = []
            for a, b in zip(edges, [*edges[1:], len(keys)]):
                prints = (keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows.append((int(parts[a]), pack(np.diff(prints, prepend=np.uint32(0))), pack(np.minimum(counts[a:b], 0xFFFFFFFF))))
            p, prints, counts = zip(*rows)
            yield pa.record_batch(
                [pa.array(p, pa.int64()), pa.array([block] * len(p), pa.int64()), pa.array(prints, pa.binary()), pa.array(counts, pa.binary())], ["part", "block", "prints", "counts"]
            )

    return run


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Grams]]:
    for batch in batches:
        for row in range(batch.num_rows):
            words = batch["words"][row].values
            yield batch["block"][row].as_py(), Grams(batch["lang"][row].as_py(), unpack(batch["numbers"][row].as_py()).view(np.int32), words)


def _survivors(min_count: int):
    def run(told: pa.Table) -> pa.Table:
        """One hash partition: which fingerprints of each block are left in the merged summary."""
        counts = [unpack(c) for c in told["counts"].to_pylist()]
        mass = sum(int(c.sum(dtype=np.int64)) for c in counts)
        summary = Summary(mass // min_count)
        packed = told["prints"].to_pylist()
        prints = lambda k: np.cumsum(unpack(packed[k]), dtype=np.uint32)
        for k, n in enumerate(counts):
            summary.merge(prints(k), n)
        summary.settle()
        bits = []
        for k in range(len(packed)):
            mine = prints(k)
            near = np.minimum(np.searchsorted(summary.keys, mine), max(0, len(summary.keys) - 1))
            bits.append(np.packbits(summary.keys[near] == mine).tobytes() if len(summary.keys) else b"\0" * (-(-len(mine) // 8)))
        return pa.table([told["block"], told["part"], pa.array(bits, pa.binary())], ["block", "part", "bits"])

    return run


def _counted(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch["answers"].to_pylist()
            langs = batch["lang"].to_pylist()
            for k, (_, grams) in enumerate(_grams_of([batch])):
                keys = grams.keys(partitions)
                known = np.unique(np.concatenate(keys))
                parts = (known >> np.uint64(32)).astype(np.int64)
                alive = np.zeros(len(known), bool)
                for answer in answers[k]:
                    a, b = np.searchsorted(parts, [answer["part"], answer["part"] + 1])
                    alive[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
                for size in range(1, LONGEST + 1):
                    chosen = np.flatnonzero(alive[np.searchsorted(known, keys[size - 1])])
                    for first in range(0, len(chosen), OUT_ROWS):
                        some = chosen[first : first + OUT_ROWS]
                        phrases = grams.phrases(size, some)
                        yield pa.record_batch(
                            [pa.array([langs[k]] * len(some)), phrases, pa.array(np.full(len(some), size, np.int32)), pa.array(grams.counts[size - 1][some], pa.int64())],
                            ["lang", "phrase", "size", "f"],
                        )

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, partition_mass: int = PARTITION_MASS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every phrase of one to three words that occurs ``min_count`` times or more in its language, and (lang, n), the words of each language."""
    blocks = blocks_of(docs, block_bytes)
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    mass = LONGEST * int(blocks.agg(F.sum("n_words")).first()[0] or 0)
    partitions = max(1, -(-mass // partition_mass))
    told = blocks.mapInArrow(_told(partitions), "part long, block long, prints binary, counts binary")
    answers = told.groupBy("part").applyInArrow(_survivors(min_count), "block long, part long, bits binary")
    answers = hold(answers.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers")))
    counted = blocks.join(answers, "block").mapInArrow(_counted(partitions), "lang string, phrase string, size int, f long")
    found = hold(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))
    sizes = hold(sizes)
    release(blocks, answers)
    return found, sizes


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) by whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    square = (F.lit(1_000_000).cast("decimal(7,0)") * wide(a)).cast("decimal(22,0)") * wide(a)
    return F.call_function("div", square, wide(left) * wide(right))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, absorbed: int = ABSORBED, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words by their weakest cut.

    Words are lower-cased in A-Z only and never span a mark or a line end. The null language
    counts as ``und``, together with a language of that name. Null and empty texts have no
    words. Repeated rows count each time. Equal scores go by count, then by the phrase's bytes.
    A language without candidates gives no row, an empty table none at all. Other columns are
    not read.
    """
    found, langs = frequent_phrases(docs, min_count, **sizes)
    candidates = found.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest")
    )
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = (
        cuts.join(part("first", "l"), ["lang", "first"])
        .join(part("rest", "r"), ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    )
    inside = (
        candidates.where("size(w) > 2")
        .select("lang", "a", F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> array_join(slice(w, i, 2), ' '))")).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that no task ranks a whole language.
    parted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    best = left.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= top).drop("rank")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(langs, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
