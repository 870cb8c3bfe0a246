"""Stupid-backoff scores: n-gram counts by hash in partitions, joined to the n-grams of each text, summed per document.

A block of texts is held once as word numbers. It tells every hash partition its n-grams as
sorted keys with counts. A partition sums them and answers, in the same order, how often all
other blocks have each n-gram. With the answers a block scores its texts word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import hold, release, whole_text
from twintrail.llm.words import CHUNK_BYTES, chunks, mixed, run_hashes, word_hashes

#: n-grams of up to so many words.
WORDS = 3
BACKOFF = 0.4
#: Texts are taken together until they have so many bytes; one text is never cut.
BLOCK_BYTES = 8 << 20
#: N-grams (with repeats) that a hash partition is meant for.
PARTITION_GRAMS = 1 << 22
#: Keys have so many bits more than it takes to number all n-grams: one in 2^24 shares its key with another.
SPARE_BITS = 24
#: Texts are scored together until they have so many words.
SCORE_WORDS = 1 << 16
#: What a text takes in a block besides its bytes.
ROW_BYTES = 16
#: Stands for a word before the text.
_START = mixed(np.array([1 << 50], np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, their first bytes together, then their second ones, and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, len(planes) // width).T).view(kind).reshape(-1)


def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        n_bytes: list[np.ndarray] = []
        n_words: list[np.ndarray] = []
        found: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            words = pa.array(np.concatenate(found).view(np.int64)).dictionary_encode()
            counts = np.concatenate(n_words)
            row = {
                "block": pa.array([task << 32 | made], pa.int64()),
                "ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([pack(np.concatenate(n_bytes))], pa.binary()),
                "counts": pa.array([pack(counts)], pa.binary()),
                "numbers": pa.array([pack(words.indices.to_numpy())], pa.binary()),
                "words": pa.array([pack(words.dictionary.to_numpy())], pa.binary()),
                "n_words": pa.array([int(counts.sum())], pa.int64()),
                "n_texts": pa.array([int(np.count_nonzero(counts))], pa.int64()),
            }
            for part in (ids, n_bytes, n_words, found):
                part.clear()
            made, size = made + 1, 0
            return pa.record_batch(list(row.values()), list(row))

        for batch in batches:
            for first, data, offsets in chunks(batch["text"], min(CHUNK_BYTES, block_bytes)):
                hashes, firsts = word_hashes(data, offsets)
                found.append(hashes)
                n_words.append(np.diff(firsts).astype(np.int64))
                n_bytes.append(np.diff(offsets))
                ids.append(batch["doc_id"].slice(first, len(offsets) - 1))
                size += len(data) + ROW_BYTES * (len(offsets) - 1)
                if size >= block_bytes:
                    yield flush()
        if ids:
            yield flush()

    return run


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All texts in blocks, held: ids, sizes, words of each text, the words' numbers and the hashes that they number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "block long, ids array<long>, sizes binary, counts binary, numbers binary, words binary, n_words long, n_texts long"
    return hold(rows.mapInArrow(_blocks(block_bytes), schema))


def words_of(counts: bytes, numbers: bytes, words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of the first word of each text and one more at the end) of a block."""
    firsts = np.concatenate([[0], np.cumsum(unpack(counts, np.int64))])
    return unpack(words, np.uint64)[unpack(numbers, np.int32)], firsts


def word_grams(found: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text, real, hashes) of the words of some texts and of the last start mark before each text that has words.

    ``hashes[k]`` holds the hash of the k words up to each place, start marks before a text
    included. ``real`` are the words.
    """
    sizes = np.diff(firsts)
    full = np.flatnonzero(sizes)
    marked = sizes[full] + WORDS
    line = np.full(int(marked.sum()), _START[0], np.uint64)
    begins = (np.cumsum(marked) - marked).astype(np.int64)
    counted = np.ones(len(line), bool)
    for k in range(WORDS - 1):
        counted[begins + k] = False
    real = counted.copy()
    real[begins + WORDS - 1] = False
    line[real] = found
    hashes = [np.zeros(0, np.uint64)]
    for k in range(1, WORDS + 1):
        runs = run_hashes(line, k) if len(line) else line
        hashes.append(runs[counted[k - 1 :]])
    return np.repeat(full, marked)[counted], real[counted], hashes


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of each, and for each key given the place of its sum)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0], place


class Keys:
    """How n-grams are keyed and dealt: the upper ``bits`` of their hash, in ``parts`` equal ranges."""

    def __init__(self, grams: int, partition_grams: int):
        self.bits = min(64, max(1, grams).bit_length() + SPARE_BITS)
        self.parts = max(1, -(-grams // partition_grams))
        self.shift = np.uint64(64 - self.bits)

    def counted(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of n-grams of all lengths, in order, and how often each occurs."""
        ordered = np.sort(np.concatenate(hashes[1:]) >> self.shift)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return ordered[starts], np.diff(starts, append=len(ordered))

    def cuts(self, keys: np.ndarray) -> np.ndarray:
        """Where each partition begins in ordered keys."""
        edges = np.array([(p << self.bits) // self.parts for p in range(self.parts)], np.uint64)
        return np.append(np.searchsorted(keys, edges), len(keys))


def _told(how: Keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *packed in zip(*(batch[name].to_pylist() for name in ("block", "counts", "numbers", "words"))):
                keys, n = how.counted(word_grams(*words_of(*packed))[2])
                cuts = how.cuts(keys)
                parts = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[p], cuts[p + 1]) for p in parts]
                prints = [pack(np.diff(keys[s], prepend=np.uint64(0))) for s in spans]
                yield pa.record_batch(
                    [pa.array(parts, pa.int64()), pa.array(np.full(len(parts), block), pa.int64()), pa.array(prints, pa.binary()), pa.array([pack(n[s]) for s in spans], pa.binary())],
                    ["part", "block", "keys", "n"],
                )

    return run


def _others(told: pa.Table) -> pa.Table:
    """One hash partition: how often the other blocks have each n-gram of a block."""
    keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in told["keys"].to_pylist()]
    counts = np.concatenate([unpack(n, np.int64) for n in told["n"].to_pylist()])
    ends = np.cumsum([len(k) for k in keys])
    _, totals, place = sums(np.concatenate(keys), counts)
    others = np.split(totals[place] - counts, ends[:-1])
    return pa.table([told["block"], told["part"], pa.array([pack(n) for n in others], pa.binary())], ["block", "part", "others"])


def _own(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each word, how often its n-gram, told by its place among the block's, occurs in its text."""
    _, n, at = sums(text << 32 | place, np.ones(len(text), np.int64))
    return n[at]


def score_texts(found: np.ndarray, firsts: np.ndarray, how: Keys, keys: np.ndarray, totals: np.ndarray, events: int) -> np.ndarray:
    """Log score of each of some texts of a block by the counts of all other texts."""
    n = len(firsts) - 1
    text, real, hashes = word_grams(found, firsts)
    others = [None]
    for h in hashes[1:]:
        place = np.searchsorted(keys, h >> how.shift)
        others.append(totals[place] - _own(text, place))
    words = np.diff(firsts)
    places = np.flatnonzero(real)
    left, value = np.arange(len(places)), np.zeros(len(places))
    for k in range(WORDS, 0, -1):
        at = places[left]
        seen = others[k][at] > 0
        # The words before a place end one place earlier.
        below = others[k - 1][at[seen] - 1] if k > 1 else events - words[text[at[seen]]] - 1
        value[left[seen]] += np.log(others[k][at[seen]] / below)
        value[left[~seen]] += np.log(BACKOFF)
        left = left[~seen]
    # A word that no other text has: as if it had been seen once more than everything there is.
    value[left] -= np.log(events + 1.0)
    return np.bincount(text[places], value, n).astype(np.float64)


def _score(how: Keys, events: int):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        found, firsts = words_of(block["counts"], block["numbers"], block["words"])
        keys, totals = how.counted(word_grams(found, firsts)[2])
        cuts = how.cuts(keys)
        for part, others in zip(answers["part"].to_pylist(), answers["others"].to_pylist()):
            totals[cuts[part] : cuts[part + 1]] += unpack(others, np.int64)
        scores, first = [], 0
        while first < len(firsts) - 1:
            last = max(first + 1, int(np.searchsorted(firsts, firsts[first] + SCORE_WORDS, "right")) - 1)
            some = firsts[first : last + 1]
            scores.append(score_texts(found[some[0] : some[-1]], some - some[0], how, keys, totals, events))
            first = last
        return pa.table(
            [pa.array(block["ids"], pa.int64()), pa.array(unpack(block["sizes"], np.int64)), pa.array(np.concatenate(scores)), pa.array(np.diff(firsts))],
            ["doc_id", "n_bytes", "log_score", "n_words"],
        )

    return run


def score_by_words(docs: DataFrame, block_bytes: int = BLOCK_BYTES, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """(doc_id, n_bytes, log_score, bits_per_byte) of every row.

    Each word is scored by how often it follows the two before it in all other texts; where it
    never does, by 0.4 times its score after one, and so on. Words are what blanks part, A-Z
    counted as a-z. A text's own n-grams are taken off the counts, so that a text is not its
    own evidence and copies are.

    Texts are taken together in blocks of the partitions they are read in. Each distinct n-gram
    of a block goes to its hash partition once, as a few bytes of a sorted string of keys, and
    its sum over the other blocks comes back the same way. A frequent n-gram is one key a block,
    and no n-gram is left out. Keys are hashes whose length follows from the number of n-grams.
    A partition holds some four million keys, a block its n-grams; both are let go once the
    table made from them is held.

    Texts without words have score 0 and no bits. Ids may be null. Repeated rows count and are
    scored each. An empty table gives no row. Other columns are not read.
    """
    blocks = blocks_of(docs, block_bytes)
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_texts")).first()
    events = int(sizes[0] or 0) + int(sizes[1] or 0)
    how = Keys(WORDS * events, partition_grams)
    told = blocks.select("block", "counts", "numbers", "words").mapInArrow(_told(how), "part long, block long, keys binary, n binary")
    answers = hold(told.groupBy("part").applyInArrow(_others, "block long, part long, others binary"))
    release()
    scored = (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_score(how, events), "doc_id long, n_bytes long, log_score double, n_words long")
    )
    bits = F.when(F.col("n_words") > 0, F.round(-F.col("log_score") / F.log(F.lit(2.0)) / F.col("n_bytes"), 6))
    return scored.select("doc_id", "n_bytes", F.round("log_score", 4).alias("log_score"), bits.alias("bits_per_byte"))
