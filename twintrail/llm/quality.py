"""Text quality: random-indexing word vectors pooled per document, a two-layer network, temperature-calibrated probabilities.

A word's vector is the sum of the sparse random index vectors of the words around it, over all
texts. Words share a table of fixed size by hash, so neither the table nor what is sent to the
tasks grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import hold, release, whole_text
from twintrail.llm.words import POWERS, byte_values, chunks, mixed

#: The network is fitted on so many labelled rows at most, those of lowest hash.
MAX_TRAINING_ROWS = 12_000
#: Rows of the table of word vectors and numbers in each.
BUCKETS, DIMENSIONS = 1 << 14, 48
#: An index vector has so many ones and as many minus ones; words up to so far apart are neighbours.
ENTRIES, WINDOW = 2, 2
#: Words of a share far above this one count little in one of the pools.
COMMON = 1e-3
HIDDEN, EPOCHS, RATE, DECAY, SEED = 24, 300, 0.01, 1e-3, 13
#: One part of so many of the fitting rows, by hash, only sets the temperature.
CALIBRATION_PARTS = 5
#: Parts of the table that are summed apart, and tasks whose sums are added before those of others.
SLICES, FAN_IN = 16, 64
#: Words whose neighbours are counted at once, and whose vectors are laid out at once.
COUNT_WORDS, POOL_WORDS = 1 << 19, 1 << 16

# Blanks part words; a run of marks is a word of its own, as is a run of letters, digits and all that is not ASCII.
_CLASS = np.full(256, 2, np.int8)
_CLASS[[*range(0x80, 0x100), *b"0123456789", *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text divisible by 5; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, letters as they are, and for each text the number of its first word (one more at the end)."""
    n = len(data)
    kind = _CLASS[data]
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = kind[edges] > 0
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = POWERS.upto(n + 1)
    values = byte_values(data) * up[:n]
    values[kind == 0] = 0
    return mixed(np.add.reduceat(values, starts) * down[starts]), np.searchsorted(starts, offsets)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def index_entry(hashes: np.ndarray, k: int) -> np.ndarray:
    """The dimension of entry ``k`` of each word's index vector: a one if ``k`` is even, else a minus one."""
    return ((((hashes >> np.uint64(14 + 10 * k)) & np.uint64(1023)) * np.uint64(DIMENSIONS)) >> np.uint64(10)).astype(np.int64)


def contexts(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each bucket the sum of the index vectors around its words, and in the last column how often it occurs.

    Neighbours are words of the same text.
    """
    bucket = buckets_of(hashes)
    entries = [index_entry(hashes, k) for k in range(2 * ENTRIES)]
    cells: tuple[list, list] = ([], [])
    for apart in range(1, WINDOW + 1):
        left = np.flatnonzero(texts[apart:] == texts[:-apart])
        for here, there in ((left, left + apart), (left + apart, left)):
            row = bucket[here] * DIMENSIONS
            for k, at in enumerate(entries):
                cells[k % 2].append(row + at[there])
    ones, minus = (np.bincount(np.concatenate(c), minlength=BUCKETS * DIMENSIONS) for c in cells)
    counts = np.bincount(bucket, minlength=BUCKETS)
    return np.concatenate([(ones - minus).reshape(BUCKETS, DIMENSIONS), counts[:, None]], axis=1)


def _packed(table: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table, np.int64).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


SUMS = "slice int, task long, sums binary"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task has seen, by slices of the table."""
    table = np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    before = held = 0

    def count():
        nonlocal table, held
        if waiting:
            table += contexts(*(np.concatenate(part) for part in zip(*waiting)))
            waiting.clear()
            held = 0

    for batch in batches:
        for _, data, offsets in chunks(batch["text"]):
            hashes, first = token_hashes(data, offsets)
            waiting.append((hashes, before + np.repeat(np.arange(len(first) - 1), np.diff(first))))
            before += len(first)
            held += len(hashes)
            if held >= COUNT_WORDS:
                count()
    count()
    parts = [_packed(p) for p in np.split(table, SLICES)]
    yield pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int64()), pa.array(parts, pa.binary())], ["slice", "task", "sums"])


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.zeros(BUCKETS // SLICES * (DIMENSIONS + 1), np.int64)
    for sums in rows["sums"]:
        total += _unpacked(sums.as_py())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([_packed(total)], pa.binary())], ["slice", "task", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of sums over all texts, BUCKETS rows of DIMENSIONS numbers and a count.

    A task sends its sums in SLICES rows; FAN_IN tasks are added at a time, until one row a
    slice is left.
    """
    sums = hold(docs.select(whole_text().alias("text")).mapInArrow(_sums, SUMS))
    tasks = (sums.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        below, tasks = sums, -(-tasks // FAN_IN)
        group = F.floor(F.col("task") / FAN_IN).cast("long").alias("task")
        sums = hold(below.select("slice", group, "sums").groupBy("slice", "task").applyInArrow(_added, SUMS))
        release(below)
    # One row a slice: BUCKETS * (DIMENSIONS + 1) numbers, however long the corpus is.
    parts = [_unpacked(r["sums"]) for r in sums.orderBy("slice").collect()]
    release(sums)
    return np.concatenate(parts).reshape(BUCKETS, DIMENSIONS + 1) if parts else np.zeros((BUCKETS, DIMENSIONS + 1), np.int64)


class Pooling:
    """Pools the vectors of a text's words."""

    def __init__(self, table: np.ndarray):
        counts = table[:, -1]
        vectors = table[:, :-1].astype(np.float32)
        self.vectors = vectors / np.maximum(1e-9, np.linalg.norm(vectors, axis=1))[:, None]
        self.weights = (COMMON / (COMMON + counts / max(1, counts.sum()))).astype(np.float32)

    @property
    def width(self) -> int:
        return 2 * DIMENSIONS + 2

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the mean of its words' vectors, the mean by rarity, and how alike neighbours and equal neighbours are."""
        hashes, first = token_hashes(data, offsets)
        sizes = np.diff(first)
        texts = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.zeros((len(sizes), 2 * DIMENSIONS + 3))
        # A long text's words are laid out part by part, one word of the part before included.
        for a in range(0, len(hashes), POOL_WORDS):
            bucket = buckets_of(hashes[max(0, a - 1) : a + POOL_WORDS])
            vector = self.vectors[bucket]
            text = texts[max(0, a - 1) : a + POOL_WORDS]
            alike = np.einsum("ij,ij->i", vector[1:], vector[:-1]) * (text[1:] == text[:-1])
            skip = int(a > 0)
            weight = self.weights[bucket[skip:], None]
            pairs = alike if skip else np.concatenate([[0.0], alike])
            same = np.concatenate([[0.0], np.where(bucket[1:] == bucket[:-1], alike, 0.0)])[1 if skip else 0 :]
            rows = np.concatenate([vector[skip:], vector[skip:] * weight, weight, pairs[:, None], same[:, None]], axis=1)
            starts = np.flatnonzero(np.diff(text[skip:], prepend=-1))
            sums[text[skip:][starts]] += np.add.reduceat(rows, starts, axis=0)
        n = np.maximum(1, sizes)[:, None]
        plain, rare, total, pairs = np.split(sums, [DIMENSIONS, 2 * DIMENSIONS, 2 * DIMENSIONS + 1], axis=1)
        return np.concatenate([plain / n, rare / np.maximum(1e-9, total), pairs / n], axis=1)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        parts = [self.chunk(data, offsets) for _, data, offsets in chunks(texts)]
        return np.concatenate(parts) if parts else np.zeros((0, self.width))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Network:
    """Two layers over standardised features; the temperature divides the log odds."""

    mean: np.ndarray
    spread: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float = 1.0

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        return np.tanh((rows - self.mean) / self.spread @ self.inner + self.inner_bias)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return self.hidden(rows) @ self.outer + self.outer_bias

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(rows) / self.temperature)


def loss_and_slopes(net: Network, rows: np.ndarray, labels: np.ndarray, decay: float = DECAY) -> tuple[float, list[np.ndarray]]:
    """Cross entropy with decaying weights, and its slopes by (inner, inner_bias, outer, outer_bias)."""
    h = net.hidden(rows)
    odds = h @ net.outer + net.outer_bias
    off = (sigmoid(odds) - labels) / len(labels)
    back = np.outer(off, net.outer) * (1 - h * h)
    loss = np.mean(np.logaddexp(0, odds) - labels * odds) + decay / 2 * (np.sum(net.inner**2) + np.sum(net.outer**2))
    scaled = (rows - net.mean) / net.spread
    return float(loss), [scaled.T @ back + decay * net.inner, back.sum(0), h.T @ off + decay * net.outer, np.asarray(off.sum())]


def train(rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Full steps by running means of slopes and of their squares; the same rows in the same order give the same network."""
    dice = np.random.Generator(np.random.PCG64(SEED))
    width = rows.shape[1]
    weights = [dice.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), dice.normal(0, HIDDEN**-0.5, HIDDEN), np.asarray(0.0)]
    mean, spread = rows.mean(0), rows.std(0) + 1e-6
    slow, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, epochs + 1):
        _, slopes = loss_and_slopes(Network(mean, spread, weights[0], weights[1], weights[2], float(weights[3])), rows, labels)
        for k, slope in enumerate(slopes):
            slow[k] = 0.9 * slow[k] + 0.1 * slope
            square[k] = 0.999 * square[k] + 0.001 * slope**2
            weights[k] = weights[k] - RATE * (slow[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, spread, weights[0], weights[1], weights[2], float(weights[3]))


def temperature(odds: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of log odds that makes labels likeliest, found by thirds between 1/16 and 16; 1 without both labels."""
    if len(np.unique(labels)) < 2:
        return 1.0
    cost = lambda t: float(np.mean(np.logaddexp(0, odds / np.exp(t)) - labels * odds / np.exp(t)))
    low, high = -np.log(16.0), np.log(16.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if cost(a) <= cost(b) else (a, high)
    return float(np.exp((low + high) / 2))


WEIGHTS = "mean array<double>, spread array<double>, inner array<double>, inner_bias array<double>, outer array<double>, outer_bias double, temperature double"


def _trained(rows: pa.Table) -> pa.Table:
    """One network of all rows (features, label, calibrates), MAX_TRAINING_ROWS at most."""
    features = rows["features"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    labels, apart = rows["label"].to_numpy().astype(float), rows["calibrates"].to_numpy().astype(bool)
    order = np.lexsort((labels, apart, *features[:, :8].T, rows["doc_id"].to_numpy()))
    features, labels, apart = features[order], labels[order], apart[order]
    net = train(features[~apart], labels[~apart])
    heat = temperature(net.log_odds(features[apart]), labels[apart])
    lists = [net.mean, net.spread, net.inner.ravel(), net.inner_bias, net.outer]
    return pa.table([*(pa.array([v.tolist()], pa.list_(pa.float64())) for v in lists), pa.array([net.outer_bias]), pa.array([heat])], [c.split()[0] for c in WEIGHTS.split(", ")])


@dataclass
class Quality:
    """A fitted classifier; without a network every text has the score ``otherwise``."""

    pooling: Pooling
    network: Network | None
    otherwise: float

    def score(self, docs: DataFrame, into: str = "score") -> DataFrame:
        """``docs`` with a score from 0 to 1 of ``text`` in column ``into``, in place of one of that name.

        Null texts count as empty. Other columns come through as they are; no shuffle.
        """
        sent = docs.sparkSession.sparkContext.broadcast((self.pooling, self.network, self.otherwise))  # of fixed size
        plain = docs.drop(into)
        schema = plain.withColumn(into, F.lit(0.0)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pooling, network, otherwise = sent.value
            for batch in batches:
                scores = np.full(batch.num_rows, otherwise) if network is None else network.probabilities(pooling(batch["text"]))
                yield batch.append_column(into, pa.array(scores, pa.float64()))

        return plain.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Quality:
    """Word vectors of all texts; the network from the labelled rows that are not held out, ``max_rows`` of lowest hash at most.

    Labels that are null or neither 0 nor 1 are left out; of several labels of an id the
    largest counts. The network sees four fifths of the rows, the temperature the rest.
    Repeated rows count each time. Where labels have one class only, every score is that
    class, and 0.5 where there are none.
    """
    pooling = Pooling(word_vectors(docs))
    known = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sent = docs.sparkSession.sparkContext.broadcast(pooling)  # BUCKETS * (DIMENSIONS + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = sent.value(batch["text"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1) * features.shape[1], pa.int32()), pa.array(features.ravel()))
            yield pa.record_batch([batch["doc_id"], batch["label"], batch["calibrates"], lists], ["doc_id", "label", "calibrates", "features"])

    apart = (F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(CALIBRATION_PARTS)) == 0).alias("calibrates")
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text")).join(chosen, "doc_id").select("doc_id", "label", apart, "text")
    features = hold(rows.mapInArrow(run, "doc_id long, label int, calibrates boolean, features array<double>"))
    seen = sorted(r["label"] for r in features.where("NOT calibrates").select("label").distinct().collect())
    network = None
    if len(seen) == 2:
        w = features.groupBy().applyInArrow(_trained, WEIGHTS).first()
        as_array = {k: np.array(v) for k, v in w.asDict().items()}
        network = Network(as_array["mean"], as_array["spread"], as_array["inner"].reshape(-1, HIDDEN), as_array["inner_bias"], as_array["outer"], w["outer_bias"], w["temperature"])
    release(features)
    return Quality(pooling, network, float(seen[0]) if seen else 0.5)
