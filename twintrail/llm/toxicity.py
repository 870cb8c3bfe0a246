"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintrail.llm.common import hold, whole_text

#: The classifier is fitted on so many labelled rows at most, those of lowest hash.
MAX_TRAINING_ROWS = 12_000
#: A lexicon entry is a word's first letters (or the word, with a final blank) in so many texts at
#: least, and the lexicon keeps so many entries, those of highest information.
ENTRY_CHARS, MIN_TEXTS, LEXICON_SIZE = range(4, 9), 8, 400
TREES, DEPTH, SEED = 40, 4, 7
#: Share of the fitting rows, by hash, that only calibrate.
CALIBRATION_PARTS = 4
#: Words on each side of a lexicon word that count as near it.
NEAR = 6
MEMO_WORDS = 150_000
# Pronouns and possessives of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner euch euer eure ihr tu te toi ton ta tes vous votre vos tú ti tuyo tuya tus usted ustedes vosotros vuestro vuestra".split()
)
WORD = re.compile(r"\w+")
#: A run of marks and digits behind a word character is taken as a whole, whether a letter follows or not, so that a long one is
#: read once; only those with a letter behind them count, and letters three times over.
OBFUSCATED = re.compile(r"\w[@$!*#0-9.\-_]++(?:([^\W\d_])|)|([^\W\d_])\2\2", re.UNICODE)
ELONGATED = re.compile(r"([!?*#$&.])\1")
FEATURES = [
    "log_words", "mean_word", "hits", "hit_rate", "strong_rate", "weight_mean", "weight_max", "window_max", "window_mean_top",
    "second_person", "second_near_hit", "capitals", "upper_words", "punctuation", "exclamations", "digits", "obfuscated", "elongated", "distinct",
]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text divisible by 5; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def entries_of(word: str) -> list[str]:
    return [word[:k] for k in ENTRY_CHARS if len(word) >= k] + [word + " "]


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds of the first letters and words that tell ``texts`` (text, label) apart best.

    Counts per text are made in the tasks and summed by Spark; at most LEXICON_SIZE entries
    come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                for entry in {e for w in set(WORD.findall(text.lower())) for e in entries_of(w)}:
                    counts.setdefault(entry, [0, 0])[label] += 1
            yield pa.record_batch(
                [pa.array(list(counts)), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                ["entry", "clean", "toxic"],
            )

    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return {}
    p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    odds = F.log(p / q)
    ranked = (
        texts.mapInArrow(run, "entry string, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") + F.col("clean") >= MIN_TEXTS)
        .select("entry", odds.alias("odds"), (p * odds).alias("gain"))
        .where("odds > 0.7")
        .orderBy(F.desc("gain"), "entry")
        .limit(LEXICON_SIZE)
    )
    return {r["entry"]: float(r["odds"]) for r in ranked.collect()}


class Weights(dict):
    """Weight of each word: the largest of its entries, else 0."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        weight = max((self.lexicon.get(e, 0.0) for e in entries_of(word)), default=0.0)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = weight
        return weight


def measure(text: str, weights: Weights) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    raw = WORD.findall(text)
    words = list(map(str.lower, raw))
    n = max(1, len(words))
    w = np.fromiter(map(weights.__getitem__, words), float, len(words))
    at = np.flatnonzero(w)
    window = top = 0.0
    if len(at):
        sums = np.concatenate([[0.0], np.cumsum(w)])
        span = min(40, len(words))
        rolling = sums[span:] - sums[:-span]
        window = float(rolling.max())
        top = float(np.sort(w[at])[-8:].mean())
    second = [k for k, x in enumerate(words) if x in SECOND_PERSON]
    near = 0
    if len(at) and second:
        next_hit = at[np.minimum(np.searchsorted(at, np.array(second) - NEAR), len(at) - 1)]
        near = int(np.count_nonzero(np.abs(next_hit - np.array(second)) <= NEAR))
    data = text.encode("utf-8")
    size = max(1, len(text))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(data) - len(data.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    strong = float(np.count_nonzero(w > 2.5))
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, float(np.log1p(len(at))), len(at) / n, strong / n, float(w.sum()) / n, float(w.max()) if len(w) else 0.0, window, top,
        len(second) / n, near / n, capitals / size, sum(map(str.isupper, raw)) / n, marks / size, text.count("!") / n, digits / size, sum(1 for m in OBFUSCATED.finditer(text) if m.lastindex) / n, len(ELONGATED.findall(text)) / n, len(set(words)) / n,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` with ``_features`` of its ``text``; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON_SIZE entries at most
    schema = docs.withColumn("_features", F.array(F.lit(0.0))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value)
        for batch in batches:
            rows = pa.array([measure(t or "", weights) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))
            yield batch.append_column("_features", rows)

    return docs.mapInArrow(run, schema)


@dataclass
class Toxicity:
    """A fitted classifier: lexicon, trees and calibration."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, into: str = "score") -> DataFrame:
        """``docs`` (with ``text``) and a score from 0 to 1 in column ``into``; null texts count as empty."""
        if self.trees is None:
            return docs.withColumn(into, F.lit(0.0))
        rows = _margins(self.trees, with_features(docs, self.lexicon))
        return rows.withColumn(into, _calibrated(F.col("_margin"), self.calibration)).drop("_features", "_margin")


def _margins(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows.withColumn("_vector", array_to_vector("_features")))
    return out.withColumn("_margin", vector_to_array("_raw")[1]).drop("_vector", "_raw", "_probability", "_prediction")


def _calibrated(margin: Column, model: IsotonicRegressionModel) -> Column:
    """The isotonic steps as an expression, linear between boundaries, a little of the margin kept to tell ties apart."""
    xs, ys = [float(x) for x in model.boundaries.toArray()], [float(y) for y in model.predictions.toArray()]
    # One flat list of cases: however many steps there are, the expression is not nested.
    curve = F.when(margin <= xs[0], F.lit(ys[0]))
    for x0, y0, x1, y1 in zip(xs, ys, xs[1:], ys[1:]):
        slope = (y1 - y0) / (x1 - x0) if x1 > x0 else 0.0
        curve = curve.when(margin <= x1, F.lit(y0) + slope * (margin - x0))
    curve = curve.otherwise(F.lit(ys[-1]))
    order = 1 / (1 + F.exp(-margin))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), curve * 0.98 + order * 0.02))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, trees: int = TREES) -> Toxicity:
    """Learn from the labelled rows that are not held out, ``max_rows`` of lowest hash at most.

    Labels that are null or neither 0 nor 1 are left out; of several labels of an id the
    largest counts. The lexicon and the trees see three quarters of the rows, the calibration
    the rest. Without both classes every score is 0.
    """
    known = (
        labels.where("toxic IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", whole_text().alias("text")).join(chosen, "doc_id")
    rows = hold(rows.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(CALIBRATION_PARTS)) == 0))
    fitting = rows.where("NOT calibrates")
    lexicon = learn_lexicon(fitting.select("text", "label"))
    if not lexicon and fitting.select("label").distinct().count() < 2:
        return Toxicity({}, None, None)
    features = hold(with_features(rows.select("text", "label", "calibrates"), lexicon).drop("text"))
    booster = GBTClassifier(
        featuresCol="_vector", labelCol="label", predictionCol="_prediction", maxIter=trees, maxDepth=DEPTH, stepSize=0.2, subsamplingRate=0.8, seed=SEED, minInstancesPerNode=4, cacheNodeIds=False, checkpointInterval=-1
    )
    booster = booster.setRawPredictionCol("_raw").setProbabilityCol("_probability")
    trained = booster.fit(features.where("NOT calibrates").withColumn("_vector", array_to_vector("_features")).select("_vector", F.col("label").cast("double").alias("label")))
    apart = _margins(trained, features.where("calibrates"))
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label").fit(apart.select("_margin", F.col("label").cast("double").alias("label")))
    return Toxicity(lexicon, trained, calibration)
