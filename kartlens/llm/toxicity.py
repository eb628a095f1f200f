"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the presence of hashed words, bigrams and skip-grams of one and
two left-out words. The learner is FTRL-proximal with per-coordinate rates;
its L1 term leaves most weights at zero, so the model is a short list of
(index, weight) rows that is broadcast for scoring. Scoring is one pass over
the documents without a shuffle.

The learner takes a bounded sample of the labelled rows: ``MAX_TRAIN_DOCS``
by hash of the id (all of them if there are fewer), in an order fixed by the
same hash, so that reruns give the same model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kartlens.llm.common import map_batches, stage, texts, unused, words_alnum

BITS = 20
MAX_TRAIN_DOCS = 12_000
# The learner's settings: rate, its damping, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.0, 4
# Odd multipliers that tell words, bigrams and the two skip-grams apart.
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
_CACHE: dict[bytes, int] = {}
_CACHE_WORDS, _CACHE_WORD_BYTES = 400_000, 40


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    if len(word) <= _CACHE_WORD_BYTES:
        if len(_CACHE) >= _CACHE_WORDS:
            _CACHE.clear()
        _CACHE[word] = h
    return h


def feature_indexes(text: bytes) -> np.ndarray:
    """The feature indexes of a text, repeats included."""
    get = _CACHE.get
    h = np.array([get(w) or _word_hash(w) for w in words_alnum(text)], np.uint64)
    parts = [h * _MULTIPLIERS[0]]
    for k, gap in enumerate((1, 2, 3)):
        if len(h) > gap:
            parts.append((h[:-gap] * _MULTIPLIERS[k + 1]) ^ (h[gap:] * _MULTIPLIERS[4] + _MULTIPLIERS[k]))
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _MULTIPLIERS[0] >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """The learner's state: one gradient sum and squared sum per coordinate;
    coordinate 2**BITS is the bias, without L1."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: distinct coordinates, the bias among them."""
        w = self.weights(at)
        g = sigmoid(float(w.sum())) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))


def held(batches: Iterator[pa.RecordBatch]) -> list[tuple[np.ndarray, int]]:
    """The sample's (coordinates with the bias, label), for several passes:
    four bytes a coordinate, each row taken from Arrow by itself."""
    bias = np.array([1 << BITS], "<i4").tobytes()
    return [
        (np.frombuffer(x.as_py() + bias, "<i4"), y.as_py())
        for batch in batches
        for x, y in zip(batch.column("idx"), batch.column("label"), strict=True)
    ]


def train(examples: DataFrame) -> DataFrame:
    """(idx, weight) of the non-zero weights, the bias at 2**BITS. ``examples``
    (place, label, idx as little-endian int32 bytes) is the bounded sample; it
    is read in order of place by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = held(batches)
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, label in rows:
                model.learn(at, label)
        every = np.arange((1 << BITS) + 1)
        weights = model.weights(every)
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(weights[kept])], ["idx", "weight"])

    return examples.repartition(1).sortWithinPartitions("place", "label", "idx").mapInArrow(run, "idx long, weight double")


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The model learned from ``docs`` and ``labels`` (doc_id, label 0 or 1).
    Rows without an id, label or document are left out; of several labels of a
    document the higher counts, of several texts under one id the one with the
    smallest hash, so that the sample is bounded however often an id repeats. No labelled row at all gives an empty model,
    which scores everything 0.5 and rejects nothing (:func:`learned`)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("place", F.xxhash64(F.col("doc_id").cast("string")))
    share = max_train_docs / max(known.count(), 1)
    if share < 1:  # of 2^20 places of the hash
        known = known.where(F.pmod(F.col("place"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "label", "place").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one"))
    sample = sample.select("place", "label", "one.text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        idx = [np.unique(feature_indexes(t)).astype("<i4").tobytes() for t in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("label"), pa.array(idx, pa.binary())], ["place", "label", "idx"]
        )

    examples = map_batches(sample, run, "place long, label int, idx binary")
    return stage(train(examples), "toxicity-model")


def scored(docs: DataFrame, model: DataFrame, column: str = "__score") -> DataFrame:
    """``docs`` with the probability of label 1 as ``column``. Null and empty
    texts get the score of no features (the bias alone). Other columns pass
    through, whatever their names, but one named ``column``, in place of which
    the score stands; repeated rows score alike."""
    rows = model.collect()  # at most 2^20 + 1 rows; L1 leaves a few hundred
    dense = np.zeros((1 << BITS) + 1, np.float32)
    for r in rows:
        dense[r["idx"]] = r["weight"]
    shared = docs.sparkSession.sparkContext.broadcast(dense)
    names = [c for c in docs.columns if c.lower() != column.lower()]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = shared.value
        out = []
        for t in texts(batch):
            at = feature_indexes(t)
            at = np.unique(at[weights[at] != 0])
            out.append(sigmoid(float(weights[at].sum(dtype=np.float64) + weights[-1])))
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out)], ["doc", "score"])

    made = map_batches(packed, run, StructType([packed.schema["doc"], StructField("score", DoubleType())]))
    return made.select(*[F.col("doc")[c].alias(c) for c in names], F.col("score").alias(column))


def learned(model: DataFrame) -> bool:
    """Whether the model has any weight. One without holds no verdict: its
    score of 0.5 marks no document."""
    return bool(model.head(1))


def reject_toxic(docs: DataFrame, model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all of them if
    nothing was learned."""
    if not learned(model):
        return docs
    score = unused("__score", docs)
    return scored(docs, model, score).where(F.col(score) < threshold).drop(score)
