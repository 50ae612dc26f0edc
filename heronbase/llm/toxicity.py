"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every coordinate has a learning rate of its own; the L1 term leaves few weights, which
are collected (at most ``2**bits``) and broadcast.  A text's features are the distinct
ones, so a score does not depend on how often a word recurs.  Training reads at most
``rows`` labelled documents, those with the smallest hash of their id, in one task and
in that order; scoring reads every whole text.

Defined cases: documents without label, or with null labels only, do not train; equal
ids in ``labels`` count once, with their largest label; of documents that share an id, one
trains (the one with the smallest hash of its text); a null id is never held out and
never trains; null and empty texts score by the bias alone; without any usable label all
scores are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronbase.llm.common import pick, small_batches
from heronbase.llm.hashed import distinct, hasher, word_features

BITS = 20
#: Labelled rows that train, whatever the size of the table.
ROWS = 16_384
THRESHOLD = 0.7


@dataclass(frozen=True)
class Rates:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 8


class Ftrl:
    """Per-coordinate FTRL-proximal with logistic loss; the bias is a coordinate without L1."""

    def __init__(self, bits: int, rates: Rates):
        self.r, self.z, self.n = rates, np.zeros(1 << bits), np.zeros(1 << bits)
        self.bz = self.bn = 0.0

    def weights(self, at) -> np.ndarray:
        r, z = self.r, self.z[at]
        return np.where(np.abs(z) > r.l1, -(z - np.sign(z) * r.l1) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2), 0.0)

    def bias(self) -> float:
        return -self.bz / ((self.r.beta + self.bn**0.5) / self.r.alpha + self.r.l2)

    def learn(self, at: np.ndarray, y: float) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.r.alpha * w
        self.n[at] = n + g * g
        self.bz += g - ((self.bn + g * g) ** 0.5 - self.bn**0.5) / self.r.alpha * b
        self.bn += g * g


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``order, text, y`` of the bounded training sample: one document for each of ``rows`` ids."""
    own = pick(labels, "doc_id", label).groupBy("doc_id").agg(F.max(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    # of the documents with an id, a task passes on one before the shuffle
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    found = found.withColumn("nth", F.row_number().over(one)).where(F.col("nth") == 1)
    return found.select(F.xxhash64("doc_id").alias("order"), F.col("text").cast("string").alias("text"), F.col("y").cast("double").alias("y"))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS, rates: Rates = Rates()) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Features, weights and bias; None without labels."""
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            own = distinct(*word_features(h, texts, bits), len(texts), bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i4").tobytes() for x in own], pa.binary()), b.column(2)], names=["order", "features", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(f, "<i4"), y) for b in batches for f, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not seen:
            return
        model = Ftrl(bits, rates)
        for _ in range(rates.epochs):
            for at, y in seen:
                model.learn(at, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(w[at], model.bias()))], names=["feature", "weight"])

    features = sample(docs, labels, "toxic", rows).mapInArrow(extract, "order long, features binary, y double")
    got = features.repartition(1).sortWithinPartitions("order", "features").mapInArrow(fit, "feature int, weight double").collect()
    if not got:
        return None
    at, w = np.array([r.feature for r in got]), np.array([r.weight for r in got])
    return at[at >= 0], w[at >= 0], float(w[at < 0][0])


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bits: int = BITS, rates: Rates = Rates(), threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``held_out, score, predicted`` behind them."""
    model = train(docs, labels, rows, bits, rates)
    if model is None:
        return docs.withColumns({"held_out": held_out(), "score": F.lit(0.0), "predicted": F.lit(0)})
    return apply(docs, model, bits).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def apply(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.withColumn("held_out", held_out()).withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits)
        dense[at] = w
        h = hasher()
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()]
            own, f = word_features(h, texts, bits)
            hit = dense[f] != 0
            both = np.unique((own[hit].astype(np.int64) << bits) | f[hit])
            total = np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], len(texts)) + bias
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield b.set_column(b.schema.get_field_index("score"), "score", pa.array(p))

    return scored.mapInArrow(run, scored.schema)
