"""Quality: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = logistic(threshold[k] - s)`` with one score ``s`` for all grades, the
sum of shared hashed-text weights, and thresholds kept in order.  Features are word
shapes, each with the share of the text's words that have it (in powers of two), the
text's length and the variety of its words (likewise), the share of words that repeat the
one before, and the words.  Training reads
at most ``rows`` labelled documents, those with the smallest hash of their id, in one
task; scoring reads every whole text.

``selected`` needs a cut on the tail probability.  Each of ``FOLDS`` parts of the training
rows is scored by a model of the others; the cut lies between the score that ``KEEP`` of
the good ones reach and the next lower one of the others.

Grades are the whole numbers from 0 to the largest one among the labels that train.
Defined cases: as for toxicity; with fewer than two grades all expected grades are that
grade (0 without labels) and every tail probability is 1; grades below 0 count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronbase.llm.common import small_batches
from heronbase.llm.hashed import FOLD, distinct, hasher, laid_out, shape_features
from heronbase.llm.pieces import mixed
from heronbase.llm.toxicity import held_out, sample

BITS = 18
ROWS = 16_384
STEPS = 50_000
GAP = 1e-3
#: Share of rows with the wanted grade that the cut keeps, as far as training rows tell.
KEEP, FOLDS = 0.99, 5
#: Stands for the cut where a model travels as rows.
CUT = -(2**31)


def features(h, texts: list[bytes]) -> list[np.ndarray]:
    """Distinct features of each text."""
    n = len(texts)

    def salted(own: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros(len(own), np.uint64)
        for p in parts:
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64) + np.uint64(1))
        return own, (x >> np.uint64(64 - BITS)).astype(np.int64)

    own, shape = shape_features(h, texts, BITS)
    per_text = np.bincount(own, minlength=n)
    both, count = np.unique((own << BITS) | shape, return_counts=True)
    text = both >> BITS
    share = np.log2(count / per_text[text]).astype(np.int64) + 64
    out = [salted(text, [np.full(len(text), 1), both & ((1 << BITS) - 1), share])]
    out.append(salted(np.arange(n), [np.full(n, 2), np.log2(per_text + 1).astype(np.int64)]))
    w, of, *_ = laid_out(h, texts, FOLD)
    again = np.bincount(of[1:][(w[1:] == w[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(w) else np.zeros(n, np.int64)
    order = np.lexsort((w, of))
    w, of = w[order], of[order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (of[1:] != of[:-1]))) if len(w) else np.empty(0, bool)
    kinds, words = np.bincount(of[new], minlength=n), np.bincount(of, minlength=n)
    out.append(salted(np.arange(n), [np.full(n, 3), np.log2(words + 1).astype(np.int64), kinds * 16 // np.maximum(words, 1)]))
    out.append(salted(np.arange(n), [np.full(n, 5), again * 16 // np.maximum(words, 1)]))
    out.append(salted(of[new], [np.full(int(new.sum()), 4), w[new]]))
    return distinct(np.concatenate([o for o, _ in out]), np.concatenate([f for _, f in out]), n, BITS)


class CumulativeLink:
    """Weights by AdaGrad with L1, thresholds by plain gradients, put back in order after each step."""

    def __init__(self, grades: int, rate: float = 0.1, l1: float = 5e-2):
        self.rate, self.l1 = rate, l1
        self.w, self.g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
        self.theta = np.arange(grades - 1, dtype=np.float64) - (grades - 2) / 2
        self.tg = np.full(grades - 1, 1e-3)

    def below(self, s: float) -> np.ndarray:
        """P(grade <= k) for k = -1 .. last."""
        return np.concatenate(([0.0], 1 / (1 + np.exp(-np.clip(self.theta - s, -35, 35))), [1.0]))

    def learn(self, at: np.ndarray, grade: int) -> None:
        c = self.below(self.w[at].sum())
        b, a = c[grade], c[grade + 1]
        step = a + b - 1  # of the log likelihood, by the score
        self.g[at] += step * step
        rate = self.rate / np.sqrt(self.g[at])
        w = self.w[at] + rate * step
        self.w[at] = np.sign(w) * np.maximum(np.abs(w) - rate * self.l1, 0)
        p = max(a - b, 1e-9)
        for k, d in ((grade, a * (1 - a) / p), (grade - 1, -b * (1 - b) / p)):
            if 0 <= k < len(self.theta):
                self.tg[k] += d * d
                self.theta[k] += self.rate / np.sqrt(self.tg[k]) * d
        for k in range(1, len(self.theta)):
            self.theta[k] = max(self.theta[k], self.theta[k - 1] + GAP)


def fitted(seen: list[tuple[np.ndarray, int]], grades: int, steps: int) -> CumulativeLink:
    """Passes over the rows in their order, up to ``steps`` steps, 4 passes at least and 50 at most."""
    model = CumulativeLink(grades)
    for _ in range(min(50, max(4, steps // len(seen)))):
        for at, y in seen:
            model.learn(at, y)
    return model


def cut_of(seen: list[tuple[np.ndarray, int]], grades: int, steps: int, tail: int) -> float:
    """The cut that rows suggest whose fold a model of the other folds scores; 0.5 where a fold leaves one kind alone."""
    if not 0 < tail < grades or len(seen) < 2 * FOLDS:
        return 0.5
    p, good = np.zeros(len(seen)), np.array([y >= tail for _, y in seen])
    for k in range(FOLDS):
        rest = [x for i, x in enumerate(seen) if i % FOLDS != k]
        if len({y >= tail for _, y in rest}) < 2:
            return 0.5
        model = fitted(rest, grades, steps)
        p[k::FOLDS] = [1 - model.below(model.w[at].sum())[tail] for at, _ in seen[k::FOLDS]]
    least = float(np.sort(p[good])[int((1 - KEEP) * good.sum())])
    return (least + float(p[~good & (p < least)].max(initial=0.0))) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, steps: int = STEPS, tail: int = 1) -> tuple | None:
    """Features, weights, thresholds and the cut; None without labels."""
    small_batches(docs.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher()
        for b in batches:
            own = features(h, [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("<i4").tobytes() for x in own], pa.binary()), b.column(2)], names=["order", "features", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.frombuffer(f, "<i4"), max(0, int(y))) for b in batches for f, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not seen:
            return
        grades = max(y for _, y in seen) + 1
        model, cut = fitted(seen, grades, steps), cut_of(seen, grades, steps, tail)
        at = np.flatnonzero(model.w)
        k = len(model.theta)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, -1 - np.arange(k), [CUT])).astype(np.int32)), pa.array(np.concatenate((model.w[at], model.theta, [cut])))], names=["feature", "weight"])

    found = sample(docs, labels, label, rows).mapInArrow(extract, "order long, features binary, y double")
    got = found.repartition(1).sortWithinPartitions("order", "features").mapInArrow(fit, "feature int, weight double").collect()
    if not got:
        return None
    at, w = np.array([r.feature for r in got]), np.array([r.weight for r in got])
    theta = (at < 0) & (at != CUT)
    return at[at >= 0], w[at >= 0], w[theta][np.argsort(-at[theta])], float(w[at == CUT][0])


def score(docs: DataFrame, labels: DataFrame, tail: int = 1, cut: float | None = None, rows: int = ROWS) -> DataFrame:
    """All columns of ``docs`` and ``held_out, expected_grade, tail`` (probability of grade ``tail`` or above), ``selected`` (tail at least ``cut``, which training rows set if it is not given)."""
    model = train(docs, labels, rows=rows, tail=tail)
    base = docs.withColumns({"held_out": held_out(), "expected_grade": F.lit(0.0), "tail": F.lit(1.0)})
    if model is not None and len(model[2]):
        base = base.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model[:3]), tail), base.schema)  # at most 2**BITS weights
    return base.withColumn("selected", F.col("tail") >= (cut if cut is not None else model[3] if model else 0.5))


def _scorer(shared, tail: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, theta = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        h = hasher()
        for b in batches:
            own = features(h, [t or b"" for t in b.column("text").cast(pa.string()).cast(pa.binary()).to_pylist()])
            s = np.array([dense[x].sum() for x in own])
            below = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -35, 35)))
            grade = (1 - below).sum(1)
            above = 1 - below[:, min(tail, len(theta)) - 1] if tail > 0 else np.ones(len(s))
            for name, values in (("expected_grade", grade), ("tail", above)):
                b = b.set_column(b.schema.get_field_index(name), name, pa.array(values, pa.float64()))
            yield b

    return run
