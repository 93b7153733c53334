"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are the distinct hashes of a text's words, of their stems (first letters, so that inflected forms count
together), of word pairs, and of pairs with one or two words between, in a table of 2 ** TABLE_BITS places. Each coordinate has its own learning rate, and L1 keeps weights at zero until the evidence
exceeds it, so the weights that remain are few: they are broadcast as two arrays of at most 2 ** TABLE_BITS entries.

The classifier is fitted on a bounded sample of labelled rows: the TRAIN_ROWS ids with the least hash, one row each,
held-out rows never among them. Their features lie in the shared folder and pass through the driver once per epoch, or
stay there if they are small. A second model, without every CALIBRATION-th of these rows, is scored on them to find the
scale and the bias at which scores are probabilities (rare labels and L1 shrink scores towards the common label); both
go into the weights. All rows are scored.

Defined results: null and empty texts have the bias alone as their score; rows without a label or with a null one are
not learnt from; of several labels for one id the largest counts, of several texts the one with the least features; without any labelled row every score is 0; held_out
is false for a null id; repeated rows repeat their result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetta.llm.common import map_texts, materialize, once_per_worker

TABLE_BITS, TRAIN_ROWS, EPOCHS, FOLDS = 20, 12_000, 5, 5
#: Every so many training rows one serves the calibration; labels of either kind that it needs; bytes of features that the driver keeps.
CALIBRATION, LEAST, KEEP_BYTES = 4, 10, 128 << 20
#: Letters of a stem.
STEMS = (4, 5)
#: FTRL's rate, its smoothing, and the L1 and L2 penalties. L1 is what two documents can add to a coordinate in all epochs,
#: so what occurs in one or two labelled documents never gets a weight.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0 * EPOCHS, 0.1
#: Words whose hashes a worker remembers.
CACHED = 300_000
_WORD = re.compile(r"[^\W_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_HASHES = _Hashes()


def features(text: str, bits: int = TABLE_BITS) -> np.ndarray:
    """Distinct places of the text's n-grams and skip-grams, ascending."""
    words = _WORD.findall(text.lower())
    h = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    once = set(words)
    parts = [h * _A]
    for size in STEMS:
        stems = {w[:size] for w in once if len(w) >= size}
        parts.append((np.array(list(map(_HASHES.__getitem__, stems)), np.uint64) + np.uint64(size)) * _B)
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append((h[:-gap] * _A ^ (h[gap:] + np.uint64(gap)) * _B) * _A)
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * _B >> np.uint64(64 - bits)).astype(np.uint32))


@dataclass
class Ftrl:
    """Weights in FTRL-proximal's state; the last place is the bias, without penalty."""

    bits: int = TABLE_BITS
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((1 << self.bits) + 1), np.zeros((1 << self.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        penalty = np.where(at == 1 << self.bits, 0.0, L1)
        shrunk = np.sign(z) * penalty - z
        return np.where(np.abs(z) <= penalty, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2 * (penalty > 0)))

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places.astype(np.int64), 1 << self.bits)
        w = self.weights(at)
        g = chance(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Places with a weight, their weights, and the bias."""
        w = self.weights(np.arange((1 << self.bits) + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.uint32), w[at].astype(np.float32), float(w[-1])


def chance(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -35.0), 35.0))))


def train(rows: Iterable[Iterable[tuple[bytes | memoryview, int]]], bits: int = TABLE_BITS, calibration: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights after the given epochs, each an iterable of (features as uint32 bytes, label).

    With calibration, the last iterable is not learnt from: its every calibration-th row is scored by a second model, which
    learnt from the others only, and scores are scaled so that they are probabilities there.
    """
    model, other, any_row, last = Ftrl(bits), Ftrl(bits), False, None
    for epoch in rows:
        if calibration and last is not None:
            any_row |= _learn(last, model, other, calibration)
        elif not calibration:
            any_row |= _learn(epoch, model, None, 0)
        last = epoch
    if not any_row:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -np.inf
    at, weights, bias = model.compact()
    if calibration:
        held = [(np.append(np.frombuffer(f, np.uint32).astype(np.int64), 1 << bits), y) for k, (f, y) in enumerate(last) if k % calibration == 0]
        scale, shift = platt(np.array([other.weights(places).sum() for places, _ in held]), np.array([y for _, y in held], float))
        at, weights, bias = at, (weights * scale).astype(np.float32), bias * scale + shift
    return at, weights, bias


def _learn(epoch: Iterable[tuple[bytes, int]], model: Ftrl, other: Ftrl | None, calibration: int) -> bool:
    any_row = False
    for k, (packed, label) in enumerate(epoch):
        places = np.frombuffer(packed, np.uint32)
        model.learn(places, label)
        if other is not None and k % calibration:
            other.learn(places, label)
        any_row = True
    return any_row


def platt(scores: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make scores log odds of the labels (Newton's steps, a slight pull to 1 and 0); 1 and 0 with few labels."""
    if min(labels.sum(), len(labels) - labels.sum()) < LEAST:
        return 1.0, 0.0
    x, w = np.column_stack([scores, np.ones(len(scores))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (labels - p) - (w - [1.0, 0.0]))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def held_out(doc_id: str = "doc_id", folds: int = FOLDS):
    """Whether a row's label may not be learnt from: crc32 of its id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS):
    """Weights from at most so many labelled rows."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isNotNull() & ~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).withColumn("__order", F.xxhash64("__id"))
    some = known.orderBy("__order", "__id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(some), "__id")
    found = map_texts(texts, "__text", ["__order", "__id", "__y"], lambda: lambda x: (features(x).tobytes(),), "f binary")
    # one row for each id, whatever the number of documents that repeat it
    single = materialize(found.groupBy("__order", "__id").agg(F.min("f").alias("f"), F.max("__y").alias("__y")))
    ordered = single.orderBy("__order", "__id").select("f", "__y")
    if (single.agg(F.sum(F.length("f"))).first()[0] or 0) <= KEEP_BYTES:
        kept = _Kept(_Pass(ordered))
        return train((kept for _ in range(epochs + 1)), calibration=CALIBRATION)
    return train((_Pass(ordered) for _ in range(epochs + 1)), calibration=CALIBRATION)


class _Pass:
    """Rows of a table, one partition at a time."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[bytes, int]]:
        return ((bytes(r.f), r["__y"]) for r in self.rows.toLocalIterator())


class _Kept:
    """Rows of a pass in one buffer, which goes back to the system as a whole. They come by partition: the JVM never holds all."""

    def __init__(self, rows: Iterable[tuple[bytes, int]]):
        buffer, self.ends, self.labels = bytearray(), [0], []
        for packed, label in rows:
            buffer += packed
            self.ends.append(len(buffer))
            self.labels.append(label)
        self.data = memoryview(buffer)

    def __iter__(self) -> Iterator[tuple[memoryview, int]]:
        return ((self.data[a:b], y) for a, b, y in zip(self.ends, self.ends[1:], self.labels, strict=False))


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, score and predicted of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    key = uuid.uuid4().hex

    def table() -> tuple[np.ndarray, float]:
        at, values, bias = sent.value
        dense = np.zeros(1 << TABLE_BITS, np.float32)
        dense[at] = values
        return dense, bias

    def make():
        dense, bias = once_per_worker(key, table)

        def one(x: str) -> tuple:
            p = chance(bias + float(dense[features(x)].sum(dtype=np.float64))) if bias > -np.inf else 0.0
            return p, int(p >= 0.5)

        return one

    return map_texts(docs, text, list(keep), make, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and keep's columns for every row, by a model fitted on its labelled rows."""
    weights = fit(docs, labels, doc_id, text)
    scored = score(docs, weights, text, (doc_id, *[c for c in keep if c != doc_id]))
    return scored.withColumn("held_out", held_out(doc_id)).select(doc_id, "held_out", "score", "predicted", *[c for c in keep if c != doc_id])
