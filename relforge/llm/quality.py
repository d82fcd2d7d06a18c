"""Operator 7: quality by logistic regression over hashed word n-grams.

Features are the unigrams and bigrams of a text's folded words, the same of the
words' shapes (letter case, digits and marks, runs shortened), and, for each
bigram that the text has had before, that it has.  Each is hashed to one of
2**BITS weights; its value is its share of the text's n-grams.  The weights are
learned by follow-the-regularised-leader updates, one text at a time; a score
is a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import _SPACE, chunks, mix64, order_in_rows, text_buffers, word_hashes
from .runtime import small_batches
from .sampling import labelled_texts

BITS = 18
#: Training texts of each class.
PER_CLASS = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 8.0

# The shape of a byte: a for lower case and other letters, A, 0, and marks as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with each run of one kind of byte shortened to one."""
    if not len(data):
        return data, offsets
    kind = _SHAPE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | _SPACE[data[1:]]
    keep[offsets[1:-1][offsets[1:-1] < len(data)]] = True
    return kind[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row, value) of all n-grams, repeated ones several times."""
    rows = len(offsets) - 1
    slots, of, values = [], [], []

    def add(hashes, row, seed, total=None):
        if len(hashes):
            n = np.bincount(row, minlength=rows) if total is None else total
            slots.append((mix64(hashes + np.uint64(seed)) >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(row)
            values.append(SCALE / np.maximum(n, 1)[row])

    def bigrams(hashes, row):
        same = row[1:] == row[:-1]
        return mix64(hashes[:-1] * np.uint64(3) + hashes[1:])[same], row[1:][same]

    with np.errstate(over="ignore"):
        for seed, (hashes, row) in ((11, word_hashes(data, offsets)), (23, _shape_words(data, offsets))):
            add(hashes, row, seed)
            pair, prow = bigrams(hashes, row)
            add(pair, prow, seed + 1)
            if seed == 11 and len(pair):
                order = order_in_rows(pair, prow)
                again = np.zeros(len(pair), dtype=bool)
                again[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (prow[order[1:]] == prow[order[:-1]])
                add(np.zeros(int(again.sum()), dtype=np.uint64), prow[again], 37, np.bincount(prow, minlength=rows))
    if not slots:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return np.concatenate(slots), np.concatenate(of), np.concatenate(values)


def _shape_words(data: np.ndarray, offsets: np.ndarray):
    short, ends = _shapes(data, offsets)
    shifted = short.copy()
    shifted[short == ord("A")] = 1  # not folded with a
    return word_hashes(shifted, ends)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slot, row, value = features(data, offsets)
        total = np.bincount(row, weights=self.weights[slot] * value, minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss over sparse rows."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -500, 500)))
        g = (p - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(documents: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int = PER_CLASS) -> Model:
    """Fit on about per_class documents of each value (0 and 1) of labels' column `label` where `training` holds.

    Only hashed features of that sample come to the driver.  With no labelled
    text, or with one class only, the model scores by the classes' shares alone.
    """
    small_batches(documents.sparkSession)
    few, counts = labelled_texts(documents, labels, label, training, per_class)

    def rows(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, e in chunks(offsets):
                slot, row, value = features(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                key, inverse = np.unique(row << BITS | slot, return_inverse=True)
                sums = np.bincount(inverse, weights=value, minlength=len(key)).astype(np.float32)
                cut = np.searchsorted(key >> BITS, np.arange(e - a + 1))
                at = (key & ((1 << BITS) - 1)).astype(np.int32)
                blobs = [[x[cut[k] : cut[k + 1]].tobytes() for k in range(e - a)] for x in (at, sums)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), batch.column(2).slice(a, e - a).cast(pa.float64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["doc_id", "label", "slots", "sums"])

    got = few.mapInArrow(rows, "doc_id long, label double, slots binary, sums binary").toPandas()
    n1 = sum(n for k, n in counts.items() if k == 1)
    n0 = sum(n for k, n in counts.items() if k == 0)
    s1, s0 = int((got["label"] == 1).sum()), int((got["label"] == 0).sum())
    learner, bias = Ftrl((1 << BITS) + 1), 1 << BITS
    if s1 and s0:
        got["order"] = [hash_order(x) for x in got["doc_id"]]
        got = got.sort_values(["order", "doc_id"])
        pairs = [(np.append(np.frombuffer(a, dtype=np.int32), bias), np.append(np.frombuffer(v, dtype=np.float32), 1.0).astype(np.float64), y) for a, v, y in zip(got["slots"], got["sums"], got["label"], strict=True)]
        for _ in range(EPOCHS):
            for at, value, y in pairs:
                learner.learn(at, value, y)
    everything = learner.weights(slice(None))
    prior = np.log((n1 + 1) / (n0 + 1))
    if s1 and s0:
        prior -= np.log((s1 + 1) / (s0 + 1))  # what was learned has the sample's shares in it
    return Model(everything[:-1].astype(np.float32), float(everything[-1] + prior))


def hash_order(doc_id: int) -> int:
    return int(mix64(np.array([doc_id & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= 0.5) of every row of `documents` (doc_id, text).

    Null and empty texts have no n-grams: their score is the bias alone.  Equal
    texts score equally; other columns are not read; no row gives no row.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            score = [m.score(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]) for a, e in chunks(offsets)]
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
