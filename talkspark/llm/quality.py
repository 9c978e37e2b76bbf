"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Families of n-grams: words, word pairs, and the same over word shapes (classes of characters with
runs collapsed, so that unseen words share features), with one more feature for a pair of equal
words.  A family contributes the mean weight of its n-grams, a sparse dot product with
coefficients count / number, so texts of any length are on one scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm import arrow, sample

BITS = 18
SCALE = 8.0
#: Class of each byte for word shapes: lower, upper, digit, beyond ASCII; other bytes stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")


def _shapes(words: arrow.Words) -> np.ndarray:
    """A hash of each word's shape."""
    kind = SHAPE[words.data]
    first = np.ones(len(kind), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[words.start] = True
    place = np.concatenate([[0], np.cumsum(first)])
    return arrow.span_hash(arrow.prefix_hash(kind[first]), place[words.start], place[words.end])


def grams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: feature number of every n-gram, and the n + 1 offsets of the texts."""
    data, offsets = arrow.raw(texts)
    words = arrow.Words(data, offsets)
    mask = np.uint64((1 << BITS) - 1)
    whole, shape, text = words.hashes(), _shapes(words), words.text
    pair = np.flatnonzero(text[1:] == text[:-1]) if len(text) else np.zeros(0, np.int64)
    at = np.searchsorted(pair, words.bounds)
    three = pair[:-1][pair[1:] == pair[:-1] + 1] if len(pair) else pair
    at_three = np.searchsorted(three, words.bounds)

    def numbered(values: np.ndarray, family: int) -> np.ndarray:
        return (arrow.mix(values + arrow.BYTE_VALUE[family]) & mask).astype(np.int32)

    two = arrow.window_hash(whole, 2)[pair] if len(pair) else np.zeros(0, np.uint64)
    two_shapes = arrow.window_hash(shape, 2)[pair] if len(pair) else np.zeros(0, np.uint64)
    same = (whole[pair] == whole[pair + 1]).astype(np.uint64)
    again = (whole[three] == whole[three + 2]).astype(np.uint64)
    return [
        (numbered(whole, 1), words.bounds),
        (numbered(two, 2), at),
        (numbered(shape, 3), words.bounds),
        (numbered(two_shapes, 4), at),
        (numbered(same, 5), at),
        (numbered(again, 6), at_three),
    ]


def margins(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Sparse dot products of all texts of a slice; a text without words has the bias alone."""
    out = np.full(len(texts), bias)
    for number, at in grams(texts):
        out += SCALE * arrow.sums(weights[number].astype(np.float64), at) / np.maximum(np.diff(at), 1)
    return out


class Ftrl:
    """Follow-the-regularised-leader with a step size per coordinate."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / step)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, most: int = 8192, epochs: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias from at most ``most`` labelled documents that are not held out.

    Tasks turn the sample's whole texts into sparse vectors; the driver sees these alone.  The
    bias is the last coordinate.  Without labelled rows all weights are 0 (every score is 0.5).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_out, x_out = [], []
            for part in arrow.slices(batch, "text"):
                cells = [[] for _ in range(part.num_rows)]
                for number, at in grams(part.column("text")):
                    for i in range(part.num_rows):
                        own = number[at[i] : at[i + 1]]
                        if len(own):
                            which, count = np.unique(own, return_counts=True)
                            cells[i].append((which, count * (SCALE / len(own))))
                for c in cells:
                    which = np.concatenate([a for a, _ in c] or [np.zeros(0, np.int32)])
                    x = np.concatenate([b for _, b in c] or [np.zeros(0)])
                    own, place = np.unique(which, return_inverse=True)
                    at_out.append(own.astype(np.int32).tobytes())
                    x_out.append(np.bincount(place, x, len(own)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(at_out, pa.binary()), pa.array(x_out, pa.binary())],
                names=["doc_id", "label", "at", "x"],
            )

    rows = sample.labelled(docs, labels, "quality", most).select("doc_id", "label", "text")
    found = rows.mapInArrow(arrow.freeing(run), "doc_id long, label int, at binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending")])
    model = Ftrl((1 << BITS) + 1)
    at, x, y = (found.column(c).combine_chunks() for c in ("at", "x", "label"))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(found.num_rows):
            # Views of the collected buffers: no second copy of the sample is made.
            own, values = np.frombuffer(at[i].as_buffer(), np.int32), np.frombuffer(x[i].as_buffer(), np.float32)
            model.learn(np.append(own, 1 << BITS), np.append(values, 1.0).astype(np.float64), y[i].as_py())
    weights = model.weights()
    return weights[:-1].astype(np.float32), float(weights[-1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``, whole texts, no shuffle.

    The score reads the text alone.  Null and empty texts get the score of the bias; a null id
    stays null and is not held out; repeated rows give repeated rows; other columns are not read;
    an empty table gives an empty result.  The weights are one array of 2^18 numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [margins(part.column("text"), weights, bias) for part in arrow.slices(batch, "text")]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(parts) if parts else np.zeros(0), -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sample.held_out("doc_id").alias("held_out"), "text")
    return picked.mapInArrow(arrow.freeing(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores at least ``threshold``; no shuffle."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(margins(part.column("text"), weights, bias), -40, 40)))
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(p >= threshold)).columns, names=names)

    return docs.mapInArrow(arrow.freeing(run), schema)
