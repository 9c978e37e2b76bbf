"""Quality rules: base rules on word and line statistics, then boosted trees.

The trees see document statistics only.  The score may never rise with the share of symbols,
repeated lines or repeated word windows (monotonic constraints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm import arrow, boost, sample

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
DIGITS = np.zeros(256, bool)
DIGITS[list(b"0123456789")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STOPS = np.zeros(256, bool)
STOPS[list(b".!?")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b",;:-_/\\()[]{}\"'=+@~^`")] = True
#: Counts that the contract asks for, in order, then counts that only the trees see.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_digits", "n_upper", "n_stops", "n_marks", "n_distinct", "longest_word")
FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "line_words",
    "digit_share", "upper_share", "stop_share", "mark_share", "distinct_share", "longest_word",
)
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share")}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``BASE + MORE`` counts per text; null and empty texts have zeros.

    Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at \\n and compared whole, only lines with
    a word count.  A word is repeated if a 3-word window over it stands twice or more in the text
    (64-bit hashes of words stand for the words).
    """
    data, offsets = arrow.raw(texts)
    n = len(offsets) - 1
    words = arrow.Words(data, offsets)
    out = np.zeros((n, len(BASE) + len(MORE)), np.int64)
    code_point = (data & 0xC0) != 0x80
    out[:, 0] = words.count
    out[:, 1] = arrow.sums(code_point & ~arrow.SPACE[data], offsets)
    out[:, 2] = arrow.sums(SYMBOLS[data], offsets)
    for k, table in enumerate((DIGITS, UPPER, STOPS, MARKS)):
        out[:, 6 + k] = arrow.sums(table[data], offsets)
    if not len(words.start):
        return out
    text = words.text
    prefix = arrow.prefix_hash(data)
    hashes = arrow.span_hash(prefix, words.start, words.end)
    # repeated 3-word windows
    if len(hashes) >= 3:
        window = arrow.window_hash(hashes, 3)
        inside = np.flatnonzero(text[2:] == text[:-2])
        if len(inside):
            keys = arrow.mix(window[inside] + arrow.mix(text[inside] + 1))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            twice = np.zeros(len(keys), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            covered = np.zeros(len(hashes), bool)
            for j in range(3):
                covered[at + j] = True
            out[:, 4] = arrow.sums(covered, words.bounds)
    # lines
    line_end = np.zeros(len(data) + 1, bool)
    line_end[offsets] = True
    line_end[:-1] |= data == 10
    line_end[0] = True
    edges = np.flatnonzero(line_end)  # a line starts at an edge, behind its \n if that is one
    start, end = edges[:-1], edges[1:]
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets] = True
    start = start + ((data[start] == 10) & ~begins_text[start])
    # A text that begins with \n has an empty first line; its edge is the text's own start.
    start = np.where((start < end) & (data[np.minimum(start, len(data) - 1)] == 10) & begins_text[start], start + 1, start)
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    line_text = np.searchsorted(offsets, start, "right") - 1
    keys = arrow.mix(arrow.span_hash(prefix, start, end) + arrow.mix(line_text + 1))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), np.int64)
    later[order[1:][keys[order][1:] == keys[order][:-1]]] = 1
    out[:, 3] = np.bincount(line_text, later, n).astype(np.int64)
    out[:, 5] = np.bincount(line_text, minlength=n)
    # distinct words per text, and the longest
    sizes = words.end - words.start
    first = np.flatnonzero(words.count)
    out[first, 11] = np.maximum.reduceat(sizes, words.bounds[:-1][first])
    keys = arrow.mix(hashes + arrow.mix(text + 1))
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    out[:, 10] = np.bincount(text[order], fresh, n).astype(np.int64)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    c = counts.astype(np.float64)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.stack(
        [
            np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / chars, c[:, 3] / lines, c[:, 4] / words, c[:, 0] / lines,
            c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words, c[:, 9] / words, c[:, 10] / np.sqrt(words), c[:, 11],
        ],
        1,
    )


def _counts_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    parts = [statistics(part.column(column)) for part in arrow.slices(batch, column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(BASE) + len(MORE)), np.int64)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> boost.Trees:
    """Trees for ``labels.quality`` from at most ``most`` labelled rows (twelve numbers each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_counts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), *(pa.array(x[:, j]) for j in range(x.shape[1]))],
                names=["doc_id", "label", *FEATURES],
            )

    rows = sample.labelled(docs, labels, "quality", most)
    schema = "doc_id long, label int, " + ", ".join(f"{f} double" for f in FEATURES)
    table = rows.select("doc_id", "label", "text").mapInArrow(arrow.freeing(run), schema).toPandas().sort_values("doc_id", kind="stable")
    return boost.fit(table[list(FEATURES)].to_numpy(), table["label"].to_numpy(), MONOTONE)


def judge(docs: DataFrame, trees: boost.Trees, threshold: float = 0.5, least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """Counts, base rules and verdict of each document.

    ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeat`` percent of the
    words repeated.  ``kept``: not failed, and the trees give at least ``threshold``.  Null and
    empty texts have zero counts and fail; null ids stay null; repeated rows give repeated rows;
    other columns are not read; an empty table gives an empty result.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts_of(batch, "text")
            n, repeat = counts[:, 0], counts[:, 4]
            failed = (n < least_words) | (100 * repeat > most_repeat * n)
            score = trees.score(features(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(counts[:, k]) for k in range(len(BASE))),
                    pa.array(failed),
                    pa.array(score),
                    pa.array(~failed & (score >= threshold)),
                ],
                names=["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(arrow.freeing(run), schema)
