"""Many patterns looked for in every text by one walk over it.

Patterns and texts meet in groups: a key's patterns (in parts, if they are many) and some of the
key's texts.  A task reads a group's patterns first, builds one automaton of them (Aho-Corasick) and
walks it over the texts that follow, batch by batch.  So it holds one part of the patterns and never
a group's texts, and a text travels once, whatever its length.

* A key with many texts is cut into groups of ``GROUP_ROWS`` texts, or of as many as it has patterns
  if these are more; copies of patterns therefore never outnumber the texts.
* A key's patterns beyond ``PART_BYTES`` go to several parts, and its texts to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions.ordered import as_list

PART_BYTES = 4 << 20
#: What a pattern counts beside its own bytes.
PATTERN_BYTES = 64
GROUP_ROWS = 4096
BEGIN, PATTERN, TEXT = 0, 1, 2
OUT_ROWS = 8192


class Automaton:
    """All patterns of one part; equal patterns are one word with several rows."""

    def __init__(self, held: list[pa.RecordBatch]):
        self.rows = pa.concat_arrays([b.column("_pat") for b in held])
        places: dict[str, list[int]] = {}
        for i, pin in enumerate(p for b in held for p in b.column("_pin").to_pylist()):
            places.setdefault(pin, []).append(i)
        self.lengths = [len(p) for p in places]
        self.places = list(places.values())
        self.words = ahocorasick.Automaton()
        for number, pin in enumerate(places):
            self.words.add_word(pin, number)
        self.words.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """How often each word stands in ``text``, from left to right without overlap."""
        found: dict[int, int] = {}
        free: dict[int, int] = {}
        for end, word in self.words.iter(text):
            if end - self.lengths[word] >= free.get(word, -1):
                found[word] = found.get(word, 0) + 1
                free[word] = end
        return found

    def hits(self, texts: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at: list[int] = []
        of: list[int] = []
        times: list[int] = []
        for j, text in enumerate(texts.column("_hay").to_pylist()):
            for word, n in self.counts(text).items():
                at += [j] * len(self.places[word])
                of += self.places[word]
                times += [n] * len(self.places[word])
            if len(at) >= OUT_ROWS:
                yield self._batch(texts, at, of, times)
                at, of, times = [], [], []
        if at:
            yield self._batch(texts, at, of, times)

    def _batch(self, texts: pa.RecordBatch, at: list[int], of: list[int], times: list[int]) -> pa.RecordBatch:
        own = [c for c in ("_text", "_row") if c in texts.schema.names]
        taken = [texts.column(c).take(pa.array(at, pa.int64())) for c in own]
        return pa.RecordBatch.from_arrays(
            [*taken, self.rows.take(pa.array(of, pa.int64())), pa.array(times, pa.int64())], names=[*own, "_pat", "_n"]
        )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups one after the other: a row that begins it, its patterns, its texts."""
    held: list[pa.RecordBatch] = []
    machine: Automaton | None = None
    for batch in batches:
        side = batch.column("_side").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            run = batch.slice(a, b - a)
            if side[a] == BEGIN:
                held, machine = [], None
            elif side[a] == PATTERN:
                held.append(run.select(["_pin", "_pat"]))
            else:
                if held:
                    held, machine = [], Automaton(held)
                if machine is not None:
                    yield from machine.hits(run)


def pattern_join(
    rows: DataFrame,
    patterns: DataFrame,
    keys: str | Sequence[str],
    text: str,
    pattern: str,
    ignore_case: bool = True,
    carry: Sequence[str] | None = None,
    part_bytes: int = PART_BYTES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Every row with every pattern of its ``keys`` (none: of all) that stands in its ``text``.

    Columns: ``carry`` of the rows (all, if not given), the patterns' but for the keys, and ``_n``,
    how often the pattern stands there without overlap.  Null keys meet nothing; null and empty texts
    and patterns neither; repeated rows and patterns count each.
    """
    keys = as_list(keys)
    names = [f"_k{i}" for i in range(max(1, len(keys)))]
    kept = list(rows.columns if carry is None else carry)
    given = [c for c in patterns.columns if c not in keys]

    def fold(c: Column) -> Column:
        return F.lower(c) if ignore_case else c

    def shaped(df: DataFrame, columns: list[str]) -> list[Column]:
        key = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias(names[0])]
        return [*key, F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in columns])]

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    *key, row = shaped(rows, [c for c in kept if c != text])
    texts = rows.select(*key, row.alias("_row"), F.col(f"`{text}`").alias("_text")).filter(F.length("_text") > 0)
    *key, row = shaped(patterns, given)
    pins = patterns.select(*key, row.alias("_pat"), fold(F.col(f"`{pattern}`")).alias("_pin")).filter(F.length("_pin") > 0)
    sizes = pins.groupBy(*names).agg(F.count("*").alias("_p"), F.sum(F.octet_length("_pin") + F.lit(PATTERN_BYTES)).alias("_b"))
    deal = sizes.join(texts.groupBy(*names).agg(F.count("*").alias("_t")), names).select(
        *names,
        F.ceil(F.col("_b") / part_bytes).cast("int").alias("_parts"),
        F.ceil(F.col("_t") / F.greatest(F.lit(group_rows), "_p")).cast("int").alias("_salts"),
    )
    place = [*names, "_part", "_salt"]
    begins = deal.withColumn("_part", each("_parts")).withColumn("_salt", each("_salts")).select(*place, F.lit(BEGIN).alias("_side"))
    dealt_pins = pins.join(deal, names).withColumn("_part", F.expr("cast(pmod(xxhash64(_pin), _parts) as int)")).withColumn("_salt", each("_salts"))
    dealt_texts = texts.join(deal, names).withColumn("_salt", F.expr("cast(pmod(xxhash64(_text, _row), _salts) as int)")).withColumn("_part", each("_parts"))
    every = begins.unionByName(
        dealt_pins.select(*place, F.lit(PATTERN).alias("_side"), "_pin", "_pat"), allowMissingColumns=True
    ).unionByName(dealt_texts.select(*place, F.lit(TEXT).alias("_side"), "_row", "_text"), allowMissingColumns=True)
    sorted_ = every.repartition(*place).sortWithinPartitions(*place, "_side")
    walked = sorted_.select("_side", "_pin", "_pat", "_row", fold(F.col("_text")).alias("_hay"), *(["_text"] if text in kept else []))
    out = [walked.schema[c] for c in (["_text"] if text in kept else [])] + [walked.schema["_row"], walked.schema["_pat"]]
    found = walked.mapInArrow(_walk, T.StructType([*out, T.StructField("_n", T.LongType())]))
    return found.select(
        *[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in kept],
        *[F.col(f"_pat.`{c}`").alias(c) for c in given],
        "_n",
    )


def contains_join(
    rows: DataFrame, patterns: DataFrame, keys: str | Sequence[str], text: str, pattern: str, ignore_case: bool = True
) -> DataFrame:
    """Rows whose ``text`` contains ``pattern``, with the pattern's columns."""
    return pattern_join(rows, patterns, keys, text, pattern, ignore_case).drop("_n")
