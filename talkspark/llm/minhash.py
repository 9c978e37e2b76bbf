"""MinHash near-duplicates with SetSketch registers.

A register holds the exponentially spaced, truncated minimum of an exponentially distributed hash
over the shingles of a set, so registers merge by maximum and are equal with about the Jaccard
similarity of two sets.  Runs of registers are the bands that bring sets together.  The counts of
larger, smaller and equal registers give the joint likelihood of a similarity; pairs for which the
limit is credible are verified on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspark.llm import arrow, links
from talkspark.llm.names import fresh
from talkspark.llm.store import keep, scope


#: Pairs that a row may propose in the round before the whole ones.
LIKELIEST = 4


@dataclass(frozen=True)
class Sketch:
    """``base`` spaces the register values, ``rate`` is the exponential's.

    24 bands of 4 registers miss a pair at similarity 0.80 once in 300,000 times, at 0.85 once in
    40 million.  The registers beyond the bands sharpen the estimate alone.
    """

    bands: int = 24
    rows: int = 4
    more: int = 96
    base: float = 1.001
    rate: float = 20.0
    seed: int = 6

    @property
    def size(self) -> int:
        return self.bands * self.rows + self.more

    def factors(self) -> np.ndarray:
        return arrow.mix(np.arange(1, self.size + 1, dtype=np.uint64) + np.uint64(self.seed << 32)) | np.uint64(1)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` lower-cased (A-Z) words, and the n + 1 offsets of the texts.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    data, offsets = arrow.raw(texts)
    words = arrow.Words(data, offsets, lower=True)
    hashes, count, bounds = words.hashes(), words.count, words.bounds
    number = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros(at[-1], np.uint64)
    full = arrow.window_hash(hashes, width)
    long_enough = np.flatnonzero(count >= width)
    place = np.repeat(at[long_enough], number[long_enough])
    start = np.repeat(bounds[:-1][long_enough], number[long_enough])
    step = np.arange(len(place)) - np.repeat(np.concatenate([[0], np.cumsum(number[long_enough])])[:-1], number[long_enough])
    out[place + step] = full[start + step]
    for i in np.flatnonzero((count > 0) & (count < width)):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[at[i]] = arrow.window_hash(own, len(own))[0] ^ np.uint64(len(own))
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the first of equal values of a text, and the key of each value with its text."""
    text = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    keys = arrow.mix(values + arrow.mix(text + np.uint64(1)))
    order = np.argsort(keys)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    mask = np.zeros(len(keys), bool)
    mask[order[fresh]] = True
    return mask, keys


def sketches(texts: pa.Array, sketch: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: size of its shingle set, two 64-bit sums that name the set, and its registers."""
    values, at = shingles(texts)
    n = len(at) - 1
    mask, _ = distinct(values, at)
    size = arrow.sums(mask, at)

    def total(x: np.ndarray) -> np.ndarray:
        run = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(np.where(mask, x, np.uint64(0)), out=run[1:])
        return run[at[1:]] - run[at[:-1]]

    first, second = total(arrow.mix(values)), total(arrow.mix(values ^ arrow.BYTE_VALUE[7]))
    registers = np.zeros((n, sketch.size), np.uint16)
    full = np.flatnonzero(size)
    if len(full):
        least = np.zeros((len(full), sketch.size))
        scratch = np.empty_like(values)
        for r, factor in enumerate(sketch.factors()):
            np.multiply(values, factor, out=scratch)
            least[:, r] = np.minimum.reduceat(scratch, at[:-1][full])
        exponential = -np.log1p(-(least + 0.5) / 2.0**64) / sketch.rate
        spaced = np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / math.log(sketch.base))
        registers[full] = np.clip(spaced, 0, 65535).astype(np.uint16)
    return size, first, second, registers


def bands(registers: np.ndarray, sketch: Sketch) -> np.ndarray:
    out = np.zeros((len(registers), sketch.bands), np.uint64)
    for b in range(sketch.bands):
        key = np.full(len(registers), b + 1, np.uint64)
        for r in range(sketch.rows):
            key = arrow.mix(key + registers[:, b * sketch.rows + r])
        out[:, b] = key
    return out


def credible(equal: np.ndarray, more: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: float, sketch: Sketch, sigmas: float = 4.5) -> np.ndarray:
    """Whether a similarity of ``limit`` or more is within ``sigmas`` of the likeliest one.

    The log likelihood of similarity J is D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(rest) with
    p(x) = -log_b(1 - x (b - 1) / b) and u, v the shares of the two set sizes.  The similarities
    from ``limit`` to the size ratio have a grid of their own that begins at ``limit``: where the
    two are close, the likelihood falls steeply towards the ratio, at which the smaller set has
    nothing of its own.
    """
    less = sketch.size - equal - more
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    ratio = np.minimum(u / v, v / u)

    def law(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (sketch.base - 1) / sketch.base) / math.log(sketch.base), 1e-9)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = law(u - v * j), law(v - u * j)
        return more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-9))

    best = likelihood(np.linspace(0, 1, 51)[None, :] * ratio).max(1)
    reached = likelihood(limit + np.linspace(0, 1, 9)[None, :] * (ratio - limit)).max(1)
    return (reached >= best - sigmas * sigmas / 2) & (ratio[:, 0] >= limit - 1e-9)


def _candidates(piece: pa.Table, percent: int, sketch: Sketch, mode: str) -> pa.RecordBatch:
    """Pairs of one piece that lie in different components and may reach the limit.

    ``likeliest``: the likeliest of each row, as (row, its peer).  Else all credible ones are held
    against the rows' shingles cut to 32 bits, which can only find too many in common, so that no
    pair that reaches the limit is lost and few others leave the task.  ``linking``: a pair whose
    components earlier ones of the piece connect is left out; while those hold, it changes nothing.
    """
    best = mode == "likeliest"
    ids = piece.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    n = piece.column("n").to_numpy()[order].astype(np.float64)
    group = piece.column("component").to_numpy()[order]  # a copy: linking changes it
    part = piece.column("part").to_numpy()[order]
    registers = np.frombuffer(b"".join(piece.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)[order]
    key = np.int64(piece.column("key")[0].as_py()).astype(np.uint64)
    alone = piece.column("i")[0].as_py() == piece.column("j")[0].as_py()
    one = part == piece.column("i")[0].as_py()
    rows, columns = np.flatnonzero(one), np.arange(len(ids)) if alone else np.flatnonzero(~one)
    limit = percent / 100
    banded = np.ascontiguousarray(registers[:, : sketch.bands * sketch.rows])
    # Far fewer equal registers than the limit leads to: no further look is needed.
    few = banded.shape[1] * (limit - 5 * math.sqrt(limit * (1 - limit) / banded.shape[1]))
    sets = [] if best else [np.frombuffer(x, np.uint32) for x in np.array(piece.column("cut").to_pylist(), object)[order]]
    marks = bands(registers, sketch)
    band = int(np.argmax(marks[0] == key))
    found_a, found_b, found_equal = [], [], []
    for r in rows:
        to = columns[(group[columns] != group[r]) & (np.minimum(n[columns], n[r]) >= limit * np.maximum(n[columns], n[r]))]
        if alone:
            to = to[to > r]
        to = to[(banded[to] == banded[r]).sum(1) >= few]
        if len(to) and band:  # a pair counts in the first band that holds it
            to = to[~(marks[to, :band] == marks[r, :band]).any(1)]
        if not len(to):
            continue
        equal = (registers[to] == registers[r]).sum(1)
        more = (registers[to] < registers[r]).sum(1)
        fine = credible(equal, more, np.full(len(to), n[r]), n[to], limit, sketch)
        to, equal = to[fine], equal[fine]
        if not best and len(to):
            flat = np.concatenate([sets[t] for t in to])
            at = np.concatenate([[0], np.cumsum([len(sets[t]) for t in to])])
            spot = np.minimum(np.searchsorted(sets[r], flat), len(sets[r]) - 1)
            both = arrow.sums(sets[r][spot] == flat, at)
            reach = 100 * both >= percent * (n[to] + n[r] - both)
            to, equal = to[reach], equal[reach]
            if mode == "linking":
                joined, at = np.unique(group[to], return_index=True)
                to, equal = to[at], equal[at]
                group[np.isin(group, joined)] = group[r]
        found_a.append(np.full(len(to), r))
        found_b.append(to)
        found_equal.append(equal)
    if not found_a:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "b", "equal"])
    a, b, equal = map(np.concatenate, (found_a, found_b, found_equal))
    if best and len(a):
        a, b, equal = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([equal, equal])
        order = np.lexsort((b, -equal, a))
        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
        a, b, equal = a[first], b[first], equal[first]
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(equal.astype(np.int64))], names=["a", "b", "equal"])


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (row, peer, equal) of all pieces the ``LIKELIEST`` of each row, each pair once."""
    first = Window.partitionBy("a").orderBy(F.col("equal").desc(), "b")
    few = pairs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LIKELIEST)
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shared(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the full shingle sets of each pair of texts."""
    sides = []
    for texts in (texts_a, texts_b):
        values, at = shingles(texts)
        mask, keys = distinct(values, at)
        pair = np.repeat(np.arange(len(at) - 1), np.diff(at))
        sides.append((keys[mask], pair[mask], arrow.sums(mask, at)))
    keys = np.concatenate([s[0] for s in sides])
    pair = np.concatenate([s[1] for s in sides])
    order = np.argsort(keys)
    same = order[1:][keys[order][1:] == keys[order][:-1]]
    both = np.bincount(pair[same], minlength=len(texts_a))
    return both, sides[0][2] + sides[1][2] - both


def _cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, cut``: the distinct shingles of each text, cut to 32 bits and sorted."""
    for batch in batches:
        for part in arrow.slices(batch, "text"):
            values, at = shingles(part.column("text"))
            mask, _ = distinct(values, at)
            cut = [np.sort((values[a:b][mask[a:b]] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cut, pa.binary())], names=["id", "cut"])


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the limit; ``texts`` has id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text_a"):
                both, union = _shared(part.column("text_a"), part.column("text_b"))
                good = 100 * both >= percent * union
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good))

    of_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(arrow.freeing(run), "a long, b long")


def components_of(edges: DataFrame) -> DataFrame:
    """The components, kept; the tables of their rounds go."""
    with scope() as rounds:
        return rounds.save(keep(links.components(edges)))


def near_duplicates(docs: DataFrame, percent: int = 80, sketch: Sketch = Sketch(), part_rows: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Equal sets are one class, represented by its smallest doc_id.  Rounds of verification:
    the centre that a class shares most bands with; then, in buckets that still hold several
    components, the likeliest few pairs of each class across components, looked for in one part of
    a bucket, so that this round grows with the rows; then all of them, of which a piece hands on
    those that link its components; where one of these fails, all once more and each handed on.
    A pair inside one component needs no check, as it can't change the components; no bucket,
    partner or pair is capped.

    Null, empty and wordless texts have an empty set and link with nothing; rows without doc_id
    link with nothing and have a null component; rows that share a doc_id are one node; other
    columns are not read; an empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow.slices(batch, "text"):
                size, first, second, registers = sketches(part.column("text"), sketch)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(size.astype(np.int64)),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    names=["doc_id", "n", "first", "second", "registers"],
                )

    all_sets = keep(base.mapInArrow(arrow.freeing(sketched), "doc_id long, n long, first long, second long, registers binary"))
    linkable = all_sets.where("n > 0 and doc_id is not null")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            keys = bands(registers, sketch).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "n", "registers", "keys"])

    with scope() as inner:
        classes = keep(
            linkable.groupBy("first", "second", "n")
            .agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers"))
            .select("id", "n", "registers")
            .mapInArrow(arrow.freeing(banded), "id long, n long, registers binary, keys array<long>")
        )
        keys = classes.select(F.explode("keys").alias("key"), "id")
        centres = keys.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("size")).where("size > 1")
        near = keep(keys.join(centres, "key").select("key", "id", "centre"))
        texts = keep(
            base.join(near.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
            .join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
            .select(F.col("doc_id").alias("id"), "text")
        )
        shared = near.where("id <> centre").groupBy("id", "centre").agg(F.count("*").alias("bands"))
        stars = shared.groupBy("id").agg(F.max_by("centre", F.struct("bands", -F.col("centre"))).alias("b")).select(F.col("id").alias("a"), "b")
        edges = keep(verified(stars, texts, percent))
        groups = components_of(edges)
        for mode in ("likeliest", "linking", "all"):
            state = classes.select("id", "n", "registers").join(groups.withColumnRenamed("node", "id"), "id", "left")
            state = keep(
                state.join(near.select("id").distinct(), "id", "left_semi").select("id", "n", "registers", F.coalesce("component", "id").alias("component"))
            )
            mixed = (
                near.select("key", "id")
                .join(state.select("id", "component"), "id")
                .groupBy("key")
                .agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
                .where("low <> high")
                .select("key", "size")
            )
            if mode != "likeliest":
                busy = near.select("key", "id").join(mixed, "key").select("id").distinct()
                state = state.join(texts.join(busy, "id", "left_semi").mapInArrow(arrow.freeing(_cut_sets), "id long, cut binary"), "id")
            deal = links.parts if mode == "likeliest" else links.blocks
            members = deal(near.select("key", "id"), mixed, part_rows).join(state, "id")

            def candidates(batches: Iterator[pa.RecordBatch], mode: str = mode) -> Iterator[pa.RecordBatch]:
                for piece in links.pieces(batches, ("key", "i", "j")):
                    yield _candidates(piece, percent, sketch, mode)

            pairs = links.dealt(members).mapInArrow(arrow.freeing(candidates), "a long, b long, equal long")
            pairs = keep(likeliest(pairs) if mode == "likeliest" else pairs.select("a", "b"))
            fresh = keep(verified(pairs, texts, percent))
            if not fresh.isEmpty():  # else the components stand as they are
                edges = edges.union(fresh)
                groups = components_of(edges)
            if mode == "linking" and fresh.count() == pairs.count():
                break
        inner.save(groups)
    named = linkable.groupBy("first", "second", "n").agg(F.min("doc_id").alias("id"))
    state = named.join(groups.withColumnRenamed("node", "id"), "id", "left").select(
        "first", "second", "n", F.coalesce("component", "id").alias("component_id")
    )
    linked = linkable.join(state, ["first", "second", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    lone = all_sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of ``docs`` (all columns) of each group of near-duplicates, the first by doc_id, null last.

    Every row is a node of its own here, so that rows that share a doc_id and rows without one are
    held against the others like any row; ties go by row number.  Rows without words link with
    nothing and stay.
    """
    row, group, first = (fresh(c, docs.columns) for c in ("row", "group", "first"))
    rows = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    with scope() as inner:
        groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), percent)
        groups = inner.save(keep(groups.select(F.col("doc_id").alias(row), F.col("component_id").alias(group))))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(row).alias("number"))
    chosen = rows.select("doc_id", row).join(groups, row).groupBy(group).agg(F.min(order).alias(first)).select(F.col(first)["number"].alias(row))
    return rows.join(chosen, row, "left_semi").select(*docs.columns)
