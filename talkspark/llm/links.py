"""Shared parts of the near-duplicate operators: bucket members in bounded blocks, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm.store import keep


def blocks(keys: DataFrame, sizes: DataFrame, most: int = 1024) -> DataFrame:
    """``key, i, j, part, id`` from ``keys`` (key, id) for the buckets in ``sizes`` (key, size).

    Members of a bucket are dealt to parts of about ``most``; each pair of parts (i <= j) is one
    piece of work, so that a bucket with any share of all rows becomes many bounded pieces.
    """
    parts = F.ceil(F.col("size") / most).cast("int")
    return (
        keys.join(sizes, "key")
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id")
    )


def parts(keys: DataFrame, sizes: DataFrame, most: int = 1024) -> DataFrame:
    """Like ``blocks``, but a row meets only its own part, dealt anew in each bucket."""
    number = F.ceil(F.col("size") / most)
    part = F.pmod(F.xxhash64(F.lit("part"), "key", "id"), number).cast("int")
    return keys.join(sizes, "key").select("key", part.alias("i"), part.alias("j"), part.alias("part"), "id")


def pieces(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one piece after the other from a stream that is sorted by the columns ``by``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the smallest node reachable from each."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Rows of a table of edges or nodes that one task takes.
ROWS_A_TASK = 100_000


def packed(table: DataFrame, rows: int) -> DataFrame:
    """``table`` of ``rows`` rows read by as many tasks as they fill; one task needs no exchange."""
    most = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.coalesce(max(1, min(most, math.ceil(rows / ROWS_A_TASK))))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``edges`` (a, b); the component is its smallest node.

    In each round a node goes to the node that is first, in a random order of that round, among
    itself, its neighbours and theirs; that step is followed twice and the graph contracted, so
    that a star is one node after a round and whatever the shape the nodes left fall by a constant
    factor a round.  Edges stay in Spark; only their number reaches the driver.
    """
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found: DataFrame | None = None
    number = total = 0
    while (rows := left.count()) or found is None:
        total = max(total, rows)
        few = packed(left, rows)
        both = few.select(F.inline(F.expr("array(struct(a as node, b as peer), struct(b as node, a as peer))")))

        def place(column: str, number: int = number):
            return F.struct(F.xxhash64(F.lit(number), column).alias("h"), F.col(column).alias("id"))

        first = both.groupBy("node").agg(F.min(place("peer")).alias("first")).select(F.col("node").alias("peer"), F.least("first", place("node")).alias("first"))
        parent = both.join(first, "peer").groupBy("node").agg(F.min("first")["id"].alias("up"))
        higher = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = packed(keep(parent.join(higher, "up").select("node", F.col("top").alias("up"))), 2 * rows)
        of_a = step.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        of_b = step.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        moved = few.join(of_a, "a").join(of_b, "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        left = keep(moved.where("a < b").distinct())
        if found is None:
            found = step.toDF("node", "root")
        else:
            onward = step.toDF("root", "next")
            found = packed(keep(found.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))), 2 * total)
        number += 1
    return found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")


def dealt(members: DataFrame) -> DataFrame:
    """Pieces dealt over as many tasks as the session shuffles to; small rows may mean long work."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
