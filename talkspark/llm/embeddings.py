"""Embedding near-duplicates by Euclidean p-stable hashing, followed by exact cosine checks.

A table hashes a normalised vector to the cells of ``width`` along ``projections`` random normal
directions with random offsets.  At cosine 0.98 (distance 0.2) a table with the default values
brings a pair together with probability 0.26, so 40 tables miss one in 170,000 such pairs; closer
pairs are missed less often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.functions.lineage import checkpointed as cut
from talkspark.llm import arrow, links


def _rows(column: pa.Array) -> np.ndarray:
    """Equal-length list column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def signatures(vectors: np.ndarray, label: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """A bucket number (64 bits, of label, table and cells) per vector and table."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, vectors.shape[1]])
    out = np.zeros((len(unit), tables), np.uint64)
    for t in range(tables):
        axes = rng.standard_normal((vectors.shape[1], projections))
        shift = rng.uniform(0, width, projections)
        cells = np.floor((unit @ axes + shift) / width).astype(np.int64).astype(np.uint64)
        key = arrow.mix(label.astype(np.int64).astype(np.uint64) + arrow.mix(np.full(len(unit), t + 1, np.uint64)))
        for j in range(projections):
            key = arrow.mix(key + cells[:, j] * np.uint64(2 * j + 1))
        out[:, t] = key
    return out


def _compare(piece: pa.Table, least: float, tables: int) -> pa.RecordBatch:
    """Links found in one piece: links of each vector, and the smallest vector it reaches there."""
    piece = piece.combine_chunks()
    ids = piece.column("id").to_numpy()
    weight = piece.column("n").to_numpy()
    part = piece.column("part").to_numpy()
    vectors = np.frombuffer(b"".join(piece.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
    marks = np.frombuffer(b"".join(piece.column("marks").to_pylist()), np.uint64).reshape(len(ids), tables)
    key = np.int64(piece.column("key")[0].as_py()).astype(np.uint64)
    order = np.argsort(ids, kind="stable")
    ids, weight, part, vectors, marks = ids[order], weight[order], part[order], vectors[order], marks[order]
    norm = np.sqrt((vectors * vectors).sum(1))
    one = part == piece.column("i")[0].as_py()
    alone = piece.column("i")[0].as_py() == piece.column("j")[0].as_py()
    rows, columns = np.flatnonzero(one), np.arange(len(ids)) if alone else np.flatnonzero(~one)
    cosine = (vectors[rows] @ vectors[columns].T) / np.outer(norm[rows], norm[columns])
    # Near the limit the product of matrices may round otherwise than a plain sum does.
    a, b = np.nonzero(cosine >= least - 1e-9)
    a, b = rows[a], columns[b]
    if alone:
        a, b = a[a < b], b[a < b]
    exact = (vectors[a] * vectors[b]).sum(1) / (norm[a] * norm[b])
    a, b = a[exact >= least], b[exact >= least]
    # A pair counts in the first table that holds it.
    table = int(np.argmax(marks[0] == key))
    fresh = ~(marks[a, :table] == marks[b, :table]).any(1) if table else np.ones(len(a), bool)
    a, b = a[fresh], b[fresh]
    degree = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    reach = links.smallest_reachable(a, b, len(ids))
    found = np.flatnonzero(degree)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[found]), pa.array(degree[found].astype(np.int64)), pa.array(ids[reach[found]])], names=["id", "degree", "peer"]
    )


def near_duplicates(
    rows: DataFrame,
    least: float = 0.98,
    tables: int = 40,
    projections: int = 16,
    width: float = 2.0,
    part_rows: int = 1024,
    seed: int = 5,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows`` (vec_id, embedding, label).

    Only rows with equal non-null labels are compared.  Null, empty and zero vectors, those with
    null or non-finite components, and rows without label or id link with nothing: 0 links, their
    own component.  Equal vectors of a label are one class that is hashed and compared once; its
    copies link with each other and share its links.  Vectors of different lengths never meet.
    Rows that share a vec_id are one node.  Other columns are not read; an empty table gives an
    empty result.

    A piece of a bucket yields one row per linked vector, never its pairs, so the result of a
    group of copies grows with the group.  No bucket or partner is dropped.
    """
    base = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("long").alias("label"),
    )
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    usable = F.coalesce(usable, F.lit(False))
    good = base.where(usable).withColumn("print", F.xxhash64("label", "vector"))
    classes = good.groupBy("print", "label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                vectors = _rows(own.column("vector"))
                marks = signatures(vectors, own.column("label").to_numpy(), tables, projections, width, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("id"),
                        own.column("n"),
                        pa.array([v.tobytes() for v in vectors], pa.binary()),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.array(list(marks.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "vector", "marks", "keys"],
                )

    hashed_classes = cut(
        classes.select("id", "n", "label", "vector").mapInArrow(arrow.freeing(hashed), "id long, n long, vector binary, marks binary, keys array<long>")
    )
    keys = hashed_classes.select(F.explode("keys").alias("key"), "id")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = links.blocks(keys, sizes, part_rows).join(hashed_classes.drop("keys"), "id")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in links.pieces(batches, ("key", "i", "j")):
            if piece.num_rows > 1:
                yield _compare(piece, least, tables)

    found = cut(links.dealt(members).mapInArrow(arrow.freeing(compared), "id long, degree long, peer long"))
    degrees = found.groupBy("id").agg(F.sum("degree").alias("degree"))
    groups = links.components(found.select(F.col("id").alias("a"), F.col("peer").alias("b")))
    state = (
        classes.select("print", "label", "vector", "id", "n")
        .join(degrees, "id", "left")
        .join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "print",
            F.col("label").alias("_label"),
            F.col("vector").alias("_vector"),
            (F.coalesce("degree", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    linked = good.join(state, "print").where((F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")))
    lone = base.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id")).unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
