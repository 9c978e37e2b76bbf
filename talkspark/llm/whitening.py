"""Embedding whitening by an exact characteristic polynomial of the integer scatter matrix.

Entries become integers; the distinct vectors' sums and products are added up exactly by Spark.
Spark tasks reduce the scatter matrix to Hessenberg form modulo one prime each; the polynomial is
put together from the residues, its roots are isolated, and tasks find one eigenvector each.  What
reaches the driver is as large as the square of the vectors' length, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.llm import charpoly
from talkspark.llm.store import keep

STEP, SHIFT = 64, 1_000_000
#: Bits of a limb; products of two limbs summed over ``ROWS`` rows are exact as doubles.
LIMB, ROWS = 20, 4096
#: Limbs of 40 bits that hold a sum of products.
PARTS = 5
PRIMES_A_TASK = 8


def integers(rows: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, y`` (y = floor(64 c), long) of the usable rows, and their dimension.

    Usable vectors hold finite entries only and are as long as most of the usable ones (of equally
    frequent lengths the longest).
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = base.where(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    first = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return good.select("vec_id", F.expr("cast(array() as array<bigint>)").alias("y")), 0
    bound = float(1 << 62)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * STEP, F.lit(bound)), F.lit(-bound))).cast("long"))
    return good.where(F.size("v") == first["d"]).select("vec_id", whole.alias("y")), first["d"]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, weighted by powers of 2^20, is y; all but the last are not negative."""
    out = []
    while len(out) < 3 and (y.min(initial=0) < -(1 << LIMB) or y.max(initial=0) >= 1 << LIMB):
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*out, y.astype(np.float64)]


def products(d: int):
    """A function from batches of ``y`` to their sums of products: rows ``i, j, p0 …`` (i <= j; i = -1: plain sums)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = 2 * PARTS
        held = np.zeros((limbs + 1, d + 1, d), np.int64)
        some = False

        def settle() -> None:
            for p in range(limbs):
                held[p + 1] += held[p] >> LIMB
                held[p] &= (1 << LIMB) - 1

        for batch in batches:
            y = _matrix(batch.column("y"), d)
            for at in range(0, len(y), ROWS):
                parts = _limbs(y[at : at + ROWS])
                some = True
                for i, a in enumerate(parts):
                    held[i, 0] += a.sum(0).astype(np.int64)
                    for j, b in enumerate(parts):
                        held[i + j, 1:] += (a.T @ b).astype(np.int64)
                settle()
        if some:
            i, j = np.triu_indices(d)
            i, j = np.concatenate([np.full(d, -1), i]), np.concatenate([np.arange(d), j])
            pairs = [held[2 * p, i + 1, j] + (held[2 * p + 1, i + 1, j] << LIMB) for p in range(PARTS)]
            pairs[-1] += held[limbs, i + 1, j] << 2 * LIMB
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, pairs)],
                names=["i", "j", *[f"p{k}" for k in range(PARTS)]],
            )

    return add


def scatter(fit: DataFrame, d: int) -> tuple[list[int], np.ndarray]:
    """Exact column sums and sums of products of ``y``; only a row per pair of dimensions is collected."""
    columns = [f"p{k}" for k in range(PARTS)]
    schema = "i int, j int, " + ", ".join(f"{c} long" for c in columns)
    total = fit.mapInArrow(products(d), schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in columns])
    sums, gram = [0] * d, np.zeros((d, d), dtype=object)
    for i, j, *parts in total.collect():
        whole = sum(int(v) << 2 * LIMB * k for k, v in enumerate(parts))
        if i < 0:
            sums[j] = whole
        else:
            gram[i, j] = gram[j, i] = whole
    return sums, gram


def polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(xI - a), lowest first; a task takes a few primes."""
    trace = sum(int(a[i, i]) for i in range(len(a)))
    chosen = charpoly.primes(charpoly.coefficient_bits(len(a), trace))

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column("id").to_pylist():
                own = chosen[task * PRIMES_A_TASK : (task + 1) * PRIMES_A_TASK]
                found = [charpoly.modular((a % p).astype(np.int64), p) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))], names=["p", "f"])

    tasks = -(-len(chosen) // PRIMES_A_TASK)
    rows = spark.range(0, tasks, 1, tasks).mapInArrow(images, "p long, f array<long>").collect()
    return charpoly.remaindered({r["p"]: r["f"] for r in rows})


def components(spark: SparkSession, a: np.ndarray, most: int) -> list[tuple[int, int, np.ndarray]]:
    """(root, bits, vector) of the ``most`` largest positive eigenvalues root / 2^bits of ``a``, falling."""
    if not any(a[i, i] for i in range(len(a))):
        return []
    roots = charpoly.largest_roots(polynomial(spark, a), most, sum(int(a[i, i]) for i in range(len(a))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                root, bits, times = roots[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * times, pa.int64()), pa.array(range(times), pa.int32()), pa.array(charpoly.null_space(a, root, bits, times).tolist())],
                    names=["k", "nth", "v"],
                )

    found = spark.range(0, len(roots), 1, len(roots)).mapInArrow(vectors, "k long, nth int, v array<double>").collect()
    found.sort(key=lambda r: (r["k"], r["nth"]))
    return [(*roots[r["k"]][:2], np.array(r["v"])) for r in found[:most]]


class Projection:
    """Centring, deviation and whitened entries of integer vectors."""

    def __init__(self, n: int, sums: list[int], axes: np.ndarray, scale: np.ndarray):
        self.n, self.sums, self.axes, self.scale = n, sums, axes, scale
        self.top = max(map(abs, sums), default=0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exact; as Python integers where 64 bits can't hold it."""
        if self.n * int(max(-y.min(initial=0), y.max(initial=0))) + self.top < 1 << 62:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviation(self, t: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null beyond 64 bits."""
        if t.dtype != object and (float(np.abs(t).max(initial=0)) ** 2) * max(1, t.shape[1]) < 2.0**62:
            return (t * t).sum(1).tolist()
        whole = t.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (whole * whole).sum(1)]

    def whitened(self, t: np.ndarray) -> np.ndarray:
        return (t / self.n).astype(np.float64) @ self.axes / self.scale


def whiten(rows: DataFrame, most: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Entries become x = floor(64 c) + 1,000,000.  Every distinct x vector counts once in the fit
    (n vectors with sums S); components are unit eigenvectors of its covariance, numbered from 1
    by falling eigenvalue, at most ``most``, the largest entry positive.  ``deviation`` is the
    exact sum of (n x - S)^2, null where that passes 64 bits; ``whitened`` projects x - S / n and
    divides by the eigenvalue's root; ``explained`` is the eigenvalue over the trace;
    ``identity_error`` is the largest entry of the whitened covariance minus the identity.

    Rows are left out if the vector is null, empty, holds null or non-finite entries, or is not as
    long as most vectors.  Entries beyond 2^62 / 64 count as that.  Eigenvalues of zero have no
    component: a fit list of one vector, and an empty table, give no rows.  Null ids and repeated
    rows keep their rows; other columns are not read.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors, d = integers(rows)
    if not d:
        return spark.createDataFrame([], schema)
    fit = keep(vectors.select("y").distinct())
    n = fit.count()
    sums, gram = scatter(fit, d)
    centre = np.array(sums, dtype=object)
    a = gram * n - centre[:, None] * centre[None, :]
    found = components(spark, a, most)
    if not found:
        return spark.createDataFrame([], schema)
    trace = sum(int(a[i, i]) for i in range(d))
    explained = np.array([root / (trace << bits) for root, bits, _ in found])
    # The scatter matrix is n^2 times the covariance.
    scale = np.sqrt(np.array([root / (n * n << bits) for root, bits, _ in found]))
    project = Projection(n, sums, np.array([v for *_, v in found]).T, scale)
    k = len(found)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = project.whitened(project.centred(_matrix(batch.column("y"), d)))
            total += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    entries = fit.mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    error = entries.agg(F.max(F.abs(F.col("s") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                t = project.centred(_matrix(own.column("y"), d))
                again = np.repeat(np.arange(len(t)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("vec_id").take(pa.array(again)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(t))),
                        pa.array(np.full(len(again), n)),
                        pa.array(project.deviation(t), pa.int64()).take(pa.array(again)),
                        pa.array(project.whitened(t).ravel()),
                        pa.array(np.tile(explained, len(t))),
                        pa.array(np.full(len(again), error)),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return vectors.mapInArrow(scored, schema)
