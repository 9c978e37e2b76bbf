"""Interval, band, point and as-of joins as equi joins on time buckets.

Each side is put into the buckets it touches, so the join key is (video, bucket): a long video
is spread over many tasks and no side has to be broadcast.  A pair that meets in several buckets
is kept only in the later of the two first buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions.ordered import as_list, running


def _first(col: Column, bucket: float) -> Column:
    return F.floor(col / F.lit(float(bucket)))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_range: tuple[Column, Column],
    right_range: tuple[Column, Column],
    bucket: float,
) -> DataFrame:
    """Pairs whose closed ranges meet.  Apart from ``keys`` the sides share no column names."""
    keys = as_list(keys)
    lt = left.withColumn("_llo", left_range[0]).withColumn("_lhi", left_range[1])
    rt = right.withColumn("_rlo", right_range[0]).withColumn("_rhi", right_range[1])
    lt = lt.withColumn("_lb", _first(F.col("_llo"), bucket)).withColumn(
        "_b",
        F.explode(F.sequence("_lb", F.greatest("_lb", _first(F.col("_lhi"), bucket)))),
    )
    rt = rt.withColumn("_rb", _first(F.col("_rlo"), bucket)).withColumn(
        "_b",
        F.explode(F.sequence("_rb", F.greatest("_rb", _first(F.col("_rhi"), bucket)))),
    )
    return (
        lt.join(rt, [*keys, "_b"])
        .filter(
            (F.col("_llo") <= F.col("_rhi"))
            & (F.col("_rlo") <= F.col("_lhi"))
            & (F.col("_b") == F.greatest("_lb", "_rb"))
        )
        .drop("_b", "_lb", "_rb", "_llo", "_lhi", "_rlo", "_rhi")
    )


def point_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: str | Sequence[str],
    at: Column,
    bounds: tuple[Column, Column],
    bucket: float,
) -> DataFrame:
    """Points in half-open ranges ``[low, high)``; points are not copied."""
    keys = as_list(keys)
    pt = points.withColumn("_at", at).withColumn("_b", _first(F.col("_at"), bucket))
    rt = (
        ranges.withColumn("_lo", bounds[0])
        .withColumn("_hi", bounds[1])
        .withColumn(
            "_b",
            F.explode(
                F.sequence(
                    _first(F.col("_lo"), bucket),
                    F.greatest(_first(F.col("_lo"), bucket), _first(F.col("_hi"), bucket)),
                )
            ),
        )
    )
    return (
        pt.join(rt, [*keys, "_b"])
        .filter((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
        .drop("_b", "_at", "_lo", "_hi")
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    left_at: Column,
    right_at: Column,
    delta: float,
    residual: Column,
) -> DataFrame:
    """Equal ``keys`` and ``|left_at − right_at| ≤ delta`` plus ``residual``."""
    keys = as_list(keys)
    lt = left.withColumn("_lat", left_at).withColumn("_slot", _first(F.col("_lat"), delta))
    rt = (
        right.withColumn("_rat", right_at)
        .withColumn("_rs", _first(F.col("_rat"), delta))
        .withColumn("_slot", F.explode(F.expr("array(_rs - 1, _rs, _rs + 1)")))
    )
    return (
        lt.join(rt, [*keys, "_slot"])
        .filter((F.abs(F.col("_lat") - F.col("_rat")) <= F.lit(float(delta))) & residual)
        .drop("_slot", "_rs", "_lat", "_rat")
    )


def asof_last(
    points: DataFrame,
    table: DataFrame,
    keys: str | Sequence[str],
    at: str,
    start: str,
    payload: Sequence[str],
    out: str,
    bucket: float = 60.0,
) -> DataFrame:
    """For every point the latest ``table`` row with ``start ≤ at`` as struct ``out``.

    Union, then a carried maximum over (time, payload); blocks are time buckets.
    """
    keys = as_list(keys)
    shape = F.struct(F.col(start).alias("_t"), *[F.col(p) for p in payload])
    left = table.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_side"), shape.alias("_row"))
    right = points.withColumn("_point", F.struct(*[F.col(c) for c in points.columns])).select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), "_point"
    )
    both = left.unionByName(right, allowMissingColumns=True)
    carried = running(
        both,
        keys,
        "_t",
        {out: ("max", F.col("_row"))},
        bucket=_first(F.col("_t"), bucket),
        order=[F.col("_t"), F.col("_side")],
    )
    return carried.filter("_side = 1").select("_point.*", out)
