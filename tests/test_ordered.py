"""Block-wise windows and greedy walks against plain loops, with blocks small enough to cross."""

import random

import pytest
from pyspark.sql import functions as F

from talkspark.functions import ordered as O


def rows_of(spark, n_keys=3, n=57, seed=1):
    rng = random.Random(seed)
    data = [(k, i, rng.randint(0, 9)) for k in range(n_keys) for i in range(n + k)]
    return data, spark.createDataFrame(data, "k int, idx long, v long")


def by_key(data):
    out = {}
    for k, i, v in sorted(data):
        out.setdefault(k, []).append(v)
    return out


def test_windowed_reaches_over_block_edges(spark):
    data, df = rows_of(spark)
    got = O.windowed(
        df, "k", "idx", {"s": lambda w: F.sum("v").over(w.rowsBetween(-2, 3))}, before=2, after=3, block=5
    ).collect()
    vals = by_key(data)
    assert len(got) == len(data)
    for r in got:
        assert r.s == sum(vals[r.k][max(0, r.idx - 2) : r.idx + 4])


def test_windowed_refuses_frames_wider_than_a_block(spark):
    _, df = rows_of(spark)
    with pytest.raises(ValueError):
        O.windowed(df, "k", "idx", {}, before=9, block=5)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_running_totals(spark, inclusive, reverse):
    data, df = rows_of(spark)
    got = O.running(
        df, "k", "idx", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=inclusive, reverse=reverse, block=7
    ).collect()
    vals = by_key(data)
    for r in got:
        own = vals[r.k]
        part = own[r.idx + (0 if inclusive else 1) :] if reverse else own[: r.idx + (1 if inclusive else 0)]
        assert r.s == sum(part)
        assert r.m == (max(part) if part else None)


def test_running_max_of_struct_gives_latest_marked_row(spark):
    df = spark.createDataFrame([(1, i * 3, i % 5 == 2) for i in range(40)], "k int, idx long, on boolean")
    got = O.running(
        df, "k", "idx", {"last": ("max", F.when(F.col("on"), F.struct("idx")))}, inclusive=False, block=10
    ).collect()
    for r in got:
        marked = [i * 3 for i in range(40) if i % 5 == 2 and i * 3 < r.idx]
        assert (r["last"].idx if r["last"] else None) == (marked[-1] if marked else None)


def test_numbered_over_buckets(spark):
    rng = random.Random(4)
    data = [(k, rng.random() * 100) for k in range(2) for _ in range(50)]
    df = spark.createDataFrame(data, "k int, t double")
    got = O.numbered(df, "k", F.floor(F.col("t") / 10).cast("long"), [F.col("t")]).collect()
    for k in range(2):
        want = sorted(t for kk, t in data if kk == k)
        assert [r.t for r in sorted((r for r in got if r.k == k), key=lambda r: r.idx)] == want


@pytest.mark.parametrize("widths", [(6,), (6, 18), (4, 12, 36)])
@pytest.mark.parametrize("root_share", [0.0, 0.05, 0.3])
def test_orbit_equals_plain_walk(spark, widths, root_share):
    """Also without any root but the first row, where levels above the blocks must resolve."""
    rng = random.Random(int(root_share * 100) + len(widths))
    data, want = [], set()
    for k in range(4):
        n = 90 + k
        roots = {0} | {i for i in range(n) if rng.random() < root_share}
        nxt = {}
        for i in range(n):
            ahead = [r for r in roots if r > i]
            nxt[i] = min([i + rng.randint(1, 9), *ahead])
        data += [(k, i, nxt[i], i in roots) for i in range(n)]
        at = 0
        while at < n:
            want.add((k, at))
            at = nxt[at]
    df = spark.createDataFrame(data, "k int, idx long, nxt long, root boolean")
    got = O.orbit(df, "k", widths).collect()
    assert {(r.k, r.idx) for r in got} == want
    assert len(got) == len(want)
