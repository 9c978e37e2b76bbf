"""Order-dependent work that never gathers one key into one task.

A plain ``Window.partitionBy(video)`` sends a whole video to one task.  Everything here cuts a
key's rows into blocks of consecutive order values instead, works inside the blocks, and passes
only one summary row per block across them.  A key that holds a third of the corpus is therefore
spread over as many tasks as it has blocks.

* ``windowed``  row frames of bounded reach (lag, lead, k rows around): block plus copied edges.
* ``running``   unbounded prefixes (sum, max, min, last value): block result plus block carry.
* ``numbered``  row numbers over any order that has a monotone integer bucket.
* ``orbit``     greedy segmentation given "where does the next group start if one starts here".
* ``group_starts`` labels every row with the start of its greedy group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions.lineage import cut

BLOCK = 8192
UPPER_WIDTHS = (BLOCK, BLOCK * 256)


def as_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def windowed(
    df: DataFrame,
    keys: str | Sequence[str],
    idx: str,
    outs: dict[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    block: int = BLOCK,
    keep: bool = False,
) -> DataFrame:
    """Window columns whose frames reach at most ``before``/``after`` rows of a dense ``idx``.

    ``idx`` must count 0, 1, 2, … within ``keys``.  Rows near a block edge are copied to the
    neighbouring block and dropped again afterwards, so frames see what they need.  An entry of
    ``outs`` may use the columns of those before it.  ``keep`` leaves the block as ``_blk``, by
    which the rows lie dealt, for ``running``.
    """
    if max(before, after) > block:
        raise ValueError("frame reaches past a neighbouring block")
    keys = as_list(keys)
    home = F.expr(f"`{idx}` div {block}")
    offset = F.expr(f"`{idx}` % {block}")
    copies = [home]
    if after:
        copies.append(F.when((offset < after) & (home > 0), home - 1))
    if before:
        copies.append(F.when(offset >= block - before, home + 1))
    copied = df.withColumn("_blk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    for name, make in outs.items():
        copied = copied.withColumn(name, make(w))
    own = copied.filter(F.col("_blk") == home)
    return own if keep else own.drop("_blk")


def neighbours(
    df: DataFrame,
    keys: str | Sequence[str],
    idx: str,
    prev: dict[str, str] | None = None,
    nxt: dict[str, str] | None = None,
    block: int = BLOCK,
    keep: bool = False,
) -> DataFrame:
    """``lag``/``lead`` by one row: ``{new column: source column}`` for each direction."""
    outs: dict[str, Callable[[WindowSpec], Column]] = {}
    for name, source in (prev or {}).items():
        outs[name] = lambda w, s=source: F.lag(s).over(w)
    for name, source in (nxt or {}).items():
        outs[name] = lambda w, s=source: F.lead(s).over(w)
    return windowed(df, keys, idx, outs, before=1 if prev else 0, after=1 if nxt else 0, block=block, keep=keep)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: str | Sequence[str],
    idx: str,
    outs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    reverse: bool = False,
    block: int = BLOCK,
    bucket: Column | None = None,
    order: Sequence[Column] | None = None,
    keep: bool = False,
) -> DataFrame:
    """Prefix ``sum``/``max``/``min`` along ``idx`` (which may have holes).

    ``max`` over a struct that starts with the order column gives "the latest earlier row that
    …", which is how carry-forward and as-of lookups are written.  ``bucket``/``order`` replace
    the integer ``idx`` when the order is a time: ``bucket`` must grow with it.  Rows that
    ``windowed`` left with their ``_blk`` stay where they are; ``keep`` leaves it.
    """
    keys = as_list(keys)
    blk = bucket if bucket is not None else F.expr(f"`{idx}` div {block}")
    base = df if "_blk" in df.columns else df.withColumn("_blk", blk)
    for name, (_, expr) in outs.items():
        base = base.withColumn(f"_in_{name}", expr)
    ordering = list(order) if order is not None else [F.col(idx)]
    if reverse:
        ordering = [c.desc() for c in ordering]
    low, high = Window.unboundedPreceding, 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_blk").orderBy(*ordering).rowsBetween(low, high)
    across = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_blk").desc() if reverse else F.col("_blk"))
        .rowsBetween(low, -1)
    )
    totals = base.groupBy(*keys, "_blk").agg(
        *[_COMBINE[kind][0](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in outs.items()]
    )
    carry = totals.select(
        *keys,
        "_blk",
        *[
            _COMBINE[kind][0](f"_tot_{name}").over(across).alias(f"_carry_{name}")
            for name, (kind, _) in outs.items()
        ],
    )
    local = base
    for name, (kind, _) in outs.items():
        local = local.withColumn(f"_loc_{name}", _COMBINE[kind][0](f"_in_{name}").over(inside))
    joined = local.join(carry, [*keys, "_blk"], "left")
    for name, (kind, _) in outs.items():
        joined = joined.withColumn(
            name, _COMBINE[kind][1](F.col(f"_loc_{name}"), F.col(f"_carry_{name}"))
        )
    scratch = [f"_{p}_{name}" for name in outs for p in ("in", "loc", "carry")]
    return joined.drop(*scratch, *([] if keep else ["_blk"]))


def numbered(
    df: DataFrame,
    keys: str | Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "idx",
    start: int = 0,
) -> DataFrame:
    """Row numbers per key; ``bucket`` is an integer that never decreases along ``order``."""
    keys = as_list(keys)
    base = df.withColumn("_bkt", bucket)
    local = base.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_bkt").orderBy(*order))
    )
    before = (
        base.groupBy(*keys, "_bkt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_off",
            F.sum("_n").over(
                Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_n")
    )
    return (
        local.join(before, [*keys, "_bkt"])
        .withColumn(out, F.col("_rn") + F.coalesce("_off", F.lit(0)) - 1 + start)
        .drop("_rn", "_off", "_bkt")
    )


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def map_groups(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: T.StructType,
) -> DataFrame:
    """Apply ``fn(rows, group_offsets)`` to runs of whole groups, many groups per call.

    Spark shuffles by ``group`` and sorts; groups are bounded blocks, so a call handles a few
    Arrow batches.
    """
    group = list(group)
    ready = df.repartition(*group).sortWithinPartitions(*group, order)

    def offsets(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for c in group:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            at = offsets(pdf)
            same = bool(held) and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in group)
            if same and len(at) == 1:
                held.append(pdf)
                continue
            cut_at = at[-1]
            ready_rows = held + ([pdf.iloc[:cut_at]] if cut_at else [])
            held = [pdf.iloc[cut_at:]]
            if ready_rows:
                rows = pd.concat(ready_rows, ignore_index=True)
                yield fn(rows, offsets(rows))
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield fn(rows, offsets(rows))

    return ready.mapInPandas(run, schema)


def _next_rows(idx: np.ndarray, nxt: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row position of each ``nxt`` inside its own group, −1 when it lies outside."""
    n = len(idx)
    out = np.full(n, -1, dtype=np.int64)
    for lo, hi in zip(starts, np.append(starts[1:], n)):
        p = lo + np.searchsorted(idx[lo:hi], nxt[lo:hi])
        ok = p < hi
        ok[ok] = idx[p[ok]] == nxt[lo:hi][ok]
        out[lo:hi][ok] = p[ok]
    return out


def _exits(keys: list[str]):
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Where does a walk that enters each block leave it?"""
        idx = pdf["idx"].to_numpy(np.int64)
        nxt = pdf["nxt"].to_numpy(np.int64)
        inner = _next_rows(idx, nxt, starts).tolist()
        leave = nxt.tolist()
        for i in range(len(leave) - 1, -1, -1):
            if inner[i] >= 0:
                leave[i] = leave[inner[i]]
        root = pdf["root"].to_numpy(bool)
        size = np.diff(np.append(starts, len(pdf)))
        block = np.repeat(np.arange(len(starts)), size)
        rooted = np.zeros(len(starts), dtype=bool)
        np.logical_or.at(rooted, block, root)
        # every real walk passes through the roots, so a rooted block needs one exit only
        last = np.full(len(starts), -1)
        hits = np.flatnonzero(root)
        last[block[hits]] = hits
        keep = np.flatnonzero(~rooted[block])
        pick = np.concatenate([last[rooted], keep])
        out = pdf.iloc[pick][keys].copy()
        out["idx"] = np.where(np.arange(len(pick)) < rooted.sum(), -1, idx[pick])
        out["nxt"] = np.asarray(leave, dtype=np.int64)[pick]
        out["rooted"] = np.arange(len(pick)) < rooted.sum()
        return out

    return run


def _mark(keys: list[str]):
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Rows on the walk, given each block's roots and entry points.

        An entry shares its ``idx`` with the row it points at; both sort next to each other.
        """
        entry = pdf["nxt"].isna().to_numpy()
        idx = pdf["idx"].to_numpy(np.int64)
        on = pdf["root"].to_numpy(bool) & ~entry
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
        hit = pd.MultiIndex.from_arrays([block, idx])
        on |= hit.isin(hit[entry]) & ~entry
        rows = np.flatnonzero(~entry)
        sub_starts = np.flatnonzero(np.diff(block[rows], prepend=-1))
        nxt = pdf["nxt"].to_numpy(float)[rows].astype(np.int64)
        inner = _next_rows(idx[rows], nxt, sub_starts).tolist() if len(rows) else []
        flag = on[rows].tolist()
        for i, to in enumerate(inner):
            if flag[i] and to >= 0:
                flag[to] = True
        return pdf.iloc[rows[np.asarray(flag, dtype=bool)]][[*keys, "idx"]]

    return run


def orbit(
    nodes: DataFrame, keys: str | Sequence[str], widths: Sequence[int] = UPPER_WIDTHS
) -> DataFrame:
    """Members of the walk ``idx → nxt → nxt(nxt) …`` from the root rows.

    ``nodes`` has ``keys``, ``idx`` (long), ``nxt`` (long, > idx) and ``root`` (rows known to be
    on the walk: the first row of a key and every break that no walk can skip).  Each level maps
    block entries to block exits, so the level above only sees entries of blocks without a root,
    which are few; the last level walks what remains.
    """
    keys = as_list(keys)
    nodes = cut(
        nodes.select(
            *keys,
            F.col("idx").cast("long").alias("idx"),
            F.col("nxt").cast("long").alias("nxt"),
            F.col("root").alias("root"),
        )
    )
    member = T.StructType([*_key_fields(nodes, keys), T.StructField("idx", T.LongType())])
    if not widths:
        return map_groups(nodes, keys, "idx", _mark(keys), member)
    width = widths[0]
    block = F.expr(f"idx div {width}")
    shape = T.StructType(
        [
            *_key_fields(nodes, keys),
            T.StructField("idx", T.LongType()),
            T.StructField("nxt", T.LongType()),
            T.StructField("rooted", T.BooleanType()),
        ]
    )
    blocks = [*keys, "_b"]
    exits = cut(map_groups(nodes.withColumn("_b", block), blocks, "idx", _exits(keys), shape))
    entries = seeds = exits.filter("rooted").select(*keys, F.col("nxt").alias("idx"))
    if not exits.filter("not rooted").isEmpty():
        crossing = nodes.filter(F.expr(f"nxt div {width} > idx div {width}")).select(
            *keys, F.col("nxt").alias("idx")
        )
        open_nodes = cut(
            exits.filter("not rooted")
            .join(crossing.distinct(), [*keys, "idx"], "left_semi")
            .join(seeds.distinct().withColumn("seed", F.lit(True)), [*keys, "idx"], "left")
            .select(*keys, "idx", "nxt", F.coalesce("seed", F.lit(False)).alias("root"))
        )
        entered = cut(orbit(open_nodes, keys, widths[1:]))
        # a walk that leaves an open block may enter a block that has a root
        left = open_nodes.join(entered, [*keys, "idx"], "left_semi").select(
            *keys, F.col("nxt").alias("idx")
        )
        entries = seeds.unionByName(entered).unionByName(left)
    entries = entries.select(
        *keys, "idx", F.lit(None).cast("long").alias("nxt"), F.lit(False).alias("root")
    )
    return map_groups(
        nodes.unionByName(entries).withColumn("_b", block), blocks, "idx", _mark(keys), member
    )


def group_starts(
    df: DataFrame, keys: str | Sequence[str], idx: str, nodes: DataFrame, out: str = "grp", keep: bool = False
) -> DataFrame:
    """``df`` plus ``out`` = the ``idx`` at which the row's greedy group starts.

    The starts are sorted among the rows of their block, so rows are dealt once and joined only
    with one carried start a block.  ``keep`` leaves the block as ``_blk``, by which the rows lie dealt.
    """
    keys = as_list(keys)
    block = F.expr(f"`{idx}` div {BLOCK}")
    marks = cut(orbit(nodes, keys).select(*keys, F.col("idx").alias(idx))).withColumns({"_blk": block, "_on": F.lit(True)})
    rows = df.withColumns({"_blk": block, "_on": F.lit(False)})
    both = rows.unionByName(marks, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.col(idx), F.col("_on").desc()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    latest = both.groupBy(*keys, "_blk").agg(F.max(F.when(F.col("_on"), F.col(idx))).alias("_top"))
    carry = latest.select(*keys, "_blk", F.max("_top").over(earlier).alias("_carry"))
    local = both.withColumn("_loc", F.max(F.when(F.col("_on"), F.col(idx))).over(inside)).filter(~F.col("_on")).drop("_on")
    labelled = local.join(carry, [*keys, "_blk"], "left").withColumn(out, F.coalesce("_loc", "_carry")).drop("_loc", "_carry")
    return labelled if keep else labelled.drop("_blk")


def time_nodes(
    df: DataFrame,
    keys: str | Sequence[str],
    idx: str,
    at: str,
    root: str,
    cols: Sequence[str],
    horizon: float,
    limit: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray],
    bucket: float = 900.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Orbit nodes for a fold whose groups end within ``horizon`` seconds of their first row.

    Rows are cut into time buckets and the first ``horizon`` seconds of a bucket are copied to
    the one before.  ``limit(rows, next_root, group_offsets)`` gives, per row, the position of the first row a
    group starting there cannot hold.  ``idx`` is dense, so when the copied rows end first the
    next start is the row after them.  ``limit`` may return a second array, kept as ``flag``.
    Nodes keep those of ``cols`` that are named in ``carry``.
    """
    keys = as_list(keys)
    home = F.floor(F.col(at) / F.lit(bucket)).cast("long")
    copied = df.select(
        *keys, F.col(idx).alias("idx"), F.col(root).alias("root"), *[F.col(c) for c in cols], home.alias("_home"),
        F.explode(
            F.when(F.col(at) - home * bucket <= horizon, F.array(home, home - 1)).otherwise(F.array(home))
        ).alias("_b"),
    )
    shape = T.StructType(
        [
            *_key_fields(df, keys),
            T.StructField("idx", T.LongType()),
            T.StructField("nxt", T.LongType()),
            T.StructField("root", T.BooleanType()),
            T.StructField("flag", T.BooleanType()),
            *[df.schema[c] for c in carry],
        ]
    )

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(pdf)
        root = pdf["root"].to_numpy(bool)
        ends = np.append(starts[1:], n)
        marks = np.where(root, np.arange(n), n)
        after = np.full(n, n)
        after[:-1] = np.minimum.accumulate(marks[::-1])[::-1][1:]
        after = np.minimum(after, np.repeat(ends, ends - starts))
        stop = limit(pdf, after, starts)
        flag = np.zeros(n, dtype=bool)
        if isinstance(stop, tuple):
            stop, flag = stop
        stop = np.minimum(stop, after)
        idx = pdf["idx"].to_numpy(np.int64)
        inside = stop < np.repeat(ends, ends - starts)
        out = pdf[[*keys, "idx"]].copy()
        out["nxt"] = np.where(inside, idx[np.minimum(stop, n - 1)], idx[stop - 1] + 1)
        out["root"] = root
        out["flag"] = flag
        out[list(carry)] = pdf[list(carry)]
        return out[(pdf["_home"] == pdf["_b"]).to_numpy()]

    return map_groups(copied, [*keys, "_b"], "idx", run, shape)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
