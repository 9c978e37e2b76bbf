"""Exact hypergeometric draws as SQL expressions: counts dealt from a total, without replacement.

``deal`` fills a communication matrix: every leaf (a partition, a shard) gets so many of each
category as a uniform draw without replacement would give it.  Leaves are dealt in a tree of
``FAN`` children a node, so that a task holds one node's counts, however many leaves there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16

#: A draw by inversion: ``s`` has n (all), k (marked), d (drawn) and u in [0, 1).  Outcomes are
#: visited from the mode upwards, then downwards, within 12 standard deviations.
_UP = "a.w * ((s.k - x + 1D) * (s.d - x + 1D)) / (x * (s.n - s.k - s.d + cast(x as double)))"
_DOWN = "a.w * ((x + 1D) * (s.n - s.k - s.d + x + 1D)) / ((s.k - cast(x as double)) * (s.d - cast(x as double)))"
_SUM = "aggregate({list}, named_struct('w', 1D, 'c', 0D), (a, x) -> element_at(transform(array({step}), w -> named_struct('w', w, 'c', a.c + w)), 1), a -> a.c)"
_FIND = """aggregate({list}, named_struct('w', 1D, 'c', {begin}, 'x', {found}),
        (a, x) -> element_at(transform(array({step}), w -> named_struct('w', w, 'c', a.c + w, 'x', coalesce(a.x, if(a.c + w >= aim, x, null)))), 1),
        a -> {end})"""
_DRAW = f"""
element_at(transform(array(named_struct(
    'm', least(greatest(cast(floor((s.d + 1D) * (s.k + 1D) / (s.n + 2D)) as bigint), s.d + s.k - s.n, 0L), s.d, s.k),
    'w', cast(ceil(12 * sqrt(s.d * (s.k / greatest(s.n, 1D)) * (1 - s.k / greatest(s.n, 1D)))) + 12 as bigint))), p ->
  element_at(transform(array(named_struct(
      'm', p.m,
      'up', if(least(s.d, s.k, p.m + p.w) > p.m, sequence(p.m + 1, least(s.d, s.k, p.m + p.w)), cast(array() as array<bigint>)),
      'down', if(greatest(0L, s.d + s.k - s.n, p.m - p.w) < p.m, sequence(p.m - 1, greatest(0L, s.d + s.k - s.n, p.m - p.w)), cast(array() as array<bigint>)))), q ->
    element_at(transform(array(s.u * (1D + {_SUM.format(list="q.up", step=_UP)} + {_SUM.format(list="q.down", step=_DOWN)})), aim ->
      element_at(transform(array({_FIND.format(list="q.up", begin="1D", found="if(aim <= 1D, q.m, cast(null as bigint))", step=_UP, end="struct(a.c AS c, a.x AS x)")}), f ->
        {_FIND.format(list="q.down", begin="f.c", found="f.x", step=_DOWN, end="coalesce(a.x, q.m)")}), 1)), 1)), 1)), 1)
"""

#: Rows of the matrix, one child after the other; within a child one category after the other.
_DEAL = f"""
aggregate(sequence(0, size(sizes) - 1), named_struct('left', counts, 'out', cast(array() as array<array<bigint>>)), (t, c) ->
  element_at(transform(array(
    aggregate(sequence(0, size(counts) - 1),
      named_struct('n', aggregate(t.left, 0L, (z, y) -> z + y), 'd', sizes[c], 'x', cast(array() as array<bigint>)),
      (r, i) -> element_at(transform(array(named_struct('n', r.n, 'k', t.left[i], 'd', r.d, 'u', {{uniform}})), s ->
        element_at(transform(array({_DRAW}), v -> named_struct('n', r.n - t.left[i], 'd', r.d - v, 'x', concat(r.x, array(v)))), 1)), 1),
      r -> r.x)), got -> named_struct('left', zip_with(t.left, got, (y, z) -> y - z), 'out', concat(t.out, array(got)))), 1),
  t -> t.out)
"""


def fraction(text: str) -> str:
    """SQL for a number in [0, 1) that only depends on the string ``text`` (52 bits of its MD5)."""
    return f"cast(conv(substring(md5({text}), 1, 13), 16, 10) as bigint) / 4503599627370496D"


def draw(n: str, k: str, d: str, u: str) -> str:
    """SQL for a draw: how many of ``d`` items drawn from ``n`` are among the ``k`` marked ones."""
    return f"element_at(transform(array(named_struct('n', {n}, 'k', {k}, 'd', {d}, 'u', {u})), s -> {_DRAW}), 1)"


def split(nodes: DataFrame, seed: str, level: int) -> DataFrame:
    """``node, counts`` of all children of ``nodes`` (node, counts, sizes): child c of node k is k * FAN + c."""
    uniform = fraction(f"concat_ws('|', '{seed}', '{level}', node, c, i)")
    dealt = nodes.withColumn("dealt", F.expr(_DEAL.format(uniform=uniform)))
    return dealt.select("node", F.posexplode("dealt").alias("child", "counts")).select(
        (F.col("node") * FAN + F.col("child")).alias("node"), "counts"
    )


def deal(leaves: DataFrame, n_leaves: int, totals: DataFrame, seed: str) -> DataFrame:
    """``leaf, counts``: how many of each category every leaf takes.

    ``leaves`` has ``leaf`` (0 to ``n_leaves`` - 1, a row each) and ``size``; ``totals`` is one row
    with ``counts``, an array of category counts with the same sum.  Counts of a leaf add up to
    its size and counts of a category to its total, exactly.  A level of the tree is one join of
    its nodes with their children's sizes, at most ``FAN`` a node; its expression stands in the
    plan once a level.  A draw takes as many steps as 24 standard deviations of its outcome.
    """
    sizes = [leaves.select(F.col("leaf").alias("node"), "size")]
    while FAN ** len(sizes) < n_leaves:
        sizes.append(sizes[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.sum("size").alias("size")))
    nodes = totals.select(F.lit(0).cast("long").alias("node"), F.col("counts").cast("array<bigint>").alias("counts"))
    for level in reversed(range(len(sizes))):
        children = (
            sizes[level]
            .groupBy(F.expr(f"node div {FAN}").alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("node", "size")))["size"].alias("sizes"))
        )
        nodes = split(nodes.join(children, "node"), seed, level)
    return nodes.withColumnRenamed("node", "leaf")
