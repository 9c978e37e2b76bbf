"""Trie of conversation prefixes by truncation peeling.

A prefix is known by an order-sensitive digest: the exclusive or of its turns' digests, each taken
together with its place, so stripping the last turn is one exclusive or.  Equal conversations are
one class.  A prefix that a single class has needs no peeling: its class says all about its tail.
The others are peeled from the greatest depth: the conversations that end there are merged with
the nodes that survive from below, the last turn is stripped, and the nodes are regrouped; what a
node returns is added up in the grouping that finds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions.ordered import numbered
from talkspark.llm.store import keep

BLOCK = 4096
NOBODY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, n, chars, print``: turns numbered from 1 by turn (null first), then role, then digest of the text.

    Texts are reduced to their length and digest before anything is shuffled.  A null role or text
    is empty; rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    short = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.char_length(text).cast("long").alias("chars"),
        F.md5(text).alias("text"),
    )
    bucket = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    placed = numbered(short, "conv_id", bucket, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], out="n", start=1)
    return placed.select("conv_id", F.col("n").cast("long").alias("n"), "chars", F.md5(F.concat_ws("|", "text", "role")).alias("print"))


def rebuilt(own: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, depth`` and their turns ``conv_id, depth, chars, print, last`` (depth from 1).

    Conversation c takes the first h turns of conversation c - c % ``group`` and goes on with its
    own turns after its first h; h is the CRC-32 of c in decimal, modulo ``heads``.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % heads
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("k"))
    # At most ``group`` conversations share a base.
    bases = sizes.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("k").alias("base_k"))
    convs = (
        sizes.withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % group})
        .join(bases, "base", "left")
        .withColumn("taken", F.least("h", F.coalesce("base_k", F.lit(0))))
        .withColumn("depth", F.col("taken") + F.greatest(F.col("k") - F.col("h"), F.lit(0)))
        .select("conv_id", "base", "k", "h", "taken", "depth")
    )
    convs = keep(convs)
    # A long conversation meets its row block by block.
    blocks = convs.withColumn("block", F.explode(F.expr(f"sequence(0L, k div {BLOCK})")))
    later = (
        own.withColumn("block", F.expr(f"n div {BLOCK}"))
        .join(blocks.select("conv_id", "block", "k", "h", "taken"), ["conv_id", "block"])
        .where("n > h")
        .select("conv_id", F.expr("taken + n - h").alias("depth"), "chars", "print", F.expr("n = k").alias("last"))
    )
    first = own.where((F.col("conv_id") % group == 0) & (F.col("n") < heads)).withColumnRenamed("conv_id", "base")
    earlier = (
        convs.where("taken > 0")
        .drop("depth")
        .join(first, "base")
        .where("n <= taken")
        .select("conv_id", F.col("n").alias("depth"), "chars", "print", F.expr("n = taken and k <= h").alias("last"))
    )
    return convs.select("conv_id", "depth"), later.unionByName(earlier)


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, chars, print, last) with ``a, b`` (the prefix), ``pa, pb`` (without the last turn), ``sum`` (chars so far)."""
    half = "conv(substring(md5(concat_ws('|', depth, print)), {at}, 15), 16, 10)"
    turn = rows.withColumns({"ta": F.expr(half.format(at=1)).cast("long"), "tb": F.expr(half.format(at=17)).cast("long")})
    turn = turn.withColumn("block", F.expr(f"depth div {BLOCK}"))
    inside = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = turn.groupBy("conv_id", "block").agg(F.bit_xor("ta").alias("a"), F.bit_xor("tb").alias("b"), F.sum("chars").alias("s"))
    carry = totals.select(
        "conv_id",
        "block",
        F.coalesce(F.bit_xor("a").over(across), F.lit(0)).alias("ca"),
        F.coalesce(F.bit_xor("b").over(across), F.lit(0)).alias("cb"),
        F.coalesce(F.sum("s").over(across), F.lit(0)).alias("cs"),
    )
    local = turn.withColumns({"a": F.bit_xor("ta").over(inside), "b": F.bit_xor("tb").over(inside), "sum": F.sum("chars").over(inside)})
    joined = local.join(carry, ["conv_id", "block"]).withColumns(
        {"a": F.col("a").bitwiseXOR(F.col("ca")), "b": F.col("b").bitwiseXOR(F.col("cb")), "sum": F.col("sum") + F.col("cs")}
    )
    return joined.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "chars",
        "last",
        "a",
        "b",
        F.col("a").bitwiseXOR(F.col("ta")).alias("pa"),
        F.col("b").bitwiseXOR(F.col("tb")).alias("pb"),
        "sum",
    )


def end_digests(members: DataFrame) -> DataFrame:
    """``a, b, depth, ends_sha256`` of the conversations (a, b, depth, conv_id) that end at a node.

    Ids are put together in ranges of 4,096, each a bounded group; one task then streams the
    ranges of a node, in order, through one digest.
    """
    pieces = (
        members.groupBy("a", "b", "depth", F.floor(F.col("conv_id") / BLOCK).alias("range"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
        .repartition("a", "b", "depth")
        .sortWithinPartitions("a", "b", "depth", "range")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "depth"]
        now, state, done = None, None, []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in (*names, "ids")])
            for a, b, depth, ids in rows:
                if now == (a, b, depth):
                    state.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*names, "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=[*names, "ends_sha256"])

    return pieces.mapInArrow(digest, "a long, b long, depth long, ends_sha256 string")


def peel(shared: DataFrame, ended: DataFrame, tops: DataFrame, deepest: int) -> DataFrame:
    """All shared nodes with their totals, one level after the other from the deepest.

    ``shared`` are the nodes without totals (depth, a, b, pa, pb, chars), ``ended`` the classes that
    end at one of them (depth, a, b, n, first), ``tops`` what hangs below them unshared (depth, pa,
    pb, n, first, saved).  A level is one grouping with a partial sum in each task, so that a node
    with any number of children is no hot key; it is written, and the next level reads it.
    """
    none = F.lit(None).cast("long")
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        here = shared.where(F.col("depth") == depth).select(
            "a", "b", "pa", "pb", "chars", none.alias("n"), none.alias("first"), F.lit(0).alias("children"), F.lit(0).alias("leaves"), F.lit(0).alias("saved")
        )
        endings = ended.where(F.col("depth") == depth).select(
            "a", "b", none.alias("pa"), none.alias("pb"), none.alias("chars"), "n", "first", F.lit(0).alias("children"), F.lit(0).alias("leaves"), F.lit(0).alias("saved")
        )
        stripped = [tops.where(F.col("depth") == depth + 1).withColumn("leaves", F.lit(1)), *levels[-1:]]
        below = [
            s.select(
                F.col("pa").alias("a"), F.col("pb").alias("b"), none.alias("pa"), none.alias("pb"), none.alias("chars"), "n", "first", F.lit(1).alias("children"), "leaves", "saved"
            )
            for s in stripped
        ]
        nodes = reduce(DataFrame.unionByName, [here, endings, *below]).groupBy("a", "b").agg(
            F.max("pa").alias("pa"),
            F.max("pb").alias("pb"),
            F.max("chars").alias("chars"),
            F.sum("n").alias("n"),
            F.min("first").alias("first"),
            F.sum("children").cast("long").alias("children"),
            F.sum("leaves").cast("long").alias("leaves"),
            F.sum("saved").cast("long").alias("saved"),
        )
        levels.append(
            keep(
                nodes.withColumn("leaves", F.greatest("leaves", F.lit(1)).cast("long"))
                .withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars"))
                .withColumn("depth", F.lit(depth).cast("long"))
            )
        )
    return reduce(DataFrame.unionByName, levels)


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, depth) with turns (conv_id, depth, chars, print, last); see ``prefix_trie``."""
    paths = keep(prefixes(rows))
    zero = F.lit(0).cast("long")
    endless = convs.where("depth = 0").select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("depth"), zero.alias("sum"))
    members = keep(paths.where("last").select("conv_id", "a", "b", "depth", "sum").unionByName(endless))
    classes = keep(members.groupBy("a", "b", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("sum").alias("total")))
    # Turns of the first conversation of each class, which meets its row block by block.
    blocks = classes.select("first", "n", "total", F.col("depth").alias("end"), F.explode(F.expr(f"sequence(0L, depth div {BLOCK})")).alias("block"))
    chosen = paths.withColumn("block", F.expr(f"depth div {BLOCK}")).withColumnRenamed("conv_id", "first").join(blocks, ["first", "block"])
    info = ["first", "n", "end", "total", "chars", "sum", "pa", "pb"]
    found = keep(chosen.groupBy("depth", "a", "b").agg(F.count("*").alias("classes"), F.min(F.struct(*info)).alias("one")))
    private = found.where("classes = 1").select("depth", "a", "b", "one.*").withColumn("saved", F.expr("(n - 1) * (total - sum + chars)"))
    root = convs.limit(1).select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), *[zero.alias(c) for c in ("pa", "pb", "chars")])
    shared = found.where("classes > 1").select("depth", "a", "b", "one.pa", "one.pb", "one.chars").unionByName(root)
    shared = keep(shared.repartitionByRange("depth", "a").sortWithinPartitions("depth"))
    tops = keep(
        private.groupBy("first")
        .agg(F.min(F.struct("depth", "a", "b", "pa", "pb", "n", "saved")).alias("top"))
        .select("first", "top.*")
        .repartitionByRange("depth", "first")
        .sortWithinPartitions("depth")
    )
    ended = keep(classes.join(tops.select("first"), "first", "left_anti").select("depth", "a", "b", "n", "first"))
    deepest = shared.agg(F.max("depth")).first()[0]
    if deepest is None:
        return convs.sparkSession.createDataFrame([], SCHEMA)
    peeled = peel(shared, ended, tops, deepest).select("depth", "a", "b", "pa", "pb", "n", "first", "children", "leaves", "saved")
    parents = peeled.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("first").alias("parent"))
    key = ["depth", "pa", "pb"]
    of_shared = peeled.join(parents, key, "left")
    # The class's own first conversation stands above an unshared node, but for the topmost ones.
    above = tops.select("depth", "first", "pa", "pb").join(parents, key).select("depth", "first", "parent")
    of_private = (
        private.withColumns({"children": F.expr("cast(depth < end as long)"), "leaves": F.lit(1).cast("long")})
        .join(above, ["depth", "first"], "left")
        .withColumn("parent", F.coalesce("parent", "first"))
    )
    columns = ["depth", "a", "b", "n", "first", "children", "leaves", "saved", "parent"]
    every = of_shared.select(*columns).unionByName(of_private.select(*columns))
    return every.join(end_digests(members), ["a", "b", "depth"], "left").select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
    )


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """A row per node of the trie over the rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256`` (ids of the conversations that
    end here).  Turns with equal number, role and text are turns each.  Null roles and texts are
    empty, a null turn comes first, rows without conv_id are left out, other columns are not read;
    an empty table has no node.

    Jobs go with the greatest depth that two different conversations share, not with their length.
    """
    return nodes(*rebuilt(keep(turns(rows)), group, heads))
