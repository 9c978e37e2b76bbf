"""Mixing sources to target weights with DataFrame and SQL functions only.

Documents are cut into blocks of consecutive words.  A source's blocks stand in a fixed random
order; its quota is the prefix of that order (after whole passes) whose words come nearest to the
target.  A multivariate-hypergeometric splitting tree deals the exact block quotas of all sources
to the output shards: a node with t blocks gives its left half so many of each source as a draw
without replacement would.  Each shard then takes its own disjoint range of every source's order
and is shuffled locally.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions.lineage import checkpointed as cut
from talkspark.functions.ordered import running
from talkspark.llm.hypergeometric import deal
from talkspark.llm.hypergeometric import draw as hypergeometric  # noqa: F401
from talkspark.llm.names import fresh
from talkspark.llm.store import keep

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
#: Parts that the rows of one source are dealt to when they meet the row of the source.
SALTS = 64


def by_source(rows: DataFrame, sources: DataFrame, on: str, spread: tuple[str, ...]) -> DataFrame:
    """``rows`` joined with a row per source on ``on`` (null equals null); a large source is many keys.

    ``sources`` is a catalogue; it is copied once for each of ``SALTS`` parts.
    """
    salted = rows.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = sources.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed(on, "joined")
    joined = salted.join(copies, (salted["part"] == copies["part"]) & salted[on].eqNullSafe(copies["joined"]))
    return joined.drop("part", "joined")


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, source, print, nth, size``, ``carry``: ``nth`` tells repeated rows apart, ``print`` hashes the text."""
    rows = docs.select(
        *carry,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("print"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    return rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "source", "print", "size").orderBy("size", *carry)))


def targets(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sid, source, source_size, target``: a row per source, numbered by code point, null last.

    Together the targets are ``share`` times all sizes.  A source's target is its weight times a
    common level, but at most ``most`` times its size.  Sorted by (cap / weight), the capped
    sources are a prefix; the level is what is left over divided by the weights that are left.
    """
    totals = documents.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = totals.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = (
        rows.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))
    )
    uncapped = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))
    level = F.min(uncapped).over(everything)["level"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level))
    return rows.select("sid", "source", "source_size", target.alias("target"))


def blocks(documents: DataFrame, sources: DataFrame, block_words: int | None, seed: str) -> DataFrame:
    """A row per block with its random sort key; with ``block_words`` None a document is one block."""
    size = F.col("size")
    count = F.lit(1) if block_words is None else F.ceil(size / block_words).cast("int")
    first = F.lit(0) if block_words is None else F.col("block") * block_words
    words = size if block_words is None else F.least(F.lit(block_words), size - first)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("nth"), F.col("block")))
    return (
        by_source(documents, sources.select("sid", "source", "source_size", "target"), "source", ("doc_id", "print", "nth"))
        .drop("source")
        .where(size > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("first_word", first.cast("long"))
        .withColumn("n_words", words.cast("long"))
        .withColumn("key", key)
    )


def ranked(cut_blocks: DataFrame, bucket_rows: int = 50_000) -> DataFrame:
    """Adds ``rank`` (from 0), ``before`` (words ahead) and ``n_blocks`` in the source's random order.

    The order is that of the key.  It is cut into buckets by the key's leading digits, so that no
    task sorts a whole source; a bucket's offset is a running sum over the bucket totals.
    """
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    counts = cut_blocks.groupBy("sid").agg(F.count("*").alias("n_blocks"))
    buckets = F.ceil(F.col("n_blocks") / bucket_rows)
    keyed = by_source(cut_blocks, counts, "sid", ("key",)).withColumn("bucket", F.shiftright(lead * buckets, 32))
    running = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        keyed.groupBy("sid", "bucket")
        .agg(F.count("*").alias("own"), F.sum("n_words").alias("own_words"))
        .withColumn("ahead", F.coalesce(F.sum("own").over(running), F.lit(0)))
        .withColumn("ahead_words", F.coalesce(F.sum("own_words").over(running), F.lit(0)))
        .drop("own", "own_words")
    )
    order = W.partitionBy("sid", "bucket").orderBy("key", "n_words", "print")
    inner = order.rowsBetween(W.unboundedPreceding, -1)
    return (
        keyed.join(totals, ["sid", "bucket"])
        .withColumn("rank", F.col("ahead") + F.row_number().over(order) - 1)
        .withColumn("before", F.col("ahead_words") + F.coalesce(F.sum("n_words").over(inner), F.lit(0)))
        .drop("ahead", "ahead_words", "bucket")
    )


def drawn(in_order: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes; ``v`` numbers a source's copies from 0 without gaps."""
    passes = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - passes * F.col("source_size")
    copies = (passes + F.when(F.col("before") + F.col("n_words") / 2 <= rest, 1).otherwise(0)).cast("int")
    return (
        in_order.withColumn("copies", copies)
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("v", F.col("copy") * F.col("n_blocks") + F.col("rank"))
        .drop("copies", "n_blocks", "rank", "before", "key")
    )


def quotas(per_source: DataFrame, shards: int, total: int, seed: str) -> DataFrame:
    """``sid, shard, start, stop``: the range of each source's numbers that each shard takes.

    A node of the tree is one row with a count per source (sources are a catalogue, not data).
    Nodes are split from the root on by separate tasks, and a source's ranges are summed in blocks.
    """
    root = per_source.agg(F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("all"))
    counts, sids = root.select(F.col("all.n").alias("counts")), root.select(F.posexplode("all.sid").alias("at", "sid"))
    leaves = per_source.sparkSession.range(0, shards).select(
        F.col("id").alias("leaf"), F.expr(f"{total}L * (id + 1) div {shards} - {total}L * id div {shards}").alias("size")
    )
    dealt = deal(leaves, shards, counts.where("size(counts) > 0"), seed)
    cells = dealt.select(F.col("leaf").alias("shard"), F.posexplode("counts").alias("at", "n")).join(sids, "at")
    stops = running(cells, "sid", "shard", {"stop": ("sum", F.col("n"))})
    return stops.select("sid", "shard", (F.col("stop") - F.col("n")).alias("start"), "stop").where("stop > start")


def mix(
    documents: DataFrame,
    sources: DataFrame,
    block_words: int | None = 256,
    shard_blocks: int = 4096,
    seed: str = "mix",
) -> DataFrame:
    """Every block copy of the mix: document keys, ``sid, block, first_word, n_words, copy, shard, place``.

    ``documents`` is ``sized``, ``sources`` is ``targets``.  ``place`` is the position after the
    local shuffle of a shard.  Only sizes and keys are shuffled here, never texts.  Documents
    without words have no blocks.  The same table and seed always give the same mix.
    """
    taken = drawn(ranked(blocks(documents, sources, block_words, seed)))
    per_source = cut(taken.groupBy("sid").agg(F.count("*").alias("n")))
    total = per_source.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_blocks))
    chunk = shard_blocks
    ranges = quotas(per_source, shards, total, seed).withColumn(
        "chunk", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(stop - 1) div {chunk}")))
    )
    placed = taken.withColumn("chunk", F.expr(f"v div {chunk}")).join(ranges, ["sid", "chunk"]).where("v >= start and v < stop")
    shuffle = F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), "sid", "v"))
    return placed.withColumn("place", F.row_number().over(W.partitionBy("shard").orderBy(shuffle, "sid", "v"))).drop("start", "stop", "chunk", "v")


def mixed_words(docs: DataFrame, block_words: int | None = 256, shard_blocks: int = 4096, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_shards, places`` for each row of ``docs``.

    ``size`` is the number of words (null text: 0); ``taken`` sums the words of all blocks that
    shards take, repeats counted, and is 0 for a document that the mix leaves out.  ``n_shards``
    is the number of shards that hold a block of it, ``places`` the sum of the positions of these
    blocks in the mix (shard times ``shard_blocks`` plus place).  A null source is a source; null
    ids and repeated rows keep a row each; other columns are not read; an empty table gives an
    empty result; if no document has words, targets and taken are 0.
    """
    documents = cut(sized(docs))
    sources = cut(targets(documents))
    pieces = mix(documents, sources, block_words, shard_blocks, **options)
    keys = ["doc_id", "print", "nth", "sid", "size"]
    numbered = by_source(documents, sources.select("sid", "source"), "source", ("doc_id", "print", "nth"))
    none = F.lit(None).cast("long")
    all_docs = numbered.select(*keys, F.lit(0).cast("long").alias("n_words"), none.alias("shard"), F.lit(0).cast("long").alias("position"))
    found = pieces.select(*keys, "n_words", "shard", (F.col("shard") * shard_blocks + F.col("place") - 1).alias("position"))
    per_shard = all_docs.unionByName(found).groupBy(*keys, "shard").agg(F.sum("n_words").alias("taken"), F.sum("position").alias("places"))
    per_doc = per_shard.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.count("shard").alias("n_shards"), F.sum("places").alias("places"))
    totals = sources.select("sid", "source_size", "target")
    return by_source(per_doc, totals, "sid", ("doc_id", "print", "nth")).select(
        "doc_id", "size", "source_size", "target", "taken", "n_shards", "places"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` as the mix takes them, whole documents as blocks, a row per copy, with shard and place.

    ``docs`` keeps its columns; if it has one of these names, the new column's gets an underscore.
    """
    names = docs.columns
    shard, place = fresh("shard", names), fresh("place", names)
    number = fresh("row_number_of_mix", names)
    # Rows get a number, so that texts are shuffled once, to meet their copies.
    rows = keep(docs.withColumn(number, F.monotonically_increasing_id()))
    documents = cut(sized(rows, number))
    pieces = mix(documents, cut(targets(documents)), None, **options)
    joined = rows.join(pieces.select(number, F.col("shard").alias(shard), F.col("place").alias(place)), number)
    return joined.select(*names, shard, place)
