"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix, in SQL only.

Rows are dealt to logical partitions by a digest.  A matrix of exact partition-to-shard counts is
drawn without replacement; each partition is permuted locally and cut into runs of these counts;
the runs are exchanged, and each shard is permuted again.  Together that is a uniform permutation
of all rows, cut at exact shard sizes, although no task sees more than a partition or a piece of a
shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions.lineage import checkpointed as cut
from talkspark.llm import hypergeometric
from talkspark.llm.names import fresh

#: Copies of one row that stay together until the local permutation.
CHUNK = 1024


def scaled(digest: str, parts: str) -> str:
    """SQL: the leading 32 bits of a hexadecimal digest, scaled to 0 .. parts - 1."""
    return f"shiftright(cast(conv(substring({digest}, 1, 8), 16, 10) as bigint) * ({parts}), 32)"


def shuffled(rows: DataFrame, shards: int = 8, partition_rows: int = 4096, seed: str = "shard") -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, … without gaps in each shard).

    Shard sizes differ by one at most.  The result depends on the rows and the seed only, not on
    their order or files.  Rows that are equal in all columns are counted, dealt in chunks and
    then shuffled singly, so a row that makes up a third of the table is no hot key.  Null values
    are values.  Any column that can be grouped by may be there (no maps); one called ``shard`` or
    ``slot`` keeps its name and the new one gets an underscore.  An empty table gives no rows;
    with fewer rows than shards the last shards are empty.
    """
    names = rows.columns
    shard, slot = fresh("shard", names), fresh("slot", names)
    columns = [f"c{i}" for i in range(len(names))]
    plain = rows.toDF(*columns)
    counted = plain.groupBy(*columns).agg(F.count("*").alias("n"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))
    counted = cut(counted.withColumn("digest", digest))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / partition_rows))
    chunks = (
        counted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
        .withColumn("held", F.expr(f"least({CHUNK}, n - chunk * {CHUNK})"))
        .withColumn("leaf", F.expr(scaled("md5(concat_ws('|', digest, 'leaf', chunk))", str(parts))))
    )
    found = chunks.groupBy("leaf").agg(F.sum("held").alias("size"))
    all_leaves = rows.sparkSession.range(0, parts).withColumnRenamed("id", "leaf")
    leaves = cut(all_leaves.join(found, "leaf", "left").select("leaf", F.coalesce("size", F.lit(0)).alias("size")))
    sizes = F.array(*[F.lit(total // shards + (j < total % shards)).cast("long") for j in range(shards)])
    totals = rows.sparkSession.range(0, 1, 1, 1).select(sizes.alias("counts"))
    matrix = hypergeometric.deal(leaves, parts, totals, seed).select(
        "leaf", F.expr("transform(counts, (v, i) -> aggregate(slice(counts, 1, i + 1), 0L, (a, x) -> a + x))").alias("stops")
    )
    singles = (
        chunks.repartition("leaf")
        .withColumn("nth", F.explode(F.expr(f"sequence(chunk * {CHUNK}, chunk * {CHUNK} + held - 1)")))
        .withColumn("first_key", F.expr("md5(concat_ws('|', digest, 'first', nth))"))
        .withColumn("place", F.row_number().over(W.partitionBy("leaf").orderBy("first_key", "digest", "nth")) - 1)
    )
    exchanged = cut(
        singles.join(matrix, "leaf")
        .withColumn("shard", F.expr("size(filter(stops, x -> x <= place))"))
        .withColumn("second_key", F.expr("md5(concat_ws('|', digest, 'second', nth))"))
        .withColumn("piece", F.expr(scaled("second_key", str(max(1, math.ceil(total / shards / partition_rows))))))
        .select(*columns, "digest", "nth", "shard", "piece", "second_key")
    )
    before = F.sum("held").over(W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    ahead = exchanged.groupBy("shard", "piece").agg(F.count("*").alias("held")).select("shard", "piece", F.coalesce(before, F.lit(0)).alias("ahead"))
    order = W.partitionBy("shard", "piece").orderBy("second_key", "digest", "nth")
    placed = exchanged.join(ahead, ["shard", "piece"]).withColumn("slot", F.col("ahead") + F.row_number().over(order) - 1)
    return placed.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col("shard").alias(shard), F.col("slot").cast("long").alias(slot))


def write_shards(rows: DataFrame, path: str, shards: int = 8, **options) -> None:
    """The shuffled rows as Parquet, a folder ``shard=…`` for each shard; files and rows in order of ``slot``."""
    placed = shuffled(rows, shards, **options)
    shard, slot = placed.columns[-2:]
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, print`` of documents: UTF-8 bytes plus 1, CRC-32 and MD5; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.col("text").cast("string")).alias("print"),
    )


def document_shards(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document under the law ``rows``.

    Only digests are shuffled, never texts.  Documents with equal texts are shuffled one by one as
    any others: kept together, they could not leave the shards equal.  ``grown_shard`` is null, as
    one more shard changes the whole shuffle.  Null ids and repeated rows keep a row each; other
    columns are not read.
    """
    placed = shuffled(sized(docs), shards, **options)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
