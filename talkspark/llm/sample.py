"""Bounded training samples drawn by Spark in an order that depends only on the row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``: the same rows on each run."""
    return rows.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), F.col(key)).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, text, label`` of a bounded sample of the labelled rows that may be learned from.

    Rows whose crc32 of the id (as text) leaves 2 modulo 4 are held out and never drawn.  The
    sample is drawn from the label table first: at most ``most`` pairs of an id and a label, which are
    broadcast, so the texts of other documents are not shuffled.  Of several rows with one id the
    text with the smallest hash counts, so ``most`` bounds the rows too.  Null ids and null labels
    are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(bounded(chosen, "doc_id", most)), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("print"), "text")).alias("row"))
    return one.select("doc_id", F.col("row.text").alias("text"), "label")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))
