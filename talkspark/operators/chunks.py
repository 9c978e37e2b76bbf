"""Chunk plans, job progress and reuse of stored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_chunks(totals: DataFrame, max_s: float, overlap_s: float) -> DataFrame:
    """Fewest equal pieces that stay within ``max_s`` once every later one starts early.

    The smallest count is at most two away from ``total / (max − overlap)``, so four candidates
    are tested; rows are then generated in two steps to keep arrays short for very long talks.
    """
    mx, ov = F.lit(float(max_s)), F.lit(float(overlap_s))
    total = F.col("total_s")
    base = F.greatest(F.lit(1), F.ceil(total / mx)).cast("long")
    guess = F.floor(total / (mx - ov)).cast("long")
    candidates = F.array(
        base, *[F.greatest(base, guess + k) for k in (-1, 0, 1, 2)]
    )
    fits = F.filter(candidates, lambda n: (n == 1) | (total / n + ov <= mx))
    planned = totals.withColumn("n_chunks", F.array_min(fits))
    rows = planned.withColumn(
        "_hi", F.explode(F.sequence(F.lit(0), F.expr("(n_chunks - 1) div 1024").cast("int")))
    ).withColumn(
        "chunk_index",
        F.explode(
            F.sequence(
                F.col("_hi").cast("long") * 1024,
                F.least(F.col("_hi").cast("long") * 1024 + 1023, F.col("n_chunks") - 1),
            )
        ),
    )
    core = total / F.col("n_chunks")
    start = F.when(F.col("chunk_index") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.col("chunk_index") * core - ov)
    )
    end = F.when(F.col("chunk_index") == F.col("n_chunks") - 1, total).otherwise(
        (F.col("chunk_index") + 1) * core
    )
    return rows.select(
        "video_id",
        "chunk_index",
        "n_chunks",
        F.round(start, 6).alias("chunk_start"),
        F.round(end, 6).alias("chunk_end"),
    )


def carry_progress(old: DataFrame, new: DataFrame, stored: DataFrame) -> DataFrame:
    """Completed chunks of an old plan kept in a new one when bounds and transcript agree."""
    done = (
        old.filter("status = 'complete'")
        .select("video_id", "chunk_start", "chunk_end", F.col("attempts").alias("old_attempts"))
        .dropDuplicates(["video_id", "chunk_start", "chunk_end"])
    )
    have = stored.select("video_id", "chunk_index").distinct().withColumn("_have", F.lit(True))
    out = new.join(done, ["video_id", "chunk_start", "chunk_end"], "left").join(
        have, ["video_id", "chunk_index"], "left"
    )
    carried = F.col("old_attempts").isNotNull() & F.col("_have").isNotNull()
    return out.select(
        "video_id",
        "chunk_index",
        "chunk_start",
        "chunk_end",
        F.when(carried, "complete").otherwise("planned").alias("status"),
        F.when(carried, F.col("old_attempts")).otherwise(F.lit(0)).alias("attempts"),
        carried.alias("carried"),
    )


def pending(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that are not complete or have no transcript."""
    done = chunks.filter("status = 'complete'").join(
        stored.select("video_id", "chunk_index"), ["video_id", "chunk_index"], "left_semi"
    )
    return chunks.join(done.select("video_id", "chunk_index"), ["video_id", "chunk_index"], "left_anti")


REUSE_TAGS = ["requested_langs", "fingerprint", "chunk_index", "chunk_start", "chunk_end"]


def reusable(expected: DataFrame, raw: DataFrame) -> DataFrame:
    """Stored responses whose five tags all equal the job's (null equals null)."""
    e, r = expected.alias("e"), raw.select("video_id", *REUSE_TAGS).distinct().alias("r")
    same = F.col("e.video_id") == F.col("r.video_id")
    for tag in REUSE_TAGS:
        same = same & F.col(f"e.{tag}").eqNullSafe(F.col(f"r.{tag}"))
    return e.join(r, same, "left_semi")


def job_rollup(chunks: DataFrame, stored: DataFrame, guard: DataFrame) -> DataFrame:
    """Per video: totals, completed, transcripts present, failed indexes, guard state."""
    have = stored.select("video_id", "chunk_index").distinct().withColumn("_have", F.lit(1))
    agg = (
        chunks.join(have, ["video_id", "chunk_index"], "left")
        .groupBy("video_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "complete").alias("complete"),
            F.count("_have").alias("transcripts"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("chunk_index")))), ","
            ).alias("failed_chunks"),
        )
    )
    out = agg.join(guard, "video_id", "left")
    return out.withColumn(
        "guard_state", guard_state(F.col("translation_guard"), F.col("complete"))
    ).withColumn("ledger_behind", F.col("transcripts") > F.col("complete")).drop("translation_guard")


def guard_state(recorded, complete):
    return (
        F.when(recorded.isin("active", "skipped"), recorded)
        .when(complete > 0, F.lit("unknown"))
        .otherwise(F.lit("not-run"))
    )
