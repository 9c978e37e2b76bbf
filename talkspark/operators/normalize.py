"""Word times of one response: cap, repair, duplicates, corruption gate, absolute time.

A response is one input record (a chunk of audio), so windows over (video, chunk) hold at most
what one record holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = ["video_id", "chunk_index"]
FALLBACK_SECS = 0.5
RANGE_SLACK = 5.0
MIN_ALLOWANCE = 3
MAX_RATIO = 0.005


def duration_caps(entries: DataFrame) -> DataFrame:
    """99th percentile element of valid durations per chunk, at least 0.5 s."""
    valid = entries.filter("start_s >= 0 AND end_s >= start_s").select(
        *CHUNK, (F.col("end_s") - F.col("start_s")).alias("d")
    )
    w = Window.partitionBy(*CHUNK)
    ranked = valid.withColumn("rn", F.row_number().over(w.orderBy("d")) - 1).withColumn(
        "n", F.count(F.lit(1)).over(w)
    )
    pick = F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)
    capped = ranked.filter(F.col("rn") == pick).select(*CHUNK, "d")
    return (
        entries.select(*CHUNK)
        .distinct()
        .join(capped, CHUNK, "left")
        .select(*CHUNK, F.greatest(F.coalesce("d", F.lit(FALLBACK_SECS)), F.lit(FALLBACK_SECS)).alias("cap"))
    )


def repair(entries: DataFrame) -> DataFrame:
    """Bad starts and ends replaced row by row; a repaired row is never a basis for another.

    ``entries(video_id, chunk_index, pos, text, start_s, end_s, audio_s, …)``; ``audio_s`` may
    be null.
    """
    limit = F.col("audio_s") + RANGE_SLACK
    far_start = F.coalesce(F.col("start_s") > limit, F.lit(False))
    far_end = F.coalesce(F.col("end_s") > limit, F.lit(False))
    bad_start = F.col("start_s").isNull() | (F.col("start_s") < 0) | far_start
    base_ok = ~bad_start & F.col("end_s").isNotNull() & (F.col("end_s") >= F.col("start_s")) & ~far_end
    w = Window.partitionBy(*CHUNK).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        entries.join(duration_caps(entries), CHUNK)
        .withColumn("bad_start", bad_start)
        .withColumn("basis", F.coalesce(F.max(F.when(base_ok, F.col("end_s"))).over(w), F.lit(0.0)))
        .withColumn("start_from", F.col("start_s"))
        .withColumn("end_from", F.col("end_s"))
        .withColumn("start_s", F.when(F.col("bad_start"), F.col("basis")).otherwise(F.col("start_s")))
        .withColumn(
            "bad_end", F.col("end_s").isNull() | (F.col("end_s") < F.col("start_s")) | far_end
        )
        .withColumn(
            "end_s",
            F.when(F.col("bad_end"), F.round(F.col("start_s") + F.col("cap"), 3)).otherwise(F.col("end_s")),
        )
    )
    fixed = F.array_compact(
        F.array(F.when(F.col("bad_start"), "start"), F.when(F.col("bad_end"), "end"))
    )
    return out.withColumn("timestamp_repaired", fixed).drop("basis", "cap")


def repair_log(repaired: DataFrame) -> DataFrame:
    """One row per repaired field."""
    return repaired.select(
        *CHUNK,
        "pos",
        "text",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("bad_start"),
                        F.struct(F.lit("start").alias("field"), F.col("start_from").alias("from_s"), F.col("start_s").alias("to_s")),
                    ),
                    F.when(
                        F.col("bad_end"),
                        F.struct(F.lit("end").alias("field"), F.col("end_from").alias("from_s"), F.col("end_s").alias("to_s")),
                    ),
                )
            )
        ).alias("r"),
    ).select(*CHUNK, "pos", "text", "r.*")


def drop_duplicates(words: DataFrame) -> DataFrame:
    """First arrival per (start, end, text) and chunk; partial minima before the shuffle."""
    rest = [c for c in words.columns if c not in {*CHUNK, "start_s", "end_s", "text"}]
    first = words.groupBy(*CHUNK, "start_s", "end_s", "text").agg(
        F.min_by(F.struct(*rest), "pos").alias("_w")
    )
    return first.select(*CHUNK, "start_s", "end_s", "text", "_w.*")


def corruption(repaired: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Per chunk: words after duplicate removal, repairs, allowance, accepted or not.

    ``chunks`` lists all chunks; one whose response has no words gets a row too and is refused.
    """
    kept = drop_duplicates(repaired).groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n_words"))
    fixes = repaired.groupBy(*CHUNK).agg(
        F.sum(F.col("bad_start").cast("int") + F.col("bad_end").cast("int")).alias("n_repairs")
    )
    if chunks is not None:
        fixes = chunks.select(*CHUNK).distinct().join(fixes, CHUNK, "left")
    fixes = fixes.withColumn("n_repairs", F.coalesce("n_repairs", F.lit(0)))
    allowance = F.greatest(F.lit(MIN_ALLOWANCE), F.floor(F.col("n_words") * MAX_RATIO))
    return (
        fixes.join(kept, CHUNK, "left")
        .withColumn("n_words", F.coalesce("n_words", F.lit(0)))
        .withColumn("allowance", allowance)
        .withColumn("accepted", (F.col("n_words") > 0) & (F.col("n_repairs") <= F.col("allowance")))
    )


def absolute(words: DataFrame) -> DataFrame:
    """Chunk-relative times moved to video time, three decimals."""
    return words.withColumn("start_s", F.round(F.col("start_s") + F.col("chunk_start"), 3)).withColumn(
        "end_s", F.round(F.col("end_s") + F.col("chunk_start"), 3)
    )
