"""Caption tracks: rolling collapse, choice of track, trust, health, text of a time range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.ordered import running, windowed
from talkspark.operators.joins import interval_join


def collapse_rolling(lines: DataFrame) -> DataFrame:
    """One cue per run of consecutive blocks that show the same line.

    ``lines(video_id, block_idx, b_start, b_end, line)`` holds one row per shown line.
    """
    keys = ["video_id", "line"]
    shown = lines.groupBy(*keys, "block_idx").agg(
        F.min("b_start").alias("b_start"), F.max("b_end").alias("b_end")
    )
    marked = windowed(
        shown, keys, "block_idx", {"_prev": lambda w: F.lag("block_idx").over(w)}, before=1
    ).withColumn("_new", F.coalesce(F.col("_prev") != F.col("block_idx") - 1, F.lit(True)))
    runs = running(
        marked, keys, "block_idx", {"run": ("max", F.expr("CASE WHEN _new THEN block_idx END"))}
    )
    return runs.groupBy(*keys, "run").agg(
        F.min_by("b_start", "block_idx").alias("cue_start"),
        F.max_by("b_end", "block_idx").alias("cue_end"),
    ).select("video_id", "cue_start", "cue_end", F.col("line").alias("cue_text"))


def pick_track(tracks: DataFrame) -> DataFrame:
    """Best track per video: original in the exact language, same base language, any original,
    then the requested order, then the first by name.

    ``tracks(video_id, name, lang, preferred, requested ARRAY)``; ``preferred`` may be null.
    """
    original = F.col("lang").endswith("-orig")
    tag = F.lower(F.regexp_replace("lang", "-orig$", ""))
    want = F.lower(F.regexp_replace("preferred", "-orig$", ""))
    place = F.array_position("requested", F.col("lang"))
    rank = (
        F.when(original & F.coalesce(tag == want, F.lit(False)), 0)
        .when(
            original
            & F.coalesce(F.split(tag, "-", 2)[0] == F.split(want, "-", 2)[0], F.lit(False)),
            1,
        )
        .when(original, 2)
        .when(place > 0, F.lit(3) + place)
        .otherwise(F.lit(1 << 30))
    )
    best = tracks.withColumn("_rank", rank).groupBy("video_id").agg(
        F.min(F.struct("_rank", "name", "lang")).alias("b")
    )
    return best.select("video_id", F.col("b.name").alias("name"), F.col("b.lang").alias("lang"))


def spoken_cues(cues: DataFrame) -> DataFrame:
    """Cues without bracket-only remarks such as ``[laughter]``."""
    return cues.filter(~X.bracket_only(F.col("cue_text")))


def trusted(language: Column) -> Column:
    """Only tracks in the spoken language are evidence."""
    return F.coalesce(language.endswith("-orig"), F.lit(False))


def evidence_language(tracks: DataFrame) -> DataFrame:
    """Language a track may be used as evidence for; null when it may be a translation.

    ``tracks(video_id, language, source, original)``: files without a language take it from the
    ``youtube-`` source name.
    """
    named = F.when(
        F.col("source").startswith("youtube-"), F.expr("substring(source, 9)")
    )
    return tracks.select(
        "video_id",
        F.when(F.coalesce(F.col("original"), F.lit(True)), F.coalesce("language", named)).alias(
            "evidence_language"
        ),
    )


def health(tracks: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """Per video: "no captions exist" is not the same as "the fetch failed"."""
    return (
        known.select("video_id")
        .join(tracks, "video_id", "left")
        .join(counts, "video_id", "left")
        .select(
            "video_id",
            F.col("language").isNotNull().alias("present"),
            F.coalesce("n_cues", F.lit(0)).alias("n_cues"),
            "language",
            F.coalesce("original", F.lit(False)).alias("original"),
            (F.col("error").isNotNull() | F.col("language").isNull()).alias("failed"),
        )
    )


def text_in_ranges(ranges: DataFrame, cues: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Caption text touching each range (closed at both ends), cues in order.

    ``ranges(video_id, range_id, r_start, r_end)``.
    """
    hits = interval_join(
        ranges,
        cues.select("video_id", "cue_idx", "cue_start", "cue_end", "cue_text"),
        "video_id",
        (F.col("r_start"), F.col("r_end")),
        (F.col("cue_start"), F.col("cue_end")),
        bucket,
    )
    return hits.groupBy("video_id", "range_id").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("cue_idx", "cue_text"))).getField("cue_text"), " "
        ).alias("caption_text"),
        F.count(F.lit(1)).alias("n_cues"),
    )


def validate_cues(cues: DataFrame) -> DataFrame:
    """Violations by rule: reversed cue, start before the previous cue's start."""
    seen = windowed(
        cues, "video_id", "cue_idx", {"_p": lambda w: F.lag("cue_start").over(w)}, before=1
    )
    return seen.select(
        "video_id",
        "cue_idx",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("cue_start").isNull() | F.col("cue_end").isNull(), "not numeric"),
                    F.when(F.col("cue_end") < F.col("cue_start"), "reversed"),
                    F.when(F.col("cue_start") < F.col("_p"), "out of order"),
                )
            )
        ).alias("rule"),
    )


def validate_words(words: DataFrame, strict: bool = False) -> DataFrame:
    """Violations by rule for words; ``strict`` raises on the first one instead."""
    seen = windowed(
        words, "video_id", "idx", {"_p": lambda w: F.lag("start_s").over(w)}, before=1
    )
    out = seen.select(
        "video_id",
        "idx",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(X.trim_ws(F.col("text")), F.lit("")) == "", "empty text"),
                    F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "not numeric"),
                    F.when(F.col("end_s") < F.col("start_s"), "reversed"),
                    F.when(F.col("start_s") < F.col("_p"), "out of order"),
                )
            )
        ).alias("rule"),
    )
    if strict:
        return out.withColumn(
            "rule", F.raise_error(F.concat_ws(" ", F.lit("invalid word:"), "video_id", "idx", "rule"))
        )
    return out


def id_mismatch(transcripts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Pairs filed together whose own ids differ (both present)."""
    return transcripts.join(tracks, "bundle").filter(
        F.col("transcript_video_id") != F.col("captions_video_id")
    )
