"""Missing Latin terms restored from captions into silences before a particle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.functions.ordered import running
from talkspark.operators.joins import interval_join
from talkspark.operators.segment import missing_gaps

LOOK = 0.5
BACK = 1.0


def gap_tokens(gaps: DataFrame, cues: DataFrame) -> DataFrame:
    """Latin caption tokens within half a second of each gap."""
    hits = interval_join(
        gaps,
        cues.select("video_id", "cue_idx", "cue_start", "cue_end", "cue_text"),
        "video_id",
        (F.greatest(F.lit(0.0), F.col("gap_start") - LOOK), F.col("gap_end") + LOOK),
        (F.col("cue_start"), F.col("cue_end")),
        30.0,
    )
    return hits.select(
        "video_id",
        "gap_idx",
        "cue_idx",
        F.posexplode(X.latin_tokens(F.col("cue_text"))).alias("token_idx", "token"),
    )


def heard_near(gaps: DataFrame, words: DataFrame) -> DataFrame:
    """Lower-case Latin tokens already spoken around each gap."""
    spoken = words.filter(F.col("text").rlike("[A-Za-z]")).select(
        "video_id", F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"), F.col("text").alias("w_text")
    )
    hits = interval_join(
        gaps,
        spoken,
        "video_id",
        (F.col("gap_start") - BACK, F.col("gap_end") + LOOK),
        (F.col("w_start"), F.col("w_end")),
        30.0,
    )
    return hits.select(
        "video_id", "gap_idx", F.explode(X.latin_tokens(F.lower("w_text"))).alias("key")
    ).distinct()


def inserted_words(words: DataFrame, cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Words to insert after ``idx``, in ``seq`` order, evenly spread over their gap.

    A caption token used by one gap is gone for later ones.  Gaps interact only when they reach
    a common cue, so gaps are grouped by shared cue ranges and each small group is folded.
    """
    # only tracks that may be translations are excluded; absent counts as original
    trusted = tracks.filter(F.coalesce("original", F.lit(True))).select("video_id")
    gaps = cut(missing_gaps(words).join(trusted, "video_id", "left_semi"))
    tokens = gap_tokens(gaps, cues)
    present = heard_near(gaps, words).withColumn("heard", F.lit(True))
    marked = tokens.withColumn("key", F.lower("token")).join(
        present, ["video_id", "gap_idx", "key"], "left"
    )
    shape = F.struct(
        "cue_idx", "token_idx", "token", "key", F.coalesce("heard", F.lit(False)).alias("heard")
    )
    per_gap = cut(
        marked.groupBy("video_id", "gap_idx").agg(
            F.array_sort(F.collect_list(shape)).alias("toks"),
            F.min("cue_idx").alias("lo"),
            F.max("cue_idx").alias("hi"),
        )
    )
    linked = running(per_gap, "video_id", "gap_idx", {"seen": ("max", F.col("hi"))}, inclusive=False)
    parts = running(
        linked,
        "video_id",
        "gap_idx",
        {
            "part": (
                "max",
                F.when(F.col("seen").isNull() | (F.col("lo") > F.col("seen")), F.col("gap_idx")),
            )
        },
    )
    folded = parts.groupBy("video_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("gap_idx", "toks"))).alias("gaps")
    )
    picked = folded.select("video_id", F.explode(_fold(F.col("gaps"))).alias("p")).select(
        "video_id", F.col("p.gap_idx").alias("gap_idx"), F.posexplode("p.take").alias("seq", "t"),
        F.size("p.take").alias("n"),
    )
    slot = (F.col("gap_end") - F.col("gap_start")) / F.col("n")
    return picked.join(gaps, ["video_id", "gap_idx"]).select(
        "video_id",
        F.col("gap_idx").alias("idx"),
        F.col("seq"),
        F.col("t.token").alias("text"),
        (F.col("gap_start") + F.col("seq") * slot).alias("start_s"),
        (F.col("gap_start") + (F.col("seq") + 1) * slot).alias("end_s"),
        F.col("gap_speaker").alias("speaker"),
        F.lit("youtube").alias("origin"),
    )


_TOK = "struct<cue_idx:bigint,token_idx:int,token:string,key:string,heard:boolean>"


def _fold(gaps: Column) -> Column:
    """Per gap: unused tokens, first per key, minus those already heard."""

    def one(acc: Column, gap: Column) -> Column:
        free = F.filter(
            gap["toks"],
            lambda t: ~F.exists(
                acc["used"], lambda u: (u["cue_idx"] == t["cue_idx"]) & (u["token_idx"] == t["token_idx"])
            ),
        )
        first = F.filter(
            free, lambda t, i: F.array_position(F.transform(free, lambda x: x["key"]), t["key"]) == i + 1
        )
        take = F.filter(first, lambda t: ~t["heard"])
        return F.struct(
            F.concat(acc["used"], take).alias("used"),
            F.concat(
                acc["out"], F.array(F.struct(gap["gap_idx"].alias("gap_idx"), take.alias("take")))
            ).alias("out"),
        )

    zero = F.expr(
        f"named_struct('used', cast(array() as array<{_TOK}>), "
        f"'out', cast(array() as array<struct<gap_idx:bigint,take:array<{_TOK}>>>))"
    )
    return F.aggregate(gaps, zero, one)["out"]


def merge(words: DataFrame, cues: DataFrame, tracks: DataFrame) -> DataFrame:
    """Transcript words plus restored ones, renumbered; existing words are untouched."""
    extra = cut(inserted_words(words, cues, tracks))
    both = (
        words.withColumn("seq", F.lit(-1))
        .unionByName(extra, allowMissingColumns=True)
        .withColumn("old_idx", F.col("idx"))
    )
    earlier = running(
        both,
        "video_id",
        "old_idx",
        {"first": ("sum", F.lit(1))},
        inclusive=False,
        order=[F.col("old_idx"), F.col("seq")],
    )
    return earlier.withColumn("idx", F.col("first")).drop("first", "seq", "old_idx")


def merge_stats(merged: DataFrame) -> DataFrame:
    """Per video: transcript words, restored words, distinct restored terms."""
    restored = F.col("origin") == "youtube"
    return merged.groupBy("video_id").agg(
        F.count_if(~restored).alias("spoken_words"),
        F.count_if(restored).alias("inserted_words"),
        F.count_distinct(F.when(restored, F.lower("text"))).alias("new_terms"),
    )
