"""Caption and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.operators import captions as C
from talkspark.plans.registry import query
from talkspark.sources import adapters as A


@query(
    "agg1_caption_collapse",
    """SELECT video_id, cue_start, cue_end, cue_text FROM (
      SELECT video_id, cue_text, run, min(cs) AS cue_start, max(ce) AS cue_end FROM (
        SELECT video_id, cue_text, cs, ce, b - row_number() OVER (PARTITION BY video_id, cue_text ORDER BY b) AS run FROM (
          SELECT video_id, b, cue_text, min(cs) AS cs, max(ce) AS ce FROM (
            SELECT video_id, cue_idx * 2 AS b, cue_text, cue_start_ms / 1e3 AS cs, (cue_end_ms - 10) / 1e3 AS ce FROM v_cues
            UNION ALL SELECT video_id, cue_idx * 2 + 1, cue_text, (cue_end_ms - 10) / 1e3, cue_end_ms / 1e3 FROM v_cues
            UNION ALL SELECT c.video_id, n.cue_idx * 2, c.cue_text, n.cue_start_ms / 1e3, (n.cue_end_ms - 10) / 1e3
              FROM v_cues c JOIN v_cues n ON n.video_id = c.video_id AND n.cue_idx = c.cue_idx + 1)
          GROUP BY ALL)) GROUP BY ALL)""",
)
def _(spark, sf):
    b = A.srt_blocks(spark, sf)
    return C.collapse_rolling(
        b.select(
            "video_id", "block_idx", A.seconds(F.col("b_start_ms")).alias("b_start"),
            A.seconds(F.col("b_end_ms")).alias("b_end"), "line",
        )
    )


@query(
    "fil1_bracket_cues",
    """SELECT video_id, cue_idx, cue_text FROM (SELECT video_id, cue_idx,
      CASE WHEN cue_idx % 23 = 4 THEN ' [laughter] ' ELSE cue_text END AS cue_text FROM v_cues)
      WHERE NOT regexp_matches(trim(cue_text), '^\\[[^\\[\\]]*\\]$')""",
)
def _(spark, sf):
    c = A.cues(spark, sf).withColumn(
        "cue_text", F.when(F.expr("cue_idx % 23 = 4"), " [laughter] ").otherwise(F.col("cue_text"))
    )
    return C.spoken_cues(c).select("video_id", "cue_idx", "cue_text")


@query(
    "jon1_captions_in_chunk",
    """SELECT k.video_id, k.chunk_index AS range_id, string_agg(cue_text, ' ' ORDER BY cue_idx) AS caption_text, count(*) AS n_cues
    FROM v_chunks k JOIN v_cues c ON c.video_id = k.video_id AND c.cue_end >= k.chunk_start AND c.cue_start <= k.chunk_end
    GROUP BY 1, 2""",
)
def _(spark, sf):
    ranges = A.chunks(spark, sf).select(
        "video_id", F.col("chunk_index").alias("range_id"), F.col("chunk_start").alias("r_start"),
        F.col("chunk_end").alias("r_end"),
    )
    return C.text_in_ranges(ranges, A.cues(spark, sf))


@query(
    "fil2_id_mismatch",
    """SELECT t.video_id // 2 AS bundle, t.video_id AS transcript_video_id, c.video_id AS captions_video_id FROM v_videos t
    JOIN v_tracks c ON c.video_id // 2 = t.video_id // 2 WHERE c.original AND c.video_id <> t.video_id""",
)
def _(spark, sf):
    # two neighbouring videos share a bundle; a track that is not the original names no video
    bundle = F.floor(F.col("video_id") / 2).alias("bundle")
    transcripts = A.videos(spark, sf).select(bundle, F.col("video_id").alias("transcript_video_id"))
    tracks = A.caption_tracks(spark, sf).select(bundle, F.when(F.col("original"), F.col("video_id")).alias("captions_video_id"))
    return C.id_mismatch(transcripts, tracks)
