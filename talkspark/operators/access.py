"""Embed gate, takedown, language choice for slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import text as X

# which kinds of tables each takedown scope removes
SCOPES = {
    "derived": ["derived", "index"],
    "raw": ["raw", "translations"],
    "all": ["derived", "index", "raw", "translations", "job"],
}


def blocked(videos: DataFrame, done: DataFrame, forced: DataFrame) -> DataFrame:
    """Videos whose embedding is known to be off, with no finished work and not forced.

    Unknown (null) never blocks.  ``done`` is the transcripts for registration, the started
    translations for subtitle work.
    """
    return (
        videos.filter("playable_in_embed = false")
        .join(done.select("video_id"), "video_id", "left_anti")
        .join(forced.select("video_id"), "video_id", "left_anti")
    )


def purge(table: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """Rows of a ``kind`` table that survive the takedown ``requests(video_id, scope)``."""
    scopes = [s for s, kinds in SCOPES.items() if kind in kinds]
    gone = requests.filter(F.col("scope").isin(scopes)).select("video_id")
    return table.join(gone, "video_id", "left_anti")


def ocr_language(caption_language: Column, job_codes: Column) -> Column:
    """Spoken language for reading slides: caption track first, then the first job code."""
    own = F.nullif(X.trim_ws(caption_language), F.lit(""))
    code = F.nullif(X.trim_ws(F.get(job_codes, F.lit(0))), F.lit(""))
    return F.coalesce(F.regexp_replace(own, "-orig$", ""), code)
