"""Moments worth a picture: spoken screen references, restored terms, thinning, even spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions.lineage import cut
from talkspark.functions.ordered import neighbours, numbered, orbit, time_nodes, windowed
from talkspark.operators.joins import band_join

LOOK_AHEAD = 6.0
SEPARATION = 8.0
MAX_FRAMES = 40


def _reference_limit(pdf: pd.DataFrame, after: np.ndarray, starts: np.ndarray):
    """Per row: the row after its six seconds when they hold a phrase, else the next row."""
    n = len(pdf)
    at = pdf["start_s"].to_numpy(float)
    size = pdf["_size"].to_numpy(float)
    stop = np.arange(1, n + 1)
    hit = np.zeros(n, dtype=bool)
    for lo, hi in zip(starts, np.append(starts[1:], n)):
        t = at[lo:hi]
        cursor = np.searchsorted(t, t + LOOK_AHEAD - 1e-6, side="left")
        while True:
            more = (cursor < len(t)) & (t[np.minimum(cursor, len(t) - 1)] - t <= LOOK_AHEAD)
            if not more.any():
                break
            cursor = cursor + more
        last = np.arange(len(t)) + size[lo:hi] - 1
        last[np.isnan(last)] = np.inf
        soonest = np.minimum.accumulate(last[::-1])[::-1]
        found = soonest <= cursor - 1
        stop[lo:hi] = np.where(found, lo + cursor, stop[lo:hi])
        hit[lo:hi] = found
    return stop, hit


def screen_references(words: DataFrame) -> DataFrame:
    """One second before each spoken screen reference; a hit skips the rest of its window."""
    n = L.SCREEN_PHRASE_WORDS
    outs = {f"_t{k}": (lambda w, k=k: F.concat_ws(" ", "text", *[F.lead("text", i).over(w) for i in range(1, k + 1)])) for k in range(n)}
    seen = windowed(words.select("video_id", "idx", "text", "start_s"), "video_id", "idx", outs, after=n - 1)
    size = F.lit(None).cast("double")
    for k in reversed(range(n)):
        size = F.when(F.col(f"_t{k}").rlike(L.SCREEN_PATTERN), F.lit(float(k + 1))).otherwise(size)
    marked = seen.withColumn("_size", size).withColumn("_root", F.col("idx") == 0)
    nodes = cut(
        time_nodes(
            marked, "video_id", "idx", "start_s", "_root", ["start_s", "_size"], LOOK_AHEAD, _reference_limit, carry=["start_s"]
        )
    )
    on = orbit(nodes, "video_id")
    # by grouping: a join would hold a row per word in memory where Spark takes them for few
    found = nodes.filter("flag").select("video_id", "idx", "start_s").unionByName(on, allowMissingColumns=True)
    hits = found.groupBy("video_id", "idx").agg(F.max("start_s").alias("start_s"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return hits.select(
        "video_id",
        F.greatest(F.lit(0.0), F.round(F.col("start_s") - 1.0, 3)).alias("at"),
        F.lit("screen-reference").alias("reason"),
    )


def restored_terms(words: DataFrame) -> DataFrame:
    """Half a second before each restored word."""
    return words.filter("origin = 'youtube'").select(
        "video_id",
        F.greatest(F.lit(0.0), F.round(F.col("start_s") - 0.5, 3)).alias("at"),
        F.lit("restored-term").alias("reason"),
    )


def _far(pdf: pd.DataFrame, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    at = pdf["at"].to_numpy(float)
    stop = after.copy()
    for lo, hi in zip(starts, np.append(starts[1:], len(at))):
        t = at[lo:hi]
        j = np.searchsorted(t, t + SEPARATION - 1e-6, side="left")
        while True:
            near = (j < len(t)) & (t[np.minimum(j, len(t) - 1)] - t < SEPARATION)
            if not near.any():
                break
            j = j + near
        stop[lo:hi] = np.minimum(stop[lo:hi], lo + j)
    return stop


def apart(rows: DataFrame) -> DataFrame:
    """Greedy subset of times at least 8 s apart, earliest first."""
    order = [F.col("at"), F.col("reason")]
    base = cut(numbered(rows, "video_id", F.floor(F.col("at") / 3600.0).cast("long"), order))
    marked = neighbours(base, "video_id", "idx", prev={"_p": "at"}).withColumn(
        "_root", F.col("_p").isNull() | (F.col("at") - F.col("_p") >= SEPARATION)
    )
    nodes = time_nodes(marked, "video_id", "idx", "at", "_root", ["at"], SEPARATION, _far)
    return base.join(orbit(nodes, "video_id"), ["video_id", "idx"], "left_semi").drop("idx")


def spread(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """Evenly spread ``room`` rows of each video's time-ordered rows.

    ``rows(video_id, pos from 0, …)``; ``rooms(video_id, room)``.
    """
    n = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    picks = (
        n.join(rooms, "video_id")
        .filter("room > 0")
        .withColumn("p", F.explode(F.expr("sequence(0, cast(room - 1 as int))")))
        .filter("room < n")
        .withColumn(
            "pos",
            F.when(F.col("room") == 1, F.lit(0)).otherwise(
                F.bround(F.col("p") * (F.col("n") - 1) / (F.col("room") - 1))
            ).cast("long"),
        )
        .select("video_id", "pos")
        .distinct()
    )
    plenty = n.join(rooms, "video_id").filter("room >= n").select("video_id")
    return rows.join(plenty, "video_id", "left_semi").unionByName(
        rows.join(picks, ["video_id", "pos"], "left_semi")
    )


def thin(candidates: DataFrame, max_frames: int = MAX_FRAMES) -> DataFrame:
    """Requested moments first, then automatic ones far from them, spread over the free room."""
    w = Window.partitionBy("video_id").orderBy("at")
    asked = cut(
        apart(candidates.filter("reason = 'requested'"))
        .withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= max_frames)
        .drop("_r")
    )
    auto = candidates.filter("reason <> 'requested'")
    near = band_join(
        auto.withColumn("_row", F.struct("at", "reason")).select("video_id", "_row", F.col("at").alias("a_at")),
        asked.select("video_id", F.col("at").alias("q_at")),
        "video_id",
        F.col("a_at"),
        F.col("q_at"),
        SEPARATION,
        F.abs(F.col("a_at") - F.col("q_at")) < SEPARATION,
    ).select("video_id", F.col("_row.at").alias("at"), F.col("_row.reason").alias("reason")).distinct()
    eligible = cut(
        numbered(
            apart(auto.join(near, ["video_id", "at", "reason"], "left_anti")),
            "video_id",
            F.floor(F.col("at") / 3600.0).cast("long"),
            [F.col("at"), F.col("reason")],
            out="pos",
        )
    )
    taken = asked.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    rooms = (
        candidates.select("video_id")
        .distinct()
        .join(taken, "video_id", "left")
        .select("video_id", (F.lit(max_frames) - F.coalesce("_n", F.lit(0))).alias("room"))
    )
    return asked.unionByName(spread(eligible, rooms).drop("pos"))
