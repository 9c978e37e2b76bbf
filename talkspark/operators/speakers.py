"""One timeline from overlapping chunks: duplicate words and speaker labels."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.functions.ordered import map_groups, neighbours, running
from talkspark.operators.joins import band_join, point_join

DELTA = 0.75
MIN_VOTES = 2


def same_words(words: DataFrame) -> DataFrame:
    """Pairs of words from different chunks that are the same word: equal key, both ends within
    0.75 s.  ``a`` comes from the earlier chunk."""
    key = X.word_key(F.col("text"))
    cols = ["chunk_index", "pos", "start_s", "end_s", "speaker_raw"]
    base = words.withColumn("key", key).filter("key <> ''")
    a = base.select("video_id", "key", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = base.select("video_id", "key", *[F.col(c).alias(f"b_{c}") for c in cols])
    residual = (F.col("a_chunk_index") < F.col("b_chunk_index")) & (
        F.abs(F.col("a_end_s") - F.col("b_end_s")) <= DELTA
    )
    return band_join(
        b, a, ["video_id", "key"], F.col("b_start_s"), F.col("a_start_s"), DELTA, residual
    )


def overlaps(chunks: DataFrame) -> DataFrame:
    """Per later chunk the re-heard range ``[lo, hi)`` and the run of ranges it touches.

    ``chunks(video_id, chunk_index, chunk_start, chunk_end)`` with dense indexes.
    """
    w = neighbours(chunks, "video_id", "chunk_index", prev={"_pe": "chunk_end"})
    ranges = w.filter("_pe is not null").select(
        "video_id",
        "chunk_index",
        (F.col("chunk_start") - DELTA).alias("lo"),
        (F.col("_pe") + DELTA).alias("hi"),
    )
    seen = running(ranges, "video_id", "chunk_index", {"_top": ("max", F.col("hi"))}, inclusive=False)
    return running(
        seen,
        "video_id",
        "chunk_index",
        {
            "run": (
                "max",
                F.when(F.col("_top").isNull() | (F.col("lo") >= F.col("_top")), F.col("chunk_index")),
            )
        },
    ).drop("_top")


def observed_bounds(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Missing chunk bounds filled with the first start and last end of the chunk's words."""
    seen = words.groupBy("video_id", "chunk_index").agg(
        F.min("start_s").alias("_lo"), F.max("end_s").alias("_hi")
    )
    return chunks.join(seen, ["video_id", "chunk_index"], "left").select(
        "video_id",
        "chunk_index",
        F.coalesce("chunk_start", "_lo", F.lit(0.0)).alias("chunk_start"),
        F.coalesce("chunk_end", "_hi", F.lit(0.0)).alias("chunk_end"),
    )


def pieces(near: DataFrame) -> DataFrame:
    """``piece``: the first start of an unbroken row of occurrences of one word form.

    It breaks where the next start is more than 0.75 s later, so words of different pieces can't be
    the same.  A form's occurrences stream through a window; the grouping by piece that follows
    needs no further shuffle.
    """
    along = Window.partitionBy("video_id", "run", "key").orderBy("start_s", "chunk_index", "pos")
    gap = F.col("start_s") - F.lag("start_s").over(along)
    begun = near.withColumn("_begin", F.when(gap.isNull() | (gap > DELTA), F.col("start_s")))
    return begun.withColumn("piece", F.max("_begin").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")


def dropped_words(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """(video, chunk, pos) of words already kept from an earlier chunk or the same one.

    Only words inside a re-heard range can be dropped or cause a drop, and only within 0.75 s, so
    a group is a piece (``pieces``) of one word form inside one run of ranges; its rows are folded
    in arrival order.
    """
    windows = overlaps(chunks)
    runs = windows.groupBy("video_id", "run").agg(F.min("lo").alias("r_lo"), F.max("hi").alias("r_hi"))
    keyed = words.withColumn("key", X.word_key(F.col("text"))).filter("key <> ''")
    near = point_join(
        keyed.select("video_id", "chunk_index", "pos", "key", "start_s", "end_s"),
        runs,
        "video_id",
        F.col("start_s"),
        (F.col("r_lo"), F.col("r_hi")),
        30.0,
    ).join(windows.select("video_id", "chunk_index", "lo", "hi"), ["video_id", "chunk_index"], "left")
    row = F.struct("chunk_index", "pos", "start_s", "end_s", "lo", "hi")
    groups = pieces(near).groupBy("video_id", "run", "key", "piece").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    shape = "struct<chunk_index:bigint,pos:bigint,start_s:double,end_s:double,lo:double,hi:double>"

    def seen_before(kept: Column, x: Column) -> Column:
        tested = F.coalesce((x["start_s"] >= x["lo"]) & (x["start_s"] < x["hi"]), F.lit(False))
        return tested & F.exists(
            kept,
            lambda k: (F.abs(k["start_s"] - x["start_s"]) <= DELTA)
            & (F.abs(k["end_s"] - x["end_s"]) <= DELTA)
            & (k["start_s"] >= x["lo"])
            & (k["start_s"] < x["hi"]),
        )

    folded = F.aggregate(
        "rows",
        F.expr(
            f"named_struct('kept', cast(array() as array<{shape}>), 'gone', cast(array() as array<{shape}>))"
        ),
        lambda acc, x: F.when(
            seen_before(acc["kept"], x),
            F.struct(acc["kept"].alias("kept"), F.concat(acc["gone"], F.array(x)).alias("gone")),
        ).otherwise(
            F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), acc["gone"].alias("gone"))
        ),
    )
    return groups.filter(F.size("rows") > 1).select(
        "video_id", F.explode(folded["gone"]).alias("g")
    ).select("video_id", F.col("g.chunk_index").alias("chunk_index"), F.col("g.pos").alias("pos"))


def keep_words(words: DataFrame, dropped: DataFrame) -> DataFrame:
    return words.join(dropped, ["video_id", "chunk_index", "pos"], "left_anti")


def votes(words: DataFrame, dropped: DataFrame) -> DataFrame:
    """How often a label's words were heard as an earlier chunk's label (kept words only)."""
    pairs = same_words(words).join(
        dropped.select(
            "video_id", F.col("chunk_index").alias("a_chunk_index"), F.col("pos").alias("a_pos")
        ),
        ["video_id", "a_chunk_index", "a_pos"],
        "left_anti",
    )
    return pairs.filter("a_speaker_raw is not null and b_speaker_raw is not null").groupBy(
        "video_id",
        F.col("b_chunk_index").alias("chunk_index"),
        F.col("b_speaker_raw").alias("raw"),
        F.col("a_chunk_index").alias("from_chunk"),
        F.col("a_speaker_raw").alias("from_raw"),
    ).agg(F.count(F.lit(1)).alias("n"))


def labels(words: DataFrame) -> DataFrame:
    """Labels per chunk, the position at which each first speaks, and whether the chunk is the
    video's first."""
    first = words.groupBy("video_id").agg(F.min("chunk_index").alias("_first"))
    return (
        words.filter("speaker_raw is not null")
        .groupBy("video_id", "chunk_index", F.col("speaker_raw").alias("raw"))
        .agg(F.min("pos").alias("first_pos"))
        .join(first, "video_id")
        .withColumn("opens", F.col("chunk_index") == F.col("_first"))
        .drop("_first")
    )


def _resolve_video(rows: list[tuple]) -> list[tuple]:
    """Labels of one video in chunk order: accept, claim once, number the rest.

    ``rows`` are (chunk, first_pos, raw, opens, from_chunk, from_raw, n), sorted.
    """
    known: dict[tuple[int, str], int] = {}
    used = 0
    out = []
    for chunk, group in groupby(rows, key=lambda r: r[0]):
        tallies: dict[str, dict[int, int]] = {}
        opens = False
        for _, _, raw, first_chunk, from_chunk, from_raw, n in group:
            opens = first_chunk
            count = tallies.setdefault(raw, {})
            speaker = known.get((from_chunk, from_raw))
            if speaker is not None:
                count[speaker] = count.get(speaker, 0) + n
        waiting, offers = [], []
        for raw, count in tallies.items():
            best = sorted(count.values(), reverse=True) + [0, 0]
            if opens:
                waiting.append((raw, "confirmed", 0))
            elif best[0] >= MIN_VOTES and best[0] > best[1]:
                offers.append((best[0], raw, max(count, key=count.get)))
            else:
                waiting.append((raw, "unresolved", best[0]))
        claimed = set()
        for n, raw, speaker in sorted(offers, reverse=True):
            if speaker in claimed:
                waiting.append((raw, "unresolved", n))
                continue
            claimed.add(speaker)
            known[chunk, raw] = speaker
            out.append((chunk, raw, f"speaker:{speaker}", "inferred", "overlap", n))
        for raw, status, n in waiting:
            known[chunk, raw] = used
            out.append((chunk, raw, f"speaker:{used}", status, None, n))
            used += 1
    return out


def _resolve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    cols = ["chunk_index", "first_pos", "raw", "opens", "from_chunk", "from_raw", "n"]
    values = list(pdf[cols].astype(object).where(pdf[cols].notna(), None).itertuples(index=False, name=None))
    videos, out = [], []
    for lo, hi in zip(starts, np.append(starts[1:], len(pdf))):
        own = _resolve_video(sorted(values[lo:hi], key=lambda r: (r[0], r[1])))
        videos += [pdf["video_id"].iloc[lo]] * len(own)
        out += own
    done = pd.DataFrame(
        out, columns=["chunk_index", "raw", "speaker_global", "speaker_status", "speaker_evidence", "votes"]
    )
    done.insert(0, "video_id", videos)
    return done


def mapping(label_table: DataFrame, vote_table: DataFrame) -> DataFrame:
    """Global speaker per (chunk, label).

    Later decisions depend on earlier ones, so a video's labels are resolved in chunk order.
    The group holds labels and their vote counts, a few rows per half hour of audio, not words.
    """
    rows = label_table.join(vote_table, ["video_id", "chunk_index", "raw"], "left")
    schema = T.StructType(
        [
            label_table.schema["video_id"],
            T.StructField("chunk_index", T.LongType()),
            T.StructField("raw", T.StringType()),
            T.StructField("speaker_global", T.StringType()),
            T.StructField("speaker_status", T.StringType()),
            T.StructField("speaker_evidence", T.StringType()),
            T.StructField("votes", T.LongType()),
        ]
    )
    return map_groups(rows, ["video_id"], "chunk_index", _resolve, schema)


def enrich(words: DataFrame, map_table: DataFrame) -> DataFrame:
    """Speaker columns from the mapping; the raw label is never overwritten."""
    m = map_table.select(
        "video_id", "chunk_index", F.col("raw").alias("speaker_raw"), "speaker_global",
        "speaker_status", "speaker_evidence",
    )
    return words.join(m, ["video_id", "chunk_index", "speaker_raw"], "left").withColumn(
        "speaker", F.coalesce("speaker_global", "speaker_raw")
    ).withColumn("speaker_status", F.coalesce("speaker_status", F.lit("unresolved")))


def reconcile(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of all videos as one deduplicated, labelled timeline."""
    gone = cut(dropped_words(words, chunks))
    map_table = mapping(labels(words), votes(words, gone))
    return enrich(keep_words(words, gone), map_table)
