"""Words into sentences, search spans, subtitle cues and breath points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.ordered import (
    group_starts,
    neighbours,
    numbered,
    running,
    time_nodes,
    windowed,
    BLOCK,
)

SENTENCE_GAP = 1.2
SENTENCE_WORDS = 35
CUT_WINDOW = 10
SPAN_GAP = 2.5
SPAN_SECS = 30.0
CUE_GAP = 0.65
CUE_SECS = 7.0
CUE_LINES = 2
BREATH_GAP = 0.3
MISSING_GAP = 1.5


def join_texts(order: str, text: str, sep: str = " ") -> Column:
    # sort_array compares rows as they are, array_sort by an expression a pair
    return F.array_join(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text).alias("_t")))).getField("_t"), sep
    )


def missing_gaps(words: DataFrame) -> DataFrame:
    """Silences over 1.5 s whose next word begins with a particle: a word is missing there."""
    nxt = neighbours(
        words,
        "video_id",
        "idx",
        nxt={"_ns": "start_s", "_nt": "text", "_nsp": "speaker"},
    )
    return nxt.filter(
        (F.col("_ns") - F.col("end_s") > MISSING_GAP) & X.particle_fragment(F.col("_nt"))
    ).select(
        "video_id",
        F.col("idx").alias("gap_idx"),
        F.col("end_s").alias("gap_start"),
        F.col("_ns").alias("gap_end"),
        F.when(F.col("speaker") == F.col("_nsp"), F.col("speaker")).alias("gap_speaker"),
    )


def _break() -> Column:
    """A sentence starts here whatever came before it; ``_pe`` and ``_pt`` are the word before's end and text."""
    return (
        F.col("_pe").isNull()
        | (F.col("start_s") - F.col("_pe") > SENTENCE_GAP)
        | X.sentence_end(F.col("_pt"))
    )


def _breaks(words: DataFrame, part: str | None = None) -> DataFrame:
    """Words plus ``brk``, with their block."""
    cols = {"_pe": "end_s", "_pt": "text"}
    if part:
        cols["_pp"] = part
    w = neighbours(words, "video_id", "idx", prev=cols, keep=True)
    brk = _break()
    if part:
        brk = brk | (F.col("_pp") != F.col(part))
    return w.withColumn("brk", brk).drop(*cols)


def chapter_sentence_starts(words: DataFrame, part: str | None = None, keep: bool = False) -> DataFrame:
    """Words plus ``grp``: breaks restart a count that also cuts every 35 words."""
    w = running(
        _breaks(words, part),
        "video_id",
        "idx",
        {"_island": ("max", F.expr("CASE WHEN brk THEN idx END"))},
        keep=keep,
    )
    return w.withColumn(
        "grp", F.expr(f"_island + ((idx - _island) div {SENTENCE_WORDS}) * {SENTENCE_WORDS}")
    ).drop("_island", "brk")


def in_blocks(grouped: DataFrame, keys: tuple[str, ...], **more: Column) -> DataFrame:
    """Words with ``grp`` and ``_blk`` as one row a group and block, made where the words lie.

    ``idx`` and ``start_s`` are those of the first word, ``end_s`` of the last, texts are joined; ``more``
    are further aggregates.  What is joined across blocks is these rows, not words.
    """
    return grouped.groupBy(*keys, "_blk").agg(
        F.min("idx").alias("_first"),
        F.min_by("start_s", "idx").alias("start_s"),
        F.max_by("end_s", "idx").alias("end_s"),
        F.when(F.count("text") > 0, join_texts("idx", "text")).alias("text"),
        *[column.alias(name) for name, column in more.items()],
    ).withColumnRenamed("_first", "idx")


def sentence_table(grouped: DataFrame, keys: tuple[str, ...] = ("video_id", "grp")) -> DataFrame:
    return grouped.groupBy(*keys).agg(
        F.min_by("start_s", "idx").alias("s_start"),
        F.max_by("end_s", "idx").alias("s_end"),
        join_texts("idx", "text").alias("s_text"),
        F.count(F.lit(1)).alias("n_words"),
    )


def chapter_sentences(words: DataFrame) -> DataFrame:
    return sentence_table(chapter_sentence_starts(words))


def sentence_starts(words: DataFrame) -> DataFrame:
    """Words plus ``grp`` for subtitle sentences.

    A run that reaches 35 words without a sentence end is cut at its longest pause among the
    last ten words and the rest carries on, so where a cut falls depends on the cut before it.
    """
    n, lo = SENTENCE_WORDS, SENTENCE_WORDS - CUT_WINDOW
    ahead = windowed(
        words,
        "video_id",
        "idx",
        {
            "_pe": lambda w: F.lag("end_s").over(w),
            "_pt": lambda w: F.lag("text").over(w),
            "brk": lambda w: _break(),
            "_end": lambda w: X.sentence_end(F.col("text")),
            "_gap": lambda w: F.col("start_s") - F.col("_pe"),
            "_last": lambda w: F.lead("idx", n - 1).over(w),
            "_last_end": lambda w: F.lead("_end", n - 1).over(w),
            "_gaps": lambda w: F.collect_list("_gap").over(w.rowsBetween(lo, n - 1)),
            "_end_idx": lambda w: F.max("idx").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            # first unavoidable break among the next 35 words; ``idx`` is dense, so its distance tells the rest
            "_next": lambda w: F.min(F.when(F.col("brk"), F.col("idx"))).over(w.rowsBetween(1, n)),
        },
        before=1,
        after=n,
    )
    free = F.col("_next").isNull() | (F.col("_next") == F.col("idx") + n)
    forced = free & F.col("_last").isNotNull() & ~F.col("_last_end")
    cut = F.col("idx") + lo + F.array_position("_gaps", F.array_max("_gaps")) - 1
    nodes = ahead.select(
        "video_id",
        "idx",
        F.when(forced, cut).otherwise(F.coalesce("_next", F.least(F.col("_end_idx"), F.col("idx") + n) + 1)).alias("nxt"),
        F.col("brk").alias("root"),
    )
    return group_starts(words, "video_id", "idx", nodes)


def number_sentences(table: DataFrame) -> DataFrame:
    """``no`` = 1, 2, … per video."""
    return numbered(
        table, "video_id", F.expr(f"grp div {BLOCK}"), [F.col("grp")], out="no", start=1
    )


def sentences(words: DataFrame) -> DataFrame:
    """Numbered subtitle sentences with a content key."""
    return number_sentences(sentence_table(sentence_starts(words))).withColumn(
        "sentence_key", sentence_key(F.col("s_start"), F.col("s_end"), F.col("s_text"))
    )


def millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def sentence_key(start: Column, end: Column, text: Column) -> Column:
    """Equal content, equal key; built from whole milliseconds."""
    raw = F.concat_ws("|", millis(start).cast("string"), millis(end).cast("string"), text)
    return F.concat(F.lit("s-"), F.substring(F.sha1(raw), 1, 12))


def breath_points(grouped: DataFrame) -> DataFrame:
    """Numbered pauses inside sentences; a point never repeats an earlier time.

    ``grouped`` is words with ``grp``; a sentence has at most 44 words.
    """
    w = Window.partitionBy("video_id", "grp").orderBy("idx")
    gap = F.col("start_s") - F.lag("end_s").over(w)
    marked = grouped.withColumn("_gap", gap).withColumn(
        "_breath",
        F.col("_gap").isNotNull()
        & ((F.col("_gap") >= BREATH_GAP) | F.lag("text").over(w).rlike("[,;:]\\s*$")),
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = marked.withColumn(
        "_seen", F.max(F.when(F.col("_breath"), F.col("start_s"))).over(before)
    ).filter(F.col("_breath") & (F.col("_seen").isNull() | (F.col("start_s") > F.col("_seen"))))
    return kept.select(
        "video_id",
        "grp",
        F.col("idx").alias("breath_idx"),
        F.row_number().over(w).alias("k"),
        F.col("start_s").alias("breath_at"),
    )


def marked_text(grouped: DataFrame) -> DataFrame:
    """Sentence text with ``^k`` before the word at breath point k."""
    points = breath_points(grouped).withColumnRenamed("breath_idx", "idx").drop("breath_at")
    w = grouped.join(points, ["video_id", "grp", "idx"], "left").withColumn(
        "_shown",
        F.when(F.col("k").isNotNull(), F.concat(F.lit("^"), F.col("k"), F.lit(" "), F.col("text"))).otherwise(
            F.col("text")
        ),
    )
    return w.groupBy("video_id", "grp").agg(join_texts("idx", "_shown").alias("marked"))


def _first_over(value: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Per i the first j > i with value[j] > threshold[i]."""
    n = len(value)
    top = np.maximum.accumulate(value)
    out = np.searchsorted(top, threshold, side="right")
    for i in np.flatnonzero(out <= np.arange(n)):  # an earlier value hides the answer
        later = np.flatnonzero(value[i + 1 :] > threshold[i])
        out[i] = i + 1 + later[0] if len(later) else n
    return out


def _span_limit(pdf: pd.DataFrame, after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    end = pdf["end_s"].to_numpy(float)
    start = pdf["start_s"].to_numpy(float)
    out = after.copy()
    for lo, hi in zip(starts, np.append(starts[1:], len(end))):
        out[lo:hi] = lo + _first_over(end[lo:hi], start[lo:hi] + SPAN_SECS)
    # the rule subtracts instead; redo the rows where that rounds to another answer
    here = np.arange(len(end))
    early = np.clip(out - 1, 0, len(end) - 1)
    late = np.clip(out, 0, len(end) - 1)
    redo = ((early > here) & (end[early] - start > SPAN_SECS)) | (
        (out < after) & ~(end[late] - start > SPAN_SECS)
    )
    for i in np.flatnonzero(redo):
        later = np.flatnonzero(end[i + 1 : after[i]] - start[i] > SPAN_SECS)
        out[i] = i + 1 + later[0] if len(later) else after[i]
    return out


def span_starts(words: DataFrame, keep: bool = False) -> DataFrame:
    """Words plus ``grp``: silence over 2.5 s, more than 30 s, or another speaker."""
    who = F.coalesce("speaker_global", "speaker")
    w = neighbours(
        words.withColumn("_who", who), "video_id", "idx", prev={"_pe": "end_s", "_pw": "_who"}
    )
    root = (
        F.col("_pe").isNull()
        | (F.col("start_s") - F.col("_pe") > SPAN_GAP)
        | ~F.col("_who").eqNullSafe(F.col("_pw"))
    )
    marked = w.withColumn("_root", root)
    nodes = time_nodes(
        marked, "video_id", "idx", "start_s", "_root", ["start_s", "end_s"],
        SPAN_SECS + SPAN_GAP, _span_limit,
    )
    return group_starts(words, "video_id", "idx", nodes, keep=keep)


def spans(words: DataFrame) -> DataFrame:
    """Search spans with the weakest speaker status of their words."""
    status = F.coalesce("speaker_status", F.lit("unresolved"))
    who = F.coalesce("speaker_global", "speaker")
    rank = F.when(status == "unresolved", 2).when(status == "inferred", 1).otherwise(0)
    spoken = words.select("video_id", "idx", "text", "start_s", "end_s", who.alias("speaker"), who.alias("speaker_global"), rank.alias("_rank"))
    pieces = in_blocks(
        span_starts(spoken, keep=True), ("video_id", "grp"), speaker_candidate=F.min_by("speaker", "idx"), _rank=F.max("_rank")
    )
    agg = pieces.groupBy("video_id", "grp").agg(
        F.min_by("start_s", "idx").alias("start_s"),
        F.max_by("end_s", "idx").alias("end_s"),
        join_texts("idx", "text").alias("text"),
        F.min_by("speaker_candidate", "idx").alias("speaker_candidate"),
        F.when(F.max("_rank") == 2, "unresolved")
        .when(F.max("_rank") == 1, "inferred")
        .otherwise("confirmed")
        .alias("speaker_status"),
    )
    return agg.select(
        "video_id",
        F.col("grp").alias("span_idx"),
        "start_s",
        "end_s",
        "text",
        F.when(F.col("speaker_status") != "unresolved", F.col("speaker_candidate")).alias("speaker"),
        "speaker_candidate",
        "speaker_status",
        X.speaker_confidence(F.col("speaker_status")).alias("speaker_confidence"),
        F.lit(1.0).alias("confidence"),
    )


def _cue_limit(width: int):
    def limit(pdf: pd.DataFrame, after: np.ndarray, _: np.ndarray) -> np.ndarray:
        start = pdf["start_s"].to_list()
        end = pdf["end_s"].to_list()
        size = pdf["_len"].to_list()
        n = len(start)
        out = np.full(n, n)
        for i in range(n):
            lines, room = 1, size[i]
            for j in range(i + 1, int(after[i])):
                if room + 1 + size[j] > width:
                    lines, room = lines + 1, size[j]
                else:
                    room += 1 + size[j]
                if lines > CUE_LINES or end[j] - start[i] > CUE_SECS:
                    out[i] = j
                    break
        return out

    return limit


def cue_starts(words: DataFrame, width: int = 20) -> DataFrame:
    """Words plus ``grp`` for rendered cues: speaker, pause, 7 s, two lines of ``width``."""
    if width < 1:
        raise ValueError("width must be at least 1")
    w = neighbours(words, "video_id", "idx", prev={"_pe": "end_s", "_pw": "speaker", "_pi": "idx"})
    root = (
        F.col("_pi").isNull()
        | ~F.col("speaker").eqNullSafe(F.col("_pw"))
        | (F.col("start_s") - F.col("_pe") > CUE_GAP)
    )
    marked = w.withColumn("_root", root).withColumn("_len", F.length(X.trim_ws(F.col("text"))))
    nodes = time_nodes(
        marked, "video_id", "idx", "start_s", "_root", ["start_s", "end_s", "_len"],
        CUE_SECS + CUE_GAP, _cue_limit(width),
    )
    return group_starts(words, "video_id", "idx", nodes)


def wrap(tokens: Column, width: int) -> Column:
    """Greedy line wrap of a token array; a token is never cut."""
    return F.aggregate(
        tokens,
        F.expr("cast(array() as array<string>)"),
        lambda acc, t: F.when(
            (F.size(acc) > 0)
            & (F.length(F.element_at(acc, -1)) + 1 + F.length(t) <= width),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.concat(F.element_at(acc, -1), F.lit(" "), t)),
            ),
        ).otherwise(F.concat(acc, F.array(t))),
    )


def cues(words: DataFrame, width: int = 20) -> DataFrame:
    """Rendered cues, numbered from 1 per video."""
    toks = F.array_sort(F.collect_list(F.struct("idx", X.trim_ws(F.col("text")).alias("t")))).getField("t")
    agg = cue_starts(words, width).groupBy("video_id", "grp").agg(
        F.min_by("start_s", "idx").alias("c_start"),
        F.max_by("end_s", "idx").alias("c_end"),
        toks.alias("_toks"),
        F.count(F.lit(1)).alias("n_words"),
    )
    return number_sentences(agg).select(
        "video_id",
        "grp",
        F.col("no").alias("cue_no"),
        "c_start",
        "c_end",
        F.array_join(wrap(F.col("_toks"), width), "\n").alias("lines"),
        F.array_join("_toks", " ").alias("plain"),
        "n_words",
    )


def srt_blocks_text(cue_table: DataFrame) -> DataFrame:
    """One SRT block per cue, ready to be written in ``cue_no`` order."""
    return cue_table.select(
        "video_id",
        "cue_no",
        F.concat_ws(
            "\n",
            F.col("cue_no").cast("string"),
            F.concat_ws(" --> ", X.srt_time(F.col("c_start")), X.srt_time(F.col("c_end"))),
            F.col("lines"),
        ).alias("block"),
        "plain",
    )


def retention(words: DataFrame, cue_table: DataFrame) -> DataFrame:
    """Videos whose rendered cues hold another number of words than the transcript."""
    have = words.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_input"))
    shown = cue_table.groupBy("video_id").agg(F.sum("n_words").alias("n_rendered"))
    return have.join(shown, "video_id", "left").select(
        "video_id",
        "n_input",
        F.coalesce("n_rendered", F.lit(0)).alias("n_rendered"),
        (F.col("n_input") == F.coalesce("n_rendered", F.lit(0))).alias("complete"),
    )
