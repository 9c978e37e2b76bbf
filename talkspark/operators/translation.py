"""Translated subtitles: packing, answer checks, flags, progress, reports, display rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.functions import text as X
from talkspark.functions.ordered import map_groups, neighbours, orbit, running, windowed
from talkspark.operators.joins import interval_join
from talkspark.operators.patterns import contains_join
from talkspark.operators.terms import mentions

READ_CPS = 13
SLACK_CHARS = 3
MIN_CUE = 1.5
BATCH_CHARS = 5000
BATCH_GAP = 2.0
MAX_REJECTS = 2
HANGUL_SHARE = 0.30
BREAK = "(?<!\\S)/(\\+\\d+(?:\\.\\d+)?|\\d+)(?!\\S)"


# --- reading answers ------------------------------------------------------------------------


def clean_line(raw: Column) -> Column:
    """A reply line without list marks, bold, code marks and table bars; null for rules and fences."""
    line = X.trim_ws(raw)
    skip = (line == "") | line.rlike("^`{3,}") | (line.contains("-") & line.rlike("^\\|?[\\s:|-]+\\|?$"))
    body = X.trim_ws(F.regexp_replace(line, "^(?:[-*•]|\\d+\\.)\\s+", ""))
    body = X.trim_ws(F.replace(body, F.lit("**"), F.lit("")))
    body = X.trim_ws(F.regexp_replace(body, "^`+|`+$", ""))
    body = X.trim_ws(F.regexp_replace(F.regexp_replace(body, "^\\|", ""), "\\|$", ""))
    return F.when(~skip, body)


def numbered_lines(replies: DataFrame) -> DataFrame:
    """``<no>|text`` lines of reply texts; a repeated number keeps its last line."""
    lines = replies.select(
        *[c for c in replies.columns if c != "reply"], F.posexplode(F.split("reply", "\\r\\n|\\r|\\n")).alias("_p", "_raw")
    ).withColumn("_line", clean_line(F.col("_raw")))
    keep = [c for c in replies.columns if c != "reply"]
    found = lines.filter(F.col("_line").rlike("^\\d+\\s*\\|")).select(
        *keep,
        "_p",
        F.regexp_extract("_line", "^(\\d+)\\s*\\|\\s*(.*)$", 1).cast("long").alias("no"),
        F.regexp_extract("_line", "^(\\d+)\\s*\\|\\s*(.*)$", 2).alias("rest"),
    )
    return found.groupBy(*keep, "no").agg(F.max_by("rest", "_p").alias("rest"))


def term_lines(replies: DataFrame) -> DataFrame:
    """Glossary replies: term lines, skip lines and lines that are neither."""
    keep = [c for c in replies.columns if c != "reply"]
    lines = replies.select(
        *keep, F.posexplode(F.split("reply", "\\r\\n|\\r|\\n")).alias("line_no", "_raw")
    ).withColumn("line", clean_line(F.col("_raw"))).filter("line <> ''")
    term = F.col("line").rlike("^T\\d+\\s*\\|")
    skip = F.col("line").rlike("^[SC]\\d+\\s*\\|\\s*-\\s*$")
    return lines.select(
        *keep,
        "line_no",
        F.when(term, "term").when(skip, "skip").otherwise("unmatched").alias("kind"),
        F.when(term | skip, F.regexp_extract("line", "^([TSC]\\d+)", 1)).otherwise(F.col("line")).alias("item"),
        F.when(
            term,
            F.transform(F.split(F.regexp_replace("line", "^T\\d+\\s*\\|\\s*", ""), "\\|"), X.trim_ws),
        ).alias("fields"),
    )


# --- packing --------------------------------------------------------------------------------


def _batch_nodes(keys: list[str]):
    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        n = len(pdf)
        idx = pdf["idx"].to_numpy(np.int64)
        size = pdf["size"].to_numpy(np.int64)
        natural = pdf["natural"].to_numpy(bool)
        home = pdf["home"].to_numpy(bool)
        upto = np.cumsum(size)
        rows = []
        for lo, hi in zip(starts, np.append(starts[1:], n)):
            for i in range(lo, hi):
                if not home[i]:
                    continue
                base = upto[i] - size[i]
                full = lo + np.searchsorted(upto[lo:hi], base + BATCH_CHARS, side="right")
                full = max(int(full), i + 1)
                half = lo + np.searchsorted(upto[lo:hi], base + BATCH_CHARS * 0.5, side="left")
                stops = np.flatnonzero(natural[max(half, i + 1) : full])
                end = max(half, i + 1) + stops[0] + 1 if len(stops) else full
                rows.append((i, idx[end] if end < hi else idx[hi - 1] + 1))
        pick = [r[0] for r in rows]
        out = pdf.iloc[pick][[*keys, "idx"]].copy()
        out["nxt"] = [r[1] for r in rows]
        out["root"] = out["idx"] == 0
        return out

    return run


def batches(unsaved: DataFrame, chapters: DataFrame) -> DataFrame:
    """Untranslated sentences packed into batches of at most 5,000 characters.

    A batch that is half full ends after a sentence that follows a pause of 2 s or opens a
    chapter.  ``unsaved(video_id, idx from 0, no, s_start, s_end, s_text)``;
    ``chapters(video_id, c_start)``.  Returns ``batch`` = index of the batch's first sentence.
    """
    w = neighbours(unsaved, "video_id", "idx", prev={"_pe": "s_end"})
    opens = interval_join(
        unsaved.select("video_id", "idx", "s_start"),
        chapters.select("video_id", "c_start"),
        "video_id",
        (F.col("s_start") - 0.05, F.col("s_start") + 0.05),
        (F.col("c_start"), F.col("c_start")),
        60.0,
    ).filter(F.abs(F.col("s_start") - F.col("c_start")) < 0.05).select("video_id", "idx").distinct().withColumn(
        "_open", F.lit(True)
    )
    marked = w.join(opens, ["video_id", "idx"], "left").select(
        "video_id",
        F.col("idx").cast("long").alias("idx"),
        F.length("s_text").cast("long").alias("size"),
        F.coalesce((F.col("s_start") - F.col("_pe") >= BATCH_GAP) | F.col("_open"), F.lit(False)).alias("natural"),
    )
    # no sentence is empty, so a batch never reaches past the next block
    block = BATCH_CHARS + 1
    blk = F.expr(f"idx div {block}")
    copied = marked.withColumn(
        "_b", F.explode(F.array_compact(F.array(blk, F.when(blk > 0, blk - 1))))
    ).withColumn("home", F.col("_b") == blk)
    shape = T.StructType(
        [
            marked.schema["video_id"],
            T.StructField("idx", T.LongType()),
            T.StructField("nxt", T.LongType()),
            T.StructField("root", T.BooleanType()),
        ]
    )
    nodes = map_groups(copied, ["video_id", "_b"], "idx", _batch_nodes(["video_id"]), shape)
    starts = orbit(nodes, "video_id").withColumn("_on", F.lit(True))
    flagged = unsaved.join(starts, ["video_id", "idx"], "left")
    return running(
        flagged, "video_id", "idx", {"batch": ("max", F.expr("CASE WHEN _on THEN idx END"))}
    ).drop("_on")


def context(sentences: DataFrame, before: int = 4, after: int = 0) -> DataFrame:
    """Neighbouring sentences of every sentence: ``near`` = texts with their numbers in order.

    Four before a batch; two on both sides for review.
    """
    shown = F.struct("no", "s_text")
    outs = {"_b": lambda w: F.collect_list(shown).over(w.rowsBetween(-before, -1))}
    if after:
        outs["_a"] = lambda w: F.collect_list(shown).over(w.rowsBetween(1, after))
    w = windowed(sentences.withColumn("_i", F.col("no") - 1), "video_id", "_i", outs, before=before, after=after)
    near = F.concat("_b", "_a") if after else F.col("_b")
    return w.select("video_id", "no", near.alias("near"))


# --- merge chains and line checks -----------------------------------------------------------


def chains(sentences: DataFrame, answers: DataFrame, stored: DataFrame) -> DataFrame:
    """Every sentence with its merge state.

    ``=`` joins the number before it when that one is answered too or already stored; chains run
    over consecutive numbers.  A stored merge holds until its number is answered again.
    ``stored(video_id, no, state, merged_into_no)``.
    """
    rows = (
        sentences.select("video_id", "no", "s_start", "s_end", "s_text", "sentence_key", "grp")
        .join(answers.select("video_id", "no", "rest"), ["video_id", "no"], "left")
        .join(stored.select("video_id", "no", "state", "merged_into_no"), ["video_id", "no"], "left")
        .withColumn("_i", F.col("no") - 1)
        .withColumn("_usable", F.col("rest").isNotNull() | F.coalesce(F.col("state").isin("ok", "flagged"), F.lit(False)))
    )
    rows = neighbours(rows, "video_id", "_i", prev={"_pu": "_usable"})
    wants = F.coalesce(X.trim_ws(F.col("rest")) == "=", F.lit(False))
    joined = (wants & F.coalesce("_pu", F.lit(False))) | (
        F.col("rest").isNull() & F.coalesce(F.col("merged_into_no") == F.col("no") - 1, F.lit(False))
    )
    rows = rows.withColumn("wants_merge", wants).withColumn("merged", joined)
    rows = running(rows, "video_id", "_i", {"root_no": ("max", F.when(~F.col("merged"), F.col("no")))})
    return rows.drop("_i", "_usable", "_pu")


def chain_ends(chained: DataFrame) -> DataFrame:
    return chained.groupBy("video_id", "root_no").agg(
        F.max("no").alias("last_no"), F.max_by("s_end", "no").alias("final_end")
    )


def pace_over(segment: Column, seconds: Column, sentence_seconds: Column) -> Column:
    chars = F.length(F.regexp_replace(segment, "\\s+", ""))
    return (
        (sentence_seconds >= MIN_CUE)
        & (seconds > 0)
        & (chars > seconds * READ_CPS * 1.2 + SLACK_CHARS)
    )


def check_lines(chained: DataFrame, breaths: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, segments) for all answered sentences.

    ``lines`` holds the stored translation with flags, or ``rule`` = why it is refused; merge
    lines point to their root.  ``breaths(video_id, no, k, breath_at)``; ``glossary(video_id,
    form, tgt, status)`` with one row per source or heard form.
    """
    key = ["video_id", "no"]
    ends = chain_ends(chained)
    rest = F.rtrim("rest")
    unsure = rest.endswith(" ?") | (rest == "?")
    body = F.when(unsure, F.rtrim(rest.substr(F.lit(1), F.length(rest) - 1))).otherwise(F.col("rest"))
    own = (
        chained.filter("rest is not null and not wants_merge")
        .drop("root_no")
        .join(ends.withColumnRenamed("root_no", "no"), key)
        .select(
            *key, "s_start", "s_end", "s_text", "sentence_key", "last_no", "final_end",
            unsure.alias("unsure"),
            F.transform(F.split(body, BREAK, -1), X.trim_ws).alias("segs"),
            F.regexp_extract_all(body, F.lit(BREAK), F.lit(1)).alias("breaks"),
        )
        .withColumn("ko", F.array_join(F.filter("segs", lambda s: s != ""), " "))
    )
    plus = F.col("tok").startswith("+")
    tokens = own.select(*key, "s_start", "last_no", F.posexplode("breaks").alias("p", "tok")).select(
        *key, "s_start", "last_no", "p", plus.alias("plus"),
        F.when(plus, F.regexp_extract("tok", "^\\+(\\d+)", 1).cast("long")).otherwise(F.lit(0)).alias("n"),
        F.when(plus, F.nullif(F.regexp_extract("tok", "\\.(\\d+)$", 1), F.lit("")).cast("long"))
        .otherwise(F.col("tok").cast("long"))
        .alias("k"),
    )
    target = tokens.withColumn("t_no", F.col("no") + F.col("n"))
    starts = chained.select("video_id", F.col("no").alias("t_no"), F.col("s_start").alias("t_start"))
    points = breaths.select("video_id", F.col("no").alias("t_no"), "k", "breath_at")
    placed = (
        target.join(starts, ["video_id", "t_no"], "left")
        .join(points, ["video_id", "t_no", "k"], "left")
        .withColumn("at_s", F.when(F.col("k").isNull(), F.col("t_start")).otherwise(F.col("breath_at")))
    )
    order = Window.partitionBy(*key).orderBy("p")
    bad = (
        F.when(F.col("plus") & ((F.col("n") < 1) | (F.col("t_no") > F.col("last_no"))), "merge out of range")
        .when(F.col("at_s").isNull(), "breath out of range")
        .when(F.col("at_s") <= F.coalesce(F.lag("at_s").over(order), F.col("s_start")), "breaths not increasing")
    )
    resolved = placed.withColumn("bad", bad).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("p", "at_s"))).getField("at_s").alias("times"),
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("p"))).alias("break_rule"),
    )
    confirmed = glossary.filter("status <> 'uncertain'").select("video_id", "form", "tgt")
    named = mentions(own.select(*key, "s_text"), confirmed).join(own.select(*key, "ko"), key).filter(
        ~F.contains("ko", "tgt")
    ).select(*key).distinct().withColumn("_terms", F.lit(True))
    none = F.expr("cast(array() as array<double>)")
    full = (
        own.join(resolved, key, "left")
        .join(named, key, "left")
        .withColumn("times", F.coalesce("times", none))
        .withColumn("edges", F.concat(F.array("s_start"), F.col("times"), F.array("final_end")))
        .withColumn("secs", F.col("final_end") - F.col("s_start"))
    )
    pieces = F.transform(
        "segs",
        lambda s, i: F.struct(
            i.alias("seg_no"), s.alias("seg_text"), F.get("edges", i).alias("seg_start"),
            F.get("edges", i + 1).alias("seg_end"),
        ),
    )
    full = full.withColumn("pieces", pieces)
    fast = F.exists(
        "pieces", lambda x: pace_over(x["seg_text"], x["seg_end"] - x["seg_start"], F.col("secs"))
    )
    lost = F.size(F.array_except(X.numbers(F.col("s_text")), X.numbers(F.col("ko")))) > 0
    flags = F.array_compact(
        F.array(
            F.when(lost, "numbers"),
            F.when(F.col("_terms"), "terms"),
            F.when(fast, "pace"),
            F.when(F.col("unsure"), "uncertain"),
        )
    )
    rule = (
        F.when(F.col("ko") == "", "empty")
        .when(F.col("break_rule").isNotNull(), F.col("break_rule"))
        .when(X.hangul_share(F.col("ko")) < HANGUL_SHARE, "too little hangul")
    )
    checked = full.withColumn("rule", rule).withColumn("flags", flags)
    good = F.col("rule").isNull()
    lines = checked.select(
        *key, "sentence_key",
        F.when(good, F.col("ko")).alias("ko"),
        F.when(good, F.col("breaks")).alias("breaks"),
        F.when(good, F.col("flags")).alias("flags"),
        F.when(good, F.when(F.size("flags") > 0, "flagged").otherwise("ok")).alias("state"),
        "rule",
        F.lit(None).cast("long").alias("merged_into_no"),
    )
    absorbed = chained.filter("wants_merge").select(
        *key, "sentence_key",
        F.lit(None).cast("string").alias("ko"),
        F.when(F.col("merged"), F.expr("cast(array() as array<string>)")).alias("breaks"),
        F.when(F.col("merged"), F.expr("cast(array() as array<string>)")).alias("flags"),
        F.when(F.col("merged"), "ok").alias("state"),
        F.when(~F.col("merged"), "nothing to merge into").alias("rule"),
        F.when(F.col("merged"), F.col("no") - 1).alias("merged_into_no"),
    )
    segments = checked.filter(good).select(*key, "sentence_key", F.explode("pieces").alias("x")).select(
        *key, "sentence_key", "x.*"
    )
    return lines.unionByName(absorbed), segments


def reject_states(history: DataFrame) -> DataFrame:
    """Refusals since the last accepted answer; at two the line stays untranslated.

    ``history(video_id, no, seq, accepted)``.
    """
    key = ["video_id", "no"]
    last = history.filter("accepted").groupBy(*key).agg(F.max("seq").alias("_ok"))
    counted = (
        history.join(last, key, "left")
        .groupBy(*key)
        .agg(
            F.count_if(~F.col("accepted") & (F.col("_ok").isNull() | (F.col("seq") > F.col("_ok")))).alias("rejects"),
            F.max("_ok").isNotNull().alias("has_answer"),
        )
    )
    return counted.withColumn(
        "state",
        F.when(F.col("rejects") >= MAX_REJECTS, "untranslated").when(F.col("has_answer"), "ok").otherwise("open"),
    ).drop("has_answer")


# --- whole-talk checks ----------------------------------------------------------------------


def inconsistent_terms(terms: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences that contain a source term with more than one translation."""
    torn = terms.groupBy("video_id", "src").agg(F.count_distinct("tgt").alias("n")).filter("n > 1")
    return contains_join(
        sentences.select("video_id", "no", "s_text"), torn.select("video_id", "src"), ["video_id"], "s_text", "src",
        ignore_case=False,
    ).select("video_id", "no").distinct()


def style_minority(lines: DataFrame) -> DataFrame:
    """Lines whose sentence ending belongs to the smaller of the two politeness styles."""
    styled = lines.filter("state in ('ok', 'flagged') and ko is not null").withColumn(
        "style", X.speech_style(F.col("ko"))
    ).filter("style is not null")
    counts = styled.groupBy("video_id").agg(
        F.count_if(F.col("style") == "formal").alias("f"), F.count_if(F.col("style") == "informal").alias("i")
    )
    minority = counts.filter("f > 0 and i > 0 and f <> i").select(
        "video_id", F.when(F.col("i") < F.col("f"), "informal").otherwise("formal").alias("style")
    )
    return styled.join(minority, ["video_id", "style"]).select("video_id", "no", "style")


def reevaluate(lines: DataFrame, segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Pace and style flags of stored lines under the current rules; others are kept.

    ``spans(video_id, no, secs)`` is the length up to the end of the line's merge chain.
    """
    key = ["video_id", "no"]
    fast = (
        segments.join(spans, key)
        .filter(pace_over(F.col("seg_text"), F.col("seg_end") - F.col("seg_start"), F.col("secs")))
        .select(*key)
        .distinct()
        .withColumn("_fast", F.lit(True))
    )
    minority = style_minority(lines).select(*key, F.lit(True).alias("_style"))
    out = lines.filter("state in ('ok', 'flagged')").join(fast, key, "left").join(minority, key, "left")
    flags = F.concat(
        F.filter("flags", lambda f: ~f.isin("pace", "style")),
        F.array_compact(F.array(F.when(F.col("_fast"), "pace"), F.when(F.col("_style"), "style"))),
    )
    return (
        out.withColumn("flags", flags)
        .withColumn("state", F.when(F.size("flags") > 0, "flagged").otherwise("ok"))
        .drop("_fast", "_style")
    )


def progress(sentences: DataFrame, lines: DataFrame, videos: DataFrame) -> DataFrame:
    """Counts per state and the phase the work is in.

    ``lines(video_id, sentence_key, state, reviewed)``; ``videos(video_id, terms_done,
    consistency_done)``.  Lines whose key is gone do not count.
    """
    s = F.col("state")
    counts = (
        sentences.select("video_id", "sentence_key")
        .join(lines.select("video_id", "sentence_key", "state", "reviewed"), ["video_id", "sentence_key"], "left")
        .groupBy("video_id")
        .agg(
            F.count(F.lit(1)).alias("sentences"),
            F.count_if(s.isin("ok", "flagged")).alias("translated"),
            F.count_if(s == "flagged").alias("flagged"),
            F.count_if(s == "untranslated").alias("untranslated"),
            F.count("state").alias("_have"),
            F.count_if((s == "flagged") & ~F.coalesce("reviewed", F.lit(False))).alias("_open"),
        )
    )
    phase = (
        F.when(~F.col("terms_done"), "terms")
        .when(F.col("_have") < F.col("sentences"), "translate")
        .when(~F.col("consistency_done") | (F.col("_open") > 0), "review")
        .otherwise("done")
    )
    return counts.join(videos, "video_id").select(
        "video_id", "sentences", "translated", "flagged", "untranslated", phase.alias("phase")
    )


def corrections(terms: DataFrame, suspects: DataFrame) -> DataFrame:
    """Terms that really correct a mis-hearing: more than case, spacing, marks or a plural s."""
    cited = terms.select("video_id", "src", F.posexplode("evidence").alias("p", "e")).filter("e like 'S%'")
    first = cited.groupBy("video_id", "src").agg(F.min_by("e", "p").alias("suspect_id"))
    return first.join(suspects.select("video_id", "suspect_id", "heard"), ["video_id", "suspect_id"]).filter(
        X.cosmetic_key(F.col("heard")) != X.cosmetic_key(F.col("src"))
    )


def report(
    videos: DataFrame, lines: DataFrame, terms: DataFrame, suspects: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Quality figures per video."""

    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("video_id").agg(F.count(F.lit(1)).alias(out))

    line_stats = lines.groupBy("video_id").agg(
        F.count_if(F.array_contains("flags", "pace")).alias("_paced"),
        F.count_if(F.col("state").isin("ok", "flagged")).alias("_done"),
        F.count_if(F.col("state") == "untranslated").alias("untranslated"),
    )
    out = videos.select("video_id").join(line_stats, "video_id", "left")
    for df, name in (
        (terms, "terms_count"),
        (terms.filter("status = 'uncertain'"), "uncertain"),
        (corrections(terms, suspects), "corrections"),
        (suspects.select("video_id").unionAll(candidates.select("video_id")), "_evidence"),
    ):
        out = out.join(count(df, name), "video_id", "left")
    zero = F.lit(0)
    return out.select(
        "video_id",
        *[F.coalesce(c, zero).alias(c) for c in ("terms_count", "uncertain", "corrections", "untranslated")],
        F.round(F.coalesce(F.when(F.col("_done") > 0, F.col("_paced") / F.col("_done")), F.lit(0.0)), 4).alias("speed_over_ratio"),
        ((F.coalesce("terms_count", zero) == 0) & (F.coalesce("_evidence", zero) > 0)).alias("no_terms_warning"),
    )


# --- display --------------------------------------------------------------------------------


def viewer_rows(sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """Sentences with their stored translation by content key; pending where there is none."""
    joined = sentences.join(
        lines.select("video_id", "sentence_key", "ko", "state", "flags", "merged_into"), ["video_id", "sentence_key"], "left"
    )
    merged = F.col("merged_into").isNotNull()
    lost = F.col("state") == "untranslated"
    shown = ~merged & ~F.coalesce(lost, F.lit(False)) & (F.coalesce("ko", F.lit("")) != "")
    return joined.select(
        "video_id", "no", "sentence_key", "s_text",
        F.when(shown, F.col("ko")).alias("ko"),
        F.when(merged, "ok").when(lost, "untranslated").when(shown, F.coalesce("state", F.lit("ok"))).otherwise("pending").alias("state"),
        F.when(F.col("state").isNotNull() & (merged | lost | shown), F.col("flags")).otherwise(F.expr("cast(array() as array<string>)")).alias("flags"),
        "merged_into",
    )


def orphans(sentences: DataFrame, lines: DataFrame) -> DataFrame:
    """Stored translations whose sentence no longer exists; hidden, never deleted."""
    return lines.join(sentences.select("video_id", "sentence_key"), ["video_id", "sentence_key"], "left_anti")


def joined_followers(rows: DataFrame) -> DataFrame:
    """Sentence texts with merged followers appended to their root; ``merged`` marks followers."""
    based = running(
        rows.withColumn("_i", F.col("no") - 1), "video_id", "_i",
        {"root_no": ("max", F.when(~F.col("merged"), F.col("no")))},
    )
    return based.groupBy("video_id", "root_no").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("no", "s_text"))).getField("s_text"), " ").alias("en"),
        F.min_by("ko", "no").alias("ko"),
    )


def filter_sentences(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Sentences containing a query in source or translation, followers joined first.

    ``queries(query_id, needle)``; an empty needle matches everything in the reader and is not
    joined here.
    """
    base = joined_followers(rows)
    both = base.select("video_id", "root_no", "en", F.explode(F.array("en", F.coalesce("ko", F.lit("")))).alias("_t"))
    asked = queries.withColumn("needle", X.trim_ws(F.col("needle"))).filter("needle <> ''")
    return contains_join(both, asked, [], "_t", "needle").select("query_id", "video_id", "root_no", "en").distinct()


def bilingual(cues: DataFrame, words: DataFrame) -> DataFrame:
    """Source words under each displayed cue, with a tolerance of a microsecond.

    ``cues(video_id, cue_id, d_start, d_end)``.
    """
    eps = 1e-6
    hits = interval_join(
        cues.select("video_id", "cue_id", "d_start", "d_end"),
        words.select("video_id", "idx", "text", "start_s", "end_s"),
        "video_id",
        (F.col("d_start"), F.col("d_end")),
        (F.col("start_s"), F.col("end_s")),
        30.0,
    ).filter((F.col("start_s") < F.col("d_end") - eps) & (F.col("end_s") > F.col("d_start") + eps))
    said = hits.groupBy("video_id", "cue_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("idx", "text"))).getField("text"), " ").alias("en")
    )
    return cues.join(said, ["video_id", "cue_id"], "left").withColumn("en", F.coalesce("en", F.lit("")))


def stretch_short(cues: DataFrame) -> DataFrame:
    """Cues under 1.5 s shown until just before the next one.

    ``cues(video_id, cue_idx dense, d_start, d_end)``.
    """
    w = neighbours(cues, "video_id", "cue_idx", nxt={"_ns": "d_start"})
    return w.withColumn(
        "d_end",
        F.when(
            (F.col("d_end") - F.col("d_start") < MIN_CUE) & F.col("_ns").isNotNull(),
            F.greatest(F.col("d_end"), F.col("_ns") - 0.01),
        ).otherwise(F.col("d_end")),
    ).drop("_ns")
