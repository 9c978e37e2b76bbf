"""Suspected mis-hearings, term candidates and glossary submissions."""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.functions.ordered import numbered
from talkspark.operators.joins import asof_last, interval_join
from talkspark.operators.patterns import contains_join

#: Seconds; a cue and the words around it take a few, and all words and cues of a bucket are held against each other.
CUE_BUCKET = 10.0
MIN_RATIO = 0.55
SLIDE_RATIO = 0.8
MIN_TOKEN = 4
MAX_SHAPED = 60
MAX_CANDIDATES = 120
SHORT_CHARS = 16
NOTE_CHARS = 50


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two short strings, Arrow batches."""
    return pd.Series([_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])


def _ratio_from(a: str, b: str, low: float) -> float | None:
    """The ratio, or nothing where the characters that both hold cannot make it ``low``."""
    shared = sum(min(a.count(c), b.count(c)) for c in set(a))
    return _ratio(a, b) if a == b or 2.0 * shared / (len(a) + len(b)) >= low else None


def similarity_from(a: Column, b: Column, low: float) -> Column:
    """``similarity`` of the pairs that reach ``low``; of others it may be null."""

    @F.pandas_udf(DoubleType())
    def bounded(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio_from(p, q, low) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return bounded(a, b)


def length_bound(a: Column, b: Column, ratio: float) -> Column:
    """No pair outside this can reach ``ratio``; never compares less."""
    return 2 * F.least(F.length(a), F.length(b)) >= F.lit(ratio) * (F.length(a) + F.length(b)) - 1e-9


def sentence_at(points: DataFrame, sentences: DataFrame, at: str, out: str = "sentence_no") -> DataFrame:
    """Sentence at a time: the first that contains it, else the last begun, else the first."""
    table = sentences.select("video_id", "s_start", "s_end", "no")
    holds = interval_join(
        points.select("video_id", at).distinct(),
        table,
        "video_id",
        (F.col(at), F.col(at)),
        (F.col("s_start"), F.col("s_end")),
        60.0,
    ).groupBy("video_id", at).agg(F.min("no").alias("_in"))
    begun = asof_last(points, table, "video_id", at, "s_start", ["no"], "_last")
    return (
        begun.join(holds, ["video_id", at], "left")
        .withColumn(out, F.coalesce("_in", "_last.no", F.lit(1).cast("long")))
        .drop("_in", "_last")
    )


def cue_windows(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Spoken words within half a second of each cue."""
    spoken = words.filter("coalesce(origin, 'gemini') = 'gemini'").select(
        "video_id", "idx", "text", "start_s", "end_s"
    )
    return interval_join(
        cues.select("video_id", "cue_idx", "cue_start", "cue_end", "cue_text"),
        spoken,
        "video_id",
        (F.col("cue_start") - 0.5, F.col("cue_end") + 0.5),
        (F.col("start_s"), F.col("end_s")),
        CUE_BUCKET,
    )


def suspects(words: DataFrame, cues: DataFrame) -> DataFrame:
    """Caption tokens that sound like, but are not, what was transcribed around them.

    Per cue the words of its few seconds form single and double candidates; only caption tokens
    heard nowhere in the window are compared, after a length test that loses nothing.  A token
    that stands among the words as it is has the same form too, so forms are made only of other
    tokens, and of the words around them.
    """
    w = cue_windows(words, cues).groupBy("video_id", "cue_idx").agg(
        F.first("cue_text").alias("cue_text"), F.sort_array(F.collect_list(F.struct("idx", "text", "start_s"))).alias("ws")
    )
    other = F.filter(
        F.transform(X.split_ws(F.col("cue_text")), lambda t, i: F.struct(i.alias("tok_no"), t.alias("raw"))),
        lambda t: ~F.array_contains("ws.text", t["raw"]),
    )
    # generated, not filtered by a condition, which would make the array twice
    w = w.select("video_id", "cue_idx", "ws", F.explode(F.filter(F.array(other), lambda ts: F.size(ts) > 0)).alias("toks"))
    formed = F.transform("ws", lambda x: F.struct(x["idx"].alias("idx"), x["text"].alias("text"), x["start_s"].alias("start_s"), X.compare_key(x["text"]).alias("norm")))
    tokens = F.transform("toks", lambda t: F.struct(t["tok_no"].alias("tok_no"), t["raw"].alias("raw"), X.compare_key(t["raw"]).alias("tnorm")))
    w = w.select("video_id", "cue_idx", formed.alias("ws"), F.explode(tokens).alias("tok")).filter(
        (F.length("tok.tnorm") >= MIN_TOKEN) & ~F.array_contains("ws.norm", F.col("tok.tnorm"))
    )
    single = F.transform(
        "ws", lambda x: F.struct(x["norm"].alias("cnorm"), x["text"].alias("shown"), x["start_s"].alias("t"))
    )
    double = F.transform(
        F.slice("ws", F.lit(1), F.size("ws") - 1),
        lambda x, i: F.struct(
            F.concat(x["norm"], F.get("ws", i + 1)["norm"]).alias("cnorm"),
            F.concat_ws(" ", x["text"], F.get("ws", i + 1)["text"]).alias("shown"),
            x["start_s"].alias("t"),
        ),
    )
    pairs = (
        w.withColumn("cands", F.concat(single, double))
        .select(
            "video_id", "cue_idx", "tok",
            F.posexplode(
                F.filter(
                    F.transform("cands", lambda c, i: F.struct(i.alias("o"), c["cnorm"].alias("cnorm"), c["shown"].alias("shown"), c["t"].alias("t"))),
                    lambda c: (c["cnorm"] != "") & length_bound(c["cnorm"], F.col("tok.tnorm"), MIN_RATIO),
                )
            ).alias("_p", "c"),
        )
        .withColumn("ratio", similarity_from(F.col("tok.tnorm"), F.col("c.cnorm"), MIN_RATIO))
        .filter(F.col("ratio") >= MIN_RATIO)
    )
    best = pairs.groupBy("video_id", "cue_idx", F.col("tok.tok_no").alias("tok_no")).agg(
        F.max_by(
            F.struct(
                X.strip_edges(F.col("c.shown")).alias("heard"),
                X.strip_edges(F.col("tok.raw")).alias("caption"),
                F.col("c.t").alias("t"),
            ),
            F.struct("ratio", (-F.col("c.o")).alias("o")),
        ).alias("b")
    ).select("video_id", "cue_idx", "tok_no", "b.*")
    kept = best.filter(~X.noise_pair(F.col("heard"), F.col("caption")))
    return kept.groupBy("video_id", "heard", "caption").agg(
        F.min_by("t", F.struct("cue_idx", "tok_no")).alias("t"),
        F.array_sort(F.collect_set("t")).alias("times"),
    )


def ocr_tokens(frames: DataFrame) -> DataFrame:
    """Distinct slide tokens per video with the place they are first read at."""
    flat = frames.filter("ocr_text <> ''").select(
        "video_id", "frame_no", "frame_at", F.posexplode(X.split_ws(F.col("ocr_text"))).alias("p", "token")
    )
    return flat.groupBy("video_id", "token").agg(
        F.min(F.struct("frame_at", "frame_no", "p")).alias("place")
    ).withColumn("onorm", X.compare_key(F.col("token"))).filter("onorm <> ''")


def _short_grams(c: Column) -> Column:
    two = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2))
    )
    one = F.when(F.length(c) <= 3, F.split(c, "")).otherwise(F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.concat(two, one))


def attach_slides(suspect_table: DataFrame, frames: DataFrame) -> DataFrame:
    """Best slide token for either form at a ratio of 0.8 or more.

    Two strings that alike share two neighbouring characters (or one, when both have at most
    three), so forms and tokens meet on those instead of in all pairs.
    """
    forms = suspect_table.select(
        "video_id", "heard", "caption",
        F.posexplode(F.array(X.compare_key(F.col("heard")), X.compare_key(F.col("caption")))).alias("side", "fnorm"),
    ).filter("fnorm <> ''")
    a = forms.select("video_id", "fnorm").distinct().withColumn("g", F.explode(_short_grams(F.col("fnorm"))))
    b = ocr_tokens(frames).select("video_id", "onorm").distinct().withColumn(
        "g", F.explode(_short_grams(F.col("onorm")))
    )
    scored = (
        a.join(b, ["video_id", "g"])
        .filter(length_bound(F.col("fnorm"), F.col("onorm"), SLIDE_RATIO))
        .select("video_id", "fnorm", "onorm")
        .distinct()
        .withColumn("ratio", similarity_from(F.col("fnorm"), F.col("onorm"), SLIDE_RATIO))
        .filter(F.col("ratio") >= SLIDE_RATIO)
    )
    place = ocr_tokens(frames)
    best = (
        forms.join(scored, ["video_id", "fnorm"])
        .join(place, ["video_id", "onorm"])
        .groupBy("video_id", "heard", "caption")
        .agg(
            F.min_by(
                X.strip_edges(F.col("token")), F.struct((-F.col("ratio")).alias("r"), "side", "place")
            ).alias("slide")
        )
    )
    return suspect_table.join(best, ["video_id", "heard", "caption"], "left")


def keep_signal(heard: Column, caption: Column, slide: Column) -> Column:
    return (
        X.interesting(heard)
        | X.interesting(caption)
        | (
            slide.isNotNull()
            & (F.least(F.length(X.strip_edges(heard)), F.length(X.strip_edges(caption))) >= 4)
        )
    )


def number_suspects(suspect_table: DataFrame) -> DataFrame:
    """Suspects with a keep signal first, then by time; ids S1, S2, …"""
    keep = F.coalesce(keep_signal(F.col("heard"), F.col("caption"), F.col("slide")), F.lit(False))
    base = cut(suspect_table.withColumn("keep", keep))  # read for numbers and for counts
    late = F.when(F.col("keep"), 0).otherwise(1)
    bucket = late.cast("long") * F.lit(1 << 40) + F.floor(F.col("t") / 3600.0)
    return numbered(
        base, "video_id", bucket, [late, F.col("t"), F.col("heard"), F.col("caption")], out="n", start=1
    ).withColumn("suspect_id", F.concat(F.lit("S"), F.col("n").cast("string"))).drop("n")


def restored_terms(words: DataFrame) -> DataFrame:
    """Restored words by text: first time and all distinct times."""
    return (
        words.filter("origin = 'youtube'")
        .withColumn("term", X.strip_edges(F.col("text")))
        .filter("term <> ''")
        .groupBy("video_id", "term")
        .agg(F.min("start_s").alias("t"), F.array_sort(F.collect_set("start_s")).alias("times"))
    )


def shaped_tokens(words: DataFrame) -> DataFrame:
    """The 60 most frequent tokens of unusual shape per video."""
    w = Window.partitionBy("video_id").orderBy(F.col("freq").desc(), "t", "term")
    return (
        words.filter("coalesce(origin, 'gemini') = 'gemini'")
        .withColumn("term", X.strip_edges(F.col("text")))
        .filter(X.interesting(F.col("term")))
        .groupBy("video_id", "term")
        .agg(F.count(F.lit(1)).alias("freq"), F.min_by("start_s", "idx").alias("t"))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= MAX_SHAPED)
    )


def term_candidates(words: DataFrame, suspect_table: DataFrame, frames: DataFrame) -> DataFrame:
    """Restored, shaped and slide terms not already suspects, first 120 by time.

    ``dropped`` tells how many the limit left out.
    """
    seen = ocr_tokens(frames).withColumn("term", X.strip_edges(F.col("token"))).filter(
        (F.col("term") != "") & X.interesting(F.col("term"))
    )
    pool = (
        restored_terms(words)
        .select("video_id", "term", "t", F.size("times").cast("long").alias("freq"))
        .unionByName(shaped_tokens(words).select("video_id", "term", "t", "freq"))
        .unionByName(
            seen.groupBy("video_id", "term").agg(F.min("place.frame_at").alias("t")).withColumn("freq", F.lit(1).cast("long"))
        )
    )
    forms = suspect_table.select("video_id", F.explode(F.array("heard", "caption")).alias("term")).distinct()
    survivors = (
        pool.join(forms, ["video_id", "term"], "left_anti")
        .groupBy("video_id", "term")
        .agg(F.min("t").alias("t"), F.sum("freq").alias("freq"))
        .filter((F.col("freq") > 1) | X.interesting(F.col("term")))
    )
    total = survivors.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("video_id").orderBy("t", "term")
    return (
        survivors.withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= MAX_CANDIDATES)
        .join(total, "video_id")
        .select(
            "video_id",
            F.concat(F.lit("C"), F.col("n").cast("string")).alias("candidate_id"),
            "term",
            "t",
            F.greatest(F.lit(0), F.col("_n") - MAX_CANDIDATES).alias("dropped"),
        )
    )


def phrase_times(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Earliest time each phrase is spoken as consecutive words.

    ``phrases(video_id, phrase)``; words meet phrases on the first token, then the run of words
    is compared.
    """
    tokens = F.filter(
        F.transform(X.split_ws(F.col("phrase")), lambda t: F.lower(X.strip_edges(t))), lambda t: t != ""
    )
    asked = (
        phrases.select("video_id", "phrase")
        .distinct()
        .withColumn("toks", tokens)
        .filter(F.size("toks") > 0)
        .select("video_id", "phrase", F.size("toks").alias("k"), F.posexplode("toks").alias("p", "tok"))
    )
    spoken = words.filter("coalesce(origin, 'gemini') = 'gemini'").select(
        "video_id", "idx", "start_s", F.lower(X.strip_edges(F.col("text"))).alias("tok")
    )
    hits = spoken.join(asked, ["video_id", "tok"]).groupBy(
        "video_id", "phrase", "k", (F.col("idx") - F.col("p")).alias("first_idx")
    ).agg(F.count_distinct("p").alias("n"), F.min_by("start_s", "p").alias("t"))
    return hits.filter("n = k").groupBy("video_id", "phrase").agg(
        F.min_by("t", "first_idx").alias("first_t")
    )


def _quote(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def mentions(sentences: DataFrame, forms: DataFrame) -> DataFrame:
    """Sentences that mention a form, ignoring case, not inside a longer Latin word.

    ``sentences(video_id, no, s_text)``, ``forms(video_id, form, …)``.
    """
    edge = F.concat(F.lit("(?i)(^|[^A-Za-z])"), _quote(F.col("form")), F.lit("($|[^A-Za-z])"))
    return contains_join(
        sentences.select("video_id", "no", "s_text"), forms, ["video_id"], "s_text", "form"
    ).filter(F.regexp_like("s_text", edge))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def heard_forms(pairs: DataFrame) -> DataFrame:
    """Of (…, heard, src) pairs those where ``heard`` is ``src`` mis-heard: 0.6 alike as a whole,
    or 0.7 to one word of several, but not equal to it or to one of its words."""
    keys = pairs.columns
    parts = F.transform(X.split_ws(F.col("src")), _plain)
    rows = (
        pairs.withColumn("_h", _plain(F.col("heard")))
        .withColumn("_ws", parts)
        .withColumn("_w", F.array_join("_ws", ""))
        .filter((F.col("_h") != "") & (F.col("_h") != F.col("_w")))
        .filter(~((F.size("_ws") > 1) & F.array_contains("_ws", F.col("_h"))))
        .withColumn("_one", F.explode(F.concat(F.array("_w"), F.filter("_ws", lambda w: w != ""))))
        .withColumn("_r", similarity(F.col("_h"), F.col("_one")))
    )
    alike = ((F.col("_one") == F.col("_w")) & (F.col("_r") >= 0.6)) | (
        (F.size("_ws") > 1) & (F.col("_r") >= 0.7)
    )
    return rows.filter(alike).select(*keys).distinct()


def check_terms(
    submissions: DataFrame, suspect_table: DataFrame, candidates: DataFrame, words: DataFrame
) -> DataFrame:
    """Glossary lines with the first broken rule, or the term to store.

    ``submissions(video_id, line_no, fields ARRAY)`` as split at ``|`` after the line id.
    """

    def field(i: int) -> Column:
        return X.trim_ws(F.coalesce(F.get("fields", F.lit(i)), F.lit("")))

    key = ["video_id", "line_no"]
    base = submissions.select(
        *key,
        F.size("fields").alias("_n"),
        field(0).alias("src"),
        field(1).alias("tgt"),
        F.when(~field(2).isin("-", ""), field(2)).alias("short"),
        F.when(~field(3).isin("-", ""), field(3)).alias("note"),
        F.filter(F.transform(F.split(field(4), ","), X.trim_ws), lambda e: ~e.isin("", "-")).alias("evidence"),
    )
    cited = base.select(*key, "src", F.posexplode("evidence").alias("p", "e"))
    s = cited.join(
        suspect_table.select("video_id", F.col("suspect_id").alias("e"), F.col("heard").alias("heard"), "t"),
        ["video_id", "e"],
    )
    first = s.groupBy(*key).agg(F.min_by(F.struct("e", "t"), "p").alias("_s"))
    c = cited.join(
        candidates.select("video_id", F.col("candidate_id").alias("e")), ["video_id", "e"], "left_semi"
    ).select(*key).distinct().withColumn("_c", F.lit(True))
    heard = heard_forms(s.select(*key, "src", "heard")).groupBy(*key).agg(
        F.array_sort(F.collect_set("heard")).alias("heard")
    )
    asked = base.select("video_id", F.col("src").alias("phrase"))
    spoken = spoken_phrases(words, asked).select("video_id", F.col("phrase").alias("src"), F.lit(True).alias("_said"))
    times = phrase_times(words, asked).select("video_id", F.col("phrase").alias("src"), "first_t")
    rows = (
        base.join(first, key, "left")
        .join(c, key, "left")
        .join(heard, key, "left")
        .join(spoken, ["video_id", "src"], "left")
        .join(times, ["video_id", "src"], "left")
    )
    corrected = F.col("_said").isNull() & F.col("_s").isNull()
    rule = (
        F.when(F.col("_n") < 5, "too few fields")
        .when(X.everyday(F.col("src")), "everyday word")
        .when((F.col("src") == "") | (F.col("tgt") == ""), "empty")
        .when(F.length("short") > SHORT_CHARS, "short explanation too long")
        .when(F.length("note") > NOTE_CHARS, "note too long")
        .when(F.col("short").isNotNull() & F.col("note").isNull(), "short explanation without note")
        .when(corrected & F.col("_c").isNotNull(), "not spoken")
        .when(corrected, "correction without suspect")
    )
    uncertain = F.col("tgt") == "?"
    return rows.select(
        *key,
        "src",
        F.when(uncertain, F.col("src")).otherwise(F.col("tgt")).alias("tgt"),
        "short",
        "note",
        F.coalesce("heard", F.expr("cast(array() as array<string>)")).alias("heard"),
        "evidence",
        F.when(uncertain, "uncertain").otherwise("confirmed").alias("status"),
        F.coalesce("_s.t", "first_t").alias("first_t"),
        rule.alias("rule"),
    )


def spoken_phrases(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """Phrases that occur in the transcript at word boundaries, ignoring case.

    A phrase of k tokens lies inside k neighbouring words.  Words meet phrases on the phrase's
    first run of letters and digits, which is a whole run of one of those words.
    """
    asked = (
        phrases.filter("phrase <> ''")
        .select("video_id", "phrase")
        .distinct()
        .withColumn("_toks", X.split_ws(F.col("phrase")))
        .withColumn("k", F.size("_toks"))
        .withColumn("run", F.regexp_extract(F.lower("phrase"), "[\\p{L}\\p{N}_]+", 0))
        .filter("run <> ''")
        .withColumn(
            "_m",
            F.array_position(F.transform("_toks", lambda t: t.rlike("[\\p{L}\\p{N}_]")), F.lit(True)) - 1,
        )
        .drop("_toks")
    )
    spoken = words.filter("coalesce(origin, 'gemini') = 'gemini'").select("video_id", "idx", "text")
    runs = F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    )
    anchors = (
        spoken.select("video_id", "idx", F.explode(runs).alias("run"))
        .join(asked, ["video_id", "run"])
        .select("video_id", "phrase", "k", (F.col("idx") - F.col("_m")).alias("first_idx"))
        .distinct()
    )
    needed = anchors.withColumn("o", F.explode(F.expr("sequence(0, k - 1)"))).withColumn(
        "idx", F.col("first_idx") + F.col("o")
    )
    text = needed.join(spoken, ["video_id", "idx"]).groupBy("video_id", "phrase", "first_idx").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("idx", "text"))).getField("text"), " ").alias("t")
    )
    word, other = "[\\p{L}\\p{N}_]", "[^\\p{L}\\p{N}_]"
    before = F.when(F.col("phrase").rlike("^" + word), F.lit(f"(^|{other})")).otherwise(F.lit(word))
    after = F.when(F.col("phrase").rlike(word + "$"), F.lit(f"($|{other})")).otherwise(F.lit(word))
    pattern = F.concat(F.lit("(?i)"), before, _quote(F.col("phrase")), after)
    return text.filter(F.regexp_like("t", pattern)).select("video_id", "phrase").distinct()


def decided_prefix(items: DataFrame) -> DataFrame:
    """Per video how many leading items (``n`` from 1) are decided."""
    return items.groupBy("video_id").agg(
        F.coalesce(F.min(F.when(~F.col("decided"), F.col("n"))) - 1, F.max("n")).alias("cursor")
    )
