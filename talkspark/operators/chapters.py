"""Chapters: boundaries, keywords, excerpts, titles, and title submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.functions.ordered import neighbours, numbered
from talkspark.operators.joins import point_join
from talkspark.operators.segment import chapter_sentence_starts, in_blocks, join_texts

TARGET = 300.0
MIN = 120.0
MAX = 480.0
SEARCH = 60.0
TITLE_CHARS = 100
EXCERPT_CHARS = 360
KEYWORDS = 5

_GROUP = "struct<start:double,stop:double,title:string,open:boolean>"


def durations(words: DataFrame) -> DataFrame:
    """Start of the first and end of the last word by order, not the largest end."""
    return words.groupBy("video_id").agg(
        F.min_by("start_s", "idx").alias("first_start"), F.max_by("end_s", "idx").alias("duration")
    )


def _group(start: Column, stop: Column, title: Column, open_: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"), title.alias("title"), open_.alias("open"))


def native_groups(videos: DataFrame) -> DataFrame:
    """Uploader chapters clipped, made adjoining, short runs joined.

    ``videos(video_id, duration, native_chapters ARRAY<STRUCT<start_time,end_time,title>>)``; the
    array is one record's field, so the folds stay inside the row.
    """
    no_title = F.lit(None).cast("string")
    clipped = F.filter(
        F.transform(
            F.coalesce("native_chapters", F.expr("array()").cast("array<struct<start_time:double,end_time:double,title:string>>")),
            lambda c, i: F.struct(
                F.greatest(F.lit(0.0), c["start_time"]).alias("start"),
                i.alias("i"),
                F.least(F.col("duration"), c["end_time"]).alias("stop"),
                X.trim_ws(F.coalesce(c["title"], F.lit(""))).alias("title"),
            ),
        ),
        lambda c: c["stop"] > c["start"],
    )
    v = videos.withColumn("_v", F.array_sort(clipped)).filter(F.size("_v") > 0)
    joined = F.transform(
        "_v",
        lambda c, i: F.struct(
            F.when(i == 0, F.lit(0.0)).otherwise(c["start"]).alias("start"),
            F.coalesce(F.get("_v", i + 1)["start"], F.col("duration")).alias("stop"),
            c["title"].alias("title"),
        ),
    )
    empty = F.expr(f"cast(array() as array<{_GROUP}>)")

    def last(acc: Column) -> Column:
        return F.element_at(acc, -1)

    def replace_last(acc: Column, g: Column) -> Column:
        return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(g))

    def collect(acc: Column, x: Column) -> Column:
        g = F.try_element_at(acc, F.lit(-1))
        grow = F.coalesce(
            g["open"] & (g["stop"] - g["start"] < MIN) & (x["stop"] - g["start"] <= MAX), F.lit(False)
        )
        span = x["stop"] - x["start"]
        named = F.when((x["title"] != "") & (span <= MAX), x["title"])
        fresh = _group(x["start"], x["stop"], named, span < MIN)
        return F.when(
            grow, replace_last(acc, _group(g["start"], x["stop"], no_title, F.lit(True)))
        ).otherwise(F.concat(acc, F.array(fresh)))

    def absorb(acc: Column, x: Column) -> Column:
        g = F.try_element_at(acc, F.lit(-1))
        short = F.coalesce(
            (x["stop"] - x["start"] < MIN) & (x["stop"] - g["start"] <= MAX), F.lit(False)
        )
        return F.when(
            short, replace_last(acc, _group(g["start"], x["stop"], no_title, F.lit(False)))
        ).otherwise(F.concat(acc, F.array(x)))

    v = v.withColumn("_g", F.aggregate(joined, empty, collect))
    v = v.withColumn("_g", F.aggregate("_g", empty, absorb))
    head, second = F.get("_g", F.lit(0)), F.get("_g", F.lit(1))
    short_head = (
        (F.size("_g") > 1)
        & (head["stop"] - head["start"] < MIN)
        & (second["stop"] - head["start"] <= MAX)
    )
    v = v.withColumn(
        "_g",
        F.when(
            short_head,
            F.concat(
                F.array(_group(head["start"], second["stop"], no_title, F.lit(False))),
                F.slice("_g", 3, F.greatest(F.size("_g"), F.lit(1))),
            ),
        ).otherwise(F.col("_g")),
    )
    return v.select("video_id", F.explode("_g").alias("g")).select(
        "video_id",
        F.col("g.start").alias("g_start"),
        F.col("g.stop").alias("g_end"),
        F.col("g.title").alias("source_title"),
    )


def groups(words: DataFrame, videos: DataFrame) -> DataFrame:
    """Native groups, or one group over the whole talk where there are none."""
    span = cut(durations(words))  # a row a video; unstored, the join below would be made with the words
    native = native_groups(videos.join(span, "video_id"))
    whole = span.join(native.select("video_id").distinct(), "video_id", "left_anti").select(
        "video_id",
        F.col("first_start").alias("g_start"),
        F.col("duration").alias("g_end"),
        F.lit(None).cast("string").alias("source_title"),
    )
    return native.unionByName(whole)


def boundary_candidates(words: DataFrame, targets: DataFrame) -> DataFrame:
    """Scored word starts within 60 s of each target and 120 s from the group's end.

    ``targets`` carries ``target``, ``hi`` and its own key columns.
    """
    marked = words.select("video_id", "idx", "start_s", "end_s", X.sentence_end(F.col("text")).alias("_stop"))
    w = neighbours(marked, "video_id", "idx", prev={"_pe": "end_s", "ended": "_stop"}).filter(
        "_pe is not null"
    )
    w = w.select(
        "video_id",
        F.col("start_s").alias("at"),
        F.greatest(F.lit(0.0), F.col("start_s") - F.col("_pe")).alias("gap"),
        "ended",
    )
    near = point_join(
        w,
        targets,
        "video_id",
        F.col("at"),
        (F.col("target") - SEARCH, F.col("target") + SEARCH + 1e-3),
        SEARCH,
    ).filter(
        (F.col("at") <= F.least(F.col("hi") - MIN, F.col("target") + SEARCH))
        & (F.col("at") >= F.col("target") - SEARCH)
    )
    score = (
        F.when(F.col("ended"), 2.0).otherwise(0.0)
        + F.least(F.col("gap"), F.lit(3.0))
        - F.abs(F.col("at") - F.col("target")) / SEARCH
    )
    return near.withColumn("score", score).drop("gap", "ended")


def split_groups(words: DataFrame, group_table: DataFrame) -> DataFrame:
    """Groups over 480 s cut near equal parts of about 300 s.

    A cut must lie 120 s after the one before it.  With five or more parts the targets are at
    least 240 s apart and the search ranges cannot touch, so all cuts are independent; the two
    or three cuts of a shorter group are folded in order.
    """
    g = cut(
        group_table.withColumn("_len", F.col("g_end") - F.col("g_start")).withColumn(
            "parts",
            F.when(F.col("_len") <= MAX, F.lit(1)).otherwise(
                F.greatest(F.lit(2), F.ceil(F.col("_len") / TARGET).cast("int"))
            ),
        )
    )
    targets = (
        g.filter("parts > 1")
        .withColumn("k", F.explode(F.expr("sequence(1, parts - 1)")))
        .select(
            "video_id",
            "g_start",
            "parts",
            "k",
            F.col("g_end").alias("hi"),
            (F.col("g_start") + F.col("_len") * F.col("k") / F.col("parts")).alias("target"),
        )
    )
    key = ["video_id", "g_start", "k"]
    found = cut(
        targets.join(
            boundary_candidates(words, targets).groupBy(*key).agg(
                F.collect_list(F.struct("score", "at")).alias("cand")
            ),
            key,
            "left",
        )
    )

    def choose(cand: Column, lo: Column, target: Column, hi: Column) -> Column:
        best = F.array_max(F.filter(cand, lambda c: c["at"] >= lo + MIN))["at"]
        return F.coalesce(best, F.least(hi, F.greatest(lo, target)))

    # far apart: any start before the search range will do
    free = found.filter("parts >= 5").select(
        *key, choose(F.col("cand"), F.col("target") - 1000.0, F.col("target"), F.col("hi")).alias("cut_at")
    )
    # at most three cuts, each with the words of two minutes
    step = F.aggregate(
        F.array_sort(F.collect_list(F.struct("k", "target", "hi", "cand"))),
        F.struct(F.col("g_start").alias("lo"), F.expr("cast(array() as array<double>)").alias("cuts")),
        lambda acc, x: F.struct(
            choose(x["cand"], acc["lo"], x["target"], x["hi"]).alias("lo"),
            F.concat(acc["cuts"], F.array(choose(x["cand"], acc["lo"], x["target"], x["hi"]))).alias("cuts"),
        ),
    )
    chained = (
        found.filter("parts < 5")
        .groupBy("video_id", "g_start")
        .agg(step.getField("cuts").alias("cuts"))
        .select("video_id", "g_start", F.posexplode("cuts").alias("p", "cut_at"))
        .select("video_id", "g_start", (F.col("p") + 1).alias("k"), "cut_at")
    )
    edges = free.unionByName(chained)
    starts = g.select("video_id", "g_start", F.lit(0).alias("k"), F.col("g_start").alias("cut_at")).unionByName(edges)
    ends = g.select(
        "video_id", "g_start", (F.col("parts") - 1).alias("k"), F.col("g_end").alias("p_end")
    ).unionByName(
        edges.select("video_id", "g_start", (F.col("k") - 1).alias("k"), F.col("cut_at").alias("p_end"))
    )
    titles = g.select("video_id", "g_start", F.when(F.col("parts") == 1, F.col("source_title")).alias("source_title"))
    return (
        starts.join(ends, key)
        .filter("p_end > cut_at")
        .join(titles, ["video_id", "g_start"])
        .select("video_id", F.col("cut_at").alias("p_start"), "p_end", "source_title")
    )


def number_chapters(pieces: DataFrame) -> DataFrame:
    return numbered(
        pieces,
        "video_id",
        F.floor(F.col("p_start") / 86400.0).cast("long"),
        [F.col("p_start"), F.col("p_end")],
        out="chapter_no",
        start=1,
    )


def chapter_words(words: DataFrame, pieces: DataFrame) -> DataFrame:
    return point_join(
        words, pieces, "video_id", F.col("start_s"), (F.col("p_start"), F.col("p_end")), MIN
    )


def token_counts(in_chapters: DataFrame) -> DataFrame:
    """(video, chapter, token) counts and in how many chapters of the video the token occurs."""
    tf = (
        in_chapters.select("video_id", "chapter_no", F.explode(X.content_tokens(F.col("text"))).alias("token"))
        .groupBy("video_id", "chapter_no", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    # a group holds a row per chapter of one video at most
    return tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("video_id", "token")))


def keywords(counts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Five best tokens per chapter, rare ones weighted up, ties by token."""
    total = pieces.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    score = F.col("tf") * (1.0 + F.log((F.col("n_chapters") + 1) / (F.col("df") + 1)))
    w = Window.partitionBy("video_id", "chapter_no").orderBy(F.col("score").desc(), "token")
    return (
        counts.join(total, "video_id")
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= KEYWORDS)
        .select("video_id", "chapter_no", "token", "tf", "df", "rank")
    )


def excerpts(in_chapters: DataFrame, top: DataFrame) -> DataFrame:
    """Two sentences per chapter with most keyword hits, then closest to its middle.

    Hits are counted in whole sentences, so words are dealt into sentences once.
    """
    at = ["video_id", "chapter_no"]
    grouped = chapter_sentence_starts(in_chapters.select(*at, "idx", "text", "start_s", "end_s"), part="chapter_no", keep=True)
    sents = in_blocks(grouped, ("video_id", "chapter_no", "grp")).groupBy("video_id", "chapter_no", "grp").agg(
        F.min_by("start_s", "idx").alias("s_start"),
        F.max_by("end_s", "idx").alias("s_end"),
        join_texts("idx", "text").alias("s_text"),
    )
    bounds = in_chapters.groupBy(*at).agg(F.first("p_start").alias("p_start"), F.first("p_end").alias("p_end"))
    asked = bounds.join(top.groupBy(*at).agg(F.collect_list("token").alias("_top")), at, "left")
    hits = F.size(F.filter(X.content_tokens(F.col("s_text")), lambda t: F.array_contains("_top", t)))
    away = F.abs((F.col("s_start") + F.col("s_end")) / 2 - (F.col("p_start") + F.col("p_end")) / 2)
    w = Window.partitionBy("video_id", "chapter_no").orderBy(F.col("hits").desc(), "away", "grp")
    return (
        sents.join(asked, at)
        .withColumn("hits", F.when(F.col("_top").isNull(), 0).otherwise(hits).cast("long"))
        .withColumn("away", away)
        .withColumn("rank", F.row_number().over(w))
        .filter("rank <= 2")
        .select(
            "video_id", "chapter_no", "rank", "hits", F.substring("s_text", 1, EXCERPT_CHARS).alias("excerpt")
        )
    )


def clamp_title(title: Column) -> Column:
    """One line of at most 100 characters, cut at the last mark past the half, with an ellipsis."""
    flat = X.trim_ws(F.regexp_replace(title, "\\s+", " "))
    window = F.substring(flat, 1, TITLE_CHARS)

    def rfind(mark: str) -> Column:
        at = F.instr(F.reverse(window), mark[::-1])
        return F.when(at > 0, F.length(window) - at - len(mark) + 1).otherwise(F.lit(-1))

    at = F.greatest(*[rfind(m) for m in (". ", "? ", "! ", " · ", ": ", " ")])
    place = F.when(at < TITLE_CHARS // 2, F.lit(TITLE_CHARS)).otherwise(at)
    short = F.regexp_replace(window.substr(F.lit(1), place), "[ ·:.,?!]+$", "")
    return F.when(F.length(flat) <= TITLE_CHARS, flat).otherwise(F.concat(short, F.lit("…")))


def fallback_title(words_: Column, sents: Column, no: Column) -> Column:
    return (
        F.when(F.size(words_) > 0, F.substring(F.array_join(F.slice(words_, 1, 4), " · "), 1, TITLE_CHARS))
        .when(F.size(sents) > 0, F.rtrim(F.substring(F.get(sents, F.lit(0)), 1, TITLE_CHARS)))
        .otherwise(F.concat(F.lit("구간 "), no.cast("string")))
    )


def build(words: DataFrame, videos: DataFrame, previous: DataFrame | None = None,
          fingerprints: DataFrame | None = None) -> DataFrame:
    """All chapters of all talks.

    ``previous(video_id, transcript_fp, chapter_id, c_start, c_end, title, title_source)`` keeps
    host titles when transcript and boundaries are unchanged.
    """
    pieces = cut(number_chapters(split_groups(words, groups(words, videos))))
    inside = cut(chapter_words(words.select("video_id", "idx", "text", "start_s", "end_s"), pieces))
    top = cut(keywords(token_counts(inside), pieces))
    sents = excerpts(inside, top)

    def listed(rows: DataFrame, value: str, out: str) -> DataFrame:
        return rows.groupBy("video_id", "chapter_no").agg(
            F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))).getField("v").alias(out)
        )

    none = F.expr("cast(array() as array<string>)")
    at = ["video_id", "chapter_no"]
    full = (
        pieces.join(listed(top, "token", "keywords"), at, "left")
        .join(listed(sents, "excerpt", "excerpts"), at, "left")
        .withColumn("keywords", F.coalesce("keywords", none))
        .withColumn("excerpts", F.coalesce("excerpts", none))
    )
    native = F.when(F.col("source_title") != "", clamp_title(F.col("source_title")))
    out = full.select(
        "video_id",
        "chapter_no",
        chapter_id(F.col("chapter_no")).alias("chapter_id"),
        F.round("p_start", 3).alias("c_start"),
        F.round("p_end", 3).alias("c_end"),
        F.coalesce(
            native, fallback_title(F.col("keywords"), F.col("excerpts"), F.col("chapter_no"))
        ).alias("title"),
        F.when(native.isNotNull(), "youtube").otherwise("local-keywords").alias("title_source"),
        "keywords",
        "excerpts",
        native.isNull().alias("needs_title"),
    )
    if previous is None or fingerprints is None:
        return out
    return carry_titles(out, previous, fingerprints)


def chapter_id(no: Column) -> Column:
    return F.concat(F.lit("chapter-"), F.when(no < 10, F.concat(F.lit("0"), no.cast("string"))).otherwise(no.cast("string")))


def carry_titles(chapters: DataFrame, previous: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Host titles kept when fingerprint, id, start and end all match."""
    old = (
        previous.filter("title_source = 'host-llm'")
        .join(fingerprints, ["video_id", "transcript_fp"], "left_semi")
        .select("video_id", "chapter_id", "c_start", "c_end", F.col("title").alias("_old"))
    )
    joined = chapters.join(old, ["video_id", "chapter_id", "c_start", "c_end"], "left")
    kept = F.col("_old").isNotNull()
    return joined.select(
        *[
            c
            for c in chapters.columns
            if c not in {"title", "title_source", "needs_title"}
        ],
        F.coalesce("_old", "title").alias("title"),
        F.when(kept, "host-llm").otherwise(F.col("title_source")).alias("title_source"),
        (F.col("needs_title") & ~kept).alias("needs_title"),
    )


def check_titles(submissions: DataFrame, chapters: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Title submissions with the first broken rule; one bad row refuses its submission.

    ``submissions(video_id, submission_id, item_no, fingerprint, chapter_id, title)``.
    """
    title = X.trim_ws(F.coalesce("title", F.lit("")))
    first = submissions.groupBy("video_id", "submission_id", "chapter_id").agg(
        F.min("item_no").alias("_first")
    )
    known = chapters.select("video_id", "chapter_id", F.lit(True).alias("_known"))
    checked = (
        submissions.withColumn("title", title)
        .join(first, ["video_id", "submission_id", "chapter_id"], "left")
        .join(known, ["video_id", "chapter_id"], "left")
        .join(fingerprints.select("video_id", "transcript_fp"), "video_id", "left")
        .withColumn(
            "rule",
            F.when(~F.col("fingerprint").eqNullSafe(F.col("transcript_fp")), "stale fingerprint")
            .when(F.col("_known").isNull(), "unknown chapter")
            .when(F.col("item_no") > F.col("_first"), "duplicate chapter")
            .when(
                (F.length("title") == 0)
                | (F.length("title") > TITLE_CHARS)
                | F.col("title").rlike("[\\x00-\\x1F]"),
                "invalid title",
            ),
        )
    )
    bad = checked.filter("rule is not null").select("video_id", "submission_id").distinct().withColumn(
        "_bad", F.lit(True)
    )
    return checked.join(bad, ["video_id", "submission_id"], "left").select(
        "video_id", "submission_id", "item_no", "chapter_id", "title", "rule", F.col("_bad").isNull().alias("applied")
    )


def apply_titles(chapters: DataFrame, checked: DataFrame) -> DataFrame:
    """Chapters with the accepted titles; the latest submission wins."""
    new = checked.filter("applied").groupBy("video_id", "chapter_id").agg(
        F.max_by("title", "submission_id").alias("_new")
    )
    out = chapters.join(new, ["video_id", "chapter_id"], "left")
    return (
        out.withColumn("title", F.coalesce("_new", "title"))
        .withColumn("title_source", F.when(F.col("_new").isNotNull(), "host-llm").otherwise(F.col("title_source")))
        .withColumn("needs_title", F.col("needs_title") & F.col("_new").isNull())
        .drop("_new")
    )
