"""Summaries: local extract, submitted content, freshness, outline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkspark.functions import text as X

MAX_OVERVIEW = 1600
MAX_POINT = 600
MAX_BULLET = 600
MAX_TERM = 100
MAX_MEANING = 600
MAX_POINTS = 12
MAX_BULLETS = 3
MAX_TERMS = 20

# fixed wording of the local extract
EMPTY_OVERVIEW = "이 영상의 내용을 시간순 챕터로 정리했다."
TERM_MEANING = "영상에서 반복해서 다루는 핵심 용어"
HEADINGS = ["## 한눈에 보기", "## 핵심 내용", "## 챕터별 정리", "## 주요 용어"]


def key_terms(chapters: DataFrame) -> DataFrame:
    """Keywords of at least two chapters, top 20 per video, one row per chapter they occur in."""
    flat = chapters.select(
        "video_id", "chapter_no", "chapter_id", F.explode(F.array_distinct("keywords")).alias("term")
    )
    w = Window.partitionBy("video_id").orderBy(F.col("n").desc(), "term")
    best = (
        flat.groupBy("video_id", "term")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n >= 2")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= MAX_TERMS)
    )
    return flat.join(best, ["video_id", "term"])


def key_points(chapters: DataFrame) -> DataFrame:
    """Up to 12 evenly spread chapters, each with its first excerpt or title."""
    n = chapters.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    picks = (
        n.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(MAX_POINTS)).cast("int") - 1)))
        .withColumn(
            "chapter_no",
            F.when(F.col("n") <= MAX_POINTS, F.col("i") + 1)
            .otherwise(F.bround(F.col("i") * (F.col("n") - 1) / (MAX_POINTS - 1)) + 1)
            .cast("long"),
        )
        .drop("n")
    )
    said = F.filter("excerpts", lambda e: X.trim_ws(e) != "")
    text = F.coalesce(X.trim_ws(F.get(said, F.lit(0))), F.col("title"))
    return picks.join(chapters, ["video_id", "chapter_no"]).select(
        "video_id",
        F.col("i").alias("point_no"),
        "chapter_id",
        "c_start",
        F.rtrim(F.substring(text, 1, MAX_POINT)).alias("text"),
    )


def overviews(chapters: DataFrame) -> DataFrame:
    """First two excerpts of the talk; the window keeps two rows per task before the shuffle."""
    flat = chapters.select("video_id", "chapter_no", F.posexplode("excerpts").alias("p", "e")).withColumn(
        "e", X.trim_ws(F.col("e"))
    ).filter("e <> ''")
    w = Window.partitionBy("video_id").orderBy("chapter_no", "p")
    two = flat.withColumn("r", F.row_number().over(w)).filter("r <= 2")
    joined = two.groupBy("video_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("r", "e"))).getField("e"), " ").alias("o")
    )
    return chapters.select("video_id").distinct().join(joined, "video_id", "left").select(
        "video_id",
        F.rtrim(F.substring(F.coalesce("o", F.lit(EMPTY_OVERVIEW)), 1, MAX_OVERVIEW)).alias("overview"),
    )


def stamp(seconds: Column) -> Column:
    return F.concat(F.lit("["), X.timecode(seconds), F.lit("]"))


def markdown_lines(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """The local summary as ordered lines (section, place, sub), ready to be written per video.

    ``titles(video_id, video_title)``.
    """

    def rows(df: DataFrame, section: int, place: Column, sub: Column, line: Column) -> DataFrame:
        return df.select(
            "video_id", F.lit(section).alias("section"), place.cast("long").alias("place"),
            sub.cast("long").alias("sub"), line.alias("line"),
        )

    zero, one = F.lit(0), F.lit(1)
    videos = chapters.select("video_id").distinct()
    head = rows(
        videos.join(titles, "video_id", "left"), 0, zero, zero,
        F.concat(F.lit("# "), F.coalesce("video_title", F.col("video_id").cast("string"))),
    )
    heads = [rows(videos, s + 1, F.lit(-1), zero, F.lit(h)) for s, h in enumerate(HEADINGS[:3])]
    over = rows(overviews(chapters), 1, zero, zero, F.col("overview"))
    points = rows(
        key_points(chapters), 2, F.col("point_no"), zero,
        F.concat(F.lit("- "), F.col("text"), F.lit(" "), stamp(F.col("c_start"))),
    )
    chapter_head = rows(
        chapters, 3, F.col("chapter_no"), zero,
        F.concat(F.lit("### "), F.col("chapter_no"), F.lit(". "), F.col("title"), F.lit(" "), stamp(F.col("c_start"))),
    )
    bullets = F.transform(
        F.filter(F.slice("excerpts", 1, 2), lambda e: X.trim_ws(e) != ""),
        lambda e: F.rtrim(F.substring(X.trim_ws(e), 1, MAX_BULLET)),
    )
    shown = chapters.withColumn("_b", F.when(F.size(bullets) > 0, bullets).otherwise(F.array("title")))
    body = rows(
        shown.select("video_id", "chapter_no", F.posexplode("_b").alias("p", "b")), 3, F.col("chapter_no"),
        F.col("p") + one, F.concat(F.lit("- "), F.col("b")),
    )
    terms = (
        key_terms(chapters)
        .join(chapters.select("video_id", "chapter_no", "c_start"), ["video_id", "chapter_no"])
        .groupBy("video_id", "term", "rank")
        .agg(F.min(F.struct("chapter_no", "c_start")).alias("f"))
    )
    term_head = rows(terms.select("video_id").distinct(), 4, F.lit(-1), zero, F.lit(HEADINGS[3]))
    term_rows = rows(
        terms, 4, F.col("rank"), zero,
        F.concat(
            F.lit("- **"), F.col("term"), F.lit("**: " + TERM_MEANING + " "), stamp(F.col("f.c_start"))
        ),
    )
    out = head
    for part in (*heads, over, points, chapter_head, body, term_head, term_rows):
        out = out.unionByName(part)
    return out


def squeeze(c: Column) -> Column:
    return X.trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))


def bad_text(c: Column, maximum: int) -> Column:
    t = squeeze(c)
    return (t == "") | (F.length(t) > maximum) | t.rlike("[\\x00-\\x1F]")


def check_content(submissions: DataFrame, chapters: DataFrame) -> DataFrame:
    """First broken rule of each submitted summary, null when it is accepted.

    ``submissions(video_id, submission_id, overview, key_points, chapter_summaries, terms)`` with
    arrays of structs; references meet the chapter table in joins, not in collected lists.
    """
    key = ["video_id", "submission_id"]
    known = chapters.select("video_id", "chapter_id", "chapter_no")
    total = chapters.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_chapters"))

    def unknown(array: str, out: str) -> DataFrame:
        ids = submissions.select(*key, F.explode(array).alias("x")).select(
            *key, F.explode("x.chapter_ids").alias("chapter_id")
        )
        return (
            ids.join(known, ["video_id", "chapter_id"], "left_anti").select(*key).distinct().withColumn(out, F.lit(True))
        )

    placed = (
        submissions.select(*key, F.posexplode("chapter_summaries").alias("p", "x"))
        .select(*key, "p", F.col("x.id").alias("chapter_id"))
        .join(known, ["video_id", "chapter_id"])
        .filter(F.col("chapter_no") == F.col("p") + 1)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_placed"))
    )

    def bad_ids(x: Column) -> Column:
        ids = x["chapter_ids"]
        return ids.isNull() | (F.size(ids) == 0) | (F.size(F.array_distinct(ids)) != F.size(ids))

    none = F.lit(False)
    points, parts, terms = F.col("key_points"), F.col("chapter_summaries"), F.col("terms")
    rows = (
        submissions.join(total, "video_id", "left")
        .join(placed, key, "left")
        .join(unknown("key_points", "_up"), key, "left")
        .join(unknown("terms", "_ut"), key, "left")
    )
    in_order = (F.coalesce("n_placed", F.lit(0)) == F.size(parts)) & (F.size(parts) == F.col("n_chapters"))
    rule = (
        F.when(bad_text(F.col("overview"), MAX_OVERVIEW), "overview")
        .when(points.isNull() | ~F.size(points).between(1, MAX_POINTS), "key point count")
        .when(F.exists(points, lambda x: bad_text(x["text"], MAX_POINT)), "key point text")
        .when(F.exists(points, bad_ids) | F.coalesce("_up", none), "key point chapters")
        .when(parts.isNull() | ~in_order, "chapter order")
        .when(F.exists(parts, lambda x: ~F.coalesce(F.size(x["bullets"]), F.lit(0)).between(1, MAX_BULLETS)), "bullet count")
        .when(F.exists(parts, lambda x: F.exists(x["bullets"], lambda b: bad_text(b, MAX_BULLET))), "bullet text")
        .when(F.size(F.coalesce(terms, F.array().cast(submissions.schema["terms"].dataType))) > MAX_TERMS, "term count")
        .when(
            F.exists(terms, lambda x: bad_text(x["term"], MAX_TERM) | bad_text(x["meaning"], MAX_MEANING)), "term text"
        )
        .when(F.exists(terms, bad_ids) | F.coalesce("_ut", none), "term chapters")
    )
    return rows.select(*key, rule.alias("rule"))


def current(stored: DataFrame, transcript_fps: DataFrame, chapter_fps: DataFrame) -> DataFrame:
    """Latest stored summary per video and whether both of its fingerprints still hold."""
    latest = stored.groupBy("video_id").agg(
        F.max_by(F.struct("transcript_fp", "chapters_fp", "generation"), "stored_at").alias("s")
    ).select("video_id", "s.*")
    t = transcript_fps.select("video_id", F.col("transcript_fp").alias("_t"))
    c = chapter_fps.select("video_id", F.col("chapters_fp").alias("_c"))
    fresh = F.coalesce(
        (F.col("transcript_fp") == F.col("_t")) & (F.col("chapters_fp") == F.col("_c")), F.lit(False)
    )
    return (
        latest.join(t, "video_id", "left")
        .join(c, "video_id", "left")
        .select("video_id", "generation", fresh.alias("is_current"), (fresh & (F.col("generation") == "host-llm")).alias("final"))
    )


def outline_stats(words: DataFrame) -> DataFrame:
    """Per video: duration by order, words, restored terms, speakers by status."""
    who = F.coalesce("speaker_global", "speaker")
    settled = F.col("speaker_status").isin("confirmed", "inferred")
    open_ = F.col("speaker_status") == "unresolved"
    return words.groupBy("video_id").agg(
        F.max_by("end_s", "idx").alias("duration"),
        F.count(F.lit(1)).alias("word_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("origin") == "youtube", F.col("text")))), "|").alias(
            "restored_terms"
        ),
        F.array_join(F.array_sort(F.collect_set(F.when(settled, who))), "|").alias("speakers"),
        F.array_join(F.array_sort(F.collect_set(F.when(open_, who))), "|").alias("unresolved_speakers"),
        F.count_if(open_).alias("unresolved_words"),
    )


def outline(chapters: DataFrame, stats: DataFrame, max_entries: int | None = None) -> DataFrame:
    """Chapter entries with timecodes beside the video's statistics.

    All chapters, unless the caller asks for the first ``max_entries``; ``left_out`` then counts
    the video's other chapters.
    """
    entries = chapters
    if max_entries is not None:
        over = F.count_if(F.col("chapter_no") > max_entries).over(Window.partitionBy("video_id"))
        entries = chapters.withColumn("left_out", over).filter(F.col("chapter_no") <= max_entries)
    return (
        entries.withColumn("timecode", X.timecode(F.col("c_start")))
        .join(stats, "video_id")
    )
