"""Segmentation, evidence and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.operators import corpus as K
from talkspark.operators import evidence as E
from talkspark.operators import index as N
from talkspark.operators import segment as S
from talkspark.operators.captions import validate_cues, validate_words
from talkspark.plans.oracle import cte
from talkspark.plans.queries_chapters import local_chapters, without_native
from talkspark.plans.registry import query
from talkspark.sources import adapters as A
from talkspark.sources import files as I


@query("adapter_words", "SELECT video_id, idx, text, start_s, end_s, speaker, speaker_status FROM v_words")
def _(spark, sf):
    return A.words(spark, sf).select(
        "video_id", "idx", "text", "start_s", "end_s", "speaker", "speaker_status"
    )


@query("win3_missing_gaps", "SELECT * FROM v_gaps")
def _(spark, sf):
    return S.missing_gaps(A.words(spark, sf))


@query("win4_chapter_sentences", "SELECT * FROM v_chsent")
def _(spark, sf):
    return S.chapter_sentences(A.words(spark, sf))


@query("win5_subtitle_sentences", "SELECT video_id, no, s_start, s_end, s_text, sentence_key, n_words FROM v_sent")
def _(spark, sf):
    return S.sentences(A.words(spark, sf)).drop("grp")


@query("win6_search_spans", "SELECT * FROM v_spans")
def _(spark, sf):
    return S.spans(A.words(spark, sf))


@query("win7_rendered_cues", "SELECT video_id, cue_no, c_start, c_end, lines, n_words FROM v_rcues")
def _(spark, sf):
    return S.cues(A.words(spark, sf)).drop("grp", "plain")


@query("win8_breath_points", "SELECT * FROM v_breath")
def _(spark, sf):
    return S.breath_points(S.sentence_starts(A.words(spark, sf)))


TIME = "printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"


@query(
    "snk2_srt_export",
    f"""SELECT video_id, cue_no, cue_no || chr(10) || {TIME.replace('ms', 'a')} || ' --> ' || {TIME.replace('ms', 'b')}
      || chr(10) || lines AS block, plain FROM (SELECT *, round_even(c_start * 1000, 0)::BIGINT AS a,
      round_even(c_end * 1000, 0)::BIGINT AS b FROM v_rcues)""",
)
def _(spark, sf):
    return S.srt_blocks_text(S.cues(A.words(spark, sf)))


@query(
    "agg15_render_retention",
    """SELECT video_id, count(*) AS n_input, count(*) AS n_rendered, true AS complete FROM v_words GROUP BY 1""",
)
def _(spark, sf):
    w = A.words(spark, sf)
    return S.retention(w, S.cues(w))


@query(
    "sca14_marked_sentences",
    """SELECT g.video_id, g.grp, string_agg(coalesce('^' || b.k || ' ', '') || g.text, ' ' ORDER BY g.idx) AS marked
    FROM v_grp5 g LEFT JOIN v_breath b ON b.video_id = g.video_id AND b.breath_idx = g.idx GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.marked_text(S.sentence_starts(A.words(spark, sf)))


cte(
    "v_records",
    """SELECT video_id, frame_at AS start_s, frame_at AS end_s, trim(ocr_text) AS text, 'frame' AS source_kind,
    NULL::VARCHAR AS speaker, NULL::VARCHAR AS speaker_candidate, NULL::VARCHAR AS speaker_status,
    NULL::DOUBLE AS speaker_confidence, CASE conf_kind WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END AS confidence
    FROM v_frames WHERE trim(ocr_text) <> ''""",
)
cte(
    "v_evidence",
    """SELECT video_id, start_s, end_s, text, 'transcript' AS source_kind, speaker, speaker_candidate, speaker_status,
    speaker_confidence, confidence FROM v_spans UNION ALL SELECT * FROM v_records
    UNION ALL SELECT video_id, c_start, c_end, trim(title), 'chapter', NULL, NULL, NULL, NULL, 1e0 FROM v_chap WHERE trim(title) <> ''""",
)


def frame_records(spark, sf):
    return E.optional_records(
        A.frames(spark, sf).withColumnRenamed("frame_at", "timestamp"), "frame"
    )


def chapter_records(spark, sf):
    rows = local_chapters(spark, sf).select("video_id", F.col("c_start").alias("start"), F.col("c_end").alias("end"), "title")
    return E.optional_records(rows, "chapter")


def evidence_table(spark, sf):
    return E.evidence(S.spans(cut(A.words(spark, sf))), frame_records(spark, sf), chapter_records(spark, sf))


def indexed(spark, sf):
    """Evidence, postings and grams as stored tables."""
    at = I.scratch(spark, "index")
    E.with_id(evidence_table(spark, sf)).write.parquet(f"{at}/evidence")
    rows = spark.read.parquet(f"{at}/evidence")
    N.postings(rows).write.partitionBy("bucket").parquet(f"{at}/postings")
    held = spark.read.parquet(f"{at}/postings")
    N.grams(held).write.partitionBy("bucket").parquet(f"{at}/grams")
    return spark.read.parquet(f"{at}/grams"), held, rows


def corpus(spark, sf):
    """The corpus job over the table folder, and a second refresh for changed words."""
    job = K.Corpus(spark, I.scratch(spark, "corpus"))
    words, talks = cut(A.words(spark, sf)), cut(without_native(spark, sf))
    pictures = cut(A.frames(spark, sf, words))

    def refresh(rows):
        longer = rows.withColumns({"start_s": F.col("start_s") * 4.0, "end_s": F.col("end_s") * 4.0})
        return job.refresh(rows, pictures, talks, longer)

    return job, words, refresh


@query("src6_optional_records", "SELECT * FROM v_records")
def _(spark, sf):
    return frame_records(spark, sf)


@query("set1_evidence_union", "SELECT source_kind, count(*) AS n, count(DISTINCT video_id) AS videos FROM v_evidence GROUP BY 1")
def _(spark, sf):
    return evidence_table(spark, sf).groupBy("source_kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("video_id").alias("videos")
    )


cte(
    "v_terms",
    "SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(query), '[0-9A-Za-z가-힣_-]+')) AS term FROM v_questions",
)
cte(
    "v_hits",
    """SELECT question_id, e.video_id, start_s, end_s, text, source_kind, confidence, speaker,
    sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)) AS hits
    FROM (SELECT *, row_number() OVER () AS rid FROM v_evidence) e JOIN v_terms t ON contains(lower(e.text), t.term)
    GROUP BY question_id, rid, e.video_id, start_s, end_s, text, source_kind, confidence, speaker""",
)
cte(
    "v_top1",
    """SELECT question_id, video_id, start_s, end_s, text, source_kind, confidence, speaker, hits::BIGINT AS hits, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY question_id, video_id ORDER BY hits DESC, confidence DESC, start_s,
      end_s, source_kind, text) AS rank FROM v_hits) WHERE rank <= 8""",
)


@query("top1_search", "SELECT * FROM v_top1")
def _(spark, sf):
    return N.search(A.questions(spark, sf), *indexed(spark, sf))


@query("job_answers", "SELECT * FROM v_top1")
def _(spark, sf):
    job, words, refresh = corpus(spark, sf)
    refresh(words)
    return job.answers(A.questions(spark, sf))


@query(
    "job_recompute",
    """SELECT stage, n AS first_run, 0::BIGINT AS same_input, 1::BIGINT AS one_changed, 0::BIGINT AS one_gone, n - 1 AS held FROM
      (SELECT count(DISTINCT video_id) AS n FROM v_words), (VALUES ('spans'), ('chapters'), ('evidence'), ('index')) s(stage)""",
)
def _(spark, sf):
    job, words, refresh = corpus(spark, sf)
    one = words.agg(F.min("video_id")).first()[0]
    told = [
        refresh(words),
        refresh(words),
        refresh(words.withColumn("text", F.when((F.col("video_id") == one) & (F.col("idx") == 0), "Changed").otherwise(F.col("text")))),
        refresh(words.where(F.col("video_id") != one)),
    ]
    held = {name: getattr(job, name).state().where("not dead").count() for name in told[0]}
    rows = [(name, *(t[name] for t in told[:2]), told[2][name], told[3][name], held[name]) for name in told[0]]
    return spark.createDataFrame(rows, "stage string, first_run long, same_input long, one_changed long, one_gone long, held long")


@query("snk4_stored_takedown", "SELECT source_kind, count(*) AS n, count(DISTINCT video_id) AS videos FROM v_evidence WHERE video_id % 7 <> 2 GROUP BY 1")
def _(spark, sf):
    job, words, refresh = corpus(spark, sf)
    refresh(words)
    job.forget(words.where("video_id % 7 = 2").select("video_id"))
    left = spark.read.parquet(f"{job.evidence.at}/evidence")  # all files there are, not only live rows
    return left.groupBy("source_kind").agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"))


@query(
    "top5_corpus_search",
    """SELECT * FROM (SELECT question_id, video_id, start_s, source_kind, hits::BIGINT AS hits, row_number() OVER (
      PARTITION BY question_id ORDER BY hits DESC, confidence DESC, start_s, video_id, end_s, source_kind, text) AS rank
      FROM v_hits) WHERE rank <= 20""",
)
def _(spark, sf):
    return N.search(A.questions(spark, sf), *indexed(spark, sf), limit=20, per_video=False).select(
        "question_id", "video_id", "start_s", "source_kind", "hits", "rank"
    )


@query(
    "fil2_validation",
    """SELECT 'word' AS kind, video_id, idx, rule FROM (SELECT *, unnest(list_filter([
      CASE WHEN trim(text) = '' THEN 'empty text' END, CASE WHEN end_s < start_s THEN 'reversed' END,
      CASE WHEN start_s < p THEN 'out of order' END], lambda x: x IS NOT NULL)) AS rule FROM (
      SELECT *, lag(start_s) OVER (PARTITION BY video_id ORDER BY idx) AS p FROM (
      SELECT video_id, idx, CASE WHEN idx % 97 = 5 THEN '  ' ELSE text END AS text,
      CASE WHEN idx % 131 = 9 THEN start_s - 3e0 ELSE start_s END AS start_s,
      CASE WHEN idx % 151 = 7 THEN start_s - 1e0 ELSE end_s END AS end_s FROM v_words)))
    UNION ALL SELECT 'cue', video_id, cue_idx, 'out of order' FROM (
      SELECT *, lag(cs) OVER (PARTITION BY video_id ORDER BY cue_idx) AS p FROM (SELECT video_id, cue_idx,
      CASE WHEN cue_idx % 17 = 3 THEN cue_start - 9e0 ELSE cue_start END AS cs FROM v_cues)) WHERE cs < p""",
)
def _(spark, sf):
    w = (
        A.words(spark, sf)
        .withColumn("text", F.when(F.expr("idx % 97 = 5"), "  ").otherwise(F.col("text")))
        .withColumn("end_s", F.when(F.expr("idx % 151 = 7"), F.col("start_s") - 1.0).otherwise(F.col("end_s")))
        .withColumn("start_s", F.when(F.expr("idx % 131 = 9"), F.col("start_s") - 3.0).otherwise(F.col("start_s")))
    )
    c = A.cues(spark, sf).withColumn(
        "cue_start", F.when(F.expr("cue_idx % 17 = 3"), F.col("cue_start") - 9.0).otherwise(F.col("cue_start"))
    )
    return (
        validate_words(w)
        .select(F.lit("word").alias("kind"), "video_id", "idx", "rule")
        .unionByName(
            validate_cues(c).select(F.lit("cue").alias("kind"), "video_id", F.col("cue_idx").alias("idx"), "rule")
        )
    )


cte(
    "v_asked",
    """SELECT 'f' || (video_id % 4) AS question_id, video_id FROM v_videos
    UNION ALL SELECT 'b' || item_id, item_id % (SELECT count(*) FROM v_videos) FROM benchmark""",
)


@query(
    "top2_answers_with_frames",
    """SELECT q.question_id, q.video_id, t.rank, t.start_s, t.end_s, t.source_kind, t.hits,
      CASE WHEN t.start_s IS NOT NULL THEN printf('%02d:%02d:%02d', round_even(t.start_s, 0)::BIGINT // 3600,
        round_even(t.start_s, 0)::BIGINT // 60 % 60, round_even(t.start_s, 0)::BIGINT % 60) END AS timecode,
      coalesce((SELECT string_agg(frame_no::VARCHAR, ',' ORDER BY frame_at) FROM v_frames f WHERE f.video_id = q.video_id
        AND f.frame_at BETWEEN t.start_s - 2e0 AND t.end_s + 2e0), '') AS frame_nos, t.rank IS NOT NULL AS answered
    FROM v_asked q LEFT JOIN v_top1 t ON t.question_id = q.question_id AND t.video_id = q.video_id""",
)
def _(spark, sf):
    # each question of the table is asked of one video, and each video one of the fixed questions
    talks = cut(A.videos(spark, sf).select("video_id"))
    own = A.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"), (F.col("item_id") % max(1, talks.count())).alias("video_id")
    )
    asked = talks.select(F.concat(F.lit("f"), (F.col("video_id") % 4).cast("string")).alias("question_id"), "video_id").unionByName(own)
    found = N.search(A.questions(spark, sf).join(asked, "question_id"), *indexed(spark, sf))
    return E.answers(found.select("question_id", "video_id", "rank", "start_s", "end_s", "source_kind", "hits"), asked, A.frames(spark, sf))
