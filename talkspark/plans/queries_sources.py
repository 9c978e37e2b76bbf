"""Sources, sinks, predicates, scalar expressions, metering and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X
from talkspark.operators import access as B
from talkspark.operators import captions as C
from talkspark.operators import evidence as E
from talkspark.operators import segment as S
from talkspark.operators import usage as U
from talkspark.operators.joins import interval_join
from talkspark.plans.oracle import cte
from talkspark.plans.queries_chapters import STOP
from talkspark.plans.queries_segment import evidence_table
from talkspark.plans.queries_words import entries, merged, responses
from talkspark.plans.registry import query
from talkspark.sources import adapters as A
from talkspark.sources import files as I
from talkspark.streaming import jobs as J

# --- sources --------------------------------------------------------------------------------


def srt_texts(spark, sf):
    """One SRT text per video made of its cues, with a BOM, CRLF and an untimed block."""
    block = F.concat_ws(
        "\r\n", (F.col("cue_idx") + 1).cast("string"),
        F.concat_ws(" --> ", X.srt_time(F.col("cue_start")), X.srt_time(F.col("cue_end"))), "cue_text", F.lit("  "),
    )
    return A.cues(spark, sf).groupBy("video_id").agg(
        F.concat(
            F.lit("﻿NOTE no timing here\r\n\r\n"),
            F.array_join(F.array_sort(F.collect_list(F.struct("cue_idx", block.alias("b")))).getField("b"), "\r\n\r\n"),
        ).alias("content")
    )


@query(
    "src1_srt_blocks",
    "SELECT video_id, cue_idx AS block_idx, cue_start_ms // 1000 + (cue_start_ms % 1000) / 1e3 AS b_start, cue_end_ms // 1000 + (cue_end_ms % 1000) / 1e3 AS b_end, trim(cue_text) AS line FROM v_cues",
)
def _(spark, sf):
    blocks = I.dense_blocks(I.srt_blocks(srt_texts(spark, sf)), "video_id")
    return blocks.select("video_id", "block_idx", "b_start", "b_end", F.array_join("lines", "\n").alias("line"))


def caption_files(spark, sf):
    cue = F.struct(F.col("cue_start").alias("start"), F.col("cue_end").alias("end"), F.col("cue_text").alias("text"))
    rows = A.cues(spark, sf).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct("cue_idx", cue.alias("c")))).getField("c").alias("cues")
    )
    track = A.caption_tracks(spark, sf).select(
        "video_id", "original",
        F.when(F.col("video_id") % 4 != 2, F.col("language")).alias("language"),
        F.concat(F.lit("youtube-"), F.col("language")).alias("source"),
    )
    return rows.join(track, "video_id").select("video_id", F.to_json(F.struct("source", "language", "original", "cues")).alias("json"))


@query(
    "src2_caption_files",
    """SELECT video_id, CASE WHEN original THEN language END AS evidence_language, count(*) AS n_cues, min(cue_start) AS first_start
    FROM v_cues JOIN v_tracks USING (video_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    tracks, cues = I.captions(caption_files(spark, sf))
    n = cues.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cues"), F.min("cue_start").alias("first_start"))
    return C.evidence_language(tracks).join(n, "video_id")


@query(
    "src3_preferred_transcript",
    """SELECT video_id, origin, count(*) AS n FROM v_merged WHERE video_id % 3 = 0 GROUP BY 1, 2
    UNION ALL SELECT video_id, 'plain', count(*) FROM v_words WHERE video_id % 3 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    plain = A.words(spark, sf).select("video_id", "idx", F.lit("plain").alias("origin"))
    better = merged(spark, sf).select("video_id", "idx", "origin").filter("video_id % 3 = 0")
    return E.prefer_merged(plain, better).groupBy("video_id", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src5_metadata",
    """SELECT doc_id::VARCHAR AS video_id, left(text, 200) AS title, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS channel, lang AS language,
      CASE WHEN doc_id % 2 = 0 THEN 'a-orig,' || lang || '-orig' ELSE '' END AS auto_caption_langs,
      array_to_string([lpad(i::VARCHAR, 3, '0') FOR i IN range(20)], ',') AS subtitle_langs,
      CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS playable_in_embed FROM documents""",
)
def _(spark, sf):
    json = F.concat(
        F.expr("substring(to_json(named_struct('id', cast(doc_id as string), 'title', text, 'language', lang, 'uploader', lang)), 1, "
               "length(to_json(named_struct('id', cast(doc_id as string), 'title', text, 'language', lang, 'uploader', lang))) - 1)"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(',"channel":"'), F.col("source"), F.lit('"'))).otherwise(F.lit("")),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(F.lit(',"automatic_captions":{"en":[{"ext":"srt"}],"'), F.col("lang"), F.lit('-orig":[],"a-orig":null}')),
        ).otherwise(F.lit("")),
        F.lit(',"subtitles":{'),
        F.lit(",".join(f'"{i:03d}":[]' for i in reversed(range(25)))),
        F.lit("}"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN ',\"playable_in_embed\":true' WHEN 1 THEN ',\"playable_in_embed\":false' "
               "WHEN 2 THEN ',\"playable_in_embed\":\"true\"' ELSE '' END"),
        F.lit("}"),
    )
    return I.metadata(A.table(spark, sf, "documents").select(json.alias("json"))).withColumn(
        "auto_caption_langs", F.array_join("auto_caption_langs", ",")
    ).withColumn("subtitle_langs", F.array_join("subtitle_langs", ","))


@query(
    "src7_video_ids",
    """SELECT page_id, k, lpad(page_id::VARCHAR, 11, '0') AS video_id FROM pages, range(0, 4) t(k)""",
)
def _(spark, sf):
    ok, _ = I.split_urls(A.urls(spark, sf))
    kind = F.when(F.col("url").contains("youtu.be/"), 0).when(F.col("url").contains("v="), 1).when(
        F.col("url").contains("/shorts/"), 2
    ).otherwise(3)
    return ok.select("page_id", kind.alias("k"), "video_id")


@query("src7_rejected_urls", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '(?:v=|youtu\\.be/|/shorts/|/embed/)[0-9A-Za-z_-]{11}')")
def _(spark, sf):
    return I.split_urls(A.urls(spark, sf))[1]


# --- sinks ----------------------------------------------------------------------------------


@query("snk1_evidence_table", "SELECT * FROM v_evidence")
def _(spark, sf):
    path = I.scratch(spark, "evidence")
    I.write_evidence(evidence_table(spark, sf), path)
    return spark.read.parquet(path)


@query(
    "snk3_carried_summaries",
    "SELECT video_id, 'host-llm' AS generation, 'summary 2' AS content, 2 AS stored_at FROM v_videos WHERE video_id % 4 <> 1",
)
def _(spark, sf):
    own = A.videos(spark, sf).filter("video_id % 4 <> 1").select("video_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("stored_at"))
    summaries = own.select(
        "video_id", F.when(F.col("stored_at") == 2, "host-llm").otherwise("local-extractive").alias("generation"),
        F.concat(F.lit("summary "), F.col("stored_at").cast("string")).alias("content"), "stored_at",
    )
    from talkspark.plans.queries_segment import frame_records

    return I.rebuild(frame_records(spark, sf), summaries, I.scratch(spark, "rebuilt"))


@query(
    "snk4_takedown",
    """SELECT kind, count(*) AS n FROM v_videos, (VALUES ('derived'), ('index'), ('raw'), ('translations'), ('job')) k(kind)
    WHERE NOT (CASE video_id % 7 WHEN 0 THEN kind IN ('derived', 'index') WHEN 1 THEN kind IN ('raw', 'translations') WHEN 2 THEN true ELSE false END) GROUP BY 1""",
)
def _(spark, sf):
    v = A.videos(spark, sf).select("video_id")
    asked = v.withColumn("scope", F.expr("CASE video_id % 7 WHEN 0 THEN 'derived' WHEN 1 THEN 'raw' WHEN 2 THEN 'all' END")).filter("scope is not null")
    out = None
    for kind in ("derived", "index", "raw", "translations", "job"):
        left = B.purge(v, asked, kind).groupBy(F.lit(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        out = left if out is None else out.unionByName(left)
    return out


# --- predicates -----------------------------------------------------------------------------


@query("fil3_caption_trust", "SELECT lang, lang || '-orig' AS track, true AS trusted, false AS plain, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    d = A.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    track = F.concat("lang", F.lit("-orig"))
    return d.select("lang", track.alias("track"), C.trusted(track).alias("trusted"), C.trusted(F.col("lang")).alias("plain"), "n")


@query(
    "fil4_embed_gate",
    """SELECT 'register' AS gate, video_id FROM v_videos WHERE playable_in_embed = false AND video_id % 4 <> 0 AND video_id % 5 <> 0
    UNION ALL SELECT 'translate', video_id FROM v_videos WHERE playable_in_embed = false AND video_id % 2 <> 0 AND video_id % 5 <> 0""",
)
def _(spark, sf):
    v = A.videos(spark, sf)
    forced = v.filter("video_id % 5 = 0")
    first = B.blocked(v, v.filter("video_id % 4 = 0"), forced).select(F.lit("register").alias("gate"), "video_id")
    return first.unionByName(B.blocked(v, v.filter("video_id % 2 = 0"), forced).select(F.lit("translate").alias("gate"), "video_id"))


@query(
    "fil5_particle_fragments",
    """SELECT text, count(*) AS n FROM v_words WHERE regexp_matches(regexp_replace(trim(text), '^[.,!?;:()\\[\\]{}"'']+', ''), '^(이라는|라는|이라고|라고|의|와|과|을|를)') GROUP BY 1""",
)
def _(spark, sf):
    return A.words(spark, sf).filter(X.particle_fragment(F.col("text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


EVERYDAY = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.EVERYDAY_WORDS) + "]"


@query(
    "fil8_everyday_words",
    f"""SELECT text, count(*) AS n FROM v_words WHERE text = lower(text) AND len(regexp_extract_all(text, '[A-Za-z'']+')) > 0
      AND len(list_filter(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: NOT list_contains({EVERYDAY}, x))) = 0 GROUP BY 1""",
)
def _(spark, sf):
    return A.words(spark, sf).filter(X.everyday(F.col("text"))).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fil9_redaction",
    r"""SELECT doc_id, regexp_replace(replace(CASE WHEN doc_id % 9 = 0 THEN text || ' AIza' || repeat('a', 32) ELSE text END, 'the thin', '***'),
      'AIza[0-9A-Za-z_-]{30,}|AQ\.[A-Za-z0-9_.-]{20,}', '***', 'g') AS text FROM documents""",
)
def _(spark, sf):
    return A.secret_texts(spark, sf).select("doc_id", X.redact(F.col("text"), ["the thin", "short"]).alias("text"))


# --- captions -------------------------------------------------------------------------------


@query(
    "agg14_caption_health",
    """SELECT video_id, t AS present, CASE WHEN t THEN n ELSE 0 END AS n_cues, CASE WHEN t THEN language END AS language,
      t AND original AS original, NOT t OR error IS NOT NULL AS failed FROM (
      SELECT k.*, k.video_id % 6 <> 1 AS t, n FROM v_tracks k JOIN (SELECT video_id, count(*) AS n FROM v_cues GROUP BY 1) USING (video_id))""",
)
def _(spark, sf):
    known = A.videos(spark, sf)
    tracks = A.caption_tracks(spark, sf).filter("video_id % 6 <> 1")
    counts = A.cues(spark, sf).filter("video_id % 6 <> 1").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cues"))
    return C.health(tracks, counts, known)


@query(
    "win24_track_choice",
    """SELECT video_id, CASE WHEN video_id % 4 = 0 THEN 'v.en-orig.srt' WHEN video_id % 4 = 1 THEN 'v.ko-orig.srt'
      WHEN video_id % 4 = 2 THEN 'v.ko.srt' ELSE 'v.aa.srt' END AS name,
      CASE WHEN video_id % 4 = 0 THEN 'en-orig' WHEN video_id % 4 = 1 THEN 'ko-orig' WHEN video_id % 4 = 2 THEN 'ko' ELSE 'aa' END AS lang
    FROM v_videos""",
)
def _(spark, sf):
    # originals with an exact match; originals by base language; requested order; first by name
    langs = F.expr(
        "CASE video_id % 4 WHEN 0 THEN array('aa-orig', 'en-orig', 'ko') WHEN 1 THEN array('aa-orig', 'ko-orig', 'en') "
        "WHEN 2 THEN array('en', 'ko') ELSE array('zz', 'aa') END"
    )
    tracks = A.videos(spark, sf).select(
        "video_id", F.explode(langs).alias("lang"),
        F.expr("CASE video_id % 4 WHEN 0 THEN 'en-orig' WHEN 1 THEN 'ko-KR' END").alias("preferred"),
        F.array(F.lit("ko"), F.lit("en")).alias("requested"),
    ).withColumn("name", F.concat(F.lit("v."), F.col("lang"), F.lit(".srt")))
    return C.pick_track(tracks)


# --- excerpts and frames --------------------------------------------------------------------

cte("v_asked", """SELECT video_id, cue_idx AS request_id, cue_start AS r_start, CASE WHEN cue_idx % 40 = 0 THEN cue_start + 9000 ELSE cue_start + 21.5e0 END AS r_end
  FROM v_cues""")
cte(
    "v_excerpt",
    """SELECT a.video_id, request_id, coalesce(string_agg(w.text, ' ' ORDER BY w.idx), '') AS t, count(w.idx) AS word_count FROM v_asked a
    LEFT JOIN v_words w ON w.video_id = a.video_id AND w.end_s >= r_start AND w.start_s <= r_end GROUP BY 1, 2""",
)


def excerpt_requests(spark, sf):
    return A.cues(spark, sf).select(
        "video_id", F.col("cue_idx").alias("request_id"), F.col("cue_start").alias("r_start"),
        F.when(F.col("cue_idx") % 40 == 0, F.col("cue_start") + 9000.0).otherwise(F.col("cue_start") + 21.5).alias("r_end"),
    )


@query(
    "jon6_time_excerpts",
    """SELECT e.video_id, e.request_id, word_count, t AS text, (SELECT count(*) FROM v_frames f JOIN v_asked a ON a.video_id = f.video_id
      WHERE a.video_id = e.video_id AND a.request_id = e.request_id AND frame_at BETWEEN r_start AND r_end) AS n_frames FROM v_excerpt e""",
)
def _(spark, sf):
    return E.excerpts(excerpt_requests(spark, sf), A.words(spark, sf), A.frames(spark, sf)).select(
        "video_id", "request_id", "word_count", "text", "n_frames"
    )


@query(
    "top3_excerpt_cut",
    """SELECT doc_id, length(text) > 12000 AS truncated, CASE WHEN length(text) <= 12000 THEN text
      WHEN strpos(reverse(left(text, 12000)), ' ') IN (0, 12000) THEN left(text, 12000)
      ELSE left(text, 12000 - strpos(reverse(left(text, 12000)), ' ')) END AS text FROM documents""",
)
def _(spark, sf):
    long = F.length("text") > E.MAX_EXCERPT
    return A.table(spark, sf, "documents").select(
        "doc_id", long.alias("truncated"), F.when(long, E.cut_text(F.col("text"), E.MAX_EXCERPT)).otherwise(F.col("text")).alias("text")
    )


@query(
    "jon5_evidence_frames",
    """SELECT s.video_id, s.span_idx, count(f.frame_no) AS n_frames, coalesce(string_agg(f.frame_no::VARCHAR, ',' ORDER BY frame_at), '') AS frame_nos
    FROM v_spans s LEFT JOIN v_frames f ON f.video_id = s.video_id AND frame_at BETWEEN s.start_s - 2e0 AND s.end_s + 2e0 GROUP BY 1, 2""",
)
def _(spark, sf):
    spans = S.spans(A.words(spark, sf)).select("video_id", "span_idx", "start_s", "end_s")
    hit = interval_join(
        spans, A.frames(spark, sf).select("video_id", "frame_no", "frame_at"), "video_id",
        (F.col("start_s") - 2.0, F.col("end_s") + 2.0), (F.col("frame_at"), F.col("frame_at")), 60.0,
    ).groupBy("video_id", "span_idx").agg(F.array_sort(F.collect_list(F.struct("frame_at", "frame_no"))).alias("fs"))
    return spans.join(hit, ["video_id", "span_idx"], "left").select(
        "video_id", "span_idx", F.coalesce(F.size("fs"), F.lit(0)).alias("n_frames"),
        F.coalesce(F.array_join(F.transform("fs", lambda x: x["frame_no"].cast("string")), ","), F.lit("")).alias("frame_nos"),
    )


# --- metering -------------------------------------------------------------------------------


@query("agg24_daily_attempts", "SELECT key_hash, pday AS day, count(*) AS attempts FROM v_attempts GROUP BY 1, 2")
def _(spark, sf):
    return U.daily(A.attempts(spark, sf))


@query(
    "win9_minute_window",
    """SELECT a.event_id, count(*) AS rpm_attempts, CASE WHEN count(*) >= 2 THEN
      epoch_us(list_sort(list(b.ts))[count(*) - 1]) + 60000000 - epoch_us(a.ts) ELSE 0 END AS wait_us
    FROM v_attempts a JOIN v_attempts b ON b.key_hash = a.key_hash AND b.pday = a.pday AND b.ts <= a.ts AND epoch_us(b.ts) > epoch_us(a.ts) - 60000000
    GROUP BY a.event_id, a.ts""",
)
def _(spark, sf):
    return U.recent(A.attempts(spark, sf), 2).select("event_id", "rpm_attempts", "wait_us")


cte(
    "v_requests",
    """SELECT event_id AS request_id, key_hash, ts + INTERVAL 5 SECOND AS ts, event_id % 30 AS expected_calls, event_id % 2 = 0 AS free_mode,
      ((ts::TIMESTAMP + INTERVAL 5 SECOND) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE::VARCHAR AS rday FROM v_attempts""",
)


@query(
    "agg25_quota_preflight",
    """SELECT request_id, attempts, rpm_attempts, greatest(0, 60 - attempts) AS remaining, CASE WHEN free_mode AND expected_calls > greatest(0, 60 - attempts)
      THEN 'daily limit' WHEN rpm_attempts >= 2 THEN 'minute limit' ELSE 'ok' END AS verdict FROM (
      SELECT r.request_id, r.expected_calls, r.free_mode, count(a.event_id) AS attempts, count(a.event_id) FILTER (epoch_us(a.ts) > epoch_us(r.ts) - 60000000) AS rpm_attempts
      FROM v_requests r LEFT JOIN v_attempts a ON a.key_hash = r.key_hash AND a.pday = r.rday AND a.ts <= r.ts GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    a = A.attempts(spark, sf)
    requests = a.select(
        F.col("event_id").alias("request_id"), "key_hash", F.expr("ts + interval 5 seconds").alias("ts"),
        (F.col("event_id") % 30).alias("expected_calls"), (F.col("event_id") % 2 == 0).alias("free_mode"),
        F.lit(60).alias("daily_limit"), F.lit(2).alias("rpm_limit"),
    )
    return U.preflight(requests, a).select("request_id", "attempts", "rpm_attempts", "remaining", "verdict")


# --- streams --------------------------------------------------------------------------------


def attempt_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select(
        F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("key_hash"), "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("str1_daily_stream", "SELECT key_hash, pday AS day, count(*) AS attempts FROM v_attempts GROUP BY 1, 2")
def _(spark, sf):
    out = I.scratch(spark, "daily")
    J.run_available(J.per_day(attempt_stream(spark, sf)), out, out + "-state")
    return J.latest(spark, out, ["key_hash", "day"], "attempts")


@query(
    "str1_minute_stream",
    "SELECT key_hash, strftime(date_trunc('minute', ts::TIMESTAMP), '%Y-%m-%d %H:%M') AS minute, count(*) AS attempts FROM v_attempts GROUP BY 1, 2",
)
def _(spark, sf):
    out = I.scratch(spark, "minutes")
    J.run_available(J.per_minute(attempt_stream(spark, sf)), out, out + "-state")
    return J.latest(spark, out, ["key_hash", "minute"], "attempts").withColumn(
        "minute", F.date_format("minute", "yyyy-MM-dd HH:mm")
    )


@query(
    "str2_chunk_ingest",
    """SELECT video_id, chunk_index, count(DISTINCT (start_r, end_r, text)) AS n_words FROM v_rep JOIN v_gate USING (video_id, chunk_index)
    WHERE accepted GROUP BY 1, 2""",
)
def _(spark, sf):
    source, out = I.scratch(spark, "responses"), I.scratch(spark, "ingested")
    responses(spark, sf).repartition(4).write.json(source)
    J.ingest(spark, source, out, out + "-state", files_per_batch=2)
    return J.current_words(spark, out).groupBy("video_id", "chunk_index").agg(F.count(F.lit(1)).alias("n_words"))


# --- scalar expressions ---------------------------------------------------------------------


@query("sca1_srt_times", "SELECT video_id, cue_idx, cue_start AS parsed FROM v_cues")
def _(spark, sf):
    return A.cues(spark, sf).select("video_id", "cue_idx", X.srt_seconds(X.srt_time(F.col("cue_start"))).alias("parsed"))


@query(
    "sca2_timecodes",
    "SELECT video_id, cue_idx, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS timecode FROM (SELECT *, round_even(cue_start * 50, 0)::BIGINT AS s FROM v_cues)",
)
def _(spark, sf):
    return A.cues(spark, sf).select("video_id", "cue_idx", X.timecode(F.col("cue_start") * 50).alias("timecode"))


@query("sca4_word_keys", r"SELECT text, lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS key, count(*) AS n FROM v_words GROUP BY 1, 2")
def _(spark, sf):
    return A.words(spark, sf).groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn("key", X.word_key(F.col("text")))


@query(
    "sca5_compare_keys",
    r"""SELECT text, regexp_replace(lower(regexp_replace(regexp_replace(text, '^[.,;:!?"''()\[\]]+', ''), '[.,;:!?"''()\[\]]+$', '')), '[^0-9a-z.]+', '', 'g') AS key
    FROM v_words GROUP BY 1""",
)
def _(spark, sf):
    return A.words(spark, sf).select("text").distinct().withColumn("key", X.compare_key(F.col("text")))


LATIN = L.LATIN_TOKEN.replace("'", "''")


@query("sca6_latin_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LATIN}')) AS token FROM documents) GROUP BY 1")
def _(spark, sf):
    return A.table(spark, sf, "documents").select(F.explode(X.latin_tokens(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "sca7_content_tokens",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(list_transform(regexp_extract_all(text, '{L.CONTENT_TOKEN}'),
      lambda x: lower(regexp_replace(x, '^[._+#-]+|[._+#-]+$', '', 'g'))), lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x)
      AND NOT regexp_matches(x, '^[0-9]+$'))) AS token FROM documents) GROUP BY 1""",
)
def _(spark, sf):
    return A.table(spark, sf, "documents").select(F.explode(X.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "sca11_cosmetic_keys",
    "SELECT text, regexp_replace(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g'), 's$', '') AS key FROM v_words GROUP BY 1",
)
def _(spark, sf):
    return A.words(spark, sf).select("text").distinct().withColumn("key", X.cosmetic_key(F.col("text")))


@query(
    "sca12_confidence",
    """SELECT speaker_status, CASE speaker_status WHEN 'confirmed' THEN 1e0 WHEN 'inferred' THEN 0.75e0 WHEN 'unresolved' THEN 0e0 END AS confidence,
      count(*) AS n FROM v_words GROUP BY 1""",
)
def _(spark, sf):
    return A.words(spark, sf).groupBy("speaker_status").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "confidence", X.speaker_confidence(F.col("speaker_status"))
    )


@query(
    "sca13_ocr_language",
    "SELECT video_id, CASE WHEN video_id % 3 = 0 THEN CASE WHEN video_id % 2 = 0 THEN 'fr' END ELSE regexp_replace(language, '-orig$', '') END AS ocr_language FROM v_tracks",
)
def _(spark, sf):
    codes = F.expr("CASE WHEN video_id % 2 = 0 THEN array(' fr ', 'en') END")
    own = F.when(F.col("video_id") % 3 == 0, F.lit(" ")).otherwise(F.col("language"))
    return A.caption_tracks(spark, sf).select("video_id", B.ocr_language(own, codes).alias("ocr_language"))


@query(
    "sca15_contractions",
    """SELECT a, a || ' is' AS s_form, a || ' not' AS n_form, a || ' would have' AS two FROM (SELECT DISTINCT text AS a FROM v_words WHERE regexp_matches(text, '^[A-Za-z]+$'))""",
)
def _(spark, sf):
    words = A.words(spark, sf).filter(F.col("text").rlike("^[A-Za-z]+$")).select(F.col("text").alias("a")).distinct()

    def spelled(suffix: str):
        return F.array_join(X.expand_contractions(X.split_ws(F.concat("a", F.lit(suffix)))), " ")

    return words.select("a", spelled("'s").alias("s_form"), spelled("n't").alias("n_form"), spelled("'d have").alias("two"))


@query(
    "set3_shared_spellings",
    """SELECT DISTINCT text AS a FROM v_words WHERE regexp_matches(text, '^[A-Za-z]{3,}$')""",
)
def _(spark, sf):
    words = A.words(spark, sf).filter(F.col("text").rlike("^[A-Za-z]{3,}$")).select(F.col("text").alias("a")).distinct()
    other = F.concat(F.substring("a", 1, 1), F.lit("-"), F.substring("a", 2, 999), F.lit("'s"))
    same = F.concat(F.upper("a"), F.lit(" is"))
    return words.filter(F.arrays_overlap(X.loose_forms(other), X.loose_forms(same)))
