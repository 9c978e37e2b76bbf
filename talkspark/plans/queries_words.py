"""Normalisation, chunk, speaker, guard and gap-fill queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.operators import chunks as K
from talkspark.operators import gapfill as G
from talkspark.operators import guard as D
from talkspark.operators import normalize as N
from talkspark.operators import speakers as P
from talkspark.plans.oracle import cte
from talkspark.plans.registry import query
from talkspark.sources import adapters as A
from talkspark.sources.responses import response_rows

# --- responses ------------------------------------------------------------------------------

cte(
    "v_entries",
    r"""SELECT *, try_cast(regexp_extract(start_offset, '^([0-9]+(?:\.[0-9]+)?)s?$', 1) AS DOUBLE) AS start_s,
    try_cast(regexp_extract(end_offset, '^([0-9]+(?:\.[0-9]+)?)s?$', 1) AS DOUBLE) AS end_s,
    chunk_end - chunk_start AS audio_s FROM v_rw""",
)
cte(
    "v_cap",
    """SELECT video_id, chunk_index, greatest(coalesce(max(d) FILTER (rn = least(floor(n * 0.99e0)::BIGINT, n - 1)), 0.5e0), 0.5e0) AS cap
    FROM (SELECT video_id, chunk_index FROM v_entries GROUP BY ALL) LEFT JOIN (
      SELECT video_id, chunk_index, end_s - start_s AS d,
        row_number() OVER (PARTITION BY video_id, chunk_index ORDER BY end_s - start_s) - 1 AS rn,
        count(*) OVER (PARTITION BY video_id, chunk_index) AS n
      FROM v_entries WHERE start_s >= 0 AND end_s >= start_s) USING (video_id, chunk_index) GROUP BY 1, 2""",
)
cte(
    "v_rep",
    """SELECT *, s2 AS start_r, CASE WHEN bad_end THEN round(s2 + cap, 3) ELSE end_s END AS end_r FROM (
      SELECT *, end_s IS NULL OR end_s < s2 OR end_s > audio_s + 5e0 AS bad_end FROM (
        SELECT *, CASE WHEN bad_start THEN coalesce(max(CASE WHEN NOT bad_start AND end_s IS NOT NULL AND end_s >= start_s
            AND end_s <= audio_s + 5e0 THEN end_s END) OVER (PARTITION BY video_id, chunk_index ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) ELSE start_s END AS s2
        FROM (SELECT *, start_s IS NULL OR start_s < 0 OR start_s > audio_s + 5e0 AS bad_start
          FROM v_entries JOIN v_cap USING (video_id, chunk_index))))""",
)


def responses(spark, sf):
    """Nested JSON per chunk, with an entry of another type and a blank one mixed in."""
    note = F.struct(
        F.lit("word_info").alias("type"), F.concat(F.lit(" "), F.col("text")).alias("text"),
        "start_offset", "end_offset", "speaker",
    )
    other = F.struct(
        F.lit("note").alias("type"), F.lit("x").alias("text"), F.lit("0s").alias("start_offset"),
        F.lit("1s").alias("end_offset"), F.lit(None).cast("string").alias("speaker"),
    )
    blank = other.withField("type", F.lit("word_info")).withField("text", F.lit("  "))
    rows = A.response_words(spark, sf).groupBy("video_id", "chunk_index", "chunk_start", "chunk_end").agg(
        F.array_sort(F.collect_list(F.struct("pos", note.alias("note")))).getField("note").alias("notes")
    )
    content = F.struct(F.concat(F.array(other, blank), F.col("notes")).alias("annotations"))
    step = F.struct(F.array(content).alias("content"))
    return rows.select(
        "video_id", "chunk_index", "chunk_start", "chunk_end",
        F.to_json(F.struct(F.array(step).alias("steps"))).alias("response"),
    )


def entries(spark, sf):
    return cut(
        response_rows(responses(spark, sf))
        .withColumn("audio_s", F.col("chunk_end") - F.col("chunk_start"))
        .drop("at")
    )


@query(
    "src4_response_words",
    """SELECT video_id, chunk_index, row_number() OVER (PARTITION BY video_id, chunk_index ORDER BY pos) + 1 AS at, text,
      start_s, end_s, speaker FROM v_entries""",
)
def _(spark, sf):
    return entries(spark, sf).select(
        "video_id", "chunk_index", F.col("pos").alias("at"), "text", "start_s", "end_s", "speaker"
    )


@query("agg2_duration_cap", "SELECT * FROM v_cap")
def _(spark, sf):
    return N.duration_caps(entries(spark, sf))


@query(
    "win1_timestamp_repair",
    """SELECT video_id, chunk_index, text, start_r AS start_s, end_r AS end_s, bad_start, bad_end FROM v_rep""",
)
def _(spark, sf):
    return N.repair(entries(spark, sf)).select(
        "video_id", "chunk_index", "text", "start_s", "end_s", "bad_start", "bad_end"
    )


@query(
    "win1_repair_log",
    """SELECT video_id, chunk_index, text, 'start' AS field, start_s AS from_s, start_r AS to_s FROM v_rep WHERE bad_start
    UNION ALL SELECT video_id, chunk_index, text, 'end', end_s, end_r FROM v_rep WHERE bad_end""",
)
def _(spark, sf):
    return N.repair_log(N.repair(entries(spark, sf))).drop("pos")


@query(
    "win2_drop_duplicates",
    """SELECT video_id, chunk_index, start_s, end_s, text, min(pos) AS pos, arg_min(speaker, pos) AS speaker FROM (
      SELECT video_id, chunk_index, start_s, end_s, text, pos * 2 AS pos, speaker_raw AS speaker FROM v_cw
      UNION ALL SELECT video_id, chunk_index, start_s, end_s, text, pos * 2 + 1, 'spk:9' FROM v_cw WHERE pos % 5 = 0)
    GROUP BY 1, 2, 3, 4, 5""",
)
def _(spark, sf):
    w = A.chunk_words(spark, sf).select(
        "video_id", "chunk_index", "start_s", "end_s", "text", (F.col("pos") * 2).alias("pos"),
        F.col("speaker_raw").alias("speaker"),
    )
    again = w.filter("pos % 10 = 0").withColumn("pos", F.col("pos") + 1).withColumn("speaker", F.lit("spk:9"))
    return N.drop_duplicates(w.unionByName(again))


cte(
    "v_gate",
    """SELECT video_id, chunk_index, n_repairs, n_words, greatest(3, floor(n_words * 0.005e0))::BIGINT AS allowance,
      n_words > 0 AND n_repairs <= greatest(3, floor(n_words * 0.005e0)) AS accepted
    FROM (SELECT video_id, chunk_index, sum(bad_start::INT + bad_end::INT) AS n_repairs,
      count(DISTINCT (start_r, end_r, text)) AS n_words FROM v_rep GROUP BY 1, 2)""",
)


@query("agg3_corruption_gate", "SELECT * FROM v_gate")
def _(spark, sf):
    return N.corruption(N.repair(entries(spark, sf)))


@query(
    "cmp6_absolute_time",
    """SELECT video_id, chunk_index, text, round(start_r + cs, 3) AS start_s, round(end_r + cs, 3) AS end_s
    FROM (SELECT *, round(chunk_start * 1000) / 1e3 AS cs FROM v_rep)""",
)
def _(spark, sf):
    # chunk starts on the millisecond grid, so that no sum is a rounding tie
    e = entries(spark, sf).withColumn("chunk_start", F.round(F.col("chunk_start") * 1000) / F.lit(1000.0))
    return N.absolute(N.repair(e)).select(
        "video_id", "chunk_index", "text", "start_s", "end_s"
    )


@query(
    "sca3_offset_parse",
    r"""SELECT off, count(*) AS n, min(try_cast(regexp_extract(trim(off), '^([0-9]+(?:\.[0-9]+)?)s?$', 1) AS DOUBLE)) AS secs
    FROM (SELECT CASE pos % 5 WHEN 0 THEN start_offset WHEN 1 THEN '12' WHEN 2 THEN ' 7.25s ' WHEN 3 THEN '-3s' ELSE '1.s' END AS off
      FROM v_rw) GROUP BY 1""",
)
def _(spark, sf):
    off = F.expr(
        "CASE pos % 5 WHEN 0 THEN start_offset WHEN 1 THEN '12' WHEN 2 THEN ' 7.25s ' WHEN 3 THEN '-3s' ELSE '1.s' END"
    )
    return A.response_words(spark, sf).select(off.alias("off")).groupBy("off").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("secs", X.parse_offset(F.col("off")))


# --- chunk plans and jobs -------------------------------------------------------------------


@query("win23_chunk_plan", "SELECT video_id, chunk_index, n_chunks, chunk_start, chunk_end FROM v_chunks")
def _(spark, sf):
    return A.chunks(spark, sf)


cte(
    "v_jobs",
    """SELECT *, CASE (video_id + chunk_index) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'planned' ELSE 'complete' END AS status,
    chunk_index + 1 AS attempts, (video_id * 3 + chunk_index) % 5 <> 0 AS has_text FROM v_chunks""",
)


def jobs(spark, sf):
    return A.chunks(spark, sf).withColumn(
        "status",
        F.expr("CASE (video_id + chunk_index) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'planned' ELSE 'complete' END"),
    ).withColumn("attempts", F.col("chunk_index") + 1)


def stored(spark, sf):
    return A.chunks(spark, sf).filter("(video_id * 3 + chunk_index) % 5 <> 0").select("video_id", "chunk_index")


@query(
    "jon9_carry_progress",
    """SELECT video_id, chunk_index, chunk_start, chunk_end, CASE WHEN c THEN 'complete' ELSE 'planned' END AS status,
      CASE WHEN c THEN attempts ELSE 0 END AS attempts, c AS carried
    FROM (SELECT *, status = 'complete' AND has_text AND chunk_index % 3 <> 1 AS c FROM v_jobs)""",
)
def _(spark, sf):
    old = jobs(spark, sf).withColumn(
        "chunk_end", F.when(F.expr("chunk_index % 3 = 1"), F.col("chunk_end") + 1.0).otherwise(F.col("chunk_end"))
    )
    return K.carry_progress(old, A.chunks(spark, sf), stored(spark, sf))


@query("jon10_pending_chunks", "SELECT video_id, chunk_index, status FROM v_jobs WHERE NOT (status = 'complete' AND has_text)")
def _(spark, sf):
    return K.pending(jobs(spark, sf), stored(spark, sf)).select("video_id", "chunk_index", "status")


@query(
    "jon11_reusable_responses",
    """SELECT video_id, chunk_index, chunk_start FROM v_chunks WHERE (video_id + chunk_index) % 3 <> 0""",
)
def _(spark, sf):
    tags = A.chunks(spark, sf).select(
        "video_id", "chunk_index", "chunk_start", "chunk_end",
        F.when(F.col("video_id") % 2 == 0, "auto").alias("requested_langs"),
        F.sha2(F.col("video_id").cast("string"), 256).alias("fingerprint"),
    )
    raw = tags.withColumn(
        "requested_langs",
        F.when(F.expr("(video_id + chunk_index) % 3 = 0"), "ko").otherwise(F.col("requested_langs")),
    )
    return K.reusable(tags, raw).select("video_id", "chunk_index", "chunk_start")


@query(
    "agg13_job_status",
    """SELECT video_id, count(*) AS total, count(*) FILTER (status = 'complete') AS complete,
      count(*) FILTER (has_text) AS transcripts, count(*) FILTER (status = 'failed') AS failed,
      coalesce(string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) FILTER (status = 'failed'), '') AS failed_chunks,
      CASE WHEN video_id % 3 = 0 THEN 'active' WHEN video_id % 3 = 1 THEN 'skipped'
        WHEN count(*) FILTER (status = 'complete') > 0 THEN 'unknown' ELSE 'not-run' END AS guard_state,
      count(*) FILTER (has_text) > count(*) FILTER (status = 'complete') AS ledger_behind
    FROM v_jobs GROUP BY 1""",
)
def _(spark, sf):
    guard = A.videos(spark, sf).select(
        "video_id", F.expr("CASE video_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'skipped' END").alias("translation_guard")
    )
    return K.job_rollup(jobs(spark, sf), stored(spark, sf), guard)


@query(
    "agg7_guard_state",
    """SELECT CASE WHEN video_id % 3 = 0 THEN 'active' WHEN complete > 0 THEN 'unknown' ELSE 'not-run' END AS guard_state,
      count(*) AS n FROM (SELECT video_id, count(*) FILTER (status = 'complete') AS complete FROM v_jobs GROUP BY 1) GROUP BY 1""",
)
def _(spark, sf):
    done = jobs(spark, sf).groupBy("video_id").agg(F.count_if(F.col("status") == "complete").alias("complete"))
    recorded = F.when(F.col("video_id") % 3 == 0, F.lit("active"))
    return done.select(K.guard_state(recorded, F.col("complete")).alias("guard_state")).groupBy("guard_state").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- speakers -------------------------------------------------------------------------------

KEY = r"lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g'))"
cte("v_key", f"SELECT *, {KEY} AS key FROM v_cw")
cte(
    "v_same",
    """SELECT a.video_id, a.key, a.chunk_index AS ac, a.pos AS ap, a.speaker_raw AS ar, b.chunk_index AS bc, b.pos AS bp,
      b.speaker_raw AS br
    FROM v_key a JOIN v_key b ON a.video_id = b.video_id AND a.key = b.key AND a.key <> '' AND a.chunk_index < b.chunk_index
      AND abs(a.start_s - b.start_s) <= 0.75e0 AND abs(a.end_s - b.end_s) <= 0.75e0""",
)


@query("jon2_same_words", "SELECT video_id, key, ac, ap, bc, bp FROM v_same")
def _(spark, sf):
    return P.same_words(cut(A.chunk_words(spark, sf))).select(
        "video_id", "key", F.col("a_chunk_index").alias("ac"), F.col("a_pos").alias("ap"),
        F.col("b_chunk_index").alias("bc"), F.col("b_pos").alias("bp"),
    )


@query(
    "agg8_speaker_votes",
    """SELECT video_id, bc AS chunk_index, br AS raw, ac AS from_chunk, ar AS from_raw, count(*) AS n FROM v_same GROUP BY ALL""",
)
def _(spark, sf):
    w = cut(A.chunk_words(spark, sf))
    return P.votes(w, w.select("video_id", "chunk_index", "pos").filter("false"))


# each dropped word, decided in arrival order against words already kept
@query(
    "cmp1_overlap_duplicates",
    """SELECT video_id, chunk_index, pos FROM v_key k WHERE key <> '' AND chunk_index > 0 AND EXISTS (
      SELECT 1 FROM v_chunks c JOIN v_chunks p ON p.video_id = c.video_id AND p.chunk_index = c.chunk_index - 1
      JOIN v_key o ON o.video_id = c.video_id
      WHERE c.video_id = k.video_id AND c.chunk_index = k.chunk_index AND o.key = k.key
        AND k.start_s >= c.chunk_start - 0.75e0 AND k.start_s < p.chunk_end + 0.75e0
        AND o.start_s >= c.chunk_start - 0.75e0 AND o.start_s < p.chunk_end + 0.75e0
        AND (o.chunk_index < k.chunk_index OR (o.chunk_index = k.chunk_index AND o.pos < k.pos))
        AND abs(o.start_s - k.start_s) <= 0.75e0 AND abs(o.end_s - k.end_s) <= 0.75e0)""",
)
def _(spark, sf):
    w = cut(A.chunk_words(spark, sf))
    return cut(P.dropped_words(w, cut(A.chunks(spark, sf))))


@query("cmp2_speaker_mapping")
def _(spark, sf):
    w = cut(A.chunk_words(spark, sf))
    gone = cut(P.dropped_words(w, cut(A.chunks(spark, sf))))
    return P.mapping(P.labels(w), P.votes(w, gone))


@query("cmp3_fresh_speakers")
def _(spark, sf):
    w = cut(A.chunk_words(spark, sf))
    gone = cut(P.dropped_words(w, cut(A.chunks(spark, sf))))
    return P.mapping(P.labels(w), P.votes(w, gone)).filter("speaker_status = 'unresolved'")


@query("cmp2_reconciled_words")
def _(spark, sf):
    return P.reconcile(cut(A.chunk_words(spark, sf)), cut(A.chunks(spark, sf))).select(
        "video_id", "pos", "text", "start_s", "end_s", "speaker", "speaker_raw", "speaker_global",
        "speaker_status", "speaker_evidence",
    )


@query(
    "cmp4_speaker_enrichment",
    """SELECT video_id, chunk_index, pos, CASE WHEN chunk_index % 2 = 0 THEN 'speaker:' || right(speaker_raw, 1) ELSE speaker_raw END AS speaker,
      speaker_raw, CASE WHEN chunk_index % 2 = 0 THEN 'speaker:' || right(speaker_raw, 1) END AS speaker_global,
      CASE WHEN chunk_index % 2 = 0 THEN 'confirmed' ELSE 'unresolved' END AS speaker_status FROM v_cw""",
)
def _(spark, sf):
    w = cut(A.chunk_words(spark, sf))
    m = P.labels(w).filter("chunk_index % 2 = 0").select(
        "video_id", "chunk_index", "raw", F.concat(F.lit("speaker:"), F.right("raw", F.lit(1))).alias("speaker_global"),
        F.lit("confirmed").alias("speaker_status"), F.lit(None).cast("string").alias("speaker_evidence"),
    )
    return P.enrich(w, m).select(
        "video_id", "chunk_index", "pos", "speaker", "speaker_raw", "speaker_global", "speaker_status"
    )


# --- translation guard ----------------------------------------------------------------------


def sql_counts(text: str, prefix: str) -> str:
    return ", ".join(
        f"length(regexp_replace({text}, '{L.script_class(s).replace('[', '[^', 1)}', '', 'g')) AS {prefix}{s}" for s in L.SCRIPTS
    )


def sql_total(prefix: str) -> str:
    return "(" + " + ".join(prefix + s for s in L.SCRIPTS) + ")"


def sql_dominant(prefix: str) -> str:
    best = "greatest(" + ", ".join(f"{{'n': {prefix}{s}, 's': '{s}'}}" for s in L.SCRIPTS) + ")"
    t = sql_total(prefix)
    return (
        f"CASE WHEN {t} = 0 THEN NULL WHEN {prefix}japanese / {t} >= 0.05e0 THEN 'japanese' "
        f"WHEN ({best}).n / {t} >= 0.3e0 THEN ({best}).s END"
    )


LANGS = "(VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in L.LANGUAGE_SCRIPT.items()) + ") ls(code, script)"
cte("v_lang", f"SELECT * FROM {LANGS}")
cte("v_scripts", f"SELECT *, {sql_counts('text', 'n_')} FROM v_guard")


@query("agg4_script_histogram", "SELECT doc_id, n_latin, n_hangul, n_han, n_japanese, n_cyrillic FROM v_scripts")
def _(spark, sf):
    return D.script_counts(A.guard_texts(spark, sf)).select(
        "doc_id", "n_latin", "n_hangul", "n_han", "n_japanese", "n_cyrillic"
    )


@query("agg5_dominant_script", f"SELECT doc_id, {sql_dominant('n_')} AS script FROM v_scripts")
def _(spark, sf):
    return D.script_counts(A.guard_texts(spark, sf)).select("doc_id", D.dominant().alias("script"))


cte(
    "v_meta",
    """SELECT video_id, coalesce((SELECT script FROM v_lang WHERE code = v.language),
      CASE WHEN len(auto_caption_langs) > 0 THEN 'latin' END) AS meta_script FROM v_videos v""",
)
cte(
    "v_gchunk",
    f"""SELECT *, {sql_counts('text', 'n_')}, {sql_counts('captions', 'c_')} FROM (
      SELECT k.video_id, k.chunk_index, m.meta_script, t.language AS captions_language,
        CASE k.chunk_index % 3 WHEN 1 THEN 'auto' WHEN 2 THEN 'ko-KR,ja' ELSE 'en' END AS langs,
        (SELECT string_agg(cue_text, ' ' ORDER BY cue_idx) FROM v_cues c WHERE c.video_id = k.video_id
          AND c.cue_end >= k.chunk_start AND c.cue_start <= k.chunk_end) AS captions,
        CASE WHEN (k.video_id + k.chunk_index) % 5 = 0 THEN repeat('안녕하세요 여러분 ', 9)
          ELSE (SELECT string_agg(w.text, ' ' ORDER BY pos) FROM v_cw w WHERE w.video_id = k.video_id
            AND w.chunk_index = k.chunk_index) END AS text
      FROM v_chunks k JOIN v_meta m USING (video_id) JOIN v_tracks t USING (video_id))""",
)
cte(
    "v_gflag",
    f"""SELECT *, CASE expected_script {' '.join(f"WHEN '{s}' THEN n_{s}" for s in L.SCRIPTS if s != 'japanese')}
        WHEN 'japanese' THEN n_japanese + n_han ELSE 0 END / {sql_total('n_')} AS share FROM (
      SELECT *, coalesce(CASE WHEN captions_language LIKE '%-orig' AND length(captions) >= 20 THEN {sql_dominant('c_')} END,
        CASE langs WHEN 'en' THEN 'latin' END, meta_script) AS expected_script FROM v_gchunk)""",
)


def guard_rows(spark, sf):
    from talkspark.operators.captions import text_in_ranges

    chunks = cut(A.chunks(spark, sf))
    caps = text_in_ranges(
        chunks.select(
            "video_id", F.col("chunk_index").alias("range_id"), F.col("chunk_start").alias("r_start"),
            F.col("chunk_end").alias("r_end"),
        ),
        A.cues(spark, sf),
    ).select("video_id", F.col("range_id").alias("chunk_index"), F.col("caption_text").alias("captions"))
    said = A.chunk_words(spark, sf).groupBy("video_id", "chunk_index").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text"))).getField("text"), " ").alias("said")
    )
    return (
        chunks.select("video_id", "chunk_index")
        .join(said, ["video_id", "chunk_index"])
        .join(caps, ["video_id", "chunk_index"], "left")
        .join(D.metadata_script(A.videos(spark, sf)), "video_id")
        .join(A.caption_tracks(spark, sf).select("video_id", F.col("language").alias("captions_language")), "video_id")
        .withColumn("langs", F.expr("CASE chunk_index % 3 WHEN 1 THEN 'auto' WHEN 2 THEN 'ko-KR,ja' ELSE 'en' END"))
        .withColumn(
            "text",
            F.when(F.expr("(video_id + chunk_index) % 5 = 0"), F.repeat(F.lit("안녕하세요 여러분 "), 9)).otherwise(F.col("said")),
        )
    )


@query(
    "agg6_translation_guard",
    """SELECT video_id, chunk_index, expected_script,
      length(text) >= 40 AND expected_script IS NOT NULL AND share < 0.05e0 AS translated FROM v_gflag""",
)
def _(spark, sf):
    return D.check(guard_rows(spark, sf)).select("video_id", "chunk_index", "expected_script", "translated")


@query(
    "agg6_document_guard",
    f"""SELECT doc_id, script AS expected_script, length(text) >= 40 AND script IS NOT NULL AND
      CASE WHEN {sql_total('n_')} = 0 THEN 0 ELSE CASE script WHEN 'latin' THEN n_latin WHEN 'hangul' THEN n_hangul
        WHEN 'han' THEN n_han WHEN 'japanese' THEN n_japanese + n_han WHEN 'cyrillic' THEN n_cyrillic
        WHEN 'arabic' THEN n_arabic ELSE 0 END / {sql_total('n_')} END < 0.05e0 AS translated
    FROM v_scripts LEFT JOIN v_lang ON code = langs""",
)
def _(spark, sf):
    rows = A.guard_texts(spark, sf).withColumns(
        {c: F.lit(None).cast("string") for c in ("captions", "captions_language", "meta_script")}
    )
    return D.check(rows).select(
        "doc_id", "expected_script", F.coalesce("translated", F.lit(False)).alias("translated")
    )


# --- gap fill -------------------------------------------------------------------------------

LATIN = L.LATIN_TOKEN.replace("'", "''")
cte(
    "v_gtok",
    f"""SELECT g.video_id, gap_idx, gap_start, gap_end, gap_speaker, c.cue_idx, tok.i AS token_idx, tok.t AS token, lower(tok.t) AS key,
      c.cue_idx || ':' || tok.i AS id FROM v_gaps g JOIN v_tracks k ON k.video_id = g.video_id AND k.original
      JOIN v_cues c ON c.video_id = g.video_id AND c.cue_end >= greatest(0, gap_start - 0.5e0) AND c.cue_start <= gap_end + 0.5e0,
      (SELECT unnest(l) AS t, unnest(range(len(l))) AS i FROM (SELECT regexp_extract_all(c.cue_text, '{LATIN}') AS l)) tok""",
)
cte(
    "v_heard",
    f"""SELECT DISTINCT g.video_id, gap_idx, unnest(regexp_extract_all(lower(w.text), '{LATIN}')) AS key FROM v_gaps g
      JOIN v_words w ON w.video_id = g.video_id AND w.end_s >= gap_start - 1e0 AND w.start_s <= gap_end + 0.5e0""",
)
cte(
    "v_gaplist",
    """SELECT t.video_id, t.gap_idx, row_number() OVER (PARTITION BY t.video_id ORDER BY t.gap_idx) AS n,
      list({'id': id, 'key': t.key, 'token': token, 'heard': h.key IS NOT NULL} ORDER BY cue_idx, token_idx) AS toks
    FROM v_gtok t LEFT JOIN v_heard h ON h.video_id = t.video_id AND h.gap_idx = t.gap_idx AND h.key = t.key GROUP BY 1, 2""",
)
cte(
    "v_gapwalk",
    """-- (video_id, n, gap_idx, used, take)
    SELECT DISTINCT video_id, 0::BIGINT, NULL::BIGINT, []::VARCHAR[], []::STRUCT(id VARCHAR, key VARCHAR, token VARCHAR, heard BOOLEAN)[] FROM v_gaplist
    UNION ALL
    SELECT video_id, n, gap_idx, list_concat(used, list_transform(take, lambda x: x.id)), take FROM (
      SELECT video_id, n, gap_idx, used, list_filter(list_filter(free, lambda t, i:
        list_position(list_transform(free, lambda x: x.key), t.key) = i), lambda t: NOT t.heard) AS take FROM (
        SELECT g.video_id, g.n, g.gap_idx, w.used, list_filter(g.toks, lambda t: NOT list_contains(w.used, t.id)) AS free
        FROM v_gapwalk w JOIN v_gaplist g ON g.video_id = w.video_id AND g.n = w.n + 1))""",
)
cte(
    "v_insert",
    """SELECT g.video_id, g.gap_idx AS idx, seq, take[seq + 1].token AS text,
      gap_start + seq * ((gap_end - gap_start) / len(take)) AS start_s,
      gap_start + (seq + 1) * ((gap_end - gap_start) / len(take)) AS end_s, gap_speaker AS speaker, 'youtube' AS origin
    FROM (SELECT video_id, gap_idx, take, unnest(range(len(take))) AS seq FROM v_gapwalk WHERE n > 0)
    JOIN v_gaps g USING (video_id, gap_idx)""",
)
cte(
    "v_merged",
    """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx, seq) - 1 AS idx, text, start_s, end_s, speaker,
      speaker_global, speaker_status, origin FROM (
      SELECT video_id, idx, -1 AS seq, text, start_s, end_s, speaker, speaker_global, speaker_status, origin FROM v_words
      UNION ALL SELECT video_id, idx, seq, text, start_s, end_s, speaker, NULL, NULL, origin FROM v_insert)""",
)


def merged(spark, sf, w=None):
    w = w or cut(A.words(spark, sf))
    return G.merge(w, cut(A.cues(spark, sf, w)), A.caption_tracks(spark, sf))


def trusted_gaps(spark, sf):
    from talkspark.operators.segment import missing_gaps

    return missing_gaps(A.words(spark, sf))


@query(
    "jon3_gap_caption_tokens",
    """SELECT video_id, gap_idx, cue_idx, token_idx, token FROM v_gtok""",
)
def _(spark, sf):
    trusted = A.caption_tracks(spark, sf).filter("original")
    return G.gap_tokens(trusted_gaps(spark, sf).join(trusted.select("video_id"), "video_id", "left_semi"), A.cues(spark, sf)).select(
        "video_id", "gap_idx", "cue_idx", "token_idx", "token"
    )


@query("jon4_heard_near_gap", "SELECT * FROM v_heard")
def _(spark, sf):
    return G.heard_near(trusted_gaps(spark, sf), A.words(spark, sf))


@query("cmp5_gap_fill", "SELECT * FROM v_insert")
def _(spark, sf):
    w = cut(A.words(spark, sf))
    return G.inserted_words(w, cut(A.cues(spark, sf)), A.caption_tracks(spark, sf))


@query("cmp5_merged_words", "SELECT video_id, idx, text, start_s, end_s, speaker, origin FROM v_merged")
def _(spark, sf):
    return merged(spark, sf).select("video_id", "idx", "text", "start_s", "end_s", "speaker", "origin")


@query(
    "agg16_merge_stats",
    """SELECT video_id, count(*) FILTER (origin = 'gemini') AS spoken_words, count(*) FILTER (origin = 'youtube') AS inserted_words,
      count(DISTINCT lower(text)) FILTER (origin = 'youtube') AS new_terms FROM v_merged GROUP BY 1""",
)
def _(spark, sf):
    return G.merge_stats(merged(spark, sf))


@query(
    "set2_token_difference",
    """SELECT DISTINCT video_id, gap_idx, key FROM v_gtok t WHERE NOT EXISTS (SELECT 1 FROM v_heard h
      WHERE h.video_id = t.video_id AND h.gap_idx = t.gap_idx AND h.key = t.key)""",
)
def _(spark, sf):
    gaps = trusted_gaps(spark, sf).join(
        A.caption_tracks(spark, sf).filter("original").select("video_id"), "video_id", "left_semi"
    )
    offered = G.gap_tokens(gaps, A.cues(spark, sf)).select("video_id", "gap_idx", F.lower("token").alias("key")).distinct()
    return offered.join(G.heard_near(gaps, A.words(spark, sf)), ["video_id", "gap_idx", "key"], "left_anti")
