"""Chapter and summary queries.  The talk is stretched four times so that chapters are long."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions.lineage import cut
from talkspark.operators import chapters as H
from talkspark.operators import fingerprint as FP
from talkspark.operators import summary as M
from talkspark.plans.oracle import cte
from talkspark.plans.queries_words import merged
from talkspark.plans.registry import query
from talkspark.sources import adapters as A

cte("v_slow", "SELECT video_id, idx, text, start_s * 4e0 AS start_s, end_s * 4e0 AS end_s, speaker FROM v_words")
cte("v_slag", "SELECT *, lag(end_s) OVER p AS pe, lag(text) OVER p AS pt FROM v_slow WINDOW p AS (PARTITION BY video_id ORDER BY idx)")
cte(
    "v_grp1",
    """SELECT *, CASE WHEN hi - lo0 <= 480e0 THEN 1 ELSE greatest(2, ceil((hi - lo0) / 300e0)::INT) END AS parts FROM (
      SELECT video_id, min_by(start_s, idx) AS lo0, max_by(end_s, idx) AS hi FROM v_slow GROUP BY 1)""",
)
END = L.SENTENCE_END.replace("'", "''")
cte(
    "v_cuts",
    f"""-- (video_id, k, b_at)
    SELECT video_id, 0, lo0 FROM v_grp1
    UNION ALL
    SELECT p.video_id, p.k + 1, coalesce(max({{'s': CASE WHEN regexp_matches(w.pt, '{END}') THEN 2e0 ELSE 0e0 END
        + least(greatest(0e0, w.start_s - w.pe), 3e0) - abs(w.start_s - t) / 60e0, 'a': w.start_s}}).a,
      least(hi, greatest(b_at, t))) FROM (
        SELECT c.video_id, c.k, c.b_at, g.hi, lo0 + (hi - lo0) * (c.k + 1) / parts AS t
        FROM v_cuts c JOIN v_grp1 g ON g.video_id = c.video_id AND c.k + 1 < g.parts) p
      LEFT JOIN v_slag w ON w.video_id = p.video_id AND w.idx > 0
        AND w.start_s >= greatest(b_at + 120e0, t - 60e0) AND w.start_s <= least(hi - 120e0, t + 60e0)
    GROUP BY p.video_id, p.k, p.b_at, p.hi, p.t""",
)
cte(
    "v_piece",
    """SELECT video_id, p_start, p_end, row_number() OVER (PARTITION BY video_id ORDER BY p_start) AS chapter_no FROM (
      SELECT c.video_id, b_at AS p_start, coalesce(lead(b_at) OVER (PARTITION BY c.video_id ORDER BY k), hi) AS p_end
      FROM v_cuts c JOIN v_grp1 g USING (video_id)) WHERE p_end > p_start""",
)
cte(
    "v_inch",
    """SELECT w.*, p.chapter_no, p.p_start, p.p_end FROM v_slow w JOIN v_piece p ON p.video_id = w.video_id
      AND w.start_s >= p_start AND w.start_s < p_end""",
)
STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.STOP_WORDS) + "]"
TOKENS = (
    f"list_filter(list_transform(regexp_extract_all(text, '{L.CONTENT_TOKEN}'), lambda x: "
    f"lower(regexp_replace(x, '^[._+#-]+|[._+#-]+$', '', 'g'))), lambda x: length(x) >= 2 AND "
    f"NOT list_contains({STOP}, x) AND NOT regexp_matches(x, '^[0-9]+$'))"
)
cte("v_ctok", f"SELECT video_id, chapter_no, idx, unnest({TOKENS}) AS token FROM v_inch")
cte(
    "v_tf",
    """SELECT *, count(*) OVER (PARTITION BY video_id, token) AS df FROM (
      SELECT video_id, chapter_no, token, count(*) AS tf FROM v_ctok GROUP BY 1, 2, 3)""",
)
cte(
    "v_kw",
    """SELECT * FROM (SELECT video_id, chapter_no, token, tf, df, row_number() OVER (PARTITION BY video_id, chapter_no
      ORDER BY tf * (1e0 + ln((n + 1)::DOUBLE / (df + 1))) DESC, token) AS rank FROM v_tf
      JOIN (SELECT video_id, count(*) AS n FROM v_piece GROUP BY 1) USING (video_id)) WHERE rank <= 5""",
)
cte(
    "v_csent",
    f"""SELECT *, island + ((idx - island) // 35) * 35 AS grp FROM (SELECT *, max(CASE WHEN brk THEN idx END)
      OVER (PARTITION BY video_id ORDER BY idx) AS island FROM (SELECT *, lag(end_s) OVER p IS NULL
        OR start_s - lag(end_s) OVER p > 1.2e0 OR regexp_matches(lag(text) OVER p, '{END}')
        OR lag(chapter_no) OVER p <> chapter_no AS brk FROM v_inch WINDOW p AS (PARTITION BY video_id ORDER BY idx)))""",
)
cte(
    "v_exc",
    """SELECT video_id, chapter_no, rank, hits, left(s_text, 360) AS excerpt FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id, chapter_no ORDER BY hits DESC,
        abs((s_start + s_end) / 2 - (p_start + p_end) / 2), grp) AS rank FROM (
        SELECT s.video_id, s.chapter_no, s.grp, any_value(p_start) AS p_start, any_value(p_end) AS p_end,
          min_by(start_s, s.idx) AS s_start, max_by(end_s, s.idx) AS s_end, string_agg(text, ' ' ORDER BY s.idx) AS s_text,
          coalesce(sum(h.n), 0)::BIGINT AS hits FROM v_csent s LEFT JOIN (
            SELECT t.video_id, t.idx, count(*) AS n FROM v_ctok t JOIN v_kw k ON k.video_id = t.video_id
              AND k.chapter_no = t.chapter_no AND k.token = t.token GROUP BY 1, 2) h ON h.video_id = s.video_id AND h.idx = s.idx
        GROUP BY 1, 2, 3)) WHERE rank <= 2""",
)
cte(
    "v_chap",
    """SELECT p.video_id, p.chapter_no, 'chapter-' || lpad(p.chapter_no::VARCHAR, 2, '0') AS chapter_id, round(p_start, 3) AS c_start,
      round(p_end, 3) AS c_end, coalesce(k.ks, []) AS keywords, coalesce(e.es, []) AS excerpts,
      CASE WHEN len(k.ks) > 0 THEN left(array_to_string(k.ks[1:4], ' · '), 100) WHEN len(e.es) > 0 THEN rtrim(left(e.es[1], 100))
        ELSE '구간 ' || p.chapter_no END AS title
    FROM v_piece p LEFT JOIN (SELECT video_id, chapter_no, list(token ORDER BY rank) AS ks FROM v_kw GROUP BY 1, 2) k
      USING (video_id, chapter_no) LEFT JOIN (SELECT video_id, chapter_no, list(excerpt ORDER BY rank) AS es FROM v_exc
      GROUP BY 1, 2) e USING (video_id, chapter_no)""",
)


def slow(spark, sf):
    return cut(
        A.words(spark, sf)
        .withColumn("start_s", F.col("start_s") * 4.0)
        .withColumn("end_s", F.col("end_s") * 4.0)
    )


def without_native(spark, sf):
    return A.videos(spark, sf).withColumn("native_chapters", F.lit(None).cast(A.videos(spark, sf).schema["native_chapters"].dataType))


def pieces(spark, sf):
    w = slow(spark, sf)
    return w, H.number_chapters(H.split_groups(w, H.groups(w, without_native(spark, sf))))


def local_chapters(spark, sf):
    return cut(H.build(slow(spark, sf), without_native(spark, sf)))


@query("win14_chapter_boundaries", "SELECT video_id, chapter_no, p_start FROM v_piece")
def _(spark, sf):
    return pieces(spark, sf)[1].select("video_id", "chapter_no", "p_start")


@query("win15_split_spans", "SELECT video_id, chapter_no, p_start, p_end FROM v_piece")
def _(spark, sf):
    return pieces(spark, sf)[1].select("video_id", "chapter_no", "p_start", "p_end")


@query("win16_native_groups")
def _(spark, sf):
    w = slow(spark, sf)
    return H.native_groups(A.videos(spark, sf).join(H.durations(w), "video_id"))


@query("agg9_token_counts", "SELECT video_id, chapter_no, token, tf, df FROM v_tf")
def _(spark, sf):
    w, p = pieces(spark, sf)
    return H.token_counts(H.chapter_words(w, p))


@query("agg10_keywords", "SELECT * FROM v_kw")
def _(spark, sf):
    w, p = pieces(spark, sf)
    p = cut(p)
    return H.keywords(H.token_counts(H.chapter_words(w, p)), p)


@query("win17_excerpts", "SELECT * FROM v_exc")
def _(spark, sf):
    w, p = pieces(spark, sf)
    p = cut(p)
    inside = cut(H.chapter_words(w.select("video_id", "idx", "text", "start_s", "end_s"), p))
    return H.excerpts(inside, cut(H.keywords(H.token_counts(inside), p)))


@query(
    "cmp18_local_chapters",
    """SELECT video_id, chapter_no, chapter_id, c_start, c_end, title, array_to_string(keywords, '|') AS keywords,
      array_to_string(excerpts, '|') AS excerpts, 'local-keywords' AS title_source, true AS needs_title FROM v_chap""",
)
def _(spark, sf):
    return local_chapters(spark, sf).withColumn("keywords", F.array_join("keywords", "|")).withColumn(
        "excerpts", F.array_join("excerpts", "|")
    )


@query("cmp18_chapters_with_native")
def _(spark, sf):
    return H.build(slow(spark, sf), A.videos(spark, sf)).drop("keywords", "excerpts")


@query(
    "cmp18_title_clamp",
    """SELECT doc_id, CASE WHEN length(flat) <= 100 THEN flat ELSE regexp_replace(left(flat, CASE WHEN b_at < 50 THEN 100 ELSE b_at END),
      '[ ·:.,?!]+$', '') || '…' END AS title FROM (SELECT *, greatest(%s) AS b_at FROM (
      SELECT *, left(flat, 100) AS w FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS flat FROM documents)))"""
    % ", ".join(
        f"CASE WHEN contains(w, '{m}') THEN length(w) - strpos(reverse(w), '{m[::-1]}') - {len(m)} + 1 ELSE -1 END"
        for m in (". ", "? ", "! ", " · ", ": ", " ")
    ),
)
def _(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", H.clamp_title(F.col("text")).alias("title"))


def sql_tree(rows: str, keys: str = "video_id") -> str:
    """Two block levels of 4,096 and a top."""
    return (
        f"SELECT {keys}, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY i)) AS fp FROM ("
        f"SELECT {keys}, i // 4096 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM ("
        f"SELECT {keys}, i // 4096 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM ({rows}) "
        f"GROUP BY {keys}, i // 4096) GROUP BY {keys}, i // 4096) GROUP BY {keys}"
    )


def ms(c: str) -> str:
    return f"round({c} * 1000)::BIGINT"


cte("v_tfp", sql_tree(f"SELECT video_id, idx AS i, {ms('start_s')} || '|' || {ms('end_s')} || '|' || speaker || '|' || text AS h FROM v_words"))
cte(
    "v_cfp",
    sql_tree(
        f"""SELECT video_id, chapter_no AS i, chapter_id || '|' || {ms('c_start')} || '|' || {ms('c_end')} || '|' || title || '|' ||
        array_to_string(keywords, ',') || '|' || array_to_string(excerpts, chr(10)) AS h FROM v_chap"""
    ),
)


@query("agg26_transcript_fingerprint", "SELECT video_id, fp AS transcript_fp FROM v_tfp")
def _(spark, sf):
    return FP.transcript(A.words(spark, sf))


@query("agg26_chapter_fingerprint", "SELECT video_id, fp AS chapters_fp FROM v_cfp")
def _(spark, sf):
    return FP.chapter_table(local_chapters(spark, sf))


@query(
    "agg11_key_terms",
    """SELECT k.video_id, k.term, n, rank, chapter_no, chapter_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, term) AS rank
      FROM (SELECT video_id, token AS term, count(*) AS n FROM v_kw GROUP BY 1, 2) WHERE n >= 2) k
      JOIN (SELECT video_id, chapter_no, chapter_id, unnest(keywords) AS term FROM v_chap) c ON c.video_id = k.video_id AND c.term = k.term
      WHERE rank <= 20""",
)
def _(spark, sf):
    return M.key_terms(local_chapters(spark, sf))


@query(
    "win18_key_points",
    """SELECT c.video_id, p.i AS point_no, chapter_id, c_start, rtrim(left(coalesce(excerpts[1], title), 600)) AS text FROM v_chap c JOIN (
      SELECT video_id, i, CASE WHEN n <= 12 THEN i + 1 ELSE round_even(i * (n - 1) / 11e0, 0)::BIGINT + 1 END AS chapter_no FROM (
        SELECT video_id, n, unnest(range(least(n, 12))) AS i FROM (SELECT video_id, count(*) AS n FROM v_chap GROUP BY 1))) p
      USING (video_id, chapter_no)""",
)
def _(spark, sf):
    return M.key_points(local_chapters(spark, sf))


@query(
    "cmp15_overviews",
    """SELECT v.video_id, rtrim(left(coalesce(o, '이 영상의 내용을 시간순 챕터로 정리했다.'), 1600)) AS overview
    FROM v_videos v LEFT JOIN (SELECT video_id, string_agg(excerpt, ' ' ORDER BY chapter_no, rank) AS o FROM (
      SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY chapter_no, rank) AS r FROM v_exc) WHERE r <= 2 GROUP BY 1) USING (video_id)""",
)
def _(spark, sf):
    return M.overviews(local_chapters(spark, sf))


HMS = "printf('%02d:%02d:%02d', round_even(c_start, 0)::BIGINT // 3600, round_even(c_start, 0)::BIGINT // 60 % 60, round_even(c_start, 0)::BIGINT % 60)"


@query(
    "cmp15_local_summary",
    f"""SELECT video_id, 3 AS section, chapter_no AS place, 0 AS sub, '### ' || chapter_no || '. ' || title || ' [' || {HMS} || ']' AS line FROM v_chap
    UNION ALL SELECT video_id, 3, chapter_no, rank, '- ' || rtrim(trim(excerpt)) FROM v_exc""",
)
def _(spark, sf):
    ch = local_chapters(spark, sf)
    titles = A.videos(spark, sf).select("video_id", F.lit(None).cast("string").alias("video_title"))
    return M.markdown_lines(ch, titles).filter("section = 3 and place > 0")


@query("cmp15_summary_markdown")
def _(spark, sf):
    ch = local_chapters(spark, sf)
    titles = A.videos(spark, sf).select("video_id", F.lit(None).cast("string").alias("video_title"))
    return M.markdown_lines(ch, titles)


cte(
    "v_prev",
    """SELECT video_id, chapter_id, 'Host ' || chapter_id AS title, CASE WHEN video_id % 4 = 3 THEN 'stale' ELSE 'fp' || video_id END AS transcript_fp,
      c_start, CASE WHEN chapter_no % 4 = 2 THEN c_end + 1 ELSE c_end END AS c_end,
      CASE WHEN chapter_no % 3 = 0 THEN 'local-keywords' ELSE 'host-llm' END AS title_source FROM v_chap""",
)


@query(
    "jon13_carried_titles",
    """SELECT c.video_id, c.chapter_id, coalesce(p.title, c.title) AS title, p.title IS NULL AS needs_title FROM v_chap c LEFT JOIN v_prev p
      ON p.video_id = c.video_id AND p.chapter_id = c.chapter_id AND p.c_start = c.c_start AND p.c_end = c.c_end
      AND p.title_source = 'host-llm' AND p.transcript_fp = 'fp' || c.video_id""",
)
def _(spark, sf):
    ch = local_chapters(spark, sf)
    fp = F.concat(F.lit("fp"), F.col("video_id").cast("string"))
    prev = ch.select(
        "video_id", "chapter_id", F.concat(F.lit("Host "), F.col("chapter_id")).alias("title"),
        F.when(F.col("video_id") % 4 == 3, "stale").otherwise(fp).alias("transcript_fp"), "c_start",
        F.when(F.col("chapter_no") % 4 == 2, F.col("c_end") + 1).otherwise(F.col("c_end")).alias("c_end"),
        F.when(F.col("chapter_no") % 3 == 0, "local-keywords").otherwise("host-llm").alias("title_source"),
    )
    fps = A.videos(spark, sf).select("video_id", fp.alias("transcript_fp"))
    return H.carry_titles(ch, prev, fps).select("video_id", "chapter_id", "title", "needs_title")


cte(
    "v_titled",
    """SELECT video_id, 1 AS submission_id, item_no, chapter_id, title, rule, NOT bool_or(rule IS NOT NULL) OVER (PARTITION BY video_id) AS applied FROM (
      SELECT video_id, item_no, chapter_id, title, CASE WHEN video_id % 4 = 3 THEN 'stale fingerprint'
        WHEN video_id % 4 = 1 AND item_no = 1 THEN 'unknown chapter'
        WHEN item_no > (SELECT max(chapter_no) FROM v_chap m WHERE m.video_id = s.video_id) THEN 'duplicate chapter'
        WHEN length(title) = 0 OR length(title) > 100 THEN 'invalid title' END AS rule FROM (
        SELECT video_id, chapter_no AS item_no, CASE WHEN video_id % 4 = 1 AND chapter_no = 1 THEN 'chapter-999' ELSE chapter_id END AS chapter_id,
          CASE WHEN video_id % 4 = 2 THEN repeat('x', 101) ELSE array_to_string(keywords, ' ') END AS title FROM v_chap
        UNION ALL SELECT video_id, 100, chapter_id, 'again' FROM v_chap WHERE video_id % 8 = 0 AND chapter_no = 1) s)""",
)


def titled(spark, sf):
    """Local chapters and the checked title submissions for them."""
    ch = local_chapters(spark, sf)
    fp = F.concat(F.lit("fp"), F.col("video_id").cast("string"))
    subs = ch.select(
        "video_id", F.lit(1).alias("submission_id"), F.col("chapter_no").alias("item_no"),
        F.when(F.col("video_id") % 4 == 3, "stale").otherwise(fp).alias("fingerprint"),
        F.when((F.col("video_id") % 4 == 1) & (F.col("chapter_no") == 1), "chapter-999").otherwise(F.col("chapter_id")).alias("chapter_id"),
        F.when(F.col("video_id") % 4 == 2, F.repeat(F.lit("x"), 101)).otherwise(F.array_join("keywords", " ")).alias("title"),
    )
    again = ch.filter("video_id % 8 = 0 and chapter_no = 1").select(
        "video_id", F.lit(1).alias("submission_id"), F.lit(100).cast("long").alias("item_no"), fp.alias("fingerprint"),
        "chapter_id", F.lit("again").alias("title"),
    )
    fps = A.videos(spark, sf).select("video_id", fp.alias("transcript_fp"))
    return ch, H.check_titles(subs.unionByName(again), ch, fps)


@query("cmp13_title_submissions", "SELECT * FROM v_titled")
def _(spark, sf):
    return titled(spark, sf)[1]


@query(
    "cmp13_applied_titles",
    """SELECT c.video_id, c.chapter_id, coalesce(n.title, c.title) AS title, n.title IS NULL AS needs_title FROM v_chap c
    LEFT JOIN v_titled n ON n.video_id = c.video_id AND n.chapter_id = c.chapter_id AND n.applied""",
)
def _(spark, sf):
    return H.apply_titles(*titled(spark, sf)).select("video_id", "chapter_id", "title", "needs_title")


@query(
    "cmp14_summary_submissions",
    """SELECT video_id, video_id AS submission_id, CASE video_id % 7 WHEN 1 THEN 'overview' WHEN 2 THEN 'key point chapters'
      WHEN 3 THEN CASE WHEN n > 1 THEN 'chapter order' END WHEN 4 THEN 'bullet count' WHEN 5 THEN 'term chapters' END AS rule
    FROM (SELECT video_id, count(*) AS n FROM v_chap GROUP BY 1)""",
)
def _(spark, sf):
    ch = local_chapters(spark, sf)
    k = F.col("video_id") % 7
    ids = F.array_sort(F.collect_list(F.struct("chapter_no", "chapter_id"))).getField("chapter_id")
    subs = ch.groupBy("video_id").agg(ids.alias("ids")).select(
        "video_id",
        F.col("video_id").alias("submission_id"),
        F.when(k == 1, F.repeat(F.lit("y"), 1601)).otherwise(F.lit("  An   overview ")).alias("overview"),
        F.array(
            F.struct(
                F.lit("point").alias("text"),
                F.when(k == 2, F.array(F.lit("nope"))).otherwise(F.array(F.get("ids", F.lit(0)))).alias("chapter_ids"),
            )
        ).alias("key_points"),
        F.transform(
            F.when(k == 3, F.reverse("ids")).otherwise(F.col("ids")),
            lambda i: F.struct(
                i.alias("id"),
                F.when(k == 4, F.array_repeat(F.lit("b"), 4)).otherwise(F.array(F.lit("b"))).alias("bullets"),
            ),
        ).alias("chapter_summaries"),
        F.array(
            F.struct(
                F.lit("term").alias("term"), F.lit("meaning").alias("meaning"),
                F.when(k == 5, F.array_repeat(F.get("ids", F.lit(0)), 2)).otherwise(F.array(F.get("ids", F.lit(0)))).alias("chapter_ids"),
            )
        ).alias("terms"),
    )
    return M.check_content(subs, ch)


@query(
    "cmp16_summary_freshness",
    """SELECT video_id, CASE WHEN video_id % 2 = 0 THEN 'host-llm' ELSE 'local-extractive' END AS generation,
      video_id % 3 <> 1 AND video_id % 5 <> 2 AS is_current,
      video_id % 3 <> 1 AND video_id % 5 <> 2 AND video_id % 2 = 0 AS final FROM v_videos""",
)
def _(spark, sf):
    t = cut(FP.transcript(A.words(spark, sf)))
    c = cut(FP.chapter_table(local_chapters(spark, sf)))
    both = t.join(c, "video_id")
    stored = both.select(
        "video_id",
        F.when(F.col("video_id") % 3 == 1, "old").otherwise(F.col("transcript_fp")).alias("transcript_fp"),
        F.when(F.col("video_id") % 5 == 2, "old").otherwise(F.col("chapters_fp")).alias("chapters_fp"),
        F.when(F.col("video_id") % 2 == 0, "host-llm").otherwise("local-extractive").alias("generation"),
        F.lit(2).alias("stored_at"),
    )
    older = both.withColumn("generation", F.lit("local-extractive")).withColumn("stored_at", F.lit(1))
    return M.current(stored.unionByName(older), t, c)


STATS = """SELECT video_id, max_by(end_s, idx) AS duration, count(*) AS word_count,
  coalesce(string_agg(DISTINCT text, '|' ORDER BY text) FILTER (origin = 'youtube'), '') AS restored_terms,
  coalesce(string_agg(DISTINCT coalesce(speaker_global, speaker), '|' ORDER BY coalesce(speaker_global, speaker)) FILTER (speaker_status IN ('confirmed', 'inferred')), '') AS speakers,
  coalesce(string_agg(DISTINCT coalesce(speaker_global, speaker), '|' ORDER BY coalesce(speaker_global, speaker)) FILTER (speaker_status = 'unresolved'), '') AS unresolved_speakers,
  count(*) FILTER (speaker_status = 'unresolved') AS unresolved_words FROM v_merged GROUP BY 1"""
cte("v_stats", STATS)


@query("agg12_outline_statistics", "SELECT * FROM v_stats")
def _(spark, sf):
    return M.outline_stats(merged(spark, sf))


@query(
    "cmp17_outline",
    f"""SELECT c.video_id, chapter_no, chapter_id, c_start, title, {HMS} AS timecode, true AS needs_title, word_count, unresolved_words
    FROM v_chap c JOIN v_stats USING (video_id)""",
)
def _(spark, sf):
    return M.outline(local_chapters(spark, sf), M.outline_stats(merged(spark, sf))).select(
        "video_id", "chapter_no", "chapter_id", "c_start", "title", "timecode", "needs_title", "word_count", "unresolved_words"
    )
