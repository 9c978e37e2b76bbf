"""Moments, mis-hearings, term candidates and glossary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.operators import moments as V
from talkspark.operators import segment as S
from talkspark.operators import terms as T
from talkspark.operators.captions import spoken_cues
from talkspark.plans.oracle import cte
from talkspark.plans.queries_words import merged
from talkspark.plans.registry import query
from talkspark.sources import adapters as A

SCREEN = L.SCREEN_PATTERN.replace("'", "''")
cte(
    "v_win10",
    f"""SELECT *, regexp_matches(t, '{SCREEN}') AS hit FROM (
      SELECT a.video_id, a.idx, a.start_s, string_agg(b.text, ' ' ORDER BY b.idx) AS t, max(b.idx) + 1 AS cursor
      FROM v_words a JOIN v_words b ON a.video_id = b.video_id AND b.idx >= a.idx AND b.idx < a.idx + 60
        AND b.start_s - a.start_s <= 6e0 GROUP BY 1, 2, 3)""",
)
cte(
    "v_walk10",
    """-- (video_id, idx)
    SELECT video_id, 0::BIGINT FROM v_videos
    UNION ALL SELECT w.video_id, CASE WHEN hit THEN cursor ELSE w.idx + 1 END FROM v_walk10 w JOIN v_win10 n ON n.video_id = w.video_id
      AND n.idx = w.idx""",
)
cte(
    "v_refs",
    """SELECT n.video_id, greatest(0, round(start_s - 1e0, 3)) AS b_at, 'screen-reference' AS reason FROM v_win10 n
    JOIN v_walk10 w ON w.video_id = n.video_id AND w.idx = n.idx WHERE hit""",
)
cte(
    "v_rest",
    """SELECT video_id, greatest(0, round(start_s - 0.5e0, 3)) AS b_at, 'restored-term' AS reason FROM v_merged WHERE origin = 'youtube'""",
)


@query("win10_screen_references", 'SELECT video_id, b_at AS "at", reason FROM v_refs')
def _(spark, sf):
    return V.screen_references(A.words(spark, sf))


@query("win11_restored_moments", 'SELECT video_id, b_at AS "at", reason FROM v_rest')
def _(spark, sf):
    return V.restored_terms(merged(spark, sf))


cte(
    "v_cand",
    """SELECT video_id, frame_at AS b_at, 'requested' AS reason, row_number() OVER (PARTITION BY video_id ORDER BY frame_at) AS n FROM v_frames
    UNION ALL SELECT video_id, b_at, reason, 0 FROM (SELECT * FROM v_refs UNION ALL SELECT * FROM v_rest)""",
)
cte(
    "v_wreq",
    """-- (video_id, n, b_at, kept, last_at)
    SELECT video_id, n, b_at, true, b_at FROM v_cand WHERE reason = 'requested' AND n = 1
    UNION ALL SELECT c.video_id, c.n, c.b_at, c.b_at - w.last_at >= 8e0, CASE WHEN c.b_at - w.last_at >= 8e0 THEN c.b_at ELSE w.last_at END
    FROM v_wreq w JOIN v_cand c ON c.video_id = w.video_id AND c.n = w.n + 1 AND c.reason = 'requested'""",
)
cte(
    "v_req",
    """SELECT * FROM (SELECT video_id, b_at, row_number() OVER (PARTITION BY video_id ORDER BY b_at) AS r FROM v_wreq WHERE kept) WHERE r <= 40""",
)
cte(
    "v_auto",
    """SELECT video_id, b_at, reason, row_number() OVER (PARTITION BY video_id ORDER BY b_at, reason) AS n FROM v_cand c WHERE reason <> 'requested'
      AND NOT EXISTS (SELECT 1 FROM v_req q WHERE q.video_id = c.video_id AND abs(q.b_at - c.b_at) < 8e0)""",
)
cte(
    "v_wauto",
    """-- (video_id, n, b_at, kept, last_at)
    SELECT video_id, n, b_at, true, b_at FROM v_auto WHERE n = 1
    UNION ALL SELECT c.video_id, c.n, c.b_at, c.b_at - w.last_at >= 8e0, CASE WHEN c.b_at - w.last_at >= 8e0 THEN c.b_at ELSE w.last_at END
    FROM v_wauto w JOIN v_auto c ON c.video_id = w.video_id AND c.n = w.n + 1""",
)
cte(
    "v_elig",
    """SELECT e.*, 40 - coalesce(q.k, 0) AS room FROM (SELECT w.video_id, w.b_at, a.reason, row_number() OVER (PARTITION BY w.video_id ORDER BY w.b_at) - 1 AS pos,
      count(*) OVER (PARTITION BY w.video_id) AS n FROM v_wauto w JOIN v_auto a ON a.video_id = w.video_id AND a.n = w.n WHERE kept) e
      LEFT JOIN (SELECT video_id, count(*) AS k FROM v_req GROUP BY 1) q USING (video_id)""",
)


def candidates(spark, sf):
    """Every moment the words offer; each frame's time is a requested one."""
    w = cut(A.words(spark, sf))
    asked = A.frames(spark, sf, w).select("video_id", F.col("frame_at").alias("at"), F.lit("requested").alias("reason"))
    found = V.screen_references(w).unionByName(V.restored_terms(merged(spark, sf, w)))
    return cut(asked.unionByName(found))


@query(
    "win12_thinned_candidates",
    """SELECT video_id, b_at AS "at", 'requested' AS reason FROM v_req UNION ALL
    SELECT video_id, b_at, reason FROM v_elig e WHERE room >= n OR EXISTS (SELECT 1 FROM range(0, 40) t(p)
      WHERE p < e.room AND CASE WHEN e.room <= 1 THEN 0 ELSE round_even(p * (e.n - 1) / (e.room - 1)::DOUBLE, 0) END = e.pos)""",
)
def _(spark, sf):
    return V.thin(candidates(spark, sf))


@query(
    "win13_even_spread",
    """SELECT w.video_id, idx AS pos FROM v_words w JOIN (SELECT video_id, count(*) AS n FROM v_words GROUP BY 1) c USING (video_id)
    WHERE EXISTS (SELECT 1 FROM range(0, 15) t(p) WHERE n > 15 AND round_even(p * (n - 1) / 14e0, 0) = idx) OR n <= 15""",
)
def _(spark, sf):
    rows = A.words(spark, sf).select("video_id", F.col("idx").alias("pos"))
    return V.spread(rows, rows.select("video_id").distinct().withColumn("room", F.lit(15)))


# --- mis-hearings ---------------------------------------------------------------------------


@query(
    "jon8_cue_word_windows",
    """SELECT c.video_id, c.cue_idx, count(*) AS n_words, min(w.idx) AS first_idx, max(w.idx) AS last_idx FROM v_cues c JOIN v_words w
      ON w.video_id = c.video_id AND w.start_s <= c.cue_end + 0.5e0 AND w.end_s >= c.cue_start - 0.5e0 GROUP BY 1, 2""",
)
def _(spark, sf):
    return T.cue_windows(A.words(spark, sf), A.cues(spark, sf)).groupBy("video_id", "cue_idx").agg(
        F.count(F.lit(1)).alias("n_words"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


def found_suspects(spark, sf):
    w = cut(A.words(spark, sf))
    return w, cut(T.suspects(w, spoken_cues(A.cues(spark, sf, w))))


def numbered_suspects(spark, sf):
    w, s = found_suspects(spark, sf)
    return w, cut(T.number_suspects(T.attach_slides(s, A.frames(spark, sf, w))))


@query("cmp7_suspects")
def _(spark, sf):
    w, s = found_suspects(spark, sf)
    sent = cut(S.sentences(w))
    return T.sentence_at(s.drop("times"), sent, "t")


@query("cmp8_slide_evidence")
def _(spark, sf):
    w, s = found_suspects(spark, sf)
    return T.attach_slides(s, A.frames(spark, sf, w)).drop("times")


cte("v_edge", "SELECT *, regexp_replace(regexp_replace(text, '^[.,;:!?\"''()\\[\\]]+', ''), '[.,;:!?\"''()\\[\\]]+$', '') AS term FROM v_merged")
INTERESTING = r"""(length(term) >= 2 AND (regexp_matches(term[2:], '\p{Lu}') OR (regexp_matches(term[1:1], '\p{Lu}')
  AND NOT (regexp_matches(term[2:], '\p{Ll}') AND NOT regexp_matches(term[2:], '[\p{Lu}\p{Lt}]')))
  OR (regexp_matches(term, '[0-9]') AND contains(term, '.'))))"""


@query(
    "cmp9_suspect_order",
    f"""SELECT video_id, heard, caption, t, 'S' || row_number() OVER (PARTITION BY video_id ORDER BY keep DESC, t, heard, caption) AS suspect_id
    FROM (SELECT *, {INTERESTING.replace("term", "heard")} OR {INTERESTING.replace("term", "caption")} AS keep
      FROM (SELECT video_id, text AS heard, 'x' || text AS caption, start_s AS t FROM v_words))""",
)
def _(spark, sf):
    s = A.words(spark, sf).select(
        "video_id", F.col("text").alias("heard"), F.concat(F.lit("x"), F.col("text")).alias("caption"),
        F.col("start_s").alias("t"), F.lit(None).cast("string").alias("slide"),
    )
    return T.number_suspects(s).select("video_id", "heard", "caption", "t", "suspect_id")


cte("v_shaped", f"""SELECT * FROM (SELECT video_id, term, count(*) AS freq, min_by(start_s, idx) AS t, row_number() OVER (PARTITION BY video_id
  ORDER BY count(*) DESC, min_by(start_s, idx), term) AS rank FROM v_edge WHERE origin = 'gemini' AND {INTERESTING} GROUP BY 1, 2) WHERE rank <= 60""")
cte("v_restored", "SELECT video_id, term, min(start_s) AS t, count(DISTINCT start_s) AS n_times FROM v_edge WHERE origin = 'youtube' AND term <> '' GROUP BY 1, 2")


@query("agg17_restored_terms", "SELECT * FROM v_restored")
def _(spark, sf):
    return T.restored_terms(merged(spark, sf)).select("video_id", "term", "t", F.size("times").alias("n_times"))


@query("agg18_shaped_tokens", "SELECT * FROM v_shaped")
def _(spark, sf):
    return T.shaped_tokens(merged(spark, sf))


@query("fil7_interesting_shape", f"SELECT term, count(*) AS n FROM v_edge WHERE {INTERESTING} GROUP BY 1")
def _(spark, sf):
    return merged(spark, sf).withColumn("term", X.strip_edges(F.col("text"))).filter(X.interesting(F.col("term"))).groupBy(
        "term"
    ).agg(F.count(F.lit(1)).alias("n"))


cte(
    "v_ocrterm",
    f"""SELECT video_id, term, min(frame_at) AS t FROM (SELECT video_id, frame_at,
      regexp_replace(regexp_replace(tok, '^[.,;:!?"''()\\[\\]]+', ''), '[.,;:!?"''()\\[\\]]+$', '') AS term FROM (
      SELECT video_id, frame_at, unnest(regexp_extract_all(ocr_text, '\\S+')) AS tok FROM v_frames)) WHERE term <> '' AND {INTERESTING} GROUP BY 1, 2""",
)
cte(
    "v_pool",
    f"""SELECT video_id, term, min(t) AS t, sum(freq) AS freq FROM (SELECT video_id, term, t, n_times AS freq FROM v_restored
      UNION ALL SELECT video_id, term, t, freq FROM v_shaped UNION ALL SELECT video_id, term, t, 1 FROM v_ocrterm)
      WHERE term NOT IN ('torch', 'PyTorch') GROUP BY 1, 2 HAVING sum(freq) > 1 OR {INTERESTING}""",
)


@query(
    "agg19_term_candidates",
    """SELECT video_id, 'C' || n AS candidate_id, term, t, greatest(0, total - 120) AS dropped FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS total,
      row_number() OVER (PARTITION BY video_id ORDER BY t, term) AS n FROM v_pool) WHERE n <= 120""",
)
def _(spark, sf):
    known = A.videos(spark, sf).select("video_id", F.lit("torch").alias("heard"), F.lit("PyTorch").alias("caption"))
    w = cut(A.words(spark, sf))
    return T.term_candidates(cut(merged(spark, sf, w)), known, A.frames(spark, sf, w))


@query(
    "jon15_phrase_times",
    """SELECT a.video_id, q.phrase, min_by(a.start_s, a.idx) AS first_t FROM v_edge a JOIN v_edge b ON b.video_id = a.video_id AND b.idx = a.idx + 1
      JOIN (SELECT DISTINCT video_id, p.phrase, p.x, p.y FROM v_videos, (VALUES ('1,200 the', '1,200', 'the'), ('the ou', 'the', 'ou'), ('De la', 'de', 'la')) p(phrase, x, y)) q
      ON q.video_id = a.video_id AND lower(a.term) = q.x AND lower(b.term) = q.y GROUP BY 1, 2""",
)
def _(spark, sf):
    asked = A.videos(spark, sf).select(
        "video_id", F.explode(F.array(F.lit("1,200 the"), F.lit("the ou"), F.lit("De la"))).alias("phrase")
    )
    return T.phrase_times(merged(spark, sf).withColumn("origin", F.lit("gemini")), asked)


@query(
    "win22_decided_prefix",
    """SELECT video_id, coalesce(min(CASE WHEN rank % 7 = 2 AND video_id % 3 <> 0 THEN rank END) - 1, max(rank)) AS cursor FROM v_shaped GROUP BY 1""",
)
def _(spark, sf):
    items = T.shaped_tokens(merged(spark, sf)).select(
        "video_id", F.col("rank").alias("n"), F.expr("not (rank % 7 = 2 and video_id % 3 <> 0)").alias("decided")
    )
    return T.decided_prefix(items)


def glossary_lines(spark, sf):
    """Submitted glossary lines: suspects with their id, shaped tokens, everyday words, defects."""
    w, s = numbered_suspects(spark, sf)
    c = cut(T.term_candidates(w, s, A.frames(spark, sf, w)))
    own = s.select(
        "video_id", (F.substring("suspect_id", 2, 9).cast("long")).alias("n"),
        F.array(F.col("caption"), F.lit("번역어"), F.lit("-"), F.lit("-"), F.col("suspect_id")).alias("fields"),
    )
    shaped = c.select(
        "video_id", (F.substring("candidate_id", 2, 9).cast("long") + 1000).alias("n"),
        F.array(F.col("term"), F.when(F.col("term").startswith("G"), "?").otherwise("용어"), F.lit("짧은"), F.lit("긴 설명"), F.col("candidate_id")).alias("fields"),
    )
    fixed = A.videos(spark, sf).select(
        "video_id",
        F.posexplode(
            F.array(
                F.array(*map(F.lit, ["times", "시간", "-", "-", "-"])),
                F.array(*map(F.lit, ["Unheard", "용어", "-", "-", "C1"])),
                F.array(*map(F.lit, ["torch", "토치", "설명", "-", "-"])),
                F.array(*map(F.lit, ["torch", "토치"])),
            )
        ).alias("n", "fields"),
    ).withColumn("n", F.col("n").cast("long") + 5000)
    lines = own.unionByName(shaped).unionByName(fixed).withColumnRenamed("n", "line_no")
    return w, s, c, lines


@query("cmp10_glossary_submissions")
def _(spark, sf):
    w, s, c, lines = glossary_lines(spark, sf)
    return T.check_terms(lines, s, c, w).withColumn("heard", F.array_join("heard", "|")).withColumn(
        "evidence", F.array_join("evidence", ",")
    )


cte("v_forms", """SELECT DISTINCT video_id, f.form FROM v_videos, (VALUES ('torch'), ('resnet50'), ('the'), ('1,200'), ('라는'), ('GPT-4.1')) f(form)""")


@query(
    "jon14_glossary_mentions",
    r"""SELECT s.video_id, s.no, f.form FROM v_sent s JOIN v_forms f ON f.video_id = s.video_id
      WHERE regexp_matches(s.s_text, '(?i)(^|[^A-Za-z])' || regexp_escape(f.form) || '($|[^A-Za-z])')""",
)
def _(spark, sf):
    forms = A.videos(spark, sf).select(
        "video_id", F.explode(F.array(*map(F.lit, ["torch", "resnet50", "the", "1,200", "라는", "GPT-4.1"]))).alias("form")
    )
    return T.mentions(S.sentences(A.words(spark, sf)), forms).select("video_id", "no", "form")


@query(
    "jon7_sentence_at",
    """SELECT p.video_id, p.t, coalesce((SELECT min(no) FROM v_sent s WHERE s.video_id = p.video_id AND p.t BETWEEN s_start AND s_end),
      (SELECT max_by(no, s_start) FROM v_sent s WHERE s.video_id = p.video_id AND s_start <= p.t), 1) AS sentence_no
    FROM (SELECT video_id, cue_end AS t FROM v_cues UNION SELECT video_id, 0 FROM v_videos) p""",
)
def _(spark, sf):
    pts = A.cues(spark, sf).select("video_id", F.col("cue_end").alias("t")).unionByName(
        A.videos(spark, sf).select("video_id", F.lit(0.0).alias("t"))
    )
    return T.sentence_at(pts.distinct(), cut(S.sentences(A.words(spark, sf))), "t")


@query(
    "fil6_noise_pairs",
    """SELECT a, kind, CASE kind WHEN 'far' THEN false ELSE true END AS noise FROM (SELECT DISTINCT text AS a FROM v_words
      WHERE regexp_matches(text, '^[A-Za-z]{4,}$')), (VALUES ('hyphen'), ('plural'), ('far'), ('case')) k(kind)""",
)
def _(spark, sf):
    words = A.words(spark, sf).filter(F.col("text").rlike("^[A-Za-z]{4,}$")).select(F.col("text").alias("a")).distinct()
    other = {
        "hyphen": F.concat(F.substring("a", 1, 2), F.lit("-"), F.substring("a", 3, 99)),
        "plural": F.concat("a", F.lit("s")),
        "far": F.concat("a", F.lit("xxxx")),
        "case": F.upper("a"),
    }
    pairs = words.select("a", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("b")) for k, v in other.items()])).alias("p"))
    return pairs.select("a", "p.kind", X.noise_pair(F.col("a"), F.col("p.b")).alias("noise"))
