"""Translated-subtitle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import text as X
from talkspark.functions.lineage import cut
from talkspark.operators import fingerprint as FP
from talkspark.operators import segment as S
from talkspark.operators import translation as R
from talkspark.plans.oracle import cte
from talkspark.plans.registry import query
from talkspark.sources import adapters as A


def base(spark, sf):
    """Words with sentence starts, and the sentence table."""
    w = cut(S.sentence_starts(cut(A.words(spark, sf))))
    table = S.number_sentences(S.sentence_table(w)).withColumn(
        "sentence_key", S.sentence_key(F.col("s_start"), F.col("s_end"), F.col("s_text"))
    )
    return w, cut(table)


def sentences(spark, sf):
    return base(spark, sf)[1]


ANSWER = """CASE WHEN no % 10 = 9 THEN '=' ELSE {c}(CASE WHEN no % 13 = 5 THEN s_text WHEN no % 6 = 1 THEN '번역 문장입니다 /1 다음 구절입니다'
  WHEN no % 17 = 3 THEN '번역 문장이에요' ELSE '번역 문장 1,200 입니다' END{s} CASE WHEN no % 19 = 2 THEN ' ?' ELSE '' END) END"""


def answers(table):
    return table.select("video_id", "no", F.expr(ANSWER.format(c="concat", s=",")).alias("rest"))


def nothing_stored(table):
    return table.select(
        "video_id", "no", F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("merged_into_no")
    ).filter("false")


def checked(spark, sf):
    w, table = base(spark, sf)
    chained = cut(R.chains(table, answers(table), nothing_stored(table)))
    points = S.breath_points(w).join(table.select("video_id", "grp", "no"), ["video_id", "grp"]).select(
        "video_id", "no", F.col("k").cast("long").alias("k"), "breath_at"
    )
    terms = A.videos(spark, sf).select(
        "video_id",
        F.explode(
            F.array(
                F.struct(F.lit("torch").alias("form"), F.lit("토치").alias("tgt"), F.lit("confirmed").alias("status")),
                F.struct(F.lit("ResNet50").alias("form"), F.lit("ResNet50").alias("tgt"), F.lit("uncertain").alias("status")),
            )
        ).alias("g"),
    ).select("video_id", "g.*")
    return table, R.check_lines(chained, points, terms)


cte("v_ans", f"SELECT *, {ANSWER.format(c='', s=' ||')} AS rest FROM v_sent")
cte(
    "v_roots",
    """SELECT a.*, coalesce(n.s_end, a.s_end) AS final_end, b.breath_at AS b1, rtrim(regexp_replace(a.rest, ' \\?$', '')) AS body
    FROM v_ans a LEFT JOIN v_sent n ON n.video_id = a.video_id AND n.no = a.no + 1 AND n.no % 10 = 9
    LEFT JOIN v_breath b ON b.video_id = a.video_id AND b.grp = a.grp AND b.k = 1 WHERE a.no % 10 <> 9""",
)
NUM = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"
LATIN_OUT = "regexp_replace(ko, '[A-Za-z][A-Za-z0-9.\\-]*', '', 'g')"
cte(
    "v_lines",
    f"""SELECT *, CASE WHEN body LIKE '% /1 %' AND b1 IS NULL THEN 'breath out of range' WHEN body LIKE '% /1 %' AND b1 <= s_start
        THEN 'breaths not increasing' WHEN letters = 0 OR hangul / letters < 0.3e0 THEN 'too little hangul' END AS rule FROM (
      SELECT *, length(regexp_replace({LATIN_OUT}, '[^\\p{{L}}]', '', 'g')) AS letters,
        length(regexp_replace({LATIN_OUT}, '[^가-힣]', '', 'g')) AS hangul,
        len(list_filter({NUM.format('s_text')}, lambda x: NOT list_contains({NUM.format('ko')}, x))) > 0 AS f_num,
        regexp_matches(s_text, '(?i)(^|[^A-Za-z])torch($|[^A-Za-z])') AND NOT contains(ko, '토치') AS f_term,
        final_end - s_start >= 1.5e0 AND CASE WHEN body LIKE '% /1 %' THEN
          (b1 - s_start > 0 AND 7 > (b1 - s_start) * 13 * 1.2e0 + 3) OR (final_end - b1 > 0 AND 7 > (final_end - b1) * 13 * 1.2e0 + 3)
          ELSE length(replace(ko, ' ', '')) > (final_end - s_start) * 13 * 1.2e0 + 3 END AS f_pace, rest LIKE '% ?' AS f_unsure
      FROM (SELECT *, replace(body, ' /1 ', ' ') AS ko FROM v_roots))""",
)
cte(
    "v_checked",
    """SELECT video_id, no, sentence_key, CASE WHEN rule IS NULL THEN ko END AS ko, CASE WHEN rule IS NULL THEN fl END AS flags,
      CASE WHEN rule IS NULL THEN CASE WHEN fl = '' THEN 'ok' ELSE 'flagged' END END AS state, rule, NULL::BIGINT AS merged_into_no
    FROM (SELECT *, concat_ws(',', CASE WHEN f_num THEN 'numbers' END, CASE WHEN f_term THEN 'terms' END, CASE WHEN f_pace THEN 'pace' END,
      CASE WHEN f_unsure THEN 'uncertain' END) AS fl FROM v_lines)
    UNION ALL SELECT video_id, no, sentence_key, NULL, '', 'ok', NULL, no - 1 FROM v_sent WHERE no % 10 = 9""",
)


@query("cmp11_line_checks", "SELECT * FROM v_checked")
def _(spark, sf):
    _, (lines, _) = checked(spark, sf)
    return lines.drop("breaks").withColumn("flags", F.array_join("flags", ","))


@query(
    "cmp11_segments",
    """SELECT video_id, no, 0 AS seg_no, CASE WHEN body LIKE '% /1 %' THEN '번역 문장입니다' ELSE ko END AS seg_text, s_start AS seg_start,
      CASE WHEN body LIKE '% /1 %' THEN b1 ELSE final_end END AS seg_end FROM v_lines WHERE rule IS NULL
    UNION ALL SELECT video_id, no, 1, '다음 구절입니다', b1, final_end FROM v_lines WHERE rule IS NULL AND body LIKE '% /1 %'""",
)
def _(spark, sf):
    _, (_, segments) = checked(spark, sf)
    return segments.drop("sentence_key")


@query(
    "win21_merge_chains",
    """SELECT video_id, no, max(CASE WHEN no % 7 NOT IN (3, 4) OR no = 1 THEN no END) OVER (PARTITION BY video_id ORDER BY no) AS root_no FROM v_sent""",
)
def _(spark, sf):
    t = sentences(spark, sf)
    said = t.select("video_id", "no", F.when(F.expr("no % 7 in (3, 4)"), "=").otherwise("번역").alias("rest"))
    return R.chains(t, said, nothing_stored(t)).select("video_id", "no", "root_no")


cte("v_long", "SELECT video_id, no, s_start, s_end, repeat(s_text, 4) AS s_text, no % 37 = 0 AS opens FROM v_sent")
cte(
    "v_nat",
    """SELECT *, length(s_text) AS size, coalesce(s_start - lag(s_end) OVER (PARTITION BY video_id ORDER BY no) >= 2e0, false) OR opens AS natural FROM v_long""",
)
cte(
    "v_pack",
    """-- (video_id, no, batch, chars, closed)
    SELECT video_id, no, no - 1, size, false FROM v_nat WHERE no = 1
    UNION ALL SELECT n.video_id, n.no, CASE WHEN w.closed OR w.chars + n.size > 5000 THEN n.no - 1 ELSE w.batch END,
      CASE WHEN w.closed OR w.chars + n.size > 5000 THEN n.size ELSE w.chars + n.size END,
      NOT (w.closed OR w.chars + n.size > 5000) AND n.natural AND w.chars + n.size >= 2500
    FROM v_pack w JOIN v_nat n ON n.video_id = w.video_id AND n.no = w.no + 1""",
)


@query("win19_translation_batches", "SELECT video_id, no, batch FROM v_pack")
def _(spark, sf):
    t = sentences(spark, sf)
    opens = t.filter("no % 37 = 0").select("video_id", F.col("s_start").alias("c_start"))
    unsaved = t.select("video_id", (F.col("no") - 1).alias("idx"), "no", "s_start", "s_end", F.repeat("s_text", F.lit(4)).alias("s_text"))
    return R.batches(cut(unsaved), opens).select("video_id", "no", "batch")


@query(
    "win20_context_windows",
    """SELECT a.video_id, a.no, coalesce(string_agg(b.no::VARCHAR, ',' ORDER BY b.no), '') AS near FROM v_sent a LEFT JOIN v_sent b
      ON b.video_id = a.video_id AND b.no BETWEEN a.no - 2 AND a.no + 2 AND b.no <> a.no GROUP BY 1, 2""",
)
def _(spark, sf):
    return R.context(sentences(spark, sf), before=2, after=2).select(
        "video_id", "no", F.array_join(F.transform("near", lambda x: x["no"].cast("string")), ",").alias("near")
    )


@query(
    "agg27_reject_counter",
    """SELECT video_id, no, CASE no % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS rejects,
      CASE no % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'open' WHEN 2 THEN 'untranslated' ELSE 'ok' END AS state FROM v_sent""",
)
def _(spark, sf):
    # accepted once; refused once; refused twice; refused, accepted, refused
    past = F.expr(
        "CASE no % 4 WHEN 0 THEN array(true) WHEN 1 THEN array(false) WHEN 2 THEN array(false, false) ELSE array(false, true, false) END"
    )
    history = sentences(spark, sf).select("video_id", "no", F.posexplode(past).alias("seq", "accepted"))
    return R.reject_states(history)


def stored_lines(table):
    """Stored lines by key: some missing, some whose sentence is gone."""
    return table.filter("no % 5 <> 0").select(
        "video_id", "no",
        F.when(F.expr("no % 7 = 3"), F.concat(F.lit("gone-"), F.col("sentence_key"))).otherwise(F.col("sentence_key")).alias("sentence_key"),
        F.expr(
            "CASE WHEN no % 11 = 4 THEN NULL WHEN no % 4 = 0 THEN '그렇게 했어요.' WHEN no % 4 = 1 THEN '\"좋아요\" 라고 합니다.' "
            "WHEN no % 4 = 2 THEN '왜일까요?' ELSE '이것은 문장입니다' END"
        ).alias("ko"),
        F.expr("CASE WHEN no % 11 = 4 THEN 'untranslated' WHEN no % 3 = 0 THEN 'flagged' ELSE 'ok' END").alias("state"),
        F.expr("CASE WHEN no % 3 = 0 AND no % 11 <> 4 THEN array('numbers', 'style', 'pace') ELSE cast(array() as array<string>) END").alias("flags"),
        F.expr("no % 2 = 0").alias("reviewed"),
    )


cte(
    "v_stored",
    """SELECT video_id, no, CASE WHEN no % 7 = 3 THEN 'gone-' ELSE '' END || sentence_key AS sentence_key, s_start, s_end,
      CASE WHEN no % 11 = 4 THEN NULL WHEN no % 4 = 0 THEN '그렇게 했어요.' WHEN no % 4 = 1 THEN '"좋아요" 라고 합니다.'
        WHEN no % 4 = 2 THEN '왜일까요?' ELSE '이것은 문장입니다' END AS ko,
      CASE WHEN no % 11 = 4 THEN 'untranslated' WHEN no % 3 = 0 THEN 'flagged' ELSE 'ok' END AS state, no % 2 = 0 AS reviewed
    FROM v_sent WHERE no % 5 <> 0""",
)
cte(
    "v_style",
    """SELECT * FROM (SELECT *, CASE no % 4 WHEN 0 THEN 'informal' WHEN 1 THEN 'formal' WHEN 3 THEN 'formal' END AS style,
      count(*) FILTER (no % 4 IN (1, 3)) OVER v AS f, count(*) FILTER (no % 4 = 0) OVER v AS i
      FROM v_stored WHERE state <> 'untranslated' WINDOW v AS (PARTITION BY video_id))
    WHERE f > 0 AND i > 0 AND f <> i AND style = CASE WHEN i < f THEN 'informal' ELSE 'formal' END""",
)


@query("agg23_style_minority", "SELECT video_id, no, style FROM v_style")
def _(spark, sf):
    return R.style_minority(stored_lines(sentences(spark, sf)))


@query(
    "cmp12_reevaluated_flags",
    """SELECT s.video_id, s.no, concat_ws(',', CASE WHEN s.state = 'flagged' THEN 'numbers' END,
        CASE WHEN s.s_end - s.s_start >= 1.5e0 AND length(replace(s.ko, ' ', '')) > 0.5e0 * 13 * 1.2e0 + 3 THEN 'pace' END,
        CASE WHEN y.no IS NOT NULL THEN 'style' END) AS flags
    FROM v_stored s LEFT JOIN v_style y ON y.video_id = s.video_id AND y.no = s.no WHERE s.state <> 'untranslated'""",
)
def _(spark, sf):
    t = sentences(spark, sf)
    lines = stored_lines(t)
    segments = lines.filter("ko is not null").select(
        "video_id", "no", F.col("ko").alias("seg_text"), F.lit(0.0).alias("seg_start"), F.lit(0.5).alias("seg_end")
    )
    spans = t.select("video_id", "no", (F.col("s_end") - F.col("s_start")).alias("secs"))
    return R.reevaluate(lines, segments, spans).select("video_id", "no", F.array_join("flags", ",").alias("flags"))


@query(
    "agg20_progress_phase",
    """SELECT v.video_id, sentences, translated, flagged, untranslated, CASE WHEN v.video_id % 4 = 0 THEN 'terms' WHEN have < sentences THEN 'translate'
      WHEN v.video_id % 4 = 1 OR open_ > 0 THEN 'review' ELSE 'done' END AS phase FROM v_videos v JOIN (
      SELECT s.video_id, count(*) AS sentences, count(*) FILTER (l.state IN ('ok', 'flagged')) AS translated, count(*) FILTER (l.state = 'flagged') AS flagged,
        count(*) FILTER (l.state = 'untranslated') AS untranslated, count(l.state) AS have, count(*) FILTER (l.state = 'flagged' AND NOT l.reviewed) AS open_
      FROM v_sent s LEFT JOIN v_stored l ON l.video_id = s.video_id AND l.sentence_key = s.sentence_key GROUP BY 1) USING (video_id)""",
)
def _(spark, sf):
    t = sentences(spark, sf)
    v = A.videos(spark, sf).select(
        "video_id", (F.col("video_id") % 4 != 0).alias("terms_done"), (F.col("video_id") % 4 != 1).alias("consistency_done")
    )
    return R.progress(t, stored_lines(t), v)


@query(
    "jon12_viewer_sentences",
    """SELECT s.video_id, s.no, s.s_text, CASE WHEN l.state <> 'untranslated' THEN l.ko END AS ko, coalesce(l.state, 'pending') AS state
    FROM v_sent s LEFT JOIN v_stored l ON l.video_id = s.video_id AND l.sentence_key = s.sentence_key""",
)
def _(spark, sf):
    t = sentences(spark, sf)
    return R.viewer_rows(t, stored_lines(t).withColumn("merged_into", F.lit(None).cast("string"))).select(
        "video_id", "no", "s_text", "ko", "state"
    )


@query("jon12_orphan_translations", "SELECT video_id, sentence_key FROM v_stored WHERE sentence_key LIKE 'gone-%'")
def _(spark, sf):
    t = sentences(spark, sf)
    return R.orphans(t, stored_lines(t)).select("video_id", "sentence_key")


@query(
    "agg22_term_consistency",
    """SELECT DISTINCT video_id, no FROM v_sent WHERE (video_id % 2 = 0 AND contains(s_text, 'torch')) OR (video_id % 3 = 0 AND contains(s_text, '1,200'))""",
)
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(s).alias("src"), F.lit(g).alias("tgt"), F.lit(m).alias("m")) for s, g, m in (
        ("torch", "토치", 1), ("torch", "횃불", 2), ("1,200", "천이백", 1), ("1,200", "1200", 3), ("ResNet50", "ResNet50", 1))])
    terms = A.videos(spark, sf).select("video_id", F.explode(rows).alias("r")).select("video_id", "r.*").filter("video_id % m = 0")
    return R.inconsistent_terms(terms, sentences(spark, sf))


@query(
    "agg21_quality_report",
    """SELECT v.video_id, CASE WHEN v.video_id % 3 = 0 THEN 0 ELSE 3 END AS terms_count, CASE WHEN v.video_id % 3 = 0 THEN 0 ELSE 1 END AS uncertain,
      CASE WHEN v.video_id % 3 = 0 THEN 0 ELSE 1 END AS corrections, coalesce(u, 0) AS untranslated, coalesce(round(p::DOUBLE / nullif(d, 0), 4), 0) AS speed_over_ratio,
      v.video_id % 3 = 0 AS no_terms_warning
    FROM v_videos v LEFT JOIN (SELECT video_id, count(*) FILTER (state = 'flagged') AS p, count(*) FILTER (state <> 'untranslated') AS d,
      count(*) FILTER (state = 'untranslated') AS u FROM v_stored GROUP BY 1) USING (video_id)""",
)
def _(spark, sf):
    v = A.videos(spark, sf)
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("src"), F.array(F.lit(e)).alias("evidence"), F.lit(st).alias("status"))
            for s, e, st in (("PyTorch", "S1", "confirmed"), ("ResNets", "S2", "confirmed"), ("ConvNet", "C1", "uncertain"))
        ]
    )
    terms = v.filter("video_id % 3 <> 0").select("video_id", F.explode(rows).alias("r")).select("video_id", "r.*")
    heard = F.array(*[F.struct(F.lit(i).alias("suspect_id"), F.lit(h).alias("heard")) for i, h in (("S1", "torch"), ("S2", "Res-Net"))])
    suspects = v.select("video_id", F.explode(heard).alias("r")).select("video_id", "r.*")
    return R.report(v, stored_lines(sentences(spark, sf)), terms, suspects, v.select("video_id").filter("false"))


@query(
    "jon16_bilingual_cues",
    """SELECT c.video_id, c.cue_idx AS cue_id, coalesce(string_agg(w.text, ' ' ORDER BY w.idx), '') AS en FROM v_cues c LEFT JOIN v_words w
      ON w.video_id = c.video_id AND w.start_s < c.cue_end - 1e-6 AND w.end_s > c.cue_start + 1e-6 GROUP BY 1, 2""",
)
def _(spark, sf):
    shown = A.cues(spark, sf).select(
        "video_id", F.col("cue_idx").alias("cue_id"), F.col("cue_start").alias("d_start"), F.col("cue_end").alias("d_end")
    )
    return R.bilingual(shown, A.words(spark, sf)).select("video_id", "cue_id", "en")


@query(
    "win25_short_cues",
    """SELECT video_id, cue_idx, d_start, CASE WHEN d_end - d_start < 1.5e0 AND ns IS NOT NULL THEN greatest(d_end, ns - 0.01e0) ELSE d_end END AS d_end FROM (
      SELECT *, lead(d_start) OVER (PARTITION BY video_id ORDER BY cue_idx) AS ns FROM (SELECT video_id, cue_idx, cue_start AS d_start,
        CASE WHEN cue_idx % 3 = 0 THEN cue_start + 1e0 ELSE cue_end END AS d_end FROM v_cues))""",
)
def _(spark, sf):
    shown = A.cues(spark, sf).select(
        "video_id", "cue_idx", F.col("cue_start").alias("d_start"),
        F.when(F.col("cue_idx") % 3 == 0, F.col("cue_start") + 1.0).otherwise(F.col("cue_end")).alias("d_end"),
    )
    return R.stretch_short(shown)


cte(
    "v_joined",
    """SELECT video_id, root_no, string_agg(s_text, ' ' ORDER BY no) AS en, max(CASE WHEN no = root_no THEN ko END) AS ko FROM (
      SELECT *, max(CASE WHEN no % 8 <> 5 THEN no END) OVER (PARTITION BY video_id ORDER BY no) AS root_no, CASE WHEN no % 3 = 0 THEN '번역된 문장' END AS ko
      FROM v_sent) GROUP BY 1, 2""",
)


@query(
    "top4_sentence_filter",
    """SELECT q.query_id, video_id, root_no, en FROM v_joined, (VALUES (1, 'TORCH'), (2, '번역된'), (3, 'resnet50 ')) q(query_id, needle)
    WHERE contains(lower(en), lower(trim(needle))) OR contains(lower(coalesce(ko, '')), lower(trim(needle)))""",
)
def _(spark, sf):
    rows = sentences(spark, sf).select(
        "video_id", "no", "s_text", (F.col("no") % 8 == 5).alias("merged"), F.when(F.col("no") % 3 == 0, "번역된 문장").alias("ko")
    )
    asked = spark.createDataFrame([(1, "TORCH"), (2, "번역된"), (3, "resnet50 ")], "query_id int, needle string")
    return R.filter_sentences(rows, asked)


@query(
    "sca16_reply_lines",
    """SELECT video_id, no, s_text AS rest FROM v_sent WHERE no % 6 <> 5 UNION ALL SELECT video_id, no, 'second' FROM v_sent WHERE no % 6 = 5""",
)
def _(spark, sf):
    # one reply per ten sentences, each line decorated another way, some answered twice
    line = F.expr(
        "CASE no % 6 WHEN 0 THEN concat('- ', no, '|', s_text) WHEN 1 THEN concat('**', no, '** | ', s_text) WHEN 2 THEN concat('`', no, '|', s_text, '`') "
        "WHEN 3 THEN concat('| ', no, ' | ', s_text, ' |') WHEN 4 THEN concat('  ', no, '|', s_text) ELSE concat(no, '|first\\n', no, '| second') END"
    )
    replies = sentences(spark, sf).groupBy("video_id", F.expr("(no - 1) div 10").alias("part")).agg(
        F.concat(
            F.lit("```\n|---|---|\n\n"),
            F.array_join(F.array_sort(F.collect_list(F.struct("no", line.alias("l")))).getField("l"), "\n"),
            F.lit("\nsome closing words\n```"),
        ).alias("reply")
    )
    return R.numbered_lines(replies).select("video_id", "no", "rest")


@query("sca16_term_lines")
def _(spark, sf):
    replies = sentences(spark, sf).select(
        "video_id", "no",
        F.concat(F.lit("- T"), F.col("no"), F.lit("|src|tgt|-|-|S1\n**S2|-**\n`C3|-`\n|---|\n"), F.col("s_text")).alias("reply"),
    )
    return R.term_lines(replies).withColumn("fields", F.array_join("fields", "|"))


@query(
    "sca8_numbers",
    f"""SELECT video_id, no, array_to_string(list_sort({NUM.format('s_text')}), '|') AS nums FROM v_sent""",
)
def _(spark, sf):
    return sentences(spark, sf).select("video_id", "no", F.array_join(F.array_sort(X.numbers(F.col("s_text"))), "|").alias("nums"))


@query(
    "sca10_char_budget",
    "SELECT video_id, no, greatest(8, round_even((s_end - s_start) * 13, 0)::INT) AS budget FROM v_sent",
)
def _(spark, sf):
    return sentences(spark, sf).select("video_id", "no", X.char_budget(F.col("s_end") - F.col("s_start")).alias("budget"))


@query(
    "sca9_hangul_share",
    """SELECT doc_id, CASE WHEN letters = 0 THEN 0 ELSE hangul / letters END AS share FROM (SELECT doc_id,
      length(regexp_replace(ko, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(ko, '[^가-힣]', '', 'g')) AS hangul FROM (
      SELECT doc_id, regexp_replace(text, '[A-Za-z][A-Za-z0-9.\\-]*', '', 'g') AS ko FROM v_guard))""",
)
def _(spark, sf):
    return A.guard_texts(spark, sf).select("doc_id", X.hangul_share(F.col("text")).alias("share"))


cte(
    "v_sfp",
    """SELECT video_id, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY i)) AS sentences_fp FROM (
      SELECT video_id, i // 4096 AS i, sha256(string_agg(h, chr(10) ORDER BY i)) AS h FROM (
        SELECT video_id, no // 4096 AS i, sha256(string_agg(sentence_key, chr(10) ORDER BY no)) AS h FROM v_sent GROUP BY 1, 2)
      GROUP BY 1, 2) GROUP BY 1""",
)


@query("agg26_sentences_fingerprint", "SELECT * FROM v_sfp")
def _(spark, sf):
    return FP.sentence_list(sentences(spark, sf))
