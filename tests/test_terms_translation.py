"""Mis-hearings, glossary rules, translated lines, metering."""

import difflib
from datetime import datetime

from pyspark.sql import functions as F

from talkspark.functions import text as X
from talkspark.operators import segment as S
from talkspark.operators import terms as T
from talkspark.operators import translation as R
from talkspark.operators import usage as U

SPOKEN = "video_id int, idx long, text string, start_s double, end_s double, origin string"


def words(spark, texts, step=1.0):
    return spark.createDataFrame([(1, i, t, i * step, i * step + 0.8, "gemini") for i, t in enumerate(texts)], SPOKEN)


def test_suspects_from_captions(spark):
    w = words(spark, ["we", "use", "convent", "js", "here", "tools"])
    cues = spark.createDataFrame(
        [(1, 0, 0.0, 6.0, "we use ConvNetJS here"), (1, 1, 0.0, 6.0, "tool's convent")],
        "video_id int, cue_idx long, cue_start double, cue_end double, cue_text string",
    )
    got = [(r.heard, r.caption, r.t) for r in T.suspects(w, cues).collect()]
    assert got == [("convent js", "ConvNetJS", 2.0)]


def test_slide_evidence_equals_all_pairs(spark):
    heard = ["nano gpt", "convent js", "abc", "resnet", "pi torch"]
    shown = ["NanoGPT", "ConvNetJS", "axc", "abc", "ResNets", "pytorch", "xy", "unrelated"]
    s = spark.createDataFrame([(1, h, h.upper(), 0.0) for h in heard], "video_id int, heard string, caption string, t double")
    f = spark.createDataFrame([(1, i, float(i), t) for i, t in enumerate(shown)], "video_id int, frame_no int, frame_at double, ocr_text string")
    got = {r.heard: r.slide for r in T.attach_slides(s, f).collect()}
    norm = lambda t: "".join(c for c in t.lower() if c.isalnum())
    for h in heard:
        best = max(((difflib.SequenceMatcher(None, norm(h), norm(t)).ratio(), -i, t) for i, t in enumerate(shown)))
        assert got[h] == (best[2] if best[0] >= 0.8 else None)


def test_noise_pairs(spark):
    pairs = [("there's", "there is"), ("self-supervised", "self supervised"), ("model", "models"), ("the", "that"), ("torch", "PyTorch"), ("cat", "category")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.a: r.n for r in df.select("a", X.noise_pair(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {"there's": True, "self-supervised": True, "model": True, "the": True, "torch": False, "cat": False}


def test_shapes(spark):
    df = spark.createDataFrame([(t,) for t in ["GPT", "iPhone", "Word", "word", "v1.5", "A", "15", "It's", "X2"]], "t string")
    got = {r.t: r.s for r in df.select("t", X.interesting(F.col("t")).alias("s")).collect()}
    assert got == {"GPT": True, "iPhone": True, "Word": False, "word": False, "v1.5": True, "A": False, "15": False, "It's": False, "X2": True}


def test_glossary_rules(spark):
    w = words(spark, ["nano", "gpt", "trains", "on", "Torch,", "data"])
    s = spark.createDataFrame([(1, "S1", "nano gpt", 0.0)], "video_id int, suspect_id string, heard string, t double")
    c = spark.createDataFrame([(1, "C1")], "video_id int, candidate_id string")
    lines = [
        ["NanoGPT", "나노", "-", "-", "S1"], ["torch", "토치", "-", "설명", "-"], ["times", "시간", "-", "-", "-"], ["torch", "", "-", "-", "-"],
        ["torch", "토치", "x" * 17, "y", "-"], ["torch", "토치", "a", "-", "-"], ["Unknown", "무", "-", "-", "C1"], ["Unknown", "무", "-", "-", "-"],
        ["torch", "토치"], ["trains on", "?", "-", "-", "-"],
    ]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(lines)], "video_id int, line_no long, fields array<string>")
    got = {r.line_no: r for r in T.check_terms(df, s, c, w).collect()}
    assert [got[i].rule for i in range(10)] == [
        None, None, "everyday word", "empty", "short explanation too long", "short explanation without note", "not spoken",
        "correction without suspect", "too few fields", None,
    ]
    # a heard form equal to the term without blanks is no mis-hearing
    assert got[0].heard == [] and got[0].first_t == 0.0
    assert got[1].first_t == 4.0 and got[9].status == "uncertain" and got[9].tgt == "trains on" and got[9].first_t == 2.0


def test_heard_forms(spark):
    pairs = [("gradient", "gradient descent"), ("gradiant descend", "gradient descent"), ("Benjio", "Yoshua Bengio"), ("piano", "torch")]
    df = spark.createDataFrame(pairs, "heard string, src string")
    assert {r.heard for r in T.heard_forms(df).collect()} == {"gradiant descend", "Benjio"}


SENT = "video_id int, no long, grp long, s_start double, s_end double, s_text string, sentence_key string"


def check(spark, rests, stored=()):
    sents = [(1, n, n * 10, n * 4.0, n * 4.0 + 3.5, "a sentence with 1,200 torch", f"k{n}") for n in range(1, 7)]
    t = spark.createDataFrame(sents, SENT)
    a = spark.createDataFrame([(1, n, r) for n, r in rests.items()], "video_id int, no long, rest string")
    old = spark.createDataFrame(list(stored), "video_id int, no long, state string, merged_into_no long")
    b = spark.createDataFrame([(1, n, k, n * 4.0 + k) for n in range(1, 7) for k in (1, 2)], "video_id int, no long, k long, breath_at double")
    g = spark.createDataFrame([(1, "torch", "토치", "confirmed")], "video_id int, form string, tgt string, status string")
    lines, segs = R.check_lines(R.chains(t, a, old), b, g)
    return {r.no: r for r in lines.collect()}, {(r.no, r.seg_no): (r.seg_start, r.seg_end) for r in segs.collect()}


def test_line_checks(spark):
    lines, segs = check(
        spark,
        {1: "문장 1200 토치 /1 다음 /2 끝", 2: "all english", 3: "숫자 없음 ?", 4: "문장 /2 뒤 /1 앞", 5: "문장 /3 밖", 6: "1/2 은 1200 토치"},
    )
    assert lines[1].rule is None and lines[1].flags == [] and lines[1].breaks == ["1", "2"]
    assert segs[1, 0] == (4.0, 5.0) and segs[1, 1] == (5.0, 6.0) and segs[1, 2] == (6.0, 7.5)
    assert lines[2].rule == "too little hangul"
    assert lines[3].flags == ["numbers", "terms", "uncertain"] and lines[3].ko == "숫자 없음"
    assert lines[4].rule == "breaths not increasing" and lines[5].rule == "breath out of range"
    assert lines[6].rule is None and lines[6].breaks == []


def test_merge_chain(spark):
    lines, segs = check(spark, {1: "문장 1200 토치 /+1 다음 /+2.1 끝", 2: "=", 3: "=", 4: "문장 /+1 토치", 6: "="})
    assert lines[1].rule is None and lines[1].breaks == ["+1", "+2.1"]
    assert segs[1, 0] == (4.0, 8.0) and segs[1, 2] == (13.0, 15.5)
    assert lines[2].merged_into_no == 1 and lines[3].merged_into_no == 2
    assert lines[4].rule == "merge out of range"
    assert lines[6].rule == "nothing to merge into"


def test_stored_merge_still_counts_for_the_root(spark):
    lines, segs = check(spark, {1: "문장 1200 토치 /+1 다음"}, stored=[(1, 2, "ok", 1)])
    assert lines[1].rule is None and segs[1, 1] == (8.0, 11.5)


def test_styles(spark):
    df = spark.createDataFrame([(t,) for t in ["합니다.", "해요", "그렇죠", "왜일까요?", '"해요" 라고 합니다', ""]], "t string")
    got = [r.s for r in df.select(X.speech_style(F.col("t")).alias("s")).collect()]
    assert got == ["formal", "informal", None, None, "formal", None]


def test_orphans_are_hidden_not_deleted(spark):
    s = spark.createDataFrame([(1, 1, "k1", "a"), (1, 2, "k2", "b")], "video_id int, no long, sentence_key string, s_text string")
    lines = spark.createDataFrame(
        [(1, "k1", "가", "ok", [], None), (1, "gone", "나", "ok", [], None)],
        "video_id int, sentence_key string, ko string, state string, flags array<string>, merged_into string",
    )
    assert [(r.no, r.ko, r.state) for r in R.viewer_rows(s, lines).orderBy("no").collect()] == [(1, "가", "ok"), (2, None, "pending")]
    assert [r.sentence_key for r in R.orphans(s, lines).collect()] == ["gone"]


def attempts(spark, stamps):
    rows = [("k", i, datetime.fromisoformat(t)) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "key_hash string, event_id int, ts timestamp")


def test_minute_window_is_strict_and_restarts_at_midnight(spark):
    a = attempts(spark, ["2026-01-02 07:59:30", "2026-01-02 07:59:40", "2026-01-02 08:00:10", "2026-01-02 08:01:10", "2026-01-02 08:01:11"])
    got = [(r.rpm_attempts, r.wait_us) for r in U.recent(a, 2).orderBy("event_id").collect()]
    assert got == [(1, 0), (2, 50_000_000), (1, 0), (1, 0), (2, 59_000_000)]


def test_daily_counts_by_pacific_day(spark):
    a = attempts(spark, ["2026-01-02 07:59:59", "2026-01-02 08:00:00"])
    assert {(r.day, r.attempts) for r in U.daily(a).collect()} == {("2026-01-01", 1), ("2026-01-02", 1)}


def test_sentence_key_depends_on_content_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (1.0, 2.0, "a"), (1.0, 2.001, "a")], "a double, b double, t string")
    keys = [r.k for r in df.select(S.sentence_key(F.col("a"), F.col("b"), F.col("t")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_attempts_of_one_microsecond_wait_for_the_same_slot(spark):
    rows = [(0, "k", "2024-01-01 10:00:00"), (1, "k", "2024-01-01 10:00:10"), (2, "k", "2024-01-01 10:00:10"), (3, "k", "2024-01-01 10:00:10")]
    a = spark.createDataFrame(rows, "event_id int, key_hash string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.rpm_attempts, r.wait_us) for r in U.recent(a, 2).orderBy("event_id").collect()]
    assert got == [(1, 0)] + [(4, 60_000_000)] * 3
    assert {r.wait_us for r in U.recent(a, 4).filter("event_id > 0").collect()} == {50_000_000}
