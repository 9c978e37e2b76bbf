"""Greedy segmentation against word-by-word loops on random talks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.operators import segment as S

SCHEMA = (
    "video_id long, idx long, text string, start_s double, end_s double, speaker string, "
    "speaker_global string, speaker_status string, origin string"
)


def talk(seed, n=700, calm=False):
    """Random words over more than one time bucket; ``calm`` talks hardly pause."""
    rng = random.Random(seed)
    at, out, who = 0, [], "a"
    for i in range(n):
        pause = rng.choice([0, 40, 80]) if calm else rng.choice([0, 50, 90, 350, 700, 1300, 2700])
        at += pause
        length = rng.choice([80, 200, 400, 900, 2500])
        text = rng.choice(["word", "a", "longerword", "x" * 25, "stop.", "pause,"] if not calm else ["word", "next"])
        if not calm and rng.random() < 0.03:
            who = rng.choice("ab")
        out.append((seed, i, text, at / 1000.0, (at + length) / 1000.0, who, None, rng.choice(["confirmed", "inferred"]), "gemini"))
        at += length if rng.random() < 0.9 else length // 2
    return out


@pytest.fixture(scope="module")
def talks():
    return talk(1) + talk(2, calm=True) + talk(3, 1500) + talk(4, 1)


def split(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def starts(df):
    out = {}
    for r in df.select("video_id", "grp").distinct().collect():
        out.setdefault(r.video_id, set()).add(r.grp)
    return out


def test_spans(spark, talks):
    want = {}
    for v, ws in split(talks).items():
        first, cuts = ws[0], {0}
        for p, w in zip(ws, ws[1:]):
            if w[3] - p[4] > 2.5 or w[4] - first[3] > 30.0 or w[5] != p[5]:
                cuts.add(w[1])
                first = w
        want[v] = cuts
    df = spark.createDataFrame(talks, SCHEMA)
    assert starts(S.span_starts(df)) == want


def test_unresolved_speaker_is_not_claimed(spark):
    rows = [
        (1, 0, "a", 0.0, 0.5, "spk:1", "speaker:0", "confirmed", "gemini"),
        (1, 1, "b", 0.6, 0.9, "spk:1", "speaker:0", "unresolved", "gemini"),
        (1, 2, "c", 5.0, 5.5, "spk:2", "speaker:1", "inferred", "gemini"),
    ]
    a, b = S.spans(spark.createDataFrame(rows, SCHEMA)).orderBy("start_s").collect()
    assert (a.speaker, a.speaker_candidate, a.speaker_confidence) == (None, "speaker:0", 0.0)
    assert (b.speaker, b.speaker_status, b.speaker_confidence) == ("speaker:1", "inferred", 0.75)


@pytest.mark.parametrize("width", [1, 20])
def test_rendered_cues(spark, talks, width):
    def lines(ws):
        n, room = 0, None
        for w in ws:
            if room is not None and room + 1 + len(w[2]) <= width:
                room += 1 + len(w[2])
            else:
                n, room = n + 1, len(w[2])
        return n

    want = {}
    for v, ws in split(talks).items():
        group, cuts = [ws[0]], {0}
        for w in ws[1:]:
            p = group[-1]
            if w[5] != p[5] or w[3] - p[4] > 0.65 or w[4] - group[0][3] > 7.0 or lines([*group, w]) > 2:
                group = []
                cuts.add(w[1])
            group.append(w)
        want[v] = cuts
    df = spark.createDataFrame(talks, SCHEMA)
    assert starts(S.cue_starts(df, width)) == want


def test_no_word_is_lost(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA)
    assert all(r.complete for r in S.retention(df, S.cues(df)).collect())


def test_subtitle_sentences(spark, talks):
    end = re.compile(L.SENTENCE_END)
    want = {}
    for v, ws in split(talks).items():
        cuts, group = set(), []
        for w in ws:
            if group and w[3] - group[-1][4] > 1.2:
                cuts.add(group[0][1])
                group = []
            group.append(w)
            if end.search(w[2]):
                cuts.add(group[0][1])
                group = []
            elif len(group) >= 35:
                gaps = [(group[i][3] - group[i - 1][4], -i) for i in range(25, 35)]
                at = -max(gaps)[1]
                cuts.add(group[0][1])
                group = group[at:]
        if group:
            cuts.add(group[0][1])
        want[v] = cuts
    df = spark.createDataFrame(talks, SCHEMA)
    assert starts(S.sentence_starts(df)) == want


def test_breath_points_never_repeat_a_time(spark):
    rows = [
        (1, 0, "one,", 0.0, 0.4, "a", None, None, "gemini"),
        (1, 1, "two,", 0.5, 0.5, "a", None, None, "gemini"),
        (1, 2, "three", 0.5, 0.9, "a", None, None, "gemini"),
        (1, 3, "four", 1.3, 1.5, "a", None, None, "gemini"),
    ]
    got = S.breath_points(spark.createDataFrame(rows, SCHEMA).withColumn("grp", F.lit(0).cast("long"))).orderBy("k").collect()
    assert [(r.k, r.breath_at) for r in got] == [(1, 0.5), (2, 1.3)]


def test_gap_needs_silence_and_particle(spark):
    rows = [
        (1, 0, "그래서", 0.0, 1.0, "a", None, None, "gemini"),
        (1, 1, "라는", 2.6, 3.0, "a", None, None, "gemini"),
        (1, 2, "것", 5.0, 5.2, "a", None, None, "gemini"),
        (1, 3, "을", 6.0, 6.2, "b", None, None, "gemini"),
    ]
    got = S.missing_gaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(g.gap_idx, g.gap_start, g.gap_end, g.gap_speaker) for g in got] == [(0, 1.0, 2.6, "a")]


def test_width_must_be_positive(spark, talks):
    with pytest.raises(ValueError):
        S.cue_starts(spark.createDataFrame(talks, SCHEMA), 0)
