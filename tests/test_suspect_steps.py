"""Suspects: what is formed and compared, held against plain code."""

import difflib

from pyspark.sql import functions as F

from talkspark.operators import segment, terms
from test_steps import logical


def test_pairs_below_the_limit_are_not_matched(spark, monkeypatch):
    words = ["pytorch", "torch", "self", "supervised", "supervisor", "flesh", "shelf", "", "aaaa", "aab"]
    for low in (terms.MIN_RATIO, terms.SLIDE_RATIO):
        for a in words:
            for b in words:
                exact = difflib.SequenceMatcher(None, a, b).ratio()
                got = terms._ratio_from(a, b, low)
                assert got == exact or (got is None and exact < low)
    monkeypatch.setattr(terms, "_ratio", None)  # not called where nothing is shared
    assert terms._ratio_from("self", "1200", 0.55) is None


def test_forms_are_made_of_tokens_that_were_not_heard(spark):
    said = ["the", "torch", "Model.", "is", "big", "now"]
    words = spark.createDataFrame([(1, i, w, i * 0.4, i * 0.4 + 0.3, "gemini") for i, w in enumerate(said)], "video_id long, idx long, text string, start_s double, end_s double, origin string")
    cues = spark.createDataFrame([(1, 0, 0.0, 2.5, "the PyTorch model is big now"), (1, 1, 0.0, 2.5, "the torch Model. is")], "video_id long, cue_idx long, cue_start double, cue_end double, cue_text string")
    found = terms.suspects(words, cues)
    assert [(r.heard, r.caption) for r in found.collect()] == [("torch", "PyTorch")]
    assert "ws#" in logical(found) and ".text, " in logical(found)  # tokens meet the words' own texts first


def test_sentence_cuts_look_ahead_once(spark):
    rows = [(1, i, "w." if i % 50 == 49 else "w", i * 0.5, i * 0.5 + (0.1 if i % 37 == 9 else 0.4)) for i in range(300)]
    words = spark.createDataFrame(rows, "video_id long, idx long, text string, start_s double, end_s double")
    starts, run, i = [], 0, 0
    while i < 300:  # the rule, word by word: a sentence end, or the longest pause among the last ten of 35 words
        starts.append(i)
        stop = next((j + 1 for j in range(i, min(i + 35, 300)) if j % 50 == 49), None)
        if stop is None and i + 35 <= 300:
            gaps = [(rows[j][3] - rows[j - 1][4], -j) for j in range(i + 25, i + 35)]
            stop = -max(gaps)[1]
        i = stop if stop is not None else 300
    got = [r.grp for r in segment.sentence_starts(words).select("grp").distinct().orderBy("grp").collect()]
    assert got == starts
