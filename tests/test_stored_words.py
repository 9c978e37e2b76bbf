"""Steps over stored words: one pass numbers merged words, cues and frames take the words as given."""

from __future__ import annotations

import re

from talkspark.operators import gapfill as G
from talkspark.operators import moments as V
from talkspark.plans import queries_terms as Q
from talkspark.sources import adapters as A

SMALL = "/root/testdata/sf0.001"


def test_merged_words_are_numbered_without_a_row_per_word_to_join(spark, monkeypatch):
    words = spark.createDataFrame([(v, i, f"w{i}", float(i), i + 0.4, "s", "gemini") for v in (1, 2) for i in range(4)], "video_id long, idx long, text string, start_s double, end_s double, speaker string, origin string")
    extra = spark.createDataFrame([(1, 0, 0, "a", 0.5, 0.6, "s", "youtube"), (1, 0, 1, "b", 0.6, 0.7, "s", "youtube"), (1, 2, 0, "c", 2.5, 2.6, "s", "youtube")], "video_id long, idx long, seq int, text string, start_s double, end_s double, speaker string, origin string")
    monkeypatch.setattr(G, "inserted_words", lambda *_: extra)
    out = G.merge(words, None, None)
    rows = sorted((r["video_id"], r["idx"], r["text"]) for r in out.collect())
    assert rows == [(1, i, t) for i, t in enumerate(["w0", "a", "b", "w1", "w2", "c", "w3"])] + [(2, i, f"w{i}") for i in range(4)]
    assert not re.search(r"Join[^\n]*old_idx", out._jdf.queryExecution().optimizedPlan().toString())


def test_candidates_make_the_words_once(spark, monkeypatch):
    made, whole = [], A.words
    monkeypatch.setattr(A, "words", lambda *a: made.append(1) or whole(*a))
    assert Q.candidates(spark, SMALL).count() and len(made) == 1


def test_given_words_make_the_same_cues_and_frames(spark):
    words = A.words(spark, SMALL)
    for make in (A.cues, A.frames):
        assert sorted(map(tuple, make(spark, SMALL, words).collect())) == sorted(map(tuple, make(spark, SMALL).collect()))


def test_references_join_nothing_with_a_row_per_word(spark):
    words = A.words(spark, SMALL)
    out = V.screen_references(words)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count()
