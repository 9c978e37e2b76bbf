"""Repair, speakers, gap fill."""

import random

from pyspark.sql import functions as F

from talkspark.operators import gapfill as G
from talkspark.operators import normalize as N
from talkspark.operators import speakers as P

ENTRY = "video_id int, chunk_index int, pos long, text string, start_s double, end_s double, speaker string, audio_s double"


def entries(spark, rows, audio=None):
    return spark.createDataFrame([(1, 0, i, *r, "s", audio) for i, r in enumerate(rows)], ENTRY)


def test_one_bad_time_does_not_poison_the_rest(spark):
    rows = [("a", 0.0, 0.4), ("b", 22979.0, 22980.0), ("c", 1.0, 1.4), ("d", 1.5, None)]
    got = {r.text: (r.start_s, r.end_s, r.timestamp_repaired) for r in N.repair(entries(spark, rows, 100.0)).collect()}
    assert got["a"] == (0.0, 0.4, []) and got["c"] == (1.0, 1.4, [])
    assert got["b"][0] == 0.4 and got["b"][2] == ["start", "end"]
    assert got["d"][0] == 1.5 and got["d"][2] == ["end"]


def test_overlapping_speech_is_not_damage(spark):
    rows = [("a", 5.0, 6.0), ("yes", 4.0, 4.2), ("b", 6.0, 6.5)]
    assert all(not r.timestamp_repaired for r in N.repair(entries(spark, rows)).collect())


def test_gate_allows_three(spark):
    rows = [("w", float(i), i + 0.5) for i in range(20)]
    rows[3] = ("w", 3.0, None)
    rows[7] = ("w", None, None)
    assert N.corruption(N.repair(entries(spark, rows))).first().accepted
    rows[9] = ("w", 9.0, None)
    bad = N.corruption(N.repair(entries(spark, rows))).first()
    assert (bad.n_repairs, bad.accepted) == (4, False)


def test_duplicates_keep_the_first_arrival(spark):
    df = entries(spark, [("a", 1.0, 2.0), ("a", 1.0, 2.0), ("a", 1.0, 2.5)]).withColumn("speaker", F.col("pos").cast("string"))
    assert sorted((r.end_s, r.speaker) for r in N.drop_duplicates(df).collect()) == [(2.0, "0"), (2.5, "2")]


WORD = "video_id int, chunk_index long, pos long, text string, start_s double, end_s double, speaker_raw string"
CHUNK = "video_id int, chunk_index long, chunk_start double, chunk_end double"


def loop_dropped(words, chunks):
    """Arrival by arrival: drop a word of the re-heard range when a kept one is the same."""
    kept, gone = [], set()
    for c, start, _ in chunks:
        for w in [w for w in words if w[0] == c]:
            if c:
                lo, hi = start - 0.75, chunks[c - 1][2] + 0.75
                near = lo <= w[3] < hi and any(
                    k[2] == w[2] and abs(k[3] - w[3]) <= 0.75 and abs(k[4] - w[4]) <= 0.75 and lo <= k[3] < hi for k in kept
                )
                if near:
                    gone.add((c, w[1]))
                    continue
            kept.append(w)
    return gone


def test_overlap_duplicates_equal_the_loop(spark):
    rng = random.Random(5)
    chunks = [(c, c * 12.0, c * 12.0 + 20.0) for c in range(5)]  # three chunks can overlap
    words, pos = [], 0
    for c, lo, hi in chunks:
        for t in sorted(rng.uniform(lo, hi) for _ in range(60)):
            words.append((c, pos, rng.choice(["no", "yes"]), round(t, 3), round(t + rng.choice([0.1, 0.5, 1.2]), 3), "s"))
            pos += 1
    df = spark.createDataFrame([(1, *w) for w in words], WORD)
    ck = spark.createDataFrame([(1, *c) for c in chunks], CHUNK)
    got = {(r.chunk_index, r.pos) for r in P.dropped_words(df, ck).collect()}
    assert got == loop_dropped(words, chunks) and got


def two_chunks(pairs, extra=()):
    """Both chunks hear the same words; ``pairs`` gives (first label, second label, count)."""
    rows, pos, t = [], 0, 0.0
    for a, b, n in pairs:
        for _ in range(n):
            rows += [(1, 0, pos, f"w{pos}", t, t + 0.2, a), (1, 1, pos + 1000, f"w{pos}", t, t + 0.2, b)]
            pos, t = pos + 1, t + 1.0
    return rows + list(extra)


def mapped(spark, rows):
    df = spark.createDataFrame(rows, WORD)
    ck = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 0.0, 90.0)], CHUNK)
    gone = P.dropped_words(df, ck)
    return {(r.chunk_index, r.raw): (r.speaker_global, r.speaker_status) for r in P.mapping(P.labels(df), P.votes(df, gone)).collect()}


def test_swapped_labels_are_followed(spark):
    m = mapped(spark, two_chunks([("x", "y", 3), ("y", "x", 2)]))
    assert m[1, "y"] == ("speaker:0", "inferred") and m[1, "x"] == ("speaker:1", "inferred")


def test_one_vote_is_not_enough(spark):
    m = mapped(spark, two_chunks([("x", "x", 1)]))
    assert m[0, "x"] == ("speaker:0", "confirmed") and m[1, "x"] == ("speaker:1", "unresolved")


def test_a_speaker_is_claimed_once(spark):
    m = mapped(spark, two_chunks([("x", "p", 3), ("x", "q", 2)]))
    assert m[1, "p"] == ("speaker:0", "inferred") and m[1, "q"] == ("speaker:1", "unresolved")


def test_tie_is_no_decision(spark):
    m = mapped(spark, two_chunks([("x", "p", 2), ("y", "p", 2)]))
    assert m[1, "p"] == ("speaker:2", "unresolved")


def test_raw_label_kept(spark):
    rows = two_chunks([("x", "y", 3)])
    df = spark.createDataFrame(rows, WORD)
    ck = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 0.0, 90.0)], CHUNK)
    got = P.reconcile(df, ck).collect()
    assert len(got) == 3 and {(r.speaker, r.speaker_raw) for r in got} == {("speaker:0", "x")}


SPOKEN = "video_id int, idx long, text string, start_s double, end_s double, speaker string, origin string"


def fill(spark, words, cues, original=True):
    w = spark.createDataFrame([(1, i, t, a, b, "s", "gemini") for i, (t, a, b) in enumerate(words)], SPOKEN)
    c = spark.createDataFrame(
        [(1, i, a, b, t) for i, (a, b, t) in enumerate(cues)],
        "video_id int, cue_idx long, cue_start double, cue_end double, cue_text string",
    )
    k = spark.createDataFrame([(1, original)], "video_id int, original boolean")
    out = G.inserted_words(w, c, k).orderBy("idx", "seq").collect()
    merged = [r.text for r in G.merge(w, c, k).orderBy("idx").collect()]
    return [(r.idx, r.text, r.start_s, r.end_s) for r in out], merged


def test_gap_fill_splits_the_gap_in_order(spark):
    got, merged = fill(spark, [("우리", 0.0, 1.0), ("라는", 3.0, 3.5)], [(0.0, 4.0, "우리 self supervised 라는")])
    assert got == [(0, "self", 1.0, 2.0), (0, "supervised", 2.0, 3.0)]
    assert merged == ["우리", "self", "supervised", "라는"]


def test_token_is_consumed_once(spark):
    words = [("가", 0.0, 1.0), ("라는", 3.0, 3.5), ("나", 3.6, 4.0), ("을", 6.0, 6.5)]
    got, _ = fill(spark, words, [(0.0, 7.0, "torch 라는"), (2.0, 7.0, "Torch tensor")])
    # the first gap takes one torch and the tensor; the second gets the other cue's Torch,
    # unless it was heard nearby
    assert [(g[0], g[1]) for g in got] == [(0, "torch"), (0, "tensor"), (2, "Torch")]


def test_heard_tokens_and_foreign_tracks_add_nothing(spark):
    words = [("torch", 0.0, 1.0), ("라는", 3.0, 3.5)]
    assert fill(spark, words, [(0.0, 4.0, "Torch")])[0] == []
    assert fill(spark, [("가", 0.0, 1.0), ("라는", 3.0, 3.5)], [(0.0, 4.0, "Torch")], original=False)[0] == []
