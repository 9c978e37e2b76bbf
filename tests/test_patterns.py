"""Patterns in texts, excerpts by offset, and pieces of a word form, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from talkspark.operators import evidence as E
from talkspark.operators import speakers as P
from talkspark.operators.patterns import contains_join, pattern_join

TEXTS = "k int, no long, body string"
PINS = "k int, pin string, mark string"


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abA é") for _ in range(rng.randint(1, n)))
    texts = [(rng.choice([1, 1, 1, 2, 3]), i, word(40)) for i in range(300)]
    texts += [(1, 900, None), (1, 901, ""), (None, 902, "ab"), (9, 903, "ab"), (1, 904, "aaaa"), (1, 904, "aaaa")]
    pins = [(rng.choice([1, 2]), word(4), f"m{i}") for i in range(60)]
    pins += [(1, "aa", "x"), (1, "aa", "x"), (1, "", "e"), (1, None, "n"), (None, "ab", "u"), (4, "ab", "alone")]
    return texts, pins, spark.createDataFrame(texts, TEXTS), spark.createDataFrame(pins, PINS)


@pytest.mark.parametrize("bounds", [(4 << 20, 4096), (300, 7), (1, 1)])
@pytest.mark.parametrize("ignore_case", [True, False])
def test_patterns_by_key_equal_the_loop(made, bounds, ignore_case):
    texts, pins, rows, patterns = made
    fold = str.lower if ignore_case else str
    want = [
        (k, no, body, pin, mark, fold(body).count(fold(pin)))
        for k, no, body in texts
        for kk, pin, mark in pins
        if k is not None and k == kk and body and pin and fold(pin) in fold(body)
    ]
    got = pattern_join(rows, patterns, "k", "body", "pin", ignore_case, part_bytes=bounds[0], group_rows=bounds[1])
    assert got.columns == ["k", "no", "body", "pin", "mark", "_n"]
    assert found(got, *got.columns) == sorted(want, key=str)


def test_patterns_without_keys_and_carried_columns(made):
    texts, pins, rows, patterns = made
    asked = patterns.select("pin").where("pin <> ''").distinct()
    want = [(no, pin, body.count(pin)) for _, no, body in texts if body for pin in {p for _, p, _ in pins if p} if pin in body]
    got = pattern_join(rows, asked, [], "body", "pin", False, carry=["no"], part_bytes=200, group_rows=16)
    assert got.columns == ["no", "pin", "_n"]
    assert found(got, *got.columns) == sorted(want, key=str)


def test_no_patterns_or_no_texts(made):
    _, _, rows, patterns = made
    assert contains_join(rows, patterns.where("false"), ["k"], "body", "pin").collect() == []
    assert contains_join(rows.where("false"), patterns, ["k"], "body", "pin").collect() == []


def test_a_text_travels_without_grams(made):
    _, _, rows, patterns = made
    plan = contains_join(rows, patterns, ["k"], "body", "pin")._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("limit", [1, 9, 10, 40, 12000])
def test_excerpts_equal_the_whole_text_cut(spark, limit):
    rng = random.Random(3)
    words = [(v, i, rng.choice(["a", "bc", "def gh", "", None, "longer", "é"]), i * 1.0, i * 1.0 + rng.choice([0.5, 1.5])) for v in (1, 2) for i in range(60)]
    asks = [(1, 0, 0.0, 60.0), (1, 1, 4.2, 9.0), (2, 2, 10.0, 11.0), (2, 3, 500.0, 600.0), (3, 4, 0.0, 9.0), (1, 5, 8.0, 8.0)]
    want = {}
    for v, q, lo, hi in asks:
        if hi > lo:
            hit = [w for w in words if w[0] == v and w[3] <= hi and w[4] >= lo]
            full = " ".join(w[2] for w in hit if w[2] is not None)
            head = full[:limit]
            text = (head[: head.rindex(" ")] if head.rfind(" ") > 0 else head) if len(full) > limit else full
            want[q] = (text, len(hit), len(full) > limit, len(full))
    got = E.excerpts(
        spark.createDataFrame(asks, "video_id int, request_id int, r_start double, r_end double"),
        spark.createDataFrame(words, "video_id int, idx long, text string, start_s double, end_s double"),
        spark.createDataFrame([(1, 0, 5.0)], "video_id int, frame_no int, frame_at double"),
        limit,
    )
    assert {r.request_id: (r.text, r.word_count, r.truncated, r.full_length) for r in got.collect()} == want


def test_chained_overlaps_equal_the_loop(spark):
    from tests.test_words import CHUNK, WORD, loop_dropped

    rng = random.Random(8)
    chunks = [(c, c * 6.0, c * 6.0 + 20.0) for c in range(8)]  # every re-heard range touches the next
    words, pos = [], 0
    for c, lo, hi in chunks:
        for t in sorted(rng.uniform(lo, hi) for _ in range(40)):
            words.append((c, pos, rng.choice(["no", "yes", "so", "well"]), round(t, 3), round(t + rng.choice([0.1, 0.5, 1.2]), 3), "s"))
            pos += 1
    df = spark.createDataFrame([(1, *w) for w in words], WORD)
    ck = spark.createDataFrame([(1, *c) for c in chunks], CHUNK)
    assert P.overlaps(ck).select("run").distinct().count() == 1
    got = {(r.chunk_index, r.pos) for r in P.dropped_words(df, ck).collect()}
    assert got == loop_dropped(words, chunks) and got


def test_pieces_break_at_the_tolerance(spark):
    times = [0.0, 0.75, 1.5, 2.26, 2.3, 9.0]
    near = spark.createDataFrame([(1, 1, "no", 0, i, t) for i, t in enumerate(times)], "video_id int, run int, key string, chunk_index int, pos int, start_s double")
    got = P.pieces(near).groupBy("piece").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(0.0, 3), (2.26, 2), (9.0, 1)]


def test_long_excerpts_meet_their_first_blocks_alone(spark, monkeypatch):
    monkeypatch.setattr(E, "EXCERPT_BLOCK", 4)
    words = [(1, i, "w" * (i % 3) or None, i * 1.0, i + 0.5) for i in range(90)]
    asks = [(1, 0, 0.0, 90.0), (1, 1, 17.2, 80.0), (1, 2, 3.0, 6.0)]
    got = E.excerpts(
        spark.createDataFrame(asks, "video_id int, request_id int, r_start double, r_end double"),
        spark.createDataFrame(words, "video_id int, idx long, text string, start_s double, end_s double"),
        spark.createDataFrame([(1, 0, 5.0)], "video_id int, frame_no int, frame_at double"),
        20,
    )
    for r in got.collect():
        hit = [w for w in words if w[3] <= asks[r.request_id][3] and w[4] >= asks[r.request_id][2]]
        full = " ".join(w[2] for w in hit if w[2])
        head = full[:20]
        assert r.text == (head[: head.rindex(" ")] if len(full) > 20 else head)
        assert (r.word_count, r.full_length, r.truncated) == (len(hit), len(full), len(full) > 20)
