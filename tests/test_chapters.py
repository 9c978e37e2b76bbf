"""Chapter boundaries, native groups and titles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from talkspark.operators import chapters as H
from talkspark.operators import summary as M

WORD = "video_id int, idx long, text string, start_s double, end_s double"


NATIVE = "video_id int, duration double, native_chapters array<struct<start_time:double,end_time:double,title:string>>"


def grouped(spark, talks):
    got = {}
    for r in H.native_groups(spark.createDataFrame(talks, NATIVE)).collect():
        got.setdefault(r.video_id, []).append((r.g_start, r.g_end, r.source_title))
    return {v: sorted(g) for v, g in got.items()}


def test_native_groups_by_hand(spark):
    talks = [
        (1, 600.0, [(0.0, 300.0, "A"), (300.0, 600.0, "B")]),
        (2, 300.0, [(0.0, 60.0, "A"), (60.0, 120.0, "B"), (120.0, 300.0, "C")]),
        (3, 700.0, [(0.0, 700.0, "A")]),
        (4, 260.0, [(5.0, 200.0, "A"), (200.0, 260.0, "B")]),
        (5, 100.0, [(150.0, 200.0, "late")]),
    ]
    assert grouped(spark, talks) == {
        1: [(0.0, 300.0, "A"), (300.0, 600.0, "B")],
        2: [(0.0, 120.0, None), (120.0, 300.0, "C")],
        3: [(0.0, 700.0, None)],
        4: [(0.0, 260.0, None)],
    }


def test_native_groups_cover_the_talk(spark):
    rng = random.Random(11)
    talks = []
    for v in range(60):
        at, native = rng.choice([0.0, 5.0]), []
        for i in range(rng.randint(1, 9)):
            n = float(rng.choice([10, 20, 60, 119, 120, 150, 300, 480, 481, 700]))
            native.append((at, at + n - rng.choice([0, 3]), rng.choice([f"Part {i}", ""])))
            at += n
        talks.append((v, at * rng.choice([0.7, 1.0, 1.1]) + 1, native))
    got = grouped(spark, talks)
    for v, duration, native in talks:
        groups, begins = got[v], {0.0, *(a for a, _, _ in native[1:])}
        assert groups[0][0] == 0.0 and groups[-1][1] == duration
        assert all(x[1] == y[0] for x, y in zip(groups, groups[1:]))
        assert {a for a, _, _ in groups} <= begins
        for a, b, title in groups:
            inside = [c for c in begins if a < c < b]
            assert b - a <= 480 or not inside  # only one chapter of its own is longer
            assert title is None or (not inside and title in {t for _, _, t in native})


@pytest.mark.parametrize("seed", [1, 2])
def test_splits_cover_and_stay_in_bounds(spark, seed):
    rng = random.Random(seed)
    rows, groups, begins = [], [], {}
    for v, length in enumerate([300, 481, 601, 610, 700, 905, 930, 1201, 1330, 2900]):
        words, at = [], 0.0
        while at < length:
            n = rng.choice([0.3, 0.6])
            words.append((rng.choice(["word", "stop."]), round(at, 3), round(at + n, 3)))
            at += n + rng.choice([0.1, 1.0, 4.0, 30.0])
        rows += [(v, i, *w) for i, w in enumerate(words)]
        groups.append((v, 0.0, words[-1][2], "T"))
        begins[v] = {w[1] for w in words}
    gs = spark.createDataFrame(groups, "video_id int, g_start double, g_end double, source_title string")
    got = {}
    for r in H.split_groups(spark.createDataFrame(rows, WORD), gs).collect():
        got.setdefault(r.video_id, []).append((r.p_start, r.p_end))
    for v, start, end, _ in groups:
        parts = sorted(got[v])
        assert parts[0][0] == start and parts[-1][1] == end
        assert all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) == (1 if end <= 480 else max(2, math.ceil(end / 300)))
        assert all(120 <= b - a <= 480 for a, b in parts)
        assert all(a in begins[v] for a, _ in parts)


def test_a_split_prefers_the_end_of_a_sentence(spark):
    words = [(1, i, "end." if i == 32 else "word", i * 10.0, i * 10.0 + 9.9) for i in range(60)]
    gs = spark.createDataFrame([(1, 0.0, 599.9, "T")], "video_id int, g_start double, g_end double, source_title string")
    got = sorted((r.p_start, r.p_end) for r in H.split_groups(spark.createDataFrame(words, WORD), gs).collect())
    assert got == [(0.0, 330.0), (330.0, 599.9)]


def test_long_talk_is_covered(spark):
    rows = [(1, i, "word." if i % 6 == 5 else "word", i * 5.0, i * 5.0 + 1) for i in range(240)]
    videos = spark.createDataFrame(
        [(1, None)], "video_id int, native_chapters array<struct<start_time:double,end_time:double,title:string>>"
    )
    ch = H.build(spark.createDataFrame(rows, WORD), videos).orderBy("chapter_no").collect()
    assert ch[0].c_start == 0.0 and ch[-1].c_end == 1196.0
    assert all(a.c_end == b.c_start for a, b in zip(ch, ch[1:]))
    assert all(120 <= c.c_end - c.c_start <= 480 for c in ch)
    assert [c.chapter_id for c in ch] == [f"chapter-{i + 1:02d}" for i in range(len(ch))]


def test_titles(spark):
    long = "First sentence about the thing. Second sentence that goes on for quite some time and more words follow here"
    df = spark.createDataFrame([(1, "  a\n b "), (2, long), (3, "x" * 150)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", H.clamp_title(F.col("t")).alias("c")).collect()}
    assert got[1] == "a b"
    assert got[2].endswith("…") and len(got[2]) <= 101 and not got[2][:-1].endswith(" ")
    assert got[3] == "x" * 100 + "…"


def test_one_bad_title_refuses_the_submission(spark):
    ch = spark.createDataFrame([(1, "chapter-01"), (1, "chapter-02")], "video_id int, chapter_id string")
    fp = spark.createDataFrame([(1, "f")], "video_id int, transcript_fp string")
    rows = [(1, 1, 0, "f", "chapter-01", "Good"), (1, 1, 1, "f", "chapter-01", "Again"), (1, 2, 0, "f", "chapter-02", " Fine ")]
    subs = spark.createDataFrame(rows, "video_id int, submission_id int, item_no int, fingerprint string, chapter_id string, title string")
    got = {(r.submission_id, r.item_no): (r.rule, r.applied, r.title) for r in H.check_titles(subs, ch, fp).collect()}
    assert got == {
        (1, 0): (None, False, "Good"), (1, 1): ("duplicate chapter", False, "Again"), (2, 0): (None, True, "Fine")
    }


def test_key_points_are_spread_over_long_talks(spark):
    rows = [(1, i, f"chapter-{i:02d}", i * 300.0, ["said"], f"t{i}") for i in range(1, 31)]
    ch = spark.createDataFrame(rows, "video_id int, chapter_no long, chapter_id string, c_start double, excerpts array<string>, title string")
    got = sorted((r.point_no, r.chapter_id) for r in M.key_points(ch).collect())
    assert [c for _, c in got] == [f"chapter-{round(i * 29 / 11) + 1:02d}" for i in range(12)]
