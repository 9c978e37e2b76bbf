import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from talkspark.operators import captions as C
from talkspark.sources import files as I


def collapse(spark, blocks):
    rows = [(1, i, s, e, line) for i, (s, e, lines) in enumerate(blocks) for line in lines]
    df = spark.createDataFrame(rows, "video_id int, block_idx long, b_start double, b_end double, line string")
    out = C.collapse_rolling(df).orderBy("cue_start", "cue_end").collect()
    return [(r.cue_start, r.cue_end, r.cue_text) for r in out]


def test_first_start_kept_and_end_extended(spark):
    got = collapse(spark, [(0.0, 1.0, ["a"]), (1.0, 2.0, ["a", "b"]), (2.0, 3.0, ["b"])])
    assert got == [(0.0, 2.0, "a"), (1.0, 3.0, "b")]


def test_reappearing_line_is_a_second_cue(spark):
    got = collapse(spark, [(0.0, 1.0, ["a"]), (1.0, 2.0, ["b"]), (2.0, 3.0, ["a"])])
    assert got == [(0.0, 1.0, "a"), (1.0, 2.0, "b"), (2.0, 3.0, "a")]


def test_line_twice_in_a_block_counts_once(spark):
    assert collapse(spark, [(0.0, 1.0, ["a", "a"])]) == [(0.0, 1.0, "a")]


def test_hot_line_crosses_blocks(spark):
    blocks = [(float(i), i + 1.0, ["hello"]) for i in range(9000)]
    blocks[4000] = (4000.0, 4001.0, ["other"])
    got = [c for c in collapse(spark, blocks) if c[2] == "hello"]
    assert got == [(0.0, 4000.0, "hello"), (4001.0, 9000.0, "hello")]


def test_srt_reader(spark):
    text = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\n hi \r\n\r\n2\r\nno timing\r\n\r\n00:01:00,000 --> 00:01:01,250 align\r\n\r\n"
    df = spark.createDataFrame([(1, text)], "video_id int, content string")
    got = I.dense_blocks(I.srt_blocks(df), "video_id").orderBy("block_idx").collect()
    assert [(r.block_idx, r.b_start, r.b_end, r.lines) for r in got] == [(0, 1.5, 2.0, ["hi"]), (1, 60.0, 61.25, [])]


def test_known_caption_file(spark):
    """A real rolling caption file, read in place when SRT_SAMPLE names it."""
    path = os.environ.get("SRT_SAMPLE")
    if not path or not Path(path).exists():
        pytest.skip("no sample file")
    blocks = I.srt_blocks(I.read_texts(spark, path)).withColumn("video_id", F.lit(1)).drop("path")
    lines = I.block_lines(I.dense_blocks(blocks, "video_id"))
    cues = C.collapse_rolling(lines).collect()
    assert (lines.count(), len(cues), sum(len(c.cue_text.split()) for c in cues)) == (1800, 603, 2752)


def pick(spark, langs, preferred=None, requested=()):
    rows = [(1, f"v.{lang}.srt", lang, preferred, list(requested)) for lang in langs]
    df = spark.createDataFrame(rows, "video_id int, name string, lang string, preferred string, requested array<string>")
    return C.pick_track(df).first().lang


def test_track_choice(spark):
    assert pick(spark, ["en", "ko-orig"]) == "ko-orig"
    assert pick(spark, ["de-orig", "ko-orig"], "ko") == "ko-orig"
    assert pick(spark, ["de-orig", "pt-BR-orig"], "pt-PT") == "pt-BR-orig"
    assert pick(spark, ["de-orig", "en-orig"], "fr") == "de-orig"
    assert pick(spark, ["en", "ko"], requested=["ko", "en"]) == "ko"
    assert pick(spark, ["fr", "en"], requested=["ja"]) == "en"


def test_evidence_language(spark):
    rows = [(1, "ko-orig", "youtube", True), (2, None, "youtube-ko-orig", None), (3, "ko", "youtube-ko", False), (4, None, "x", None)]
    df = spark.createDataFrame(rows, "video_id int, language string, source string, original boolean")
    got = {r.video_id: r.evidence_language for r in C.evidence_language(df).collect()}
    assert got == {1: "ko-orig", 2: "ko-orig", 3: None, 4: None}


def test_strict_validation_raises(spark):
    df = spark.createDataFrame([(1, 0, "a", 2.0, 1.0)], "video_id int, idx long, text string, start_s double, end_s double")
    assert [r.rule for r in C.validate_words(df).collect()] == ["reversed"]
    with pytest.raises(Exception, match="invalid word"):
        C.validate_words(df, strict=True).collect()
