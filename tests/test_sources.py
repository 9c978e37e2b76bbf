"""Response blocks, refused chunks, equal evidence rows, takedown of stored tables."""

import json

from talkspark.operators import evidence as E
from talkspark.operators import normalize as N
from talkspark.operators import summary as M
from talkspark.operators import translation as T
from talkspark.sources import files as I
from talkspark.sources.responses import response_rows


def note(text):
    return {"type": "word_info", "text": text, "start_offset": "1s", "end_offset": "2s", "speaker": "s"}


def test_positions_run_over_steps_and_blocks(spark):
    steps = [{"content": [{"annotations": [note("a"), note("b")]}, {"annotations": [note("c")]}]}, {"content": [{"annotations": [note("d")]}]}]
    frame = spark.createDataFrame([(1, json.dumps({"steps": steps}))], "video_id int, response string")
    assert [r.text for r in response_rows(frame).orderBy("pos").collect()] == ["a", "b", "c", "d"]


def test_a_chunk_without_words_is_refused(spark):
    schema = "video_id int, chunk_index int, chunk_start double, chunk_end double, pos long, text string, start_s double, end_s double, speaker string, audio_s double"
    words = spark.createDataFrame([(1, 0, 0.0, 9.0, 0, "w", 0.0, 1.0, "s", 9.0)], schema)
    chunks = spark.createDataFrame([(1, 0, 0.0, 9.0), (1, 1, 9.0, 18.0)], "video_id int, chunk_index int, chunk_start double, chunk_end double")
    got = {r.chunk_index: (r.n_words, r.accepted) for r in N.corruption(N.repair(words), chunks).collect()}
    assert got == {0: (1, True), 1: (0, False)}


EVIDENCE = (
    "video_id int, start_s double, end_s double, text string, source_kind string, speaker string, speaker_candidate string, "
    "speaker_status string, speaker_confidence double, confidence double"
)
NOBODY = (None, None, None, None, 0.5)


def test_equal_evidence_rows_stay_apart(spark):
    row = (1, 1.0, 2.0, "The model", "frame", *NOBODY)
    rows = spark.createDataFrame([row, row, (2, 1.0, 2.0, "the Model the", "frame", *NOBODY)], EVIDENCE)
    questions = spark.createDataFrame([("q", "the model")], "question_id string, query string")
    assert sorted((r.video_id, r.hits, r["rank"]) for r in E.search(rows, questions).collect()) == [(1, 2, 1), (1, 2, 2), (2, 3, 1)]
    named = spark.createDataFrame([("q", "the model", 2)], "question_id string, query string, video_id int")
    assert [(r.video_id, r.hits) for r in E.search(rows, named).collect()] == [(2, 3)]


def test_takedown_removes_a_whole_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "video_id int, text string").write.partitionBy("video_id").parquet(path)
    new = I.rewrite_without(spark, path, spark.createDataFrame([(1,)], "video_id int"), ["video_id"], "video_id")
    assert [(r.video_id, r.text) for r in spark.read.parquet(new).collect()] == [(2, "c")]
    assert not (tmp_path / "table").exists()


def test_an_outline_has_all_chapters(spark):
    chapters = spark.createDataFrame([(1, i, float(i)) for i in range(1, 131)], "video_id int, chapter_no int, c_start double")
    stats = spark.createDataFrame([(1, 5)], "video_id int, word_count int")
    assert M.outline(chapters, stats).count() == 130
    assert {r.left_out for r in M.outline(chapters, stats, 100).collect()} == {30}


def test_an_unmatched_reply_line_stays_whole(spark):
    line = "x" * 300
    frame = spark.createDataFrame([(1, f"{line}\nT1 | a | b\nS2 | -")], "id int, reply string")
    assert {(r.kind, r["item"]) for r in T.term_lines(frame).collect()} == {("unmatched", line), ("term", "T1"), ("skip", "S2")}
