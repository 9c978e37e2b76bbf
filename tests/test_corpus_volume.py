"""What the corpus job shuffles and writes goes with its rows: prints, first runs, grams, takedown, blocks."""

import os

from pyspark.sql import functions as F

from talkspark.functions import ordered
from talkspark.operators import chapters, fingerprint, index, segment
from talkspark.operators.corpus import Corpus
from test_corpus import answers, inputs, talk, WORDS  # noqa: F401


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prints_tell_content_and_place_and_shuffle_no_text(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 1, "b"), (4, 0, "a")], "video_id long, idx long, text string")

    def prints(df):
        return {r.video_id: r.fp for r in fingerprint.unordered(df, "video_id", [F.col("idx"), F.col("text")], "fp").collect()}

    told = prints(rows)
    assert told[1] == told[3] and len({told[1], told[2], told[4]}) == 3
    assert prints(rows.orderBy(F.desc("idx")).repartition(3)) == told
    plan = physical(fingerprint.unordered(rows, "video_id", [F.col("idx"), F.col("text")], "fp"))
    assert "collect_list" not in plan and "partial_sum" in plan


def test_a_first_run_neither_picks_nor_stores_the_words(spark, tmp_path, inputs, monkeypatch):  # noqa: F811
    words, frames, videos = inputs
    used = []
    for module, name in ((segment, "spans"), (chapters, "build")):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, *more, made=made: used.append(rows) or made(rows, *more))
    job = Corpus(spark, str(tmp_path / "a"))
    job.refresh(words, frames, videos)
    assert used[0] is words and used[1] is words
    job.refresh(words.where("video_id <> 2 or idx > 0"), frames, videos)
    assert {r.video_id for r in used[2].select("video_id").distinct().collect()} == {2}


def test_a_gram_a_place_finds_terms_of_any_length(spark):
    made = index.grams(spark.createDataFrame([("theatre",), ("aaaa",), ("라는",), ("b",)], "token string"))
    assert made.count() == 7 + 3 + 2 + 1
    terms = spark.createDataFrame([("t",), ("at",), ("tre",), ("eatr",), ("aaaaa",), ("는",), ("b",)], "term string")
    for term, found in (("t", {"theatre"}), ("at", {"theatre"}), ("eatr", {"theatre"}), ("aaaaa", set()), ("는", {"라는"}), ("a", {"theatre", "aaaa"})):
        assert {r.token for r in index.asked_tokens(terms.limit(0).unionByName(spark.createDataFrame([(term,)], "term string")), made).collect()} == found
    assert {r.token for r in index.asked_tokens(terms, made).collect()} == {"theatre", "라는", "b"}


def test_takedown_leaves_the_vocabulary_in_place(spark, tmp_path, inputs, monkeypatch):  # noqa: F811
    job = Corpus(spark, str(tmp_path / "a"))
    job.refresh(*inputs)
    before = sorted(map(tuple, job.index.read("pieces").collect()), key=str)
    runs = lambda: [d for d in os.listdir(tmp_path / "a/index/pieces") if d.startswith("run=")]
    job.forget(spark.createDataFrame([(2,)], "video_id long"))
    assert runs() == ["run=1"] and sorted(map(tuple, job.index.read("pieces").collect()), key=str) == before
    monkeypatch.setattr("talkspark.sources.versions.MANY", 0)
    kept = answers(job, spark)
    job.index.vacuum()
    assert len(runs()) == 1 and runs() != ["run=1"] and answers(job, spark) == kept != []


def test_groups_are_joined_where_the_words_lie(spark, monkeypatch):
    rows = talk(1, "alpha beta gamma. delta " * 20) + [(2, i, None if i < 5 else "x", i * 0.5, i * 0.5 + 0.3, None, "s", "inferred") for i in range(9)]
    words = spark.createDataFrame(rows, WORDS)
    whole = sorted(map(str, segment.spans(words).collect()))
    monkeypatch.setattr(ordered, "BLOCK", 4)  # a span reaches over many blocks
    assert sorted(map(str, segment.spans(words).collect())) == whole
    text = {r.video_id: r.text for r in segment.spans(words).where("start_s = 0").collect()}
    assert text[2] == "x x x x" and text[1].startswith("alpha beta gamma. delta alpha")


def test_durations_are_not_joined_as_words(spark):
    words = spark.createDataFrame(talk(1, "a b c"), WORDS)
    videos = spark.createDataFrame([(1, None)], "video_id long, native_chapters array<struct<start_time:double,end_time:double,title:string>>")
    plan = chapters.groups(words, videos)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan
