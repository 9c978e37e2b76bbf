"""The corpus job, its versioned tables and its inverted index; the package on executors."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from talkspark.operators import evidence as E
from talkspark.operators import index as N
from talkspark.operators import ranking
from talkspark.operators.corpus import Corpus
from talkspark.sources.versions import Versions, changes

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVIDENCE = (
    "video_id long, start_s double, end_s double, text string, source_kind string, speaker string, speaker_candidate string, "
    "speaker_status string, speaker_confidence double, confidence double"
)
QUESTIONS = "question_id string, query string"


def rows_of(spark, texts):
    return spark.createDataFrame(
        [(i % 4, float(i // 3), float(i), t, "frame", None, None, None, None, (i % 3) / 2) for i, t in enumerate(texts)], EVIDENCE
    )


def test_index_answers_as_a_scan_does(spark):
    texts = ["The model", "the Model the", "theatre-the_the aaaa", "", "???", "라는 말", "self-supervised 라는라는", "aa aaa", "the model"] * 7 + ["the " * 50]
    rows = E.with_id(rows_of(spark, texts))
    questions = spark.createDataFrame([("q", "the MODEL?"), ("a", "aa"), ("k", "라는, the"), ("none", "zzz"), ("empty", "?!"), ("one", "e")], QUESTIONS)
    postings = N.postings(rows)
    for per_video in (True, False):
        got = N.search(questions, N.grams(postings), postings, rows, 5, per_video).collect()
        assert got and sorted(map(tuple, got)) == sorted(map(tuple, E.search(rows, questions, 5, per_video).collect()))
    named = spark.createDataFrame([("q", "the model", 2)], "question_id string, query string, video_id long")
    got = N.search(named, N.grams(postings), postings, rows).collect()
    assert {r["video_id"] for r in got} == {2} and sorted(map(tuple, got)) == sorted(map(tuple, E.search(rows, named).collect()))
    both = spark.createDataFrame([("q", "the model", v) for v in (2, 3)], "question_id string, query string, video_id long")
    twice = N.search(both, N.grams(postings), postings, rows).where("video_id = 2").collect()
    assert sorted(map(tuple, twice)) == sorted(map(tuple, got))  # another video's asking adds no hits
    assert sorted(map(tuple, E.search(rows, both).where("video_id = 2").collect())) == sorted(map(tuple, got))


def test_blocks_and_parts_are_ranked_as_a_scan_does(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("BUCKET_ROWS", 8), ("PART", 2)):
        monkeypatch.setattr(ranking, name, value)
    rows = E.with_id(rows_of(spark, ["the model", "a b the", "model model", "the"] * 9 + ["the the the", "lone"]).withColumn("video_id", F.expr("if(start_s < 1, 9, video_id)")))
    questions = spark.createDataFrame([("q", "the MODEL?"), ("a", "a, b"), ("o", "lone"), ("none", "zzz")], QUESTIONS)
    postings = N.postings(rows)
    found = N.search(questions, N.grams(postings), postings, rows, 3)
    # hits leave a task as the best rows alone: nothing with a row for each hit is shuffled
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, E.search(rows, questions, 3).collect()))


def test_a_question_reads_its_buckets_alone(spark, tmp_path):
    postings = N.postings(E.with_id(rows_of(spark, [f"word{i} other{i * 7}" for i in range(200)])))
    postings.write.partitionBy("bucket").parquet(str(tmp_path / "p"))
    held = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([("word17",)], "token string")
    pruned = N.only(held, asked, "token")
    assert {r["token"] for r in pruned.collect()} >= {"word17"}
    assert len(pruned.inputFiles()) < len(held.inputFiles()) or pruned.select("bucket").distinct().count() == 1
    assert "PartitionFilters: [isnotnull(bucket" in pruned._jdf.queryExecution().toString() or "bucket#" in pruned._jdf.queryExecution().toString()


WORDS = "video_id long, idx long, text string, start_s double, end_s double, speaker string, speaker_global string, speaker_status string"


def talk(video, said, pause=0.5):
    return [(video, i, w, i * pause, i * pause + 0.3, "s", "s", "confirmed") for i, w in enumerate(said.split())]


@pytest.fixture
def inputs(spark):
    words = [*talk(1, "alpha beta gamma. delta " * 30), *talk(2, "beta epsilon. " * 40), *talk(3, "zeta eta theta. " * 20)]
    frames = [(1, 0, 3.0, "slide alpha", "{}"), (2, 0, 4.0, "slide beta", "{}")]
    videos = [(v, None) for v in (1, 2, 3)]
    return (
        spark.createDataFrame(words, WORDS),
        spark.createDataFrame(frames, "video_id long, frame_no long, frame_at double, ocr_text string, extra string"),
        spark.createDataFrame(videos, "video_id long, native_chapters array<struct<start_time:double,end_time:double,title:string>>"),
    )


def answers(job, spark):
    questions = spark.createDataFrame([("q1", "alpha beta"), ("q2", "changed slide"), ("q3", "eta")], QUESTIONS)
    return sorted(map(tuple, job.answers(questions).collect()), key=str)


def test_only_changed_videos_are_redone(spark, tmp_path, inputs):
    words, frames, videos = inputs
    job = Corpus(spark, str(tmp_path / "a"))
    assert set(job.refresh(words, frames, videos).values()) == {3}
    assert set(job.refresh(words.orderBy(F.desc("idx")), frames, videos).values()) == {0}  # order of arrival is no change
    assert {r[0] for r in job.evidence.read("evidence").select("source_kind").distinct().collect()} == {"transcript", "chapter", "frame"}
    shown = frames.withColumn("ocr_text", F.when(F.col("video_id") == 2, "slide changed").otherwise(F.col("ocr_text")))
    assert job.refresh(words, shown, videos) == {"spans": 0, "chapters": 0, "evidence": 1, "index": 1}
    said = words.withColumn("text", F.when((F.col("video_id") == 1) & (F.col("idx") == 5), "changed").otherwise(F.col("text")))
    assert set(job.refresh(said, shown, videos).values()) == {1}
    left = said.where("video_id <> 3")
    assert set(job.refresh(left, shown, videos).values()) == {0}
    full = Corpus(spark, str(tmp_path / "b"))
    full.refresh(left, shown, videos)
    assert answers(job, spark) == answers(full, spark) != []
    for name, table in (("spans", "spans"), ("chapters", "chapters"), ("evidence", "evidence"), ("index", "postings")):
        kept, fresh = getattr(job, name).read(table), getattr(full, name).read(table)
        assert sorted(map(str, kept.collect())) == sorted(map(str, fresh.select(kept.columns).collect()))


def test_takedown_deletes_files(spark, tmp_path, inputs):
    job = Corpus(spark, str(tmp_path / "a"))
    job.refresh(*inputs)
    job.forget(spark.createDataFrame([(2,), (99,)], "video_id long"))
    for held, table in ((job.evidence, "evidence"), (job.index, "postings"), (job.spans, "spans"), (job.chapters, "chapters")):
        files = spark.read.parquet(f"{held.at}/{table}")
        assert {r[0] for r in files.select("video_id").distinct().collect()} == {1, 3}
    assert job.refresh(*inputs) == {"spans": 1, "chapters": 1, "evidence": 1, "index": 1}


def test_a_run_without_commit_changes_nothing(spark, tmp_path):
    held = Versions(spark, str(tmp_path), "s", {"t": "video_id long, x string"})
    assert held.newest() is None and held.read("t").count() == 0 and held.state().count() == 0
    done = spark.createDataFrame([(1, "a"), (2, "b")], "video_id long, input_fp string")
    held.commit({"t": spark.createDataFrame([(1, "one"), (2, "two")], "video_id long, x string")}, done)
    # A run that died after its data, and one whose state was not written to the end.
    spark.createDataFrame([(1, "lost")], "video_id long, x string").write.parquet(f"{held.at}/t/run=7")
    done.withColumns({"run": F.lit(8).cast("long"), "dead": F.lit(False)}).write.parquet(f"{held.at}/state/run=8")
    os.remove(tmp_path / "s/state/run=8/_SUCCESS")
    assert sorted(map(tuple, held.read("t").collect())) == [(1, "one"), (2, "two")]
    changed, gone = changes(held, spark.createDataFrame([(1, "a"), (3, "c")], "video_id long, input_fp string"))
    assert [tuple(r) for r in changed.collect()] == [(3, "c")] and [tuple(r) for r in gone.collect()] == [(2,)]
    assert held.commit({"t": spark.createDataFrame([(3, "three")], "video_id long, x string")}, changed, gone) == 9
    assert sorted(map(tuple, held.read("t").collect())) == [(1, "one"), (3, "three")]
    held.vacuum()
    assert sorted(map(tuple, held.read("t").collect())) == [(1, "one"), (3, "three")]
    assert [d for d in os.listdir(tmp_path / "s/t") if d.startswith("run=")] == ["run=10"]
    assert sorted(map(tuple, held.state().collect())) == [(1, "a", 10, False), (3, "c", 10, False)]


def test_executors_get_the_package(tmp_path):
    """Started elsewhere, with the entry file's path alone, Python tasks import the package."""
    code = f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", "{REPO}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()["win6_search_spans"](spark, entry.SMALL).count())
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=240)
    assert run.returncode == 0 and "rows" in run.stdout, run.stderr[-2000:]
