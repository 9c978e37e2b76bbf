"""Steps whose cost grows with the input alone: results against plain code, and what their plans hold."""

from pyspark.sql import functions as F

from talkspark.functions import lexicon as L
from talkspark.functions import ordered
from talkspark.operators import chapters, guard, terms
from talkspark.streaming import jobs as J
from test_streams import put, response


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_script_counts_make_no_array_of_letters(spark):
    texts = ["", "Hello, Größe 12", "안녕 world 漢字かなカナ привет", "ελληνικά 😀 עברית ไทย", "ㄱㄴ ﷲ ﻀ ᄀ", None, "漢" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    counted = guard.script_counts(rows)
    assert "regexp_extract_all" not in plan(counted)
    ranges = {s: [("A", "Z"), ("a", "z")] if s == "latin" else [(chr(lo), chr(hi)) for name, lo, hi in L.SCRIPT_BLOCKS if name == s] for s in L.SCRIPTS}
    for row in counted.collect():
        text = texts[row["n"]]
        for s in L.SCRIPTS:
            assert row["n_" + s] == (None if text is None else sum(any(lo <= c <= hi for lo, hi in ranges[s]) for c in text)), (text, s)


def test_ingest_parses_each_response_once(spark, tmp_path, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        parsed.add(1)
        return text

    rows = J.response_rows
    monkeypatch.setattr(J, "response_rows", lambda r: rows(r.withColumn("response", counted.asNondeterministic()("response"))))
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        put(source, n, n, response("a", "b", "b"))
    J.ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=10)
    assert J.current_words(spark, str(tmp_path / "out")).count() == 9
    assert parsed.value == 3


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def spoken(spark, n=200):
    texts = ["alpha", "beta.", "x-1.", "._gamma_.", "2024", "the", "delta"]
    rows = [(1, i, texts[i % 7], i * 0.5, i * 0.5 + 0.4, 1 + i // 90, 45.0 * (i // 90), 45.0 * (i // 90) + 45.0) for i in range(n)]
    return spark.createDataFrame(rows, "video_id long, idx long, text string, start_s double, end_s double, chapter_no int, p_start double, p_end double")


def test_chapter_words_are_cut_into_tokens_and_sentences_once(spark):
    words = spoken(spark)
    counts = chapters.token_counts(words)
    assert logical(counts).count("Generate explode") == 1
    got = {(r.chapter_no, r.token): (r.tf, r.df) for r in counts.collect()}
    assert got[1, "alpha"] == (13, 3) and {t for _, t in got} == {"alpha", "beta", "x-1", "gamma", "delta"}
    top = spark.createDataFrame([(1, 1, "alpha"), (1, 1, "delta"), (1, 2, "zzz")], "video_id long, chapter_no int, token string")
    found = chapters.excerpts(words, top)
    rows = {(r.chapter_no, r["rank"]): (r.hits, r.excerpt) for r in found.collect()}
    assert rows[1, 1][0] == 2 and rows[2, 1][0] == rows[3, 1][0] == 0 and len(rows) == 6


def test_group_starts_join_blocks_not_rows(spark):
    rows = spark.range(30).selectExpr("1L AS video_id", "id AS idx", "id * 2 AS carried")
    nodes = rows.selectExpr("video_id", "idx", "idx + 7 AS nxt", "idx = 0 AS root")
    got = ordered.group_starts(rows, "video_id", "idx", nodes)
    assert logical(got).count("Join LeftOuter") == 1
    assert [(r.idx, r.carried, r.grp) for r in got.orderBy("idx").collect()] == [(i, 2 * i, i // 7 * 7) for i in range(30)]


def test_suspects_are_judged_once(spark):
    rows = spark.createDataFrame([(1, "Foo", "ResNet", 4.0, None), (1, "a", "b", 1.0, None), (1, "a", "a", 1.0, None)], "video_id long, heard string, caption string, t double, slide string")
    found = terms.number_suspects(rows)
    assert "RLIKE" not in logical(found)
    assert {(r.suspect_id, r.heard, r.caption, r.keep) for r in found.collect()} == {("S1", "Foo", "ResNet", True), ("S2", "a", "a", False), ("S3", "a", "b", False)}
