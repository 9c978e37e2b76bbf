"""The pipeline's stages on the smallest table, each against a check of its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from talkspark.llm import mixing

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(number))
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_columns_and_rows(stages):
    for df in stages[1:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS
    assert stages[-1].count() == stages[-2].count()
    assert stages[-1].where("not lossless").count() == 0


def test_classifier_keeps_rows_whole(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert 0 < len(after) < len(before) and all(before[i] == r for i, r in after.items())


def test_one_of_each_group_stays(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    group = {i: i for i in before}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(before)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    assert set(after) == {i for i in ids if top(i) == i}


def test_no_passage_repeats_as_input(stages):
    n = corpus_pipeline.PASSAGE_BYTES
    before, after = by_id(stages[2]), by_id(stages[3])
    seen = Counter(t[k : k + n] for r in before.values() for t in [r["text"].encode()] for k in range(len(t) - n + 1))
    for i, r in before.items():
        text = r["text"].encode()
        hit = any(seen[text[k : k + n]] > 1 for k in range(len(text) - n + 1))
        assert (i not in after or after[i]["text"] != r["text"]) if hit else after[i]["text"] == r["text"]


def test_mix_takes_whole_documents(spark, stages):
    before, rows = by_id(stages[3]), stages[4].collect()
    taken = Counter(r["doc_id"] for r in rows)
    assert max(taken.values()) <= 2 and all(before[r["doc_id"]]["text"] == r["text"] for r in rows)
    words = {i: len(WORD.findall(r["text"])) for i, r in before.items()}
    got, longest = defaultdict(int), defaultdict(int)
    for i, r in before.items():
        got[r["source"]] += taken[i] * words[i]
        longest[r["source"]] = max(longest[r["source"]], words[i])
    for t in mixing.targets(mixing.sized(stages[3])).collect():
        assert abs(got[t["source"]] - t["target"]) <= longest[t["source"]]


def test_run_is_repeatable(spark, stages):
    rows = corpus_pipeline.run(spark, SMALL)
    assert sorted((r["doc_id"], tuple(r["pieces"])) for r in rows.collect()) == sorted((r["doc_id"], tuple(r["pieces"])) for r in stages[-1].collect())


def test_repeated_rows_stay_once(spark):
    """Rows of one doc_id, or of none, with one text of over 400 bytes; a passage in two other documents."""
    text = {k: " ".join(f"{k}{i}" for i in range(150)) for k in "abcdefg"}
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(7, text["a"]), (7, text["a"]), (None, text["b"]), (None, text["b"]), (3, text["c"]), (None, text["c"]), (9, text["d"]), (9, text["e"])]
    rows += [(20, text["f"] + "!" + passage), (21, text["g"] + "?" + passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    once = corpus_pipeline.deduplicate(spark, docs, SMALL)
    want = [(None, text["b"]), (3, text["c"]), (7, text["a"]), (9, text["d"]), (9, text["e"]), *rows[-2:]]
    assert Counter((r["doc_id"], r["text"]) for r in once.collect()) == Counter(want)
    left = corpus_pipeline.cut_repeats(spark, once, SMALL).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter(want[:-2] + [(20, text["f"] + "!"), (21, text["g"] + "?")])


def test_mix_is_written_in_shards_by_place(spark, tmp_path):
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('w', id, ' a b') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "9L AS n_chars")
    corpus_pipeline.mix(spark, docs, SMALL).write.parquet(str(tmp_path / "mix"))
    got = [[r["doc_id"] for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "mix").glob("*.parquet"))]
    shards = defaultdict(list)
    for r in mixing.mixed_documents(docs).orderBy("shard", "place").collect():
        shards[r["shard"]].append(r["doc_id"])
    assert len(shards) > 1 and sum(map(len, got)) == sum(map(len, shards.values()))
    for ids in shards.values():
        assert any(ids == part[k : k + len(ids)] for part in got for k in range(len(part)) if part[k] == ids[0])


def test_passages_of_51_words_go(stages):
    """No run of 51 words stands in two documents after the cut, whatever their length in bytes."""
    rows = [(i, WORD.findall(r["text"])) for i, r in by_id(stages[3]).items()]
    held = defaultdict(set)
    for i, words in rows:
        for k in range(len(words) - 50):
            held[tuple(words[k : k + 51])].add(i)
    assert not [w for w, ids in held.items() if len(ids) > 1]


def test_stages_take_odd_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard int, _row int, _one int"
    rows = [(None, None, None, None, None, 1, 2, 3), (1, "", "en", "s", 0, 1, 2, 3), (1, "", "en", "s", 0, 1, 2, 3), (2, "word " * 60_000, "en", None, 300_000, 1, 2, 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            assert number == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
            out.count()
