"""What the ranking step hands to Python, and the weights it makes there."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspark.operators import evidence as E
from talkspark.operators import index as N
from talkspark.operators import ranking

EVIDENCE = (
    "video_id long, start_s double, end_s double, text string, source_kind string, speaker string, speaker_candidate string, "
    "speaker_status string, speaker_confidence double, confidence double"
)


def test_no_list_and_no_unasked_column_goes_to_python(spark, monkeypatch):
    rows = E.with_id(spark.createDataFrame([(i % 3, float(i), i + 1.0, "the model", "frame", None, None, None, None, 1.0) for i in range(9)], EVIDENCE))
    rows = rows.withColumn("source_path", F.lit("frame/1"))
    sent = []
    plain = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: (sent.append(self.schema), plain(self, *a, **k))[1])
    postings = N.postings(rows)
    found = N.search(spark.createDataFrame([("q", "the MODEL")], "question_id string, query string"), N.grams(postings), postings, rows)
    assert found.count() == 9
    # Arrow's writer walks a list column from its start at each row where it is null
    assert not any(isinstance(f.dataType, T.ArrayType) for f in sent[0])
    assert set(sent[0]["_row"].dataType.names) == {"evidence_id", "video_id", "start_s", "end_s", "text", "source_kind", "confidence", "speaker"}


def test_weights_of_many_tokens_at_once(monkeypatch):
    held = [("q", ["aa", "the"]), ("r", ["a", "them", "the"]), ("s", ["zzz"]), ("t", ["라는", "the-"])]
    words = ["aaa", "aaaa", "the", "them", "theatre-the", "x", "", "라는라는", "the-the-", "zz", "bathe"]
    for step, known in ((8192, 16384), (2, 4)):
        monkeypatch.setattr(ranking, "STEP", step)
        monkeypatch.setattr(ranking, "KNOWN", known)
        asked = ranking.Questions(held)
        for at in range(0, 3 * len(words), 2):  # tokens come again after they were dropped
            some = [words[i % len(words)] for i in (at, at + 1)]
            want = [[sum(word.count(t) for t in terms) for _, terms in held] for word in some]
            assert np.array_equal(asked.weigh(some), want)
        assert len(asked.known) <= max(known, step)
