"""Chunk ingest: repeats, retries, several responses in one batch, restarts."""

import json
import os

from talkspark.streaming import jobs as J


def response(*texts):
    notes = [{"type": "word_info", "text": t, "start_offset": f"{i}s", "end_offset": f"{i}.5s", "speaker": "s"} for i, t in enumerate(texts)]
    return json.dumps({"steps": [{"content": [{"annotations": notes}]}]})


def put(folder, number, chunk, text):
    path = folder / f"{number}.json"
    row = {"video_id": 1, "chunk_index": chunk, "chunk_start": chunk * 10.0, "chunk_end": chunk * 10.0 + 10.0, "response": text}
    path.write_text(json.dumps(row) + "\n")
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def test_ingest_keeps_the_latest_accepted_response(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run():
        J.ingest(spark, str(source), out, str(tmp_path / "state"), files_per_batch=10)
        words = sorted((r.chunk_index, r.pos, r.text, r.start_s) for r in J.current_words(spark, out).collect())
        return [(c, t, s) for c, _, t, s in words], spark.read.parquet(f"{out}/chunks").count()

    first = response("a", "b")
    put(source, 1, 0, first)
    put(source, 2, 0, response("c"))
    put(source, 3, 0, first)  # repeats the first, so the second stays the latest
    put(source, 4, 1, response())
    assert run() == ([(0, "c", 0.0)], 3)
    assert run() == ([(0, "c", 0.0)], 3)
    put(source, 5, 0, first)
    put(source, 6, 1, response("d", "d"))  # a retry
    put(source, 7, 0, response())  # refused, so the accepted one stays
    assert run() == ([(0, "c", 0.0), (1, "d", 10.0), (1, "d", 11.0)], 5)
    put(source, 8, 0, response("e"))
    put(source, 9, 0, response("f"))
    assert run() == ([(0, "f", 0.0), (1, "d", 10.0), (1, "d", 11.0)], 7)
    assert all(r.turn in (0, 1) for r in spark.read.parquet(f"{out}/chunks").collect())
