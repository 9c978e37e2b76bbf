"""Large groups of near copies: links handed on grow with the rows, and none that matters is lost."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from talkspark.llm import arrow, minhash


def near_copies(n: int, words: int = 240, changed: int = 2) -> list[tuple[int, str]]:
    """Copies of one text with other words put in at random: some pairs reach the limit, some don't."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for place in draw.sample(range(words), changed):
            own[place] = f"x{i}y{place}"
        rows.append((i, " ".join(own)))
    return rows


def brute(rows: list[tuple[int, str]], percent: int) -> dict[int, int]:
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i, _ in rows}

    def top(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("blurred", [False, True])
def test_links_of_a_large_group_grow_with_its_rows(spark, monkeypatch, blurred):
    rows = near_copies(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, whole = [], minhash.components_of
    monkeypatch.setattr(minhash, "components_of", lambda edges: seen.append(edges.count()) or whole(edges))
    if blurred:  # shingles cut so far that the piece finds all pairs alike: those it left out come again

        def cut(batches):
            for batch in batches:
                for part in arrow.slices(batch, "text"):
                    values, at = minhash.shingles(part.column("text"))
                    sets = [np.zeros(b - a, np.uint32).tobytes() for a, b in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "cut"])

        monkeypatch.setattr(minhash, "_cut_sets", cut)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 85, part_rows=64).collect()}
    assert got == brute(rows, 85)
    assert len(set(got.values())) < len(rows) / 2
    assert blurred or max(seen) <= (2 + minhash.LIKELIEST) * len(rows)


def test_a_piece_hands_on_the_links_of_its_components(spark):
    rows = near_copies(40, changed=1)
    sketch = minhash.Sketch()
    texts = pa.array([t for _, t in rows])
    size, _, _, registers = minhash.sketches(texts, sketch)
    cut = next(iter(minhash._cut_sets(iter([pa.record_batch({"id": pa.array(range(40)), "text": texts})])))).column("cut")
    key = minhash.bands(registers, sketch).view(np.int64)
    most = max(set(key[:, 0].tolist()), key=key[:, 0].tolist().count)
    piece = pa.table(
        {
            "key": [most] * 40, "i": [0] * 40, "j": [0] * 40, "part": [0] * 40, "id": range(40), "n": size.astype(np.int64),
            "component": range(40), "registers": [r.tobytes() for r in registers], "cut": cut,
        }
    ).filter(pa.array(key[:, 0] == most))
    every = minhash._candidates(piece, 85, sketch, "all")
    few = minhash._candidates(piece, 85, sketch, "linking")
    assert every.num_rows > few.num_rows == piece.num_rows - 1 > 5
