"""Bounded samples, clashing names, several shards, learned verdicts on held-out rows."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from talkspark.llm import arrow, minhash, mixing, pieces, quality, queries, rules, sample, suffix

SMALL = "/root/testdata/sf0.01"


def test_sample_has_one_row_of_each_id(spark):
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id % 7) AS text").unionByName(
        spark.range(2, 60).selectExpr("id AS doc_id", "concat('t', id) AS text")
    )
    labels = spark.range(1, 60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = sample.labelled(docs, labels, "quality", 10).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 10
    every = sample.labelled(docs, labels, "quality", 1000).collect()
    allowed = {i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert Counter(r["doc_id"] for r in every) == Counter(allowed)


def test_columns_with_inner_names_keep_their_values(spark):
    names = ["_row", "_one", "_two", "_left", "_bytes", "_size", "_print", "_nth", "shard", "place", "row", "group", "first", "_others", "key", "n"]
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame(
        [(i, t, "s", *range(i * 100, i * 100 + len(names))) for i, t in enumerate([text, text, "a b c", text[:50] + " zz"])],
        "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names),
    )
    want = {tuple(r) for r in docs.collect()}
    for out in (minhash.one_of_each_group(docs), suffix.without_repeats(docs, 1000), mixing.mixed_documents(docs).select(*docs.columns)):
        assert out.columns == docs.columns
        got = {tuple(r) for r in out.collect()}
        assert got and got <= want
    assert mixing.mixed_documents(docs).columns[-2:] == ["shard_", "place_"]


def test_places_of_several_shards(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 90 AS int)) AS text", "concat('s', id % 3) AS source")
    sized = mixing.sized(docs)
    rows = mixing.mix(sized, mixing.targets(sized), 8, 64).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert len(shards) > 20 and max(map(len, shards.values())) <= 64
    for held in shards.values():
        assert sorted(r["place"] for r in held) == list(range(1, len(held) + 1))
    want = defaultdict(lambda: [0, set(), 0])
    for r in rows:
        own = want[r["doc_id"]]
        own[0] += r["n_words"]
        own[1].add(r["shard"])
        own[2] += r["shard"] * 64 + r["place"] - 1
    for r in mixing.mixed_words(docs, 8, 64).collect():
        taken, held, places = want[r["doc_id"]]
        assert (r["taken"], r["n_shards"], r["places"]) == (taken, len(held), places)


def test_quality_model_equals_a_plain_loop(spark):
    """Sparse vectors, follow-the-leader state and scores, number by number."""
    docs = spark.createDataFrame([(i, ("good plain words here " if i % 2 else "junk $$ ## junk ") * (i % 5 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    weights, bias = quality.train(docs, labels)
    rows = sorted((r["doc_id"], r["text"], r["label"]) for r in sample.labelled(docs, labels, "quality", 8192).collect())
    vectors = []
    for _, text, label in rows:
        cells = Counter()
        for number, at in quality.grams(pa.array([text])):
            own = number[at[0] : at[1]]
            for c in own.tolist():
                cells[c] += quality.SCALE / len(own)
        vectors.append(([*sorted(cells), 1 << quality.BITS], [*[float(np.float32(cells[c])) for c in sorted(cells)], 1.0], label))
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.3, 1.0, 1e-4, 1e-3

    def weight(c):
        return 0.0 if abs(z[c]) <= l1 else -(z[c] - np.sign(z[c]) * l1) / ((beta + n[c] ** 0.5) / alpha + l2)

    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(len(vectors)):
            at, x, y = vectors[i]
            w = [weight(c) for c in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x))))
            for c, value, own in zip(at, x, w):
                g = (p - y) * value
                z[c] += g - ((n[c] + g * g) ** 0.5 - n[c] ** 0.5) / alpha * own
                n[c] += g * g
    assert abs(weight(1 << quality.BITS) - bias) < 1e-5
    touched = {c for at, _, _ in vectors for c in at[:-1]}
    assert max(abs(weight(c) - weights[c]) for c in touched) < 1e-5 and not weights[[c for c in range(1000) if c not in touched]].any()
    for r in quality.score(docs, weights, bias).collect():
        text = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]
        margin = bias
        for number, at in quality.grams(pa.array([text])):
            margin += quality.SCALE * sum(float(weights[c]) for c in number.tolist()) / max(1, len(number))
        assert abs(r["score"] - 1 / (1 + np.exp(-margin))) < 1e-5
        if r["doc_id"] > 5:
            break


def test_quality_rules_hold_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    # Rows that the base rules reject (too short, repetitive) never reach the trees.
    verdict = rules.judge(docs, rules.train(docs, labels)).where("not base_failed").select("doc_id", "kept")
    rows = verdict.join(labels, "doc_id").where(sample.held_out("doc_id")).select("kept", "quality").collect()
    assert len(rows) > 50 and np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.9


def test_url_verdicts_follow_the_ruled_ones(spark):
    """Trees learn from ruled URLs alone; a URL that only a rule's host tells apart is judged as the ruled ones are."""
    rows = [(i, f"https://{'www.' if i % 2 else ''}example.com/en/{'page' if i % 2 else 'x' * 40 + str(i)}?q={i}") for i in range(600)]
    rows += [(1000 + i, f"https://other.org/en/{'page' if i % 2 else 'x' * 40 + str(i)}?q={i}") for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    from talkspark.llm import urls

    got = {r["page_id"]: r for r in urls.judge(pages, queries.URL_RULES).collect()}
    assert all(got[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(600))
    free = [got[1000 + i] for i in range(100)]
    assert all(r["rule"] is None for r in free)
    assert np.mean([(r["verdict"] == "allow") == (i % 2 == 1) for i, r in enumerate(free)]) > 0.9


def test_long_chunks_draw_as_short_ones(monkeypatch):
    own = pieces.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    texts = pa.array(["".join(f"Wörd{i}日本é{i % 7}x" for i in range(5)), "some words and " * 50, "x" * 90, "é" * 50, "\n\t a  b"])
    keys = np.arange(5, dtype=np.uint64)
    monkeypatch.setattr(pieces, "LONG", 110)
    together = own.encode(texts, keys)
    monkeypatch.setattr(pieces, "LONG", 0)
    alone = own.encode(texts, keys)
    assert (together[0] == alone[0]).all() and (together[1] == alone[1]).all()
    data, _ = own.decode(alone[0].astype(np.int64), alone[1])
    assert data.tobytes().decode() == "".join(texts.to_pylist())


def test_kept_lattices_change_no_draw(monkeypatch):
    own = pieces.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    rng = np.random.default_rng(2)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(20)]
    first = [own.encode(pa.array([t]), np.array([i], np.uint64))[0].tolist() for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "KEPT", 50)
    own._forget()
    again = [own.encode(pa.array([t]), np.array([i], np.uint64))[0].tolist() for i, t in reversed(list(enumerate(texts)))]
    assert first == again[::-1]
