"""The training-data operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkspark.llm import arrow, boost, chat, embeddings, links, minhash, mixing, pieces, quality, rules, suffix, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an ba co de el fi go hu in ja".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    """Odd texts, copies, near copies, shared passages, one very long text."""
    rng = random.Random(11)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c d", "A B c d e", "é ö\n日本 日本\t\x0b#$|", "x" * 3000, "\nq\nq\n q\nq"]
    base = [prose(rng, rng.randint(60, 200)) for _ in range(20)]
    passage = prose(rng, 120)
    out += base + base[:6] + [base[0]] * 5
    for b in base[:10]:
        for _ in range(3):
            words = b.split()
            words[rng.randrange(len(words))] = "zz"
            out.append(" ".join(words))
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    out += ["Eron, " * 300, prose(rng, 8000)]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, "en", [None, "s1", "s2", "s3", "é"][i % 5], None, i) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int"  # n clashes with inner names
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    rows = [(None, None, None), (None, "a b c", "s"), (7, "a b c", "s"), (7, "a b c", "s"), (8, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def keyed(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


# --- token counts --------------------------------------------------------------------------------


def test_token_counts(documents, texts, odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = keyed(tokens.count_tokens(documents, limit=500))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 500)
    assert tokens.count_tokens(odd).count() == 5
    assert tokens.count_tokens(nothing).count() == 0


def test_token_pattern_is_the_librarys():
    own = tokens.WholeTokens(public_tokenizers.path("word_bpe_49k.json"))
    cases = [s for c in map(chr, range(256)) for s in (c, f"a{c}b", f"1{c}{c}'s", f" {c} 'RE{c}")]
    cases += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "日本語 é ΣΑΣ", "e\u0301", "İI", "<|ENDOFTEXT|>", "it's 'LL"]
    for s in cases:
        assert own.count(s) == len(own.tokenizer.encode(s, add_special_tokens=False).ids), s
    forgetful = tokens.Counts({"a": 1}, len, most=2)
    assert [forgetful[x] for x in ("bb", "ccc", "dddd", "bb", "a")] == [2, 3, 4, 2, 1] and len(forgetful) <= 4


# --- quality classifier --------------------------------------------------------------------------


def test_quality_classifier(spark, documents, texts, nothing, odd):
    rng = random.Random(5)
    docs = [(i, prose(rng, 60) if i % 3 else " | ".join(prose(rng, 1) for _ in range(40))) for i in range(600)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels, most=400)
    got = keyed(quality.score(table, *model))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(i for i in got if got[i]["held_out"]) == held
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    again = keyed(quality.score(table.repartition(7), *quality.train(table.repartition(3), labels, most=400)))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-6 for i in got)
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(quality.train(table, flipped, most=400)[0], model[0])
    assert quality.score(documents, *model).count() == len(texts)
    assert quality.score(nothing, *quality.train(nothing, labels)).count() == 0
    assert quality.score(odd, *model).where("held_out is null or score is null").count() == 0
    kept = quality.accepted(documents, *model)
    assert kept.columns == documents.columns and kept.count() == quality.score(documents, *model).where("predicted = 1").count()


# --- mixing --------------------------------------------------------------------------------------


def fill(sizes: dict, share=1.5, most=2.0):
    """Targets by resharing what is above a cap until nothing is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, documents, texts, odd, nothing):
    got = keyed(mixing.mixed_words(documents, block_words=16, shard_blocks=40))
    source = {i: [None, "s1", "s2", "s3", "é"][i % 5] for i in range(len(texts))}
    sizes = defaultdict(int)
    for i, t in enumerate(texts):
        assert got[i]["size"] == len(WORD.findall(t or ""))
        sizes[source[i]] += got[i]["size"]
    target = fill(sizes)
    for i, r in got.items():
        assert r["source_size"] == sizes[source[i]] and math.isclose(r["target"], target[source[i]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s in sizes:
        assert abs(sum(r["taken"] for i, r in got.items() if source[i] == s) - target[s]) <= 16
    assert keyed(mixing.mixed_words(documents.repartition(3), block_words=16, shard_blocks=40)) == got
    assert mixing.mixed_words(nothing).count() == 0
    assert mixing.mixed_words(odd).count() == 5
    whole = mixing.mixed_documents(documents)
    assert whole.columns[:6] == documents.columns
    assert max(Counter(r["doc_id"] for r in whole.collect()).values()) <= 2


def test_mix_blocks_are_disjoint_and_quotas_exact(documents):
    sized = mixing.sized(documents)
    sources = mixing.targets(sized)
    rows = mixing.mix(sized, sources, block_words=16, shard_blocks=40).collect()
    assert len({(r["doc_id"], r["block"], r["copy"]) for r in rows}) == len(rows)
    shards = Counter(r["shard"] for r in rows)
    assert max(shards.values()) - min(shards.values()) <= len(shards).bit_length()
    for s, n in shards.items():
        assert sorted(r["place"] for r in rows if r["shard"] == s) == list(range(1, n + 1))


def test_hypergeometric_draws(spark):
    """Mean and variance of the draw, and that it stays within its support."""
    for n, k, d in ((50, 20, 10), (1000, 300, 400), (7, 7, 3), (10, 0, 4), (30, 29, 28)):
        sql = mixing.hypergeometric(f"{n}L", f"{k}L", f"{d}L", "(id + 0.5D) / 4000")
        x = np.array([r[0] for r in spark.range(4000).select(F.expr(sql)).collect()])
        assert x.min() >= max(0, d + k - n) and x.max() <= min(d, k)
        mean, var = d * k / n, d * k / n * (1 - k / n) * (n - d) / max(1, n - 1)
        assert abs(x.mean() - mean) < 0.02 + 0.01 * mean and abs(x.var() - var) < 0.05 + 0.03 * var


# --- suffix arrays -------------------------------------------------------------------------------


def brute_repeats(data: list[bytes], length: int):
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        left = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        out.append((len(t), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    for symbols, wide in itertools.product((1, 2, 3, 5, 300), (True, False)):
        for _ in range(60):
            t = np.array([rng.randrange(symbols) for _ in range(rng.randint(0, 60))], np.int64 if symbols > 256 else np.uint8)
            order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
            assert suffix.suffix_array(t, max(symbols, 256) if wide else max(symbols, 257)).tolist() == order
            if len(t) > 1 and symbols <= 256:
                own, n = bytes(t), rng.randint(1, 6)
                want = [len(own) - max(a, b) >= n and own[a : a + n] == own[b : b + n] for a, b in zip(order, order[1:])]
                assert suffix.shares(t, np.array(order), n).tolist() == want


@pytest.mark.parametrize("options", [{}, {"hot": 1, "step": 7, "shard_bytes": 30_000, "sort_bytes": 2_000}])
def test_suffix_dedup(documents, texts, options):
    got = keyed(suffix.removed(documents, **options))
    for i, want in enumerate(brute_repeats([(t or "").encode() for t in texts], 400)):
        assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, i


def test_equal_surroundings_leave_a_task_twice(spark, tmp_path, monkeypatch):
    """A passage of over 423 bytes in a third of the documents, all different."""
    rng = random.Random(5)
    passage = prose(rng, 300)
    texts = [prose(rng, 70) + (f" {passage} " if i % 3 == 0 else " ") + prose(rng, 70) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shard = suffix._shard

    def counted(batches, *options):
        def passed():
            for batch in batches:
                (tmp_path / f"{os.getpid()}-{time.time_ns()}").write_text("\n".join(hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("segment")))
                yield batch

        yield from shard(passed(), *options)

    monkeypatch.setattr(suffix, "_shard", counted)
    for hot in (4096, 100):
        for path in tmp_path.iterdir():
            path.unlink()
        got = keyed(suffix.removed(docs, hot=hot))
        for i, want in enumerate(brute_repeats([t.encode() for t in texts], 400)):
            assert tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, i
        rows = Counter(line for p in tmp_path.iterdir() for line in p.read_text().split("\n"))
        assert 1 < max(rows.values()) < 100  # of 300 occurrences


def test_suffix_dedup_cases(documents, texts, odd, nothing):
    assert suffix.removed(odd).count() == 5 and suffix.removed(nothing).count() == 0
    left = keyed(suffix.without_repeats(documents))
    for i, (n, gone, _, _) in enumerate(brute_repeats([(t or "").encode() for t in texts], 400)):
        if gone == 0:
            assert left[i]["text"] == texts[i]
        elif gone == n:
            assert i not in left
        else:
            assert len(left[i]["text"].encode()) >= n - gone
    assert suffix._whole_characters("aéb".encode(), [(2, 4)]) == "aé".encode()


# --- embeddings ----------------------------------------------------------------------------------


def brute_links(vectors: list, label: list, least: float):
    n = len(vectors)
    peers = [set() for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        a, b = vectors[i], vectors[j]
        if label[i] is None or label[i] != label[j] or len(a or []) != len(b or []):
            continue
        if any(not v or None in v or not np.isfinite(v).all() or not any(v) for v in (a, b)):
            continue
        x, y = np.array(a, np.float64), np.array(b, np.float64)
        if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
            peers[i].add(j)
            peers[j].add(i)
    return peers


def reach(peers: list[set]) -> list[int]:
    out = list(range(len(peers)))
    for i in range(len(peers)):
        seen, todo = {i}, [i]
        while todo:
            for j in peers[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = min(seen)
    return out


@pytest.mark.parametrize("part_rows", [1024, 8])
def test_embedding_dedup(spark, part_rows):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [v.tolist() for v in base] + [(base[i % 12] + rng.standard_normal(16) * 0.12).tolist() for i in range(120)]
    rows += [base[0].tolist()] * 15 + [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    label = [None if i % 29 == 28 else i % 2 for i in range(len(rows))]
    label[-2:] = [1, 1]
    frame = spark.createDataFrame(
        [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, label[i], i) for i, v in enumerate(rows)],
        "vec_id long, embedding array<float>, label int, id int",
    )
    want = brute_links([[None if x is None else float(np.float32(x)) for x in v] if v else v for v in rows], label, 0.98)
    got = keyed(embeddings.near_duplicates(frame, part_rows=part_rows), "vec_id")
    smallest = reach(want)
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(want[i]), smallest[i], smallest[i] == i), i
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in embeddings.near_duplicates(odd).collect()) == [(-1, 0), (3, 1), (3, 1)]


# --- MinHash -------------------------------------------------------------------------------------


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


@pytest.mark.parametrize("percent,part_rows", [(80, 1024), (85, 4)])
def test_minhash(documents, texts, percent, part_rows):
    sets = [shingle_set(t) for t in texts]
    peers = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            peers[i].add(j)
            peers[j].add(i)
    smallest = reach(peers)
    got = keyed(minhash.near_duplicates(documents, percent, part_rows=part_rows))
    for i in range(len(texts)):
        want = (len(sets[i]), smallest[i], smallest[i] == i)
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == want, i


def test_minhash_cases(documents, odd, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    rows = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd).collect() if r["doc_id"])
    assert rows == [(7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True)]
    kept = minhash.one_of_each_group(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in minhash.near_duplicates(documents).where("kept").collect()}


def test_credible_keeps_pairs_of_uneven_sizes(spark):
    """Pairs whose size ratio is just above the limit, the smaller set with a few shingles of its own."""
    sketch, draws = minhash.Sketch(), np.random.default_rng(3)
    for large, small, own, limit in ((1000, 866, 5, 0.85), (200, 172, 1, 0.85), (1000, 806, 2, 0.8), (100, 85, 0, 0.85)):
        j = (small - own) / (large + own)
        assert j >= limit
        u = large / (large + small)
        up, down = (-np.log1p(-x * (sketch.base - 1) / sketch.base) / math.log(sketch.base) for x in (u - (1 - u) * j, 1 - u - u * j))
        more, less, equal = draws.multinomial(sketch.size, [up, max(0, down), 1 - up - max(0, down)], 5000).T
        assert (~minhash.credible(equal, more, np.full(5000, float(large)), np.full(5000, float(small)), limit, sketch)).mean() < 0.001
    rng = random.Random(8)
    rows = []
    for g in range(0, 30, 3):
        hub = [f"w{rng.randrange(10**9)}" for _ in range(1004)]
        left, right = hub[:870], hub[134:]
        left[-5] = right[4] = f"own{g}"
        rows += [(g, " ".join(left)), (g + 1, " ".join(right)), (g + 2, " ".join(hub))]
    a, b, hub = (shingle_set(t) for _, t in rows[:3])
    assert len(a - hub) == 5 and min(len(a & hub) / len(a | hub), len(b & hub) / len(b | hub)) >= 0.85 > len(a & b) / len(a | b)
    got = keyed(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85))
    assert [got[i]["component_id"] for i, _ in rows] == [i - i % 3 for i, _ in rows]


def test_registers_merge_and_estimate():
    sketch = minhash.Sketch()
    a, b = " ".join(map(str, range(300))), " ".join(map(str, range(150, 450)))
    _, _, _, registers = minhash.sketches(pa.array([a, b, " ".join(map(str, range(450)))]), sketch)
    assert (np.maximum(registers[0], registers[1]) <= registers[2]).all()
    share = (registers[0] == registers[1]).mean()  # similarity is about 1 / 3
    assert 0.15 < share < 0.55
    equal, more = (registers[:1] == registers[1:2]).sum(1), (registers[:1] > registers[1:2]).sum(1)
    sizes = np.array([296.0]), np.array([296.0])
    assert not minhash.credible(equal, more, *sizes, 0.8, sketch)[0] and minhash.credible(equal, more, *sizes, 0.33, sketch)[0]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 500)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    peers = [set() for _ in range(501)]
    for a, b in edges:
        peers[a].add(b)
        peers[b].add(a)
    want = reach(peers)
    got = {r["node"]: r["component"] for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for i in range(501) if peers[i] - {i}}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pieces --------------------------------------------------------------------------------------


def test_pieces(documents, texts, odd, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(documents, carry=("n",))
    got = keyed(encoded)
    back = keyed(pieces.decode(encoded))
    for i, t in enumerate(texts):
        assert got[i]["lossless"] and got[i]["n_pieces"] == len(got[i]["pieces"]) and got[i]["n"] == i
        assert library.decode(got[i]["pieces"]) == (t or "") == back[i]["text"]
    assert keyed(pieces.encode(documents.repartition(2), carry=("n",))) == got
    assert pieces.encode(odd).count() == 5 and pieces.encode(nothing).count() == 0


def test_pieces_are_drawn_by_their_weights():
    own = pieces.Lattices(public_tokenizers.path("piece_bpe_32k.model"), 1.0)

    def ways(s: bytes):
        if not s:
            yield ()
        for j in range(1, len(s) + 1):
            if s[:j] in own.piece:
                yield from (((own.piece[s[:j]], *rest)) for rest in ways(s[j:]))

    weight = {w: math.prod(own.weight[p] for p in w) for w in ways(b" there")}
    total, n = sum(weight.values()), 50_000
    ids, at = own.encode(pa.array(["there"] * n), arrow.mix(np.arange(n, dtype=np.uint64)))
    seen = Counter(tuple(ids[at[i] : at[i + 1]].tolist()) for i in range(n))
    for w, x in weight.items():
        p = x / total
        assert abs(seen[w] / n - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    # a long chunk goes another way with the same law
    draws = arrow.mix(np.arange(4000, dtype=np.uint64))
    one = Counter(tuple(p for _, p in reversed(own._one(b" there", int(d)))) for d in draws)
    top = max(weight, key=weight.get)
    p = weight[top] / total
    assert abs(one[top] / 4000 - p) <= 5 * math.sqrt(p * (1 - p) / 4000)


# --- URL filter ----------------------------------------------------------------------------------

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for _, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_filter(spark):
    urls_ = [None, "", "x", "http://", "http://A.com", "http://a.COM/", "https://Example.com/en/x?y=1#z", "http://www.example.com/en/1", "ftp://b.www.example.com/en/"]
    urls_ += ["http://notexample.com/en/", "http://a.net/es/1", "http://a.net/fr", "http://a.net/fr/", "http://é.org/ü?a://b", "a://b://c/d", "http://x.net\n/es/", "http:///en/"]
    urls_ += [f"http://h{i}.{t}/{p}/{i}" for i in range(60) for t, p in (("com", "de"), ("net", "es"), ("net", "de"), ("org", "en"))]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls_)] + [(None, "http://a.com/", None, None)], "page_id long, url string, html string, rule string")
    rows = urls.judge(pages, RULES).collect()
    assert len(rows) == len(urls_) + 1
    verdict = dict((rule, v) for v, rule in RULES)
    for r in rows:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == brute_url(urls_[r["page_id"]]), urls_[r["page_id"]]
        assert r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
        assert r["rule"] is None or r["verdict"] == verdict[r["rule"]]
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_trees_respect_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(4000) + (x[:, 1] > 0.5) > 0.8).astype(float)
    free, held = boost.fit(x, y), boost.fit(x, y, {0: 1, 1: -1})
    assert np.mean((free.score(x) > 0.5) == y) > 0.85
    grid = np.repeat(rng.uniform(0, 1, (50, 3)), 40, 0)
    for feature, sign in ((0, 1), (1, -1)):
        line = grid.copy()
        line[:, feature] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(held.score(line).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert boost.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (boost.fit(x, np.ones(4000)).score(x) > 0.99).all()


# --- quality rules -------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)]


def test_quality_rules(spark, documents, texts, odd, nothing):
    rng = random.Random(1)
    more = ["".join(rng.choice("ab \n\n\té#日") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    assert rules.statistics(pa.array(more, pa.string()))[:, :5].tolist() == [brute_rules(t) for t in more]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    got = keyed(rules.judge(documents, rules.train(documents, labels)))
    for i, t in enumerate(texts):
        n, *_, repeat = want = brute_rules(t)
        assert [got[i][c] for c in rules.BASE] == want
        failed = n < 50 or 100 * repeat > 50 * n
        assert got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and got[i]["score"] >= 0.5)
    assert rules.judge(odd, rules.train(nothing, labels)).count() == 5 and rules.judge(nothing, rules.train(nothing, labels)).count() == 0


# --- chat ----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(9)
    bits = [*chat.CONTROLS, "\\", "<", "|", "a", "\n", "é", "[", "/INST]", "<\\", "end|>"]
    conversations = [
        [(rng.choice(["user", "assistant", "system", "x<|text|>"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(1, 90))]
        for _ in range(40)
    ]
    for turns in conversations:
        out, spans, rewriting = chat.locate(chat.markup, turns)
        assert [(r, t) for r, t, _, _ in chat.read_back(out)] == turns and not rewriting
        assert spans[-1][1] == len(out) and [s for s, _ in spans] == [0, *(e for _, e in spans[:-1])]
    rows = [(c, i, r, t, 0) for c, turns in enumerate(conversations) for i, (r, t) in enumerate(turns)]
    rows += [(100, 1, None, None, 0), (100, None, "assistant", "x", 0), (None, 1, "user", "u", 0), (100, 1, None, None, 0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, steps int").repartition(4)
    got = keyed(chat.digests(frame), "conv_id")
    conversations_by_id = dict(enumerate(conversations)) | {100: [("assistant", "x"), ("", ""), ("", "")], None: [("user", "u")]}
    assert set(got) == set(conversations_by_id)
    full = keyed(chat.format_all(frame), "conv_id")
    for c, turns in conversations_by_id.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"]) == want
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert full[c]["formatted"] == chat.markup(turns) and got[c]["formatted_chars"] == len(full[c]["formatted"])
        assert "".join(chat.unescape(full[c]["formatted"][a:b]) for a, b in full[c]["loss_spans"]) == loss
    assert chat.digests(frame.limit(0)).count() == 0


def test_rewriting_templates_are_detected():
    def last_only(turns):  # drops the thoughts of earlier turns
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('|')[-1]}" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "think|answer"), ("user", "more")]
    _, spans, rewriting = chat.locate(last_only, turns)
    assert rewriting == [2] and spans[0] == (0, 7)
    steps = chat.Incremental(last_only)
    assert [steps.add(t)[1] for t in turns] == [True, True, False] and steps.rewrites == 1


def test_rewriting_after_many_turns_is_reported(spark):
    def last_forty(turns):
        return chat.markup(turns[-40:])

    turns = [("assistant" if i % 2 else "user", f"t{i}") for i in range(60)]
    rewriting = chat.locate(last_forty, turns)[2]
    assert rewriting == list(range(40, 60))
    steps = chat.Incremental(last_forty)
    assert [i for i, t in enumerate(turns) if not steps.add(t)[1]] == rewriting and steps.length == len(last_forty(turns))
    frame = spark.createDataFrame([(c, i, r, t) for c, n in ((1, 60), (2, 35)) for i, (r, t) in enumerate(turns[:n])], "conv_id long, turn long, role string, text string")
    got, full = keyed(chat.digests(frame, last_forty), "conv_id"), keyed(chat.format_all(frame, last_forty), "conv_id")
    for c, n in ((1, 60), (2, 35)):
        out = last_forty(turns[:n])
        assert got[c]["rewriting"] == full[c]["rewriting"] == (rewriting if n == 60 else []) and full[c]["formatted"] == out
        assert (got[c]["n_turns"], got[c]["formatted_chars"]) == (min(n, 40), len(out))
