"""Whitening, sharding and the prefix trie against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talkspark.llm import charpoly, hypergeometric, queries, sharding, trie, whitening

VECTORS = "vec_id long, embedding array<float>, label long, y int, n string"


def leverrier(a: list[list[int]]) -> list[int]:
    """Characteristic polynomial, lowest coefficient first, by Faddeev and Leverrier in integers."""
    d = len(a)
    m, out = [[0] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += out[-1]
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(m[i][i] for i in range(d)) // k)
    return out[::-1]


@pytest.mark.parametrize("d", [1, 2, 5, 9])
def test_characteristic_polynomial_is_exact(d):
    rng = random.Random(d)
    y = [[rng.randint(-(10**9), 10**9) for _ in range(d)] for _ in range(d + 2)]
    a = [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]
    exact = np.array(a, dtype=object)
    chosen = charpoly.primes(charpoly.coefficient_bits(d, sum(a[i][i] for i in range(d))))
    residues = {p: charpoly.modular((exact % p).astype(np.int64), p).tolist() for p in chosen}
    assert charpoly.remaindered(residues) == leverrier(a)


def test_roots_with_multiplicity_and_near_ones():
    # (x - 7)^3 (x - 2)^2 x, and 10^12 beside 10^12 + 1.
    f = [1]
    for root in (7, 7, 7, 2, 2, 0):
        f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    assert [(r >> b, m) for r, b, m in charpoly.largest_roots(f, 16, 30)] == [(7, 3), (2, 2)]
    near = [10**12 * (10**12 + 1), -(2 * 10**12 + 1), 1]
    assert [r >> b for r, b, _ in charpoly.largest_roots(near, 16, 2 * 10**12 + 1)] == [10**12 + 1, 10**12]


def test_vectors_of_a_repeated_root_and_near_ones():
    a = np.kron(np.eye(3, dtype=np.int64), np.array([[5, 1], [1, 7]]))
    (root, bits, times), _ = charpoly.largest_roots(leverrier(a.tolist()), 16, 36)
    v = charpoly.null_space(a, root, bits, times)
    assert times == 3 and np.abs(v @ v.T - np.eye(3)).max() < 1e-15
    assert np.abs(a @ v.T - root / (1 << bits) * v.T).max() < 1e-14
    # Two roots that differ by 4 in 10^12: doubles alone would mix their vectors.
    b = np.array([[10**12, 2], [2, 10**12]])
    first, second = charpoly.largest_roots(leverrier(b.tolist()), 16, 2 * 10**12)
    assert np.abs(np.abs(charpoly.null_space(b, first[0], first[1], 1)) - math.sqrt(0.5)).max() < 1e-15
    assert np.abs(np.abs(charpoly.null_space(b, second[0], second[1], 1)) - math.sqrt(0.5)).max() < 1e-15


def whitened_by_numpy(rows, most=16):
    usable = {i: v for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    sizes = Counter(len(v) for v in usable.values())
    d = max(sizes, key=lambda k: (sizes[k], k))
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in usable.items() if len(v) == d}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    keep = [k for k in np.argsort(-values) if values[k] > 1e-9 * values.max()][:most]
    out = []
    for i, v in x.items():
        w = np.array([(n * a - s) / n for a, s in zip(v, sums)])
        for number, k in enumerate(keep, 1):
            out.append((rows[i][0], number, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), float(w @ axes[:, k] / math.sqrt(values[k])), values[k] / values.sum()))
    return out


def check_whitening(got, want):
    assert len(got) == len(want)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = np.array([r[4] for r in got if r[1] == k]), np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert max(abs(a[5] - b[5]) for a, b in zip(got, want)) < 1e-12
    assert max(r[6] for r in got) < 1e-9


def test_whitening_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, k + 1) for k in range(7)]) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(100, 130)] + [(None, rows[1][1]), (1, rows[2][1])]
    rows += [(200, None), (201, []), (202, [1.0] * 6 + [None]), (203, [1.0] * 6 + [math.inf]), (204, [math.nan] * 7), (205, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS).repartition(4)
    check_whitening(whitening.whiten(df).collect(), whitened_by_numpy(rows))
    assert {r["component"] for r in whitening.whiten(df, most=3).collect()} == {1, 2, 3}


def test_whitening_of_flat_and_large_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [a := rng.gauss(0, 1e12), -a, rng.gauss(0, 1e12), 5.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2}  # the third and fourth directions are flat
    assert all(r["deviation"] is None for r in got) and max(r["identity_error"] for r in got) < 1e-9
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 1, "x")] * 3, VECTORS)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_products_are_exact_for_any_size():
    import pyarrow as pa

    rng = random.Random(5)
    for top in (3, 1 << 20, 1 << 41, 1 << 62):
        y = [[rng.randint(-top, top) for _ in range(3)] for _ in range(9000)]
        (batch,) = whitening.products(3)(iter([pa.RecordBatch.from_pydict({"y": y})]))
        for row in batch.to_pylist():
            whole = sum(row[f"p{k}"] << 40 * k for k in range(whitening.PARTS))
            i, j = row["i"], row["j"]
            assert whole == sum(v[j] * (v[i] if i >= 0 else 1) for v in y)


def test_deal_has_exact_margins_and_the_right_spread(spark):
    sizes = [5 + i % 3 for i in range(700)]  # more leaves than a node has children
    total = sum(sizes)
    leaves = spark.range(0, 700).selectExpr("id AS leaf", "5 + id % 3 AS size")
    counts = [total // 4, total // 4, total - 2 * (total // 4)]
    seen = []
    for seed in ("a", "b", "c"):
        rows = hypergeometric.deal(leaves, 700, spark.range(1).select(F.array(*map(F.lit, counts)).alias("counts")), seed).collect()
        m = np.array([r["counts"] for r in sorted(rows, key=lambda r: r["leaf"])])
        assert m.sum(0).tolist() == counts and m.sum(1).tolist() == sizes and m.min() >= 0
        seen.append(m)
    m = np.concatenate(seen)
    s = np.array(sizes * 3)
    for j, c in enumerate(counts):
        share = c / total
        score = (m[:, j] - s * share) / np.sqrt(s * share * (1 - share))
        assert abs(score.mean()) < 0.02 and abs((score**2).mean() - 1) < 0.12


def test_draw_follows_the_hypergeometric_law(spark):
    draw = hypergeometric.draw("30L", "11L", "13L", "(id + 0.5D) / 20000")
    found = Counter(r[0] for r in spark.range(20000).selectExpr(draw).collect())
    for x in range(12):
        p = math.comb(11, x) * math.comb(19, 13 - x) / math.comb(30, 13)
        assert abs(found[x] / 20000 - p) < 1e-4


def documents(spark, texts):
    rows = [(None if i % 11 == 3 else i, t, i, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard int, Slot string, digest string").repartition(3)


def test_sharding_equals_its_sql(spark):
    rng = random.Random(1)
    texts = [rng.choice([None, "", "é日本", "a b", "same " * 40, str(i)]) for i in range(400)]
    docs = documents(spark, texts).unionByName(documents(spark, ["twin"] * 40).withColumn("doc_id", F.lit(7).cast("long")))
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM frame")
    for partition_rows in (4096, 30):
        want = sorted(map(tuple, con.execute(queries.shard_sql(partition_rows)).fetchall()), key=str)
        got = sharding.document_shards(docs, partition_rows=partition_rows).collect()
        assert sorted(map(tuple, got), key=str) == want
        held = defaultdict(list)
        for r in got:
            held[r["shard"]].append(r["slot"])
        assert sorted(map(len, held.values())) == [55] * 8 and all(sorted(v) == list(range(55)) for v in held.values())


def test_shuffle_keeps_all_columns_and_clashing_names(spark):
    docs = documents(spark, [f"t{i}" for i in range(50)]).unionByName(documents(spark, ["copy"] * 1).crossJoin(spark.range(3000)).drop("id"))
    placed = sharding.shuffled(docs, shards=4, partition_rows=100)
    assert placed.columns == [*docs.columns, "shard_", "slot_"]
    rows = placed.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, docs.collect()))
    assert sorted(Counter(r["shard_"] for r in rows).values()) == [762, 762, 763, 763]
    # Copies of one row are spread over all shards.
    assert min(Counter(r["shard_"] for r in rows if r["text"] == "copy").values()) > 700
    again = sharding.shuffled(docs.repartition(7), shards=4, partition_rows=100).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_sharding_of_few_and_no_rows(spark, tmp_path):
    few = sharding.document_shards(documents(spark, ["a", None, "b"])).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert {(r["size"], r["text_crc32"]) for r in few} == {(2, zlib.crc32(b"a")), (1, 0), (2, zlib.crc32(b"b"))}
    assert sharding.document_shards(documents(spark, ["a"]).where("false")).count() == 0
    sharding.write_shards(documents(spark, list("abcdefghij")).drop("shard", "Slot"), str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["text"] for r in back.collect()) == list("abcdefghij")
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [3, 3, 4]


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for conv in own:
        own[conv].sort()
    built = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(math.fmod(conv, 100))
        built[conv] = [(t[2], t[4]) for t in own.get(base, [])[:h] + own[conv][h:]]
    members, children = defaultdict(list), defaultdict(list)
    for conv, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


TURNS = "conv_id long, turn long, role string, text string, n string, block int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(4)


@pytest.mark.parametrize("block", [3, 4096])
def test_trie_equals_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for conv in [*range(-5, 130), 200, 201, 250, 10**12 + 7]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["hello", "hello", "é日", "", None, "other"])))
    rows += [(300 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)]  # one conversation many times
    rows += [(301, 4, "user", "tie"), (301, 4, "user", "tie"), (301, 4, "a", "tie"), (302, None, "user", "first"), (None, 1, "user", "nobody")]
    rows += [(400, t, "user", "w" * (t % 7)) for t in range(60)] + [(5000, t, "user", "w" * (t % 7)) for t in range(40)]
    got = sorted(map(tuple, trie.prefix_trie(turns(spark, rows)).collect()))
    assert got == trie_by_hand(rows)


def test_trie_equals_its_sql(spark):
    rng = random.Random(9)
    rows = [(conv, turn, "user", rng.choice("ab")) for conv in range(95, 260) for turn in range(rng.randint(1, 7))]
    con = duckdb.connect()
    frame = turns(spark, rows).toPandas()  # noqa: F841
    con.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    want = con.execute(queries.TRIE_SQL).fetchall()
    assert sorted(map(tuple, trie.prefix_trie(turns(spark, rows)).collect())) == sorted(map(tuple, want))


def test_trie_of_one_long_and_of_no_conversation(spark):
    rows = [(17, t, "user", "word") for t in range(9000)]  # over two blocks, nothing shared
    got = sorted(map(tuple, trie.prefix_trie(turns(spark, rows)).collect()))
    # Conversation 17 has no base, so its first turns are left out.
    h = zlib.crc32(b"17") % 6
    assert len(got) == 9001 - h and got[-1][:6] == (17, 9000 - h, 17, 1, 0, 1)
    assert trie.prefix_trie(turns(spark, rows).where("false")).count() == 0
    # A conversation that rebuilding leaves without turns ends at the root.
    gone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    (only,) = trie.prefix_trie(turns(spark, [(gone, 0, "user", "x")])).collect()
    assert tuple(only) == (gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())
