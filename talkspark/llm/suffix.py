"""Suffix-array dedup of repeated byte strings.

A string of ``length`` bytes is found through the smallest hash among its ``gram``-byte windows
(its anchor): equal strings have equal anchors at equal places.  Only starts whose anchor stands
more than once in the corpus can repeat.  Their surroundings are dealt to shards by anchor; a
shard builds the suffix array of its distinct surroundings by induced sorting and the permuted
common prefixes, and a start repeats if its neighbours share ``length`` bytes.  An anchor with many
surroundings is dealt by shorter runs of starts and the bytes that all strings of the run share,
so that no anchor fills a task.  A task sends equal surroundings to a shard twice at most, and the
ranges found in a surrounding are joined back to its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm import arrow
from talkspark.llm.store import keep, scope

GRAM = 32
#: A task that has seen a surrounding so often deals its further occurrences to so many salts.
OFTEN, SALTS = 32, 128
#: Surroundings that a task remembers.
REMEMBERED = 200_000


# --- suffix array by induced sorting -------------------------------------------------------------


def _induce_small(text: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array of a large alphabet's text from its sorted leftmost-smaller positions."""
    n = len(text)
    # Symbol in front of each position if that is of the kind asked for, else -1; empty places are -1.
    front = np.full(n + 1, -1, np.int64)
    own = text[: n - 1].astype(np.int64)
    front[1:n] = np.where(is_s[: n - 1], -1, own)
    larger = front.tolist()
    front[1:n] = np.where(is_s[: n - 1], own, -1)
    smaller = front.tolist()
    seeded = np.full(n, -1, np.int64)
    symbol = text[lms]  # sorted
    seeded[ends[symbol] - (np.searchsorted(symbol, symbol, "right") - np.arange(len(lms)))] = lms
    sa = seeded.tolist()
    head = [0, *ends[:-1].tolist()]
    if not is_s[n - 1]:  # the end of the text is smaller than all, so its last suffix leads its bucket
        c = int(text[n - 1])
        sa[head[c]] = n - 1
        head[c] += 1
    for p in sa:  # the list grows ahead of the walk
        c = larger[p]
        if c >= 0:
            at = head[c]
            sa[at] = p - 1
            head[c] = at + 1
    tail = ends.tolist()
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            at = tail[c] - 1
            sa[at] = p - 1
            tail[c] = at
    return np.array(sa, np.int64)


def _induce_wide(text: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for few symbols: whole buckets at a time, in waves within a bucket."""
    n, k = len(text), len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    symbol = text[lms]
    held = np.searchsorted(symbol, np.arange(k + 1))  # lms is sorted, so its symbols are too
    head = starts.copy()

    def spread(found: np.ndarray, fill: np.ndarray, step: int) -> None:
        """Appends positions to their buckets, in order; step -1 fills from the end."""
        own = text[found]
        order = np.argsort(own, kind="stable")
        found, own = found[order], own[order]
        number = np.bincount(own, minlength=k)
        used = np.flatnonzero(number)
        first = np.cumsum(number) - number
        inside = np.arange(len(found)) - first[own]
        if step > 0:
            sa[fill[own] + inside] = found
            fill[used] += number[used]
        else:
            sa[fill[own] - 1 - inside] = found
            fill[used] -= number[used]

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[is_s[found] == kind]

    if not is_s[n - 1]:
        spread(np.array([n - 1]), head, 1)
    for c in range(k):
        at = starts[c]
        while at < head[c]:  # L suffixes of this bucket; more may be induced into it meanwhile
            wave, at = sa[at : head[c]].copy(), head[c]
            found = before(wave, False)
            if len(found):
                spread(found, head, 1)
        found = before(lms[held[c] : held[c + 1]], False)
        if len(found):
            spread(found, head, 1)
    tail = ends.copy()
    for c in range(k - 1, -1, -1):
        at = ends[c]
        while at > tail[c]:  # S suffixes of this bucket, from the largest
            wave, at = sa[tail[c] : at][::-1].copy(), tail[c]
            found = before(wave, True)
            if len(found):
                spread(found, tail, -1)
        found = before(sa[starts[c] : head[c]][::-1], True)
        if len(found):
            spread(found, tail, -1)
    return sa


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array by induced sorting; a suffix that is a prefix of another is the smaller one.

    Suffixes are smaller (S) or larger (L) than the next one.  The leftmost S of each run are
    sorted by induction on their substrings, named, and, where names repeat, ordered by the suffix
    array of the names; all other suffixes are induced from them.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    # S or L: decided at the next differing symbol.
    change = np.flatnonzero(text[1:] != text[:-1])
    kind = np.zeros(n, bool)
    run_end = np.concatenate([change, [n - 1]])
    run_kind = np.concatenate([text[change] < text[change + 1], [False]])
    kind[:] = np.repeat(run_kind, np.diff(np.concatenate([[-1], run_end])))
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    induce = _induce_wide if symbols <= max(256, n // 200) else _induce_small
    if not len(lms):
        return induce(text, kind, ends, lms)
    # 1. order the LMS substrings: seeds in text order within their bucket
    seeds = lms[np.argsort(text[lms], kind="stable")]
    rough = induce(text, kind, ends, seeds)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    found = number[rough]
    ordered = lms[found[found >= 0]]
    # 2. names: equal for equal substrings (symbols up to and including the next LMS position)
    stop = np.concatenate([lms[1:], [n - 1]])
    size = stop[number[ordered]] - ordered + 1
    last = number[ordered] == len(lms) - 1
    differs = np.ones(len(ordered), bool)
    a, b = ordered[:-1], ordered[1:]
    same = (size[:-1] == size[1:]) & ~last[:-1] & ~last[1:]
    check = np.flatnonzero(same)
    for step in range(int(size.max())):
        if not len(check):
            break
        check = check[size[check] > step] if step else check
        unequal = text[a[check] + step] != text[b[check] + step]
        same[check[unequal]] = False
        check = check[~unequal]
    differs[1:] = ~same
    name = np.cumsum(differs) - 1
    if name[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ordered]] = name
        ordered = lms[suffix_array(reduced, int(name[-1]) + 1)]
    # 3. induce everything from the sorted LMS suffixes
    return induce(text, kind, ends, ordered)


def shares(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Per rank from 1 on: whether the suffix has ``length`` bytes in common with the one before.

    Permuted common prefixes: in text order a value is one less than that of the position to the
    left if the bytes before both suffixes agree; only the other (irreducible) ones are compared,
    eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    ok = np.flatnonzero(before[1:] > 0) + 1
    reducible = np.zeros(n, bool)
    reducible[ok] = text[ok - 1] == text[before[ok] - 1]
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    eight = np.zeros(n + 8, np.uint64)
    for j in range(8):
        eight |= padded[j : j + n + 8].astype(np.uint64) << np.uint64(8 * j)
    a = np.flatnonzero(~reducible & (before >= 0))
    common = np.zeros(n, np.int64)
    b, own = before[a], a
    while len(own):
        x = eight[np.minimum(a, n)] ^ eight[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
        common[own] += same
        on = (x == 0) & (a < n) & (b < n)
        own, a, b = own[on], a[on] + 8, b[on] + 8
    common = np.minimum(common, n - np.maximum(np.arange(n), before))
    # A reducible value falls by one per place from the last irreducible one.
    base = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    common = common[base] - (np.arange(n) - base)
    return common[sa[1:]] >= length


def repeated_starts(segments: list[bytes], starts: list[int], copies: list[int], length: int) -> list[np.ndarray]:
    """For each distinct segment: which of its first ``starts`` places begin a string that repeats.

    A string repeats if it begins at another of these places, or if its segment has ``copies``.
    """
    sizes = np.array([len(x) + 1 for x in segments])
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no byte of UTF-8
    sa = suffix_array(text, 256)
    group = np.concatenate([[0], np.cumsum(~shares(text, sa, length))])
    count = np.array(starts)
    owned = np.repeat(at[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    rank = np.empty(len(text), np.int64)
    rank[sa] = np.arange(len(text))
    own_group = group[rank[owned]]
    total = np.bincount(own_group, np.repeat(np.array(copies, np.float64), count))
    return np.split(total[own_group] > 1, np.cumsum(count)[:-1])


# --- anchors and surroundings --------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    prefix = arrow.prefix_hash(data)
    start = np.arange(max(0, len(data) - gram + 1))
    return arrow.span_hash(prefix, start, start + gram)


def anchor_runs(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start, end of the starts, and whether strings of the run may repeat in it."""
    grams = gram_hashes(data, gram)
    width, m = length - gram + 1, len(data) - length + 1
    padded = np.concatenate([grams, np.full(-len(grams) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    end = np.concatenate([first[1:], [m]])
    leads = np.concatenate([[0], np.cumsum(grams[:m] == least)])
    return least[first], first, end, leads[end - 1] > leads[first]


def _join_text(docs: DataFrame) -> DataFrame:
    """Text as bytes with a 128-bit name; equal texts have one name."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_one": F.xxhash64(text), "_two": F.xxhash64(F.lit("second"), text)}).withColumn("_bytes", text.cast("binary"))


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, digest = [], []
        for x in batch.column("bytes"):
            data = x.as_py()
            digest.append(hashlib.sha256(data).hexdigest())
            if len(data) < length:
                packed.append(None)
                continue
            anchor, first, end, inside = anchor_runs(np.frombuffer(data, np.uint8), length)
            packed.append(anchor.tobytes() + first.astype(np.int64).tobytes() + end.astype(np.int64).tobytes() + inside.astype(np.int64).tobytes())
        size = pc.binary_length(batch.column("bytes")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("one"), batch.column("two"), size, pa.array(digest, pa.string()), pa.array(packed, pa.binary())],
            names=["row", "one", "two", "n_bytes", "sha", "anchors"],
        )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.frombuffer(x.as_py(), np.int64).reshape(4, -1) for x in batch.column("anchors")]
        count = [p.shape[1] for p in parts]
        all_runs = np.concatenate(parts, 1) if parts else np.zeros((4, 0), np.int64)
        names = [np.repeat(batch.column(c).to_numpy(), count) for c in ("one", "two")]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, names), pa.array(all_runs[0]), pa.array(all_runs[1]), pa.array(all_runs[2]), pa.array(all_runs[3] > 0)],
            names=["one", "two", "anchor", "first", "end", "inside"],
        )


def _segments(batches: Iterator[pa.RecordBatch], length: int, step: int) -> Iterator[pa.RecordBatch]:
    """Surroundings of the starts of each run; runs of hot anchors in parts of ``step`` places.

    Each occurrence has a row with a 128-bit name of its surrounding.  The bytes are on the rows of
    the first and second time that the task sees it, which is enough to tell one from several, and
    on the row that says that salts begin.
    """
    seen: dict[tuple, int] = {}
    for batch in batches:
        for part in arrow.slices(batch, "bytes"):
            out: list[tuple] = []
            for row in part.to_pylist():
                data, one, two = row["bytes"], row["one"], row["two"]
                grams = None
                for run in row["runs"]:
                    anchor, first, end = run["anchor"], run["first"], run["end"]
                    if not run["hot"]:
                        out.append((anchor, one, two, first, end - first, data[first : end - 1 + length]))
                        continue
                    if grams is None:
                        array = np.frombuffer(data, np.uint8)
                        prefix, grams = arrow.prefix_hash(array), gram_hashes(array)
                    places = np.flatnonzero(grams[first : end - 1 + length - GRAM + 1] == np.int64(anchor).astype(np.uint64)) + first
                    start = np.arange(first, end)
                    place = places[np.searchsorted(places, start)]
                    slot = (place - start) // step
                    edge = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (place[1:] != place[:-1])]))
                    low, high = start[edge], np.concatenate([start[edge[1:]], [end]])
                    # Bytes that every string of the part holds, told from the anchor's place alone.
                    inner_from = place[edge] - slot[edge] * step
                    inner_to = np.minimum(place[edge] - (slot[edge] + 1) * step + 1 + length, len(data))
                    inner = arrow.span_hash(prefix, inner_from, inner_to)
                    keys = arrow.mix(inner + arrow.mix(slot[edge].astype(np.uint64) + np.uint64(1))).view(np.int64)
                    out += [
                        (k, one, two, a, b - a, data[a : b - 1 + length]) for k, a, b in zip(keys.tolist(), low.tolist(), high.tolist())
                    ]
            rows = []
            for key, one, two, first, starts, segment in out:
                name = hashlib.blake2b(segment, digest_size=16).digest()
                times = seen.get((key, starts, name), 0) + 1
                seen[key, starts, name] = times
                salted = times == OFTEN + 1
                salt = 1 + times % SALTS if times > OFTEN else 0
                rows.append((key, one, two, first, starts, salt, name, salted, segment if times <= 2 or salted else None))
            if len(seen) > REMEMBERED:
                seen.clear()
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)],
                names=["key", "one", "two", "first", "starts", "salt", "name", "salted", "segment"],
            )


def _shard(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """Covered byte ranges of surroundings, from a stream of surroundings in the order of their keys.

    Whole keys are taken together until they hold about ``most`` distinct bytes.
    """
    names = ["key", "starts", "name", "salted", "low", "high"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64()]

    def solve(distinct: dict[tuple, list]) -> pa.RecordBatch:
        out: list[tuple] = []
        of_key: dict[int, int] = {}
        for key, _, _ in distinct:
            of_key[key] = of_key.get(key, 0) + 1
        # The copies of a key's only segment repeat as a whole; the others are sorted.
        plain = [s for s in distinct if of_key[s[0]] == 1 and distinct[s][1] > 1]
        sorted_ones = [s for s in distinct if of_key[s[0]] > 1 or distinct[s][1] == 1]
        flags = [np.ones(n, bool) for _, n, _ in plain]
        if sorted_ones:
            copies = [distinct[s][1] for s in sorted_ones]
            flags += repeated_starts([distinct[s][0] for s in sorted_ones], [n for _, n, _ in sorted_ones], copies, length)
        for own, flag in zip(plain + sorted_ones, flags):
            on = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
            out += [(*own, distinct[own][2], low, high) for low, high in zip(on[::2].tolist(), (on[1::2] - 1 + length).tolist())]
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=names)

    held: dict[tuple, list] = {}
    size = 0
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "starts", "name", "salted", "segment")]
        for key, starts, name, salted, segment in zip(*columns):
            if key != last and size >= most:
                yield solve(held)
                held, size = {}, 0
            last = key
            own = (key, starts, name)
            if own not in held:
                held[own] = [segment, 0, False]
                size += len(segment)
            held[own][1] += 1
            held[own][2] |= salted
    if held:
        yield solve(held)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept_parts(data: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """Bytes outside the union of the ranges, bytes removed, and maximal removed runs."""
    runs = _union(ranges)
    edges = [0, *(x for run in runs for x in run), len(data)]
    left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return left, len(data) - len(left), len(runs)


def covered(rows: DataFrame, length: int, shard_bytes: int, sort_bytes: int, hot: int, step: int) -> tuple[DataFrame, DataFrame]:
    """A light row per document, and ``one, two, bytes, ranges`` of each text with repeats."""
    named = _join_text(rows)
    light = keep(
        named.select(F.col("_row").alias("row"), F.col("_one").alias("one"), F.col("_two").alias("two"), F.col("_bytes").alias("bytes")).mapInArrow(
            arrow.freeing(lambda batches: _anchors(batches, length)), "row long, one long, two long, n_bytes long, sha string, anchors binary"
        )
    )
    runs = (
        light.where("anchors is not null")
        .groupBy("one", "two")
        .agg(F.first("anchors").alias("anchors"))
        .mapInArrow(arrow.freeing(_unpacked), "one long, two long, anchor long, first long, end long, inside boolean")
    )
    with scope() as inner:
        runs = keep(runs)
        seen = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.max("inside").alias("inside")).where("n > 1 or inside")
        wanted = runs.drop("inside").join(seen.select("anchor", (F.col("n") > hot).alias("hot")), "anchor")
        per_text = keep(wanted.groupBy("one", "two").agg(F.collect_list(F.struct("anchor", "first", "end", "hot")).alias("runs")))
        inner.save(per_text)
    texts = named.groupBy(F.col("_one").alias("one"), F.col("_two").alias("two")).agg(F.first("_bytes").alias("bytes"))
    texts = keep(texts.join(per_text, ["one", "two"]))
    total = per_text.select(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"] + length))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    segments = keep(
        texts.mapInArrow(
            arrow.freeing(lambda b: _segments(b, length, step)),
            "key long, one long, two long, first long, starts long, salt long, name binary, salted boolean, segment binary",
        )
    )
    distinct = segments.where("segment is not null").select("key", "starts", "name", "salted", "segment")
    dealt = distinct.repartition(int(shards), "key").sortWithinPartitions("key")
    solved = dealt.mapInArrow(arrow.freeing(lambda b: _shard(b, length, sort_bytes)), "key long, starts long, name binary, salted boolean, low long, high long")
    salts = F.when(F.col("salted"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    solved = keep(solved).withColumn("salt", F.explode(salts)).drop("salted")
    found = segments.drop("segment", "salted").join(solved, ["key", "starts", "name", "salt"])
    found = found.select("one", "two", (F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high")).alias("stop"))
    ranges = found.groupBy("one", "two").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return light.drop("anchors"), texts.drop("runs").join(ranges, ["one", "two"])


def removed(
    docs: DataFrame, length: int = 400, shard_bytes: int = 4 << 20, sort_bytes: int = 1 << 19, hot: int = 4096, step: int = 24
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere (another
    document or the same one) counts as removed, as judged on the input.  A text that stands in
    several rows is removed whole if it has ``length`` bytes.  Null and empty texts have 0 bytes;
    null ids stay null; repeated rows keep a row each; other columns are not read; an empty table
    gives an empty result.
    """
    light, found = covered(docs.select(F.col("doc_id").cast("long").alias("_row"), "text"), length, shard_bytes, sort_bytes, hot, step)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, ranges in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist()):
                left, gone, spans = _kept_parts(data, [(r["start"], r["stop"]) for r in ranges])
                rows.append((gone, spans, hashlib.sha256(left).hexdigest()))
            gone, spans, sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("one"), batch.column("two"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["one", "two", "gone", "spans", "left_sha"],
            )

    partly = found.mapInArrow(arrow.freeing(cut), "one long, two long, gone long, spans long, left_sha string")
    copied = light.where(F.col("n_bytes") >= length).groupBy("one", "two").agg(F.count("*").alias("copies")).where("copies > 1")
    joined = light.join(copied, ["one", "two"], "left").join(partly, ["one", "two"], "left")
    whole = F.col("copies").isNotNull()
    return joined.select(
        F.col("row").alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    )


def _whole_characters(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """Bytes outside the union of the ranges; a character that a range only touches stays whole."""
    parts, at = [], 0
    for a, b in _union(ranges):
        while a < b and (data[a] & 0xC0) == 0x80:
            a += 1
        while a < b < len(data) and (data[b] & 0xC0) == 0x80:
            b -= 1
        parts.append(data[at:a])
        at = max(at, b)
    return b"".join([*parts, data[at:]])


def without_repeats(docs: DataFrame, length: int = 400, shard_bytes: int = 4 << 20, sort_bytes: int = 1 << 19, hot: int = 4096, step: int = 24) -> DataFrame:
    """The rows of ``docs`` (all columns) with every repeated string cut out of ``text``.

    Cuts are as in ``removed``: all occurrences of a repeated string go, none stays, so a text of
    ``length`` bytes in several rows goes from all of them; let only one of equal rows in.
    Cuts keep whole characters.  Rows of which only white space is left by the cuts go; rows that
    nothing is cut from stay as they are, null and empty texts included.
    """
    with scope() as inner:
        light, found = covered(docs.select(F.lit(0).cast("long").alias("_row"), "text"), length, shard_bytes, sort_bytes, hot, step)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [
                    _whole_characters(data, [(r["start"], r["stop"]) for r in ranges])
                    for data, ranges in zip(batch.column("bytes").to_pylist(), batch.column("ranges").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("one"), batch.column("two"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                    names=["_one", "_two", "_left"],
                )

        copied = light.where(F.col("n_bytes") >= length).groupBy("one", "two").agg(F.count("*").alias("copies")).where("copies > 1")
        copied = copied.select(F.col("one").alias("_one"), F.col("two").alias("_two"), F.lit("").alias("_left"))
        partly = found.mapInArrow(arrow.freeing(cut), "_one long, _two long, _left string")
        changed = inner.save(keep(partly.unionByName(copied).groupBy("_one", "_two").agg(F.min("_left").alias("_left"))))
    # The other columns travel in a struct, so that no name of theirs meets one of these.
    others = [c for c in docs.columns if c != "text"]
    whole = docs.select(F.struct(*others).alias("_others") if others else F.lit(None).alias("_others"), "text")
    joined = _join_text(whole).drop("_bytes").join(changed, ["_one", "_two"], "left")
    gone = F.coalesce(F.regexp_replace("_left", "[\\x20\\x09-\\x0D]+", "") == "", F.lit(False))
    text = F.coalesce("_left", "text").alias("text")
    return joined.where(~gone).select(*[text if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns])
