"""SentencePiece encoding by sampling, and lossless decoding.

All segmentations of a text into pieces form a lattice.  Forward filtering gives each place the
total weight of the ways to reach it; backward sampling walks from the end and draws each piece
with its share of that weight.  Draws depend on the row key and the place alone, so they are the
same on every run and in every partitioning.

No piece holds a space behind another character, so the lattice falls apart into chunks (spaces
and the word behind them).  The lattices of the distinct chunks of a slice are found and filtered
together with numpy, by place within the chunk; then every chunk draws from the lattice of its
kind.  Chunks over ``LONG`` bytes go one by one, by the same law and the same draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm import arrow

SPACE = "\u2581"
LONG = 48  # some 100 at most: sums of weights must stay in the range of doubles
#: Weights are multiplied by this per byte, which changes no share and keeps sums in range.
LIFT = math.exp(3.5)
SLICE_BYTES = 1 << 18
#: Places of distinct chunks whose lattices a task keeps, some 60 bytes each.
KEPT = 1 << 20


class Lattices:
    """The pieces of a model with their weights, found by the hash of their bytes.

    The model's BPE scores are ranks, not log probabilities; a piece of rank r weighs
    ``1 / (r c)`` (Zipf, c makes the weights sum to about 1), to the power ``smooth``.  A
    character without a piece of its own is one edge of its UTF-8 byte pieces.
    """

    def __init__(self, path: str, smooth: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        scale = math.log(size) + 0.58
        bytes_of: list[bytes] = []
        self.piece: dict[bytes, int] = {}
        self.byte_ids = np.zeros(256, np.int32)
        first = next(i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        weight = np.zeros(size)
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
                bytes_of.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                bytes_of.append(b"")
            else:
                bytes_of.append(text.replace(SPACE, " ").encode())
                self.piece[bytes_of[-1]] = i
                weight[i] = ((i - first + 1) * scale) ** -smooth * LIFT ** len(bytes_of[-1])
        self.weight = weight
        self.byte_weight = (size * scale) ** -smooth * LIFT
        if any(b" " in p.lstrip(b" ") for p in self.piece):
            raise ValueError("a piece holds a space behind another character")
        self.apart = np.zeros(256, bool)  # bytes that no piece holds, so chunks can end around them
        for c in b"\n\t\r":
            self.apart[c] = not any(c in p for p in self.piece)
        self.lengths = sorted({len(p) for p in self.piece})
        self.byte_at = np.concatenate([[0], np.cumsum([len(b) for b in bytes_of])])
        self.byte_data = np.frombuffer(b"".join(bytes_of), np.uint8)
        # Open addressing; the hash is told from byte ranges of a text in the same way.
        self.bits = 18
        self.slots, self.slot_ids = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        names = list(self.piece)
        data = np.frombuffer(b"".join(names), np.uint8)
        stop = np.cumsum([len(p) for p in names])
        hashes = self._hash(arrow.prefix_hash(data), stop - [len(p) for p in names], stop)
        self._forget()
        self.probes = 1
        for h, p in zip(hashes.tolist(), names):
            at = h >> (64 - self.bits)
            tries = 1
            while self.slot_ids[at] >= 0:
                at, tries = (at + 1) % (1 << self.bits), tries + 1
            self.slots[at], self.slot_ids[at] = h, self.piece[p]
            self.probes = max(self.probes, tries)

    @staticmethod
    def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, down = arrow.powers(len(prefix))
        x = (prefix[stop] - prefix[start]) * down[start]
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x9E3779B97F4A7C15)

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and its id."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        hit, ids = [], []
        live = np.arange(len(h))
        for _ in range(self.probes):
            same = self.slots[at] == h[live]
            own = self.slot_ids[at]
            good = same & (own >= 0)
            hit.append(live[good])
            ids.append(own[good])
            on = ~same & (own >= 0)
            live, at = live[on], (at[on] + 1) % (1 << self.bits)
            if not len(live):
                break
        return np.concatenate(hit), np.concatenate(ids)

    def _chunks(self, data: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Starts of the chunks, and the end of the data."""
        begin = np.zeros(len(data) + 1, bool)
        begin[texts] = True
        begin[1:-1] |= (data[1:] == 32) & (data[:-1] != 32)
        apart = self.apart[data]
        begin[:-1] |= apart
        begin[1:] |= apart
        begin[len(data)] = True
        return np.flatnonzero(begin)

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and the n + 1 offsets."""
        plain, offsets = arrow.raw(texts)
        full = np.flatnonzero(np.diff(offsets))
        data = np.insert(plain, offsets[:-1][full], 32)  # every text but an empty one begins with a space
        begin = offsets[:-1][full] + np.arange(len(full))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        edges = self._chunks(data, begin)
        start, size = edges[:-1], np.diff(edges)
        text = np.searchsorted(begin, start, "right") - 1
        draw = arrow.mix(keys[full][text] + (start - begin[text]).astype(np.uint64))
        n = len(data)
        where = np.flatnonzero(size <= LONG)
        kind = self._kinds(data, start[where], size[where])
        first_edge, width, lengths, ids, upto = self.known
        base = self.homes[kind]
        place, step = base + width[kind], 0
        seed, who = draw[where], np.arange(len(where))
        rounds = []
        while len(place):
            u = ((arrow.mix(seed[who] + np.uint64(2 * step + 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            # Edges that end at a place stand together; the first whose summed share reaches u is drawn.
            edge = first_edge[place]
            open_ = np.flatnonzero(upto[edge] < u)
            while len(open_):
                edge[open_] += 1
                open_ = open_[upto[edge[open_]] < u[open_]]
            taken = lengths[edge].astype(np.int64)
            rounds.append((start[where[who]] + place - base[who], taken, ids[edge]))
            place = place - taken
            on = place > base[who]
            who, place, step = who[on], place[on], step + 1
        stop = np.concatenate([r[0] for r in rounds] or [np.zeros(0, np.int64)])
        took = np.concatenate([r[1] for r in rounds] or [np.zeros(0, np.int64)])
        piece = np.concatenate([r[2] for r in rounds] or [np.zeros(0, np.int32)])
        # one slot per place: the piece that ends there, or the byte piece of the byte before it
        out = np.full(n + 1, -1, np.int32)
        normal = piece >= 0
        out[stop[normal]] = piece[normal]
        for size_ in (1, 2, 3, 4):
            own = stop[~normal & (took == size_)]
            for k in range(size_):
                out[own - k] = self.byte_ids[data[own - k - 1]]
        for i in np.flatnonzero(size > LONG):
            for at, piece_id in self._one(data[start[i] : start[i] + size[i]].tobytes(), int(draw[i])):
                out[start[i] + at] = piece_id
        slots = np.flatnonzero(out >= 0)
        ends = np.concatenate([begin[1:], [n]])  # last place of each text
        number = np.searchsorted(slots, ends, "right")
        at = np.zeros(len(offsets), np.int64)
        at[full + 1] = np.diff(np.concatenate([[0], number]))
        return out[slots], np.cumsum(at)

    def _kinds(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each chunk's lattice; those not met before are found and kept.

        Equal chunks have equal lattices, so a task keeps up to ``KEPT`` bytes of distinct chunks
        and begins anew beyond that.  What is kept changes no draw.
        """
        name, sample, kind = np.unique(arrow.span_hash(arrow.prefix_hash(data), start, start + size), return_index=True, return_inverse=True)
        if len(self.known[0]) > KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.names, name), max(0, len(self.names) - 1))
        new = self.names[at] != name if len(self.names) else np.ones(len(name), bool)
        if new.any():
            width = size[sample[new]]
            home = np.cumsum(width) - width
            own = data[np.repeat(start[sample[new]] - home, width) + np.arange(int(width.sum()))]
            first_edge, lengths, ids, upto = self._lattice(own, home, width)
            places, edges, had = len(self.known[0]), len(self.known[2]), len(self.homes)
            parts = (first_edge + edges, width, lengths.astype(np.uint8), ids.astype(np.int32), upto)
            # A place more than bytes in a chunk: that of its end.
            self.known = tuple(np.concatenate(pair) for pair in zip(self.known, parts))
            self.homes = np.concatenate([self.homes, home + np.arange(len(home)) + places])
            names, numbers = np.concatenate([self.names, name[new]]), np.concatenate([self.numbers, had + np.arange(len(home))])
            order = np.argsort(names)
            self.names, self.numbers = names[order], numbers[order]
            at = np.searchsorted(self.names, name)
        return self.numbers[at][kind]

    def _forget(self) -> None:
        none = np.zeros(0, np.int64)
        self.names, self.numbers, self.homes = np.zeros(0, np.uint64), none, none
        self.known = (none, none, np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0))

    def _lattice(self, data: np.ndarray, home: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of the chunks at ``home``: number of the first that ends at each place (a chunk has
        a place more than bytes), then length, piece (-2: single bytes) and summed share of each.

        The share is that of the edge in all ways to the place where it ends, longest edge first:
        forward filtering by place within the chunk, all chunks at once.
        """
        n = len(data)
        chunk = np.repeat(np.arange(len(home)), width)
        inside = np.arange(n) - home[chunk]
        rest = width[chunk] - inside
        prefix = arrow.prefix_hash(data)
        all_end, all_len, all_id = [], [], []
        live = np.arange(n)
        single = np.zeros(n, bool)
        lead = (data & 0xC0) != 0x80
        after = np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 1)))
        for length in self.lengths:
            live = live[rest[live] >= length]
            if not len(live):
                break
            hit, ids = self._found(self._hash(prefix, live, live + length))
            place = live[hit]
            single[place[after[place] == length]] = True
            all_end.append(place + length)
            all_len.append(np.full(len(place), length, np.int64))
            all_id.append(ids)
        none = np.flatnonzero(lead & ~single)
        wide = np.minimum(after[none], rest[none])
        all_end.append(none + wide)
        all_len.append(wide)
        all_id.append(np.full(len(none), -2, np.int32))
        end, length, ids = map(np.concatenate, (all_end, all_len, all_id))
        weight = np.where(ids >= 0, self.weight[np.maximum(ids, 0)], (self.byte_weight ** np.arange(5))[np.minimum(length, 4)])
        # By place within the chunk and length, so that no place comes twice in a group.
        group = (inside[end - 1] + 1) * 64 + np.minimum(length, 63)
        order = np.argsort(group.astype(np.uint16), kind="stable")
        end, length, ids, weight, group = end[order], length[order], ids[order], weight[order], group[order]
        reached, share = np.zeros(n + 1), np.zeros(len(end))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            back = end[a:b] - length[a:b]
            # A chunk's begin is free; its place otherwise tells of the end of the chunk before.
            if b > a:
                share[a:b] = np.where(inside[back] == 0, 1.0, reached[back]) * weight[a:b]
                reached[end[a:b]] += share[a:b]
        able = share > 0
        end, length, ids, share = end[able], length[able], ids[able], share[able]
        order = np.argsort(end * 64 + 63 - np.minimum(length, 63), kind="stable")
        end, length, ids, share = end[order], length[order], ids[order], share[order] / reached[end[order]]
        place = end + chunk[end - 1]
        first = np.searchsorted(place, np.arange(n + len(home)))
        turn = np.arange(len(end)) - first[place]
        for k in range(1, int(turn.max(initial=0)) + 1):
            at = np.flatnonzero(turn == k)
            share[at] += share[at - 1]
        share[np.append(np.flatnonzero(np.diff(place)), len(place) - 1)] = 1.0
        return first, length, ids, share

    def _edges(self, chunk: bytes, i: int, longest: int) -> list[tuple[int, int, float]]:
        """End, piece and log weight of the edges that begin at byte ``i``."""
        n = len(chunk)
        ways = [(j, p, math.log(self.weight[p])) for j in range(i + 1, min(n, i + longest) + 1) if (p := self.piece.get(chunk[i:j])) is not None]
        width = self._width(chunk, i)
        if width and all(j != i + width for j, _, _ in ways):
            ways.append((i + width, -2, width * math.log(self.byte_weight)))
        return ways

    @staticmethod
    def _width(chunk: bytes, i: int) -> int:
        """Bytes of the character that begins at byte ``i``; 0 inside a character."""
        c = chunk[i]
        return 0 if c & 0xC0 == 0x80 else min(len(chunk) - i, 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4)

    def _one(self, chunk: bytes, draw: int) -> list[tuple[int, int]]:
        """The same draws for one long chunk: (end place, piece) pairs; log weights.

        Only the sums are kept, eight bytes a byte of the chunk; the walk back finds the edges anew.
        """
        n, longest = len(chunk), self.lengths[-1]
        logs = np.full(n + 1, -np.inf)
        logs[0] = 0.0
        for i in range(n):
            if logs[i] > -np.inf:
                for j, _, w in self._edges(chunk, i, longest):
                    logs[j] = np.logaddexp(logs[j], logs[i] + w)
        out = []
        j, step = n, 0
        while j > 0:
            u = (int(arrow.mix(np.array([(draw + 2 * step + 1) % 2**64], np.uint64))[0] >> np.uint64(11)) + 0.5) / 2.0**53
            back, piece = j, 0
            for i in range(max(0, j - longest), j):
                piece_of = self.piece.get(chunk[i:j])
                if logs[i] == -np.inf or (piece_of is None and self._width(chunk, i) != j - i):
                    continue
                back, piece = i, -2 if piece_of is None else piece_of
                weight = (j - i) * math.log(self.byte_weight) if piece_of is None else math.log(self.weight[piece_of])
                u -= math.exp(logs[i] + weight - logs[j])
                if u <= 0:
                    break
            out += [(j, piece)] if piece >= 0 else [(k + 1, int(self.byte_ids[chunk[k]])) for k in range(back, j)]
            j, step = back, step + 1
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the rows' texts and their offsets; the leading space of a row goes."""
        width = self.byte_at[ids + 1] - self.byte_at[ids]
        start = np.cumsum(width) - width
        data = self.byte_data[np.repeat(self.byte_at[ids], width) + np.arange(int(width.sum())) - np.repeat(start, width)]
        bounds = np.concatenate([[0], np.cumsum(width)])[at]
        first = bounds[:-1][(np.diff(bounds) > 0)]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], bounds - np.searchsorted(first, bounds)


@lru_cache(maxsize=2)
def lattices(path: str, smooth: float) -> Lattices:
    return Lattices(path, smooth)


def encode(
    docs: DataFrame, model: str = "piece_bpe_32k.model", smooth: float = 1.0, seed: int = 7, carry: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id, pieces, n_pieces, lossless`` and the ``carry`` columns for each row of ``docs``.

    The segmentation is drawn by the row key (doc_id; null counts as 0) and ``seed``.  ``lossless``
    tells that the decoded pieces are the text's bytes.  Null and empty texts have no pieces;
    repeated rows get the same pieces; other columns are not read; an empty table gives an empty
    result.  No shuffle.  A run of over ``LONG`` bytes without a space takes some 20 bytes of memory
    for each of its bytes and is walked in plain Python.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"carried_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(public_tokenizers.path(model), smooth)
        for batch in batches:
            for part in arrow.slices(batch, "text", SLICE_BYTES):
                keys = part.column("doc_id").fill_null(0).to_numpy().astype(np.uint64)
                ids, at = own.encode(part.column("text"), arrow.mix(keys + np.uint64(seed << 32)))
                data, bounds = own.decode(ids, at)
                want, offsets = arrow.raw(part.column("text"))
                if len(bounds) == len(offsets) and np.array_equal(bounds, offsets) and np.array_equal(data, want):
                    same = np.ones(part.num_rows, bool)
                else:
                    same = np.array(
                        [bytes(data[bounds[i] : bounds[i + 1]]) == bytes(want[offsets[i] : offsets[i + 1]]) for i in range(part.num_rows)]
                    )
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(np.diff(at)), pa.array(same), *part.columns[2:]],
                    names=["doc_id", "pieces", "n_pieces", "lossless", *carry],
                )

    types = dict(docs.dtypes)
    schema = "doc_id long, pieces array<int>, n_pieces long, lossless boolean" + "".join(f", `{c}` {types[c]}" for c in carry)
    return picked.mapInArrow(arrow.freeing(run), schema)


def decode(rows: DataFrame, model: str = "piece_bpe_32k.model", ids_column: str = "pieces", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of rows of piece ids; null ids give a null text, control pieces nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(public_tokenizers.path(model), 1.0)
        for batch in batches:
            texts = []
            for x in batch.column("ids").to_pylist():
                if x is None:
                    texts.append(None)
                    continue
                data, _ = own.decode(np.array(x, np.int64), np.array([0, len(x)]))
                texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    picked = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids"))
    return picked.mapInArrow(arrow.freeing(run), "doc_id long, text string")
