"""Array helpers for work on text columns inside tasks.

Texts arrive as Arrow record batches.  Everything here works on the UTF-8 bytes of one slice of a
batch with numpy, so memory is bounded by ``SLICE_BYTES`` or by the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


#: A fixed 64-bit value per byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits

    def table(base: int) -> np.ndarray:
        steps = np.full(n, np.uint64(base))
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return table(_BASE), table(_BASE_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2^64, and of its inverse."""
    return tuple(t[:n] for t in _powers(max(21, int(max(1, n) - 1).bit_length())))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the sum of value(byte) * base^position over bytes i..j-1."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever the bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, which at its end gives freed memory back to the system.

    Spark keeps Python workers for the next task; what they hold while other stages run is missing
    there.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return wrapped


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``most`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte ranges, text of each, hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | first[:n]))
        self.end = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words of text i: bounds[i]..bounds[i+1]
        self.count = np.diff(self.bounds)

    @property
    def text(self) -> np.ndarray:
        """Number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` word hashes (runs may cross texts; the caller masks them)."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = mix(out + words[j : j + n] * np.uint64(2 * j + 1) + np.uint64(j + 1))
    return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each range offsets[i]..offsets[i+1]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
