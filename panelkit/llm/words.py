"""Words and word hashes of text batches in numpy, for use inside tasks.

A batch is one UTF-8 byte buffer plus document offsets.  Words are maximal
runs of bytes other than space and \\t \\n \\v \\f \\r.  A word's hash is a
polynomial over its bytes (mod 2**64, bytes mapped through a random table)
taken from one running sum, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U64 = np.uint64
_BLOCK = 1 << 21
_rng = np.random.default_rng(20240607)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _BLOCK + 1024)
        table = np.full(size, _U64(base), np.uint64)
        table[0] = 1
        _powers[base] = have = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads the polynomial's weak low bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


class Batch:
    """Texts of some documents: ``data`` bytes, ``offsets`` per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, texts: pa.Array) -> Batch:
        """From an Arrow string or binary column; null is empty."""
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        if len(texts) == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(raw[offsets[0]:offsets[-1]], offsets - offsets[0])

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """starts, ends (byte positions) of all words, and bounds: document d
        owns words bounds[d]:bounds[d + 1]."""
        data = self.data
        held = ~_SPACE[data]
        n = len(held)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        first = held.copy()
        first[1:] &= ~held[:-1]
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first[inner] = held[inner]           # a document starts a new word
        last = held.copy()
        last[:-1] &= ~held[1:]
        last[inner - 1] = held[inner - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of every word."""
        out = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            lo = starts[k]
            stop = max(k + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
            raw = self.data[lo:ends[stop - 1]]
            if lower:
                raw = _LOWER[raw]
            sums = np.empty(len(raw) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[raw] * _power_table(_BASE, len(raw))[:len(raw)], out=sums[1:])
            s, e = starts[k:stop] - lo, ends[k:stop] - lo
            out[k:stop] = (sums[e] - sums[s]) * _power_table(_BASE_INV, len(raw))[s] \
                + (e - s).astype(np.uint64)
            k = stop
        return mix(out)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words (runs across document
    bounds included: mask them with :func:`gram_mask`)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:n] * _GRAM[0]
    for k in range(1, width):
        acc += words[k:k + n] * _GRAM[k]
    return mix(acc)


def gram_mask(bounds: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """True where a run of ``width`` words stays in one document."""
    n = max(0, n_words - width + 1)
    ok = np.ones(n, bool)
    for k in range(1, width):
        cut = bounds[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def owner(bounds: np.ndarray) -> np.ndarray:
    """Document number of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``size`` bytes of text; one
    document is never cut."""
    for batch in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lens)
        at = 0
        while at < len(lens):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def gathered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches merged or cut to about ``size`` bytes of text each."""
    held, n = [], 0
    for part in slices(batches, column, size):
        length = pa.compute.sum(pa.compute.binary_length(part.column(column))).as_py() or 0
        if held and n + length > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
        if part.num_rows:
            held.append(part)
            n += length
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
