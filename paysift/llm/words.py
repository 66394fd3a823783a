"""Word hashing over Arrow string columns, shared by the operators that work on word windows.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); ``A-Z`` is
folded to lower case. All words of a batch are hashed at once: a word's 64-bit hash is a
polynomial over a random byte table, taken from prefix sums modulo 2**64 and finally mixed.
A batch is walked in chunks of about ``CHUNK`` bytes that end on a word boundary, so memory
is bounded for very long texts too (one chunk holds at least one word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
PART = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_TABLE[ord("A"):ord("Z") + 1] = _TABLE[ord("a"):ord("z") + 1]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 16 * CHUNK:
            _powers[base] = have
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows in them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def parts(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``PART`` bytes of the named string columns, so that what a
    task holds beside the batch is bounded (a slice holds at least one row)."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    group = np.cumsum(sizes) // PART
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows in order, and each row's offsets into them."""
    raw, off = utf8(texts)
    n = len(raw)
    hashes, starts, at = [], [], 0
    while at < n:
        to = min(n, at + CHUNK)
        if to < n:
            to = _cut(raw, off, at, to)
        h, s = _chunk(raw[at:to], off, at)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    begin = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(begin, off)


def _cut(raw: np.ndarray, off: np.ndarray, at: int, to: int) -> int:
    """The last place in (at, to] where no word is cut; beyond ``to`` only for a longer word."""
    row = int(off[np.searchsorted(off, to, side="right") - 1])
    space = np.flatnonzero(_SPACE[raw[at:to]])
    best = max(row, at + int(space[-1]) + 1 if len(space) else 0)
    if best > at:
        return best
    end = int(off[np.searchsorted(off, to, side="left")])
    while to < end:
        hit = np.flatnonzero(_SPACE[raw[to:min(end, to + CHUNK)]])
        if len(hit):
            return to + int(hit[0]) + 1
        to = min(end, to + CHUNK)
    return end


def _chunk(raw: np.ndarray, off: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    space = _SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    inside = off[(off >= at) & (off <= at + n)] - at
    edge[inside] = True
    edge[0] = edge[n] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[raw] * _power(_BASE, n), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_INVERSE, n)[begin]), begin
