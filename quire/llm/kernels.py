"""Vectorised text kernels on Arrow buffers: words, word hashes, shingle hashes.

Everything runs on slices of a bounded number of bytes, so temporary arrays stay small whatever the
batch holds; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 20
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of more bytes are hashed one by one.
LANE_BYTES = 64
_LANE_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for b in (_BASE, _UNBASE):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a))
        if size > 8 * SLICE_BYTES:
            return made[0][:n], made[1][:n]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    """The words of the texts of one slice."""

    data: np.ndarray  #: bytes of the texts, one after the other
    texts: np.ndarray  #: where each text starts in data, and the end
    start: np.ndarray  #: where each word starts in data
    end: np.ndarray
    of: np.ndarray  #: index of each text's first word, and the number of words

    def __len__(self) -> int:
        return len(self.texts) - 1


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _IS_SPACE) -> Words:
    """Words are the runs of bytes that aren't breaks (a flag for each byte; white space by default); no word crosses
    from text to text."""
    if lower:
        data = _LOWER[data]
    word = ~breaks[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = word[edge]
    edge = edge[edge > 0]
    last[edge - 1] = word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Eight bytes are mixed in at a time, in as many steps as the longest word has lanes; words beyond LANE_BYTES go
    through xxh3. Words of up to eight bytes and equal length never collide. Two seeds give independent hashes.
    """
    n = w.end - w.start
    h = mix(n.astype(np.uint64) + np.uint64(xxh3_64_intdigest(seed.to_bytes(8, "little"))))
    padded = np.concatenate([w.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(w.data) + 1, "<u8", padded, strides=(1,))
    for k in range(0, LANE_BYTES, 8):
        left = np.flatnonzero(n > k) if k else np.arange(len(n))
        if not len(left):
            break
        h[left] = mix(h[left] ^ (lanes[w.start[left] + k] & _LANE_MASK[np.minimum(n[left] - k, 8)]))
    for i in np.flatnonzero(n > LANE_BYTES):
        h[i] = xxh3_64_intdigest(w.data[w.start[i] : w.end[i]].tobytes(), seed)
    return h


def shingles(w: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words of each text, and the index of each text's first.

    A text with fewer words, but some, has one shingle: all of them.
    """
    n = np.diff(w.of)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    of = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(of[-1]) - np.repeat(of[:-1], count) + np.repeat(w.of[:-1], count)
    long = np.repeat(n >= width, count)
    out = np.zeros(of[-1], np.uint64)
    full = at[long]
    value = np.zeros(len(full), np.uint64)
    for k in range(width):
        value = value * np.uint64(_BASE) + h[full + k]
    out[long] = mix(value)
    for i in np.flatnonzero((n > 0) & (n < width)):
        v = int(n[i])
        for x in h[w.of[i] : w.of[i + 1]]:
            v = (v * _UNBASE + int(x)) % (1 << 64)
        out[of[i]] = mix(np.array([v], np.uint64))[0]
    return out, of


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width items of h that start at each place where one fits."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = _power(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    n = len(h) - width + 1
    return mix((sums[width:] - sums[:-width]) * down[:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width items, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    return v
