"""Word and shingle hashes of Arrow text batches, vectorised with numpy.

A batch is cut into slices of about ``SLICE_BYTES`` so that the working arrays
stay small; only a single longer text makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1          # odd, so it has an inverse modulo 2**64
_P_INVERSE = pow(_P, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32                   # A-Z only
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and reused between slices."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                a = np.full(n, base, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into the bytes); null texts are empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row, n = 0, len(texts)
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each row): words never cross a row's end."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers,
                lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, the same for the same bytes anywhere."""
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    codes = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    np.cumsum(codes * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, shingles before each row).

    A row with fewer words than ``width`` gives one shingle of all its words, a
    row without words none.
    """
    n = np.diff(before)
    padded = np.concatenate([hashes, np.zeros(width, dtype=np.uint64)])
    whole = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(width):
        whole += padded[k:k + len(hashes)] * np.uint64(pow(_P, k + 1, 1 << 64))
    # in a row, the last width-1 positions start no full window
    row = np.repeat(np.arange(len(n)), n)
    left = before[1:][row] - np.arange(len(hashes))
    out, at = mix(whole), left >= width
    short = np.flatnonzero((n > 0) & (n < width))
    for r in short:
        i, m = int(before[r]), int(n[r])
        one = hashes[i:i + m] * np.array([pow(_P, k + 1, 1 << 64) for k in range(m)], dtype=np.uint64)
        out[i] = mix(np.array([one.sum(dtype=np.uint64) + np.uint64(m)], dtype=np.uint64))[0]
        at[i] = True
    counts = np.maximum(n - width + 1, (n > 0).astype(n.dtype))
    return out[at], np.concatenate([[0], np.cumsum(counts)])
