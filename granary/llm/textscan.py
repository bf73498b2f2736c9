"""Array code over whole Arrow batches of text: bytes, words and their hashes.

A word's hash comes from running sums: with v[i] = mix[byte] * B**i modulo 2**64,
the sum over a word times B**-start does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in blocks of about so many bytes, to bound memory; a longer
#: text is a block of its own.
BLOCK = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words made of ASCII letters, digits and all that lies beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _mix(seed: int, lower: bool) -> np.ndarray:
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[LOWER] if lower else table


_powers: dict[str, np.ndarray] = {}


def _pow(n: int, inverse: bool) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK + (1 << 16))
        steps = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * BLOCK:
            _powers[key] = have
    return have[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective finish, so that all bits of a hash are usable."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        end = min(n, max(end, row + 1))
        lo = offsets[row]
        yield row, end, raw[lo : offsets[end]], offsets[row : end + 1] - lo
        row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each row, the first of its spans, of runs of True that
    do not cross rows. The third has one entry more than there are rows."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1], out=first[1:])
    cuts = offsets[:-1][offsets[:-1] < n]
    first[cuts] = True
    edges = np.flatnonzero(first)
    kind = inside[edges]
    ends = np.append(edges[1:], n)
    starts, ends = edges[kind], ends[kind]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the bytes of each span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_mix(seed, lower)[data] * _pow(len(data), False), out=sums[1:])
    return scramble((sums[ends] - sums[starts]) * _pow(len(data) + 1, True)[starts] + (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive offsets (int64 or float64)."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


class Index:
    """Positions in a sorted array of hashes: as hashes are spread evenly, their leading
    bits tell where to begin, and few steps are left."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, min(22, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        ends = np.append(self.start[1:], len(keys))
        self.steps = int((ends - self.start).max(initial=0))
        self.size = len(keys)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its position (if it is not, some position up to
        the size)."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        short = np.flatnonzero(self.keys[at] < wanted)
        for _ in range(self.steps):
            if not len(short):
                break
            at[short] += 1
            short = short[self.keys[at[short]] < wanted[short]]
        return (self.keys[at] == wanted) & (at < self.size), at
