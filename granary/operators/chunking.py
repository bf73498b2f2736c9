"""Splitting files into chunks.

Fixed sizes are built-in expressions. Content-defined methods find their cuts with
array code over whole files, in Arrow batches: Rabin fingerprints depend on 48 bytes,
so they are computed for all positions at once, and only the choice of cuts goes
chunk by chunk.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.config import CONTAINER_PAYLOAD, StoreConfig
from granary.functions.shipping import ship

#: Fixed values of Rabin chunking.
WINDOW, POLYNOMIAL, BREAK_MARK = 48, 0xBFE6B8A5BF378D83, 0x78
E_ROUNDED = 2.718281828
#: Bytes of a file whose fingerprints are in memory at once, and of one run of lookups.
BLOCK, LOOKUPS = 1 << 22, 1 << 15


def fixed_chunks(stream: DataFrame, size: int = 4096) -> DataFrame:
    """One row for each `size` bytes of `data`: chunk_no, size and the bytes. Files
    without bytes have no chunk."""
    n = F.length("data")
    pieces = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    return (
        stream.withColumn("chunk_no", F.explode(pieces))
        .withColumn("size", F.least(F.lit(size), n - F.col("chunk_no") * size).cast("int"))
        .withColumn("data", F.substring("data", F.col("chunk_no") * size + 1, F.lit(size)))
        .withColumn("chunk_no", F.col("chunk_no").cast("bigint"))
    )


def file_chunks(stream: DataFrame) -> DataFrame:
    """Whole files, cut only where a container would overflow."""
    return fixed_chunks(stream, CONTAINER_PAYLOAD)


def floor_power_of_two(n: int) -> int:
    return 1 << (n.bit_length() - 1)


# --- Rabin ----------------------------------------------------------------------


def _mod(value: int, poly: int) -> int:
    """Remainder of polynomials over GF(2)."""
    degree = poly.bit_length()
    while value.bit_length() >= degree:
        value ^= poly << (value.bit_length() - degree)
    return value


@cache
def rabin_tables() -> np.ndarray:
    """[k, b]: what byte b adds to the fingerprint k steps after it came in."""
    out = np.zeros((WINDOW, 256), np.uint64)
    for k in range(WINDOW):
        bits = [_mod(1 << (8 * k + j), POLYNOMIAL) for j in range(8)]
        for b in range(256):
            total = 0
            for j in range(8):
                if b >> j & 1:
                    total ^= bits[j]
            out[k, b] = total
    return out


@cache
def _pair_tables(bits: int) -> list[np.ndarray]:
    """For every second step back the low bits that a pair of bytes adds."""
    tables, pair = rabin_tables(), np.arange(1 << 16)
    kind = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
    return [(tables[k + 1][pair >> 8] ^ tables[k][pair & 255]).astype(kind) for k in range(0, WINDOW, 2)]


def rabin_fingerprints(data: np.ndarray, bits: int = 64) -> np.ndarray:
    """The fingerprint of the 48 bytes that end at each position (of fewer at the start); its
    low bits, `bits` of them or more."""
    tables = _pair_tables(bits)
    out, held = np.empty(len(data), tables[0].dtype), np.empty(LOOKUPS + WINDOW, tables[0].dtype)
    for at in range(0, len(data), LOOKUPS):
        lo = max(0, at - WINDOW + 1)
        pairs = data[lo : at + LOOKUPS].astype(np.intp)
        pairs[1:] |= pairs[:-1] << 8  # the right side is evaluated first
        part = tables[0].take(pairs)
        for j in range(1, min(WINDOW // 2, (len(pairs) + 1) // 2)):
            added = held[: len(pairs) - 2 * j]
            tables[j].take(pairs[: -2 * j], out=added, mode="clip")
            part[2 * j :] ^= added
        out[at : at + LOOKUPS] = part[at - lo :]
    return out


class _Rabin:
    """Cut points of one file under the Rabin methods. Each chunk begins with an empty
    window, filled from its byte min - 1 on."""

    def __init__(self, data: np.ndarray, least: int, most: int):
        self.data, self.least, self.most = data, least, most

    def hits(self, masks: dict[str, int]) -> dict[str, np.ndarray]:
        """Positions at which the fingerprint of the last 48 bytes has the mark under each
        mask; found block by block, so that memory does not follow the file."""
        found: dict[str, list] = {name: [] for name in masks}
        bits = max(masks.values()).bit_length()
        for at in range(0, len(self.data), BLOCK):
            before = min(at, WINDOW - 1)
            full = rabin_fingerprints(self.data[at - before : at + BLOCK], bits)[before:]
            for name, mask in masks.items():
                found[name].append(np.flatnonzero((full & full.dtype.type(mask)) == BREAK_MARK) + at)
        return {name: np.concatenate(parts) for name, parts in found.items()}

    def early(self, start: int, end: int) -> np.ndarray:
        """Fingerprints while the window fills: after byte start + least - 1, and on."""
        first = start + self.least - 1
        stop = min(first + WINDOW - 1, end)
        if stop <= first:
            return np.empty(0, np.uint64)
        return rabin_fingerprints(self.data[first:stop])

    def next(self, start: int, end: int, low: int, mask: int, hits: np.ndarray) -> int | None:
        """The least length i in [low, end - start) at which (fingerprint & mask) is the
        mark, the fingerprint being that of bytes up to start + i - 1."""
        limit = end - start
        early = self.early(start, end)
        for j in np.flatnonzero((early & np.uint64(mask)) == BREAK_MARK):
            if low <= self.least + j < limit:
                return int(self.least + j)
        at = max(start + self.least + WINDOW - 2, start + low - 1)
        k = np.searchsorted(hits, at)
        if k < len(hits) and hits[k] + 1 - start < limit:
            return int(hits[k] + 1 - start)
        return None


def _rabin(r: _Rabin, start: int, end: int, avg: int, hits: dict) -> int:
    found = r.next(start, end, r.least, avg - 1, hits["main"])
    return end - start if found is None else found


def _normalized(r: _Rabin, start: int, end: int, avg: int, hits: dict) -> int:
    found = r.next(start, end, r.least, 2 * avg - 1, hits["small"])
    if found is not None and found < avg:
        return found
    found = r.next(start, end, max(avg, r.least), avg // 2 - 1, hits["large"])
    return end - start if found is None else found


def _tttd(r: _Rabin, start: int, end: int, avg: int, hits: dict) -> int:
    """A hit of the main mask, else the last hit of the wider one, else the end."""
    found = r.next(start, end, r.least, avg - 1, hits["main"])
    if found is not None:
        return found
    limit, back = end - start, None
    early = r.early(start, end)
    for j in np.flatnonzero((early & np.uint64(avg // 2 - 1)) == BREAK_MARK):
        if r.least + j < limit:
            back = int(r.least + j)
    lo = np.searchsorted(hits["large"], start + r.least + WINDOW - 2)
    hi = np.searchsorted(hits["large"], end - 1)
    if hi > lo:
        back = int(hits["large"][hi - 1] + 1 - start)
    return limit if back is None else back


def _keys(data: np.ndarray, first: int, end: int) -> np.ndarray:
    """The 8 bytes from each position in [first, end), as big-endian numbers."""
    part = data[first : end + 7].astype(np.uint64)
    out = np.zeros(end - first, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | part[k : k + end - first]
    return out


def _ae_cut(data: np.ndarray, start: int, n: int, window: int, most: int) -> int:
    """Asymmetric extremum: the chunk ends `window` bytes after the last byte whose
    following 8 bytes, as a number, are at most all before in the chunk."""
    left = n - start
    if left <= window + 8:
        return left
    last = left - 8
    low, at = _keys(data, start, start + 1)[0], 0
    pos = 0
    while True:  # blocks of positions, until a gap of `window` without a new least key
        lo, hi = pos + 1, min(last, pos + 4 * window + most)
        if lo > hi:
            return left
        part = _keys(data, start + lo, start + hi + 1)
        least = np.minimum.accumulate(np.minimum(part, low))
        before = np.concatenate(([low], least[:-1]))
        new = np.flatnonzero(part <= before) + lo
        marks = np.concatenate(([at], new, [hi + window + 1]))
        gaps = np.flatnonzero(np.diff(marks) > window)
        for g in gaps:
            cut = int(marks[g]) + window
            if cut > hi:
                break
            if most < cut and most >= lo and most not in new:
                return most
            return cut
        if lo <= most <= hi and most not in new:
            return most
        at, low, pos = int(marks[-2]), least[-1], hi
        if hi == last:
            return left


def cut_points(data: bytes, algorithm: str, avg: int, least: int, most: int) -> list[int]:
    """Ends of the chunks of a file."""
    n = len(data)
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)
    if algorithm in ("fixed", "file"):
        step = CONTAINER_PAYLOAD if algorithm == "file" else avg
        return [*range(step, n, step), n]
    out, start = [], 0
    if algorithm == "ae":
        window = int(avg / (E_ROUNDED - 1))
        while start < n:
            start += _ae_cut(raw, start, n, window, most)
            out.append(start)
        return out
    avg = floor_power_of_two(avg)
    method = {"rabin": _rabin, "normalized rabin": _normalized, "tttd": _tttd}[algorithm]
    r = _Rabin(raw, least, most)
    needed = {"rabin": ("main",), "normalized rabin": ("small", "large"), "tttd": ("main", "large")}[algorithm]
    masks = {"main": avg - 1, "small": 2 * avg - 1, "large": avg // 2 - 1}
    hits = r.hits({name: masks[name] for name in needed})
    while start < n:
        if n - start <= least:
            start = n
        else:
            start += method(r, start, min(n, start + most), avg, hits)
        out.append(start)
    return out


def content_chunks(stream: DataFrame, config: StoreConfig, with_data: bool = False) -> DataFrame:
    """The columns of `stream` with data replaced by chunk_no, size and fp (SHA-1 in
    hex), and, with_data, the chunk's bytes."""
    ship(stream.sparkSession)
    carried = [c for c in stream.columns if c != "data"]
    empty = stream.select(*carried).withColumn("chunk_no", F.lit(None).cast("bigint")).withColumn("size", F.lit(None).cast("int")).withColumn("fp", F.lit(None).cast("string"))
    schema = (empty.withColumn("data", F.lit(None).cast("binary")) if with_data else empty).schema
    algorithm, avg, least, most = config.chunk_algorithm, config.chunk_avg_size, config.chunk_min_size, config.chunk_max_size

    def run(batches):
        for batch in batches:
            rows, numbers, sizes, fps, parts = [], [], [], [], []
            for row, data in enumerate(batch.column(batch.schema.get_field_index("data"))):
                raw = data.as_py() or b""
                start = 0
                for number, end in enumerate(cut_points(raw, algorithm, avg, least, most)):
                    piece = raw[start:end]
                    rows.append(row)
                    numbers.append(number)
                    sizes.append(end - start)
                    fps.append(hashlib.sha1(piece).hexdigest().upper())
                    if with_data:
                        parts.append(piece)
                    start = end
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in carried]
            columns = [*kept, pa.array(numbers, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.string())]
            names = [*carried, "chunk_no", "size", "fp"]
            if with_data:
                columns.append(pa.array(parts, pa.binary()))
                names.append("data")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return stream.mapInArrow(run, schema)
