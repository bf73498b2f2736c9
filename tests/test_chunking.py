"""Content-defined chunking against byte-by-byte versions."""

import random

import pytest

from granary.config import CONTAINER_PAYLOAD, StoreConfig
from granary.operators import chunking

AVG, LEAST, MOST = 256, 64, 1024


def slow_fingerprint(window):
    """The remainder of the window's polynomial, by long division."""
    value = int.from_bytes(bytes(window), "big")
    p, degree = chunking.POLYNOMIAL, chunking.POLYNOMIAL.bit_length()
    while value.bit_length() >= degree:
        value ^= p << (value.bit_length() - degree)
    return value


def slow_rabin(data, kind):
    out, start = [], 0
    while start < len(data):
        n = len(data) - start
        if n <= LEAST:
            out.append(len(data))
            break
        end, i, backup, cut = min(n, MOST), LEAST, 0, None
        seen = []
        while i < end:
            seen.append(data[start + i - 1])
            f = slow_fingerprint(seen[-48:])
            if kind == "rabin" and f & (AVG - 1) == 0x78:
                break
            if kind == "normalized rabin" and f & ((2 * AVG - 1) if i < AVG else (AVG // 2 - 1)) == 0x78:
                break
            if kind == "tttd" and f & (AVG // 2 - 1) == 0x78:
                if f & (AVG - 1) == 0x78:
                    cut = i
                    break
                backup = i
            i += 1
        if kind == "tttd":
            i = cut if cut is not None else (backup or i)
        start += i
        out.append(start)
    return out


def slow_ae(data, avg=AVG, most=MOST):
    window, out, start = int(avg / 1.718281828), [], 0
    key = lambda at: int.from_bytes(data[at : at + 8], "big")
    while start < len(data):
        n = len(data) - start
        size = n
        if n > window + 8:
            best = 0
            for i in range(1, n - 8 + 1):
                if key(start + i) <= key(start + best):
                    best = i
                elif i == best + window or i == most:
                    size = i
                    break
        start += size
        out.append(start)
    return out


def samples():
    r = random.Random(5)
    yield b""
    yield b"x"
    for n in (LEAST, LEAST + 1, MOST, MOST + 1, 5000):
        yield r.randbytes(n)
    yield bytes(3000)
    yield b"\xff" * 3000
    yield bytes(r.choice(b"ab ") for _ in range(6000))


@pytest.mark.parametrize("kind", ["rabin", "normalized rabin", "tttd"])
def test_rabin_methods(kind):
    for data in samples():
        assert chunking.cut_points(data, kind, AVG, LEAST, MOST) == slow_rabin(data, kind)


def test_blocks_do_not_show(monkeypatch):
    data = random.Random(8).randbytes(30_000)
    whole = chunking.cut_points(data, "rabin", AVG, LEAST, MOST)
    monkeypatch.setattr(chunking, "BLOCK", 1000)
    assert chunking.cut_points(data, "rabin", AVG, LEAST, MOST) == whole


def test_ae():
    for data in samples():
        assert chunking.cut_points(data, "ae", AVG, LEAST, MOST) == slow_ae(data)
    rising = bytes(range(256)) * 8
    assert chunking.cut_points(rising, "ae", 64, 16, 128) == slow_ae(rising, 64, 128)
    falling = bytes(reversed(range(256))) * 4
    assert chunking.cut_points(falling, "ae", 64, 16, 128) == slow_ae(falling, 64, 128)


def test_an_inserted_byte_shifts_little():
    data = random.Random(1).randbytes(200_000)
    moved = data[:1000] + b"!" + data[1000:]

    def pieces(x):
        ends = [0, *chunking.cut_points(x, "rabin", 1024, 256, 8192)]
        return {x[a:b] for a, b in zip(ends, ends[1:], strict=False)}

    a, b = pieces(data), pieces(moved)
    assert len(a & b) > 0.9 * len(a)


def test_chunks_join_up(spark):
    data = [(0, b""), (1, b"abc"), (2, random.Random(2).randbytes(9000))]
    files = spark.createDataFrame(data, "file_id long, data binary")
    for algorithm in ("rabin", "normalized rabin", "tttd", "ae", "fixed", "file"):
        config = StoreConfig(chunk_algorithm=algorithm, chunk_avg_size=AVG, chunk_min_size=LEAST, chunk_max_size=MOST)
        found = chunking.content_chunks(files, config, with_data=True).orderBy("file_id", "chunk_no").collect()
        for file_id, whole in data:
            assert b"".join(bytes(r.data) for r in found if r.file_id == file_id) == whole
    fixed = chunking.fixed_chunks(files, 4096).orderBy("file_id", "chunk_no").collect()
    assert [(r.file_id, r.chunk_no, r["size"]) for r in fixed] == [(1, 0, 3), (2, 0, 4096), (2, 1, 4096), (2, 2, 808)]
    assert CONTAINER_PAYLOAD == 4_161_536
