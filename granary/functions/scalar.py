"""Scalar functions over columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.config import FEATURES_PER_RECIPE
from granary.functions.shipping import ship

TWO_64 = 1 << 64


def sha1_fp(data: Column) -> Column:
    """SHA-1 of bytes, as 40 upper-case hex digits."""
    return F.upper(F.sha1(data))


def sha256_fp(data: Column) -> Column:
    return F.upper(F.sha2(data, 256))


def to_hex(fp: Column) -> Column:
    """Bytes to upper-case hex."""
    return F.hex(fp)


def from_hex(text: Column) -> Column:
    """Hex of either case to bytes."""
    return F.unhex(text)


def is_zero_chunk(data: Column) -> Column:
    """Whether a chunk is all zero bytes."""
    return (F.length(data) > 0) & (F.length(F.replace(F.hex(data), F.lit("00"), F.lit(""))) == 0)


def truncated_key(fp_hex: Column, key_bytes: int) -> Column:
    """The first bytes of a fingerprint in hex; what an index with short keys compares."""
    return F.substring(fp_hex, 1, 2 * key_bytes)


def residue(fp_hex: Column, n: int) -> Column:
    """The little-endian 32-bit number at byte 16 of a fingerprint, modulo n. It is read
    as signed; only whether the result is 0 matters. A fingerprint of fewer than 20
    bytes counts as padded with zero bytes."""
    part = F.rpad(F.substring(F.rpad(fp_hex, 40, "0"), 33, 8), 8, "0")
    byte = lambda k: F.conv(F.substring(part, 2 * k + 1, 2), 16, 10).cast("bigint")
    value = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
    return signed % n


def lane_constants(lanes: int = FEATURES_PER_RECIPE) -> list[tuple[int, int]]:
    """Odd multipliers and offsets of 64 bits for MinHash lanes, from a fixed seed."""
    got = np.random.default_rng(20240229).integers(0, 1 << 63, (lanes, 2), dtype=np.uint64)
    return [(int(a) * 2 + 1, int(b) * 2 + 1) for a, b in got]


def lane(x: Column, k: int) -> Column:
    """x * a + b modulo 2**64, unsigned, as DECIMAL(20, 0). x is below 2**56."""
    a, b = lane_constants()[k]
    wide = x.cast("decimal(18,0)") * F.lit(str(a)).cast("decimal(20,0)") + F.lit(str(b)).cast("decimal(20,0)")
    return F.pmod(wide, F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def fp_prefix(fp_hex: Column) -> Column:
    """The first 8 bytes of a fingerprint as a signed little-endian number."""
    pairs = [F.substring(fp_hex, 2 * k + 1, 2) for k in range(7, -1, -1)]
    low = F.conv(F.concat(*pairs[1:]), 16, 10).cast("bigint")
    high = F.conv(pairs[0], 16, 10).cast("int")
    return F.shiftleft(F.when(high >= 128, high - 256).otherwise(high).cast("bigint"), 56).bitwiseOR(low)


def container_overflow(used: Column, entries: Column, size: Column, most_entries: int, payload: int) -> Column:
    """Whether a chunk does not fit into a container with so many bytes and entries."""
    return (used + size > payload) | (entries >= most_entries)


def simulated_fp(old_fp: Column) -> Column:
    """The new fingerprint where hashing is only simulated: the old one."""
    return old_fp


def utilization(size: Column, payload: int) -> Column:
    return size / F.lit(float(payload))


def segment_key(version: Column, offset: Column, size: Column) -> Column:
    """16 bits of version, 32 of offset, 16 of size."""
    return F.shiftleft(version.cast("bigint"), 48).bitwiseOR(F.shiftleft(offset.cast("bigint"), 16)).bitwiseOR(size.cast("bigint"))


def segment_parts(key: Column) -> Column:
    mask = lambda bits: F.lit((1 << bits) - 1).cast("bigint")
    return F.struct(
        F.shiftrightunsigned(key, 48).cast("int").alias("version"),
        F.shiftrightunsigned(key, 16).bitwiseAND(mask(32)).alias("offset"),
        key.bitwiseAND(mask(16)).cast("int").alias("size"),
    )


def restore_cache_bytes(stored: Column, ratio_percent: float) -> Column:
    """Cache size of the evaluation: a quarter percent of the stored bytes, scaled."""
    return (stored * 0.0025 * ratio_percent / 100).cast("bigint")


# --- Bloom filter ---------------------------------------------------------------
# Seven classic string hashes on 32 bits, of which four are used.


def _rs(data: bytes) -> int:
    a, h = 63689, 0
    for b in data:
        h = (h * a + b) & 0xFFFFFFFF
        a = a * 378551 & 0xFFFFFFFF
    return h


def _js(data: bytes) -> int:
    h = 1315423911
    for b in data:
        h ^= (h << 5) + b + (h >> 2)
        h &= 0xFFFFFFFF
    return h


def _pjw(data: bytes) -> int:
    h = 0
    for b in data:
        h = ((h << 4) + b) & 0xFFFFFFFF
        if high := h & 0xF0000000:
            h = (h ^ (high >> 24)) & 0x0FFFFFFF
    return h


def _times(factor: int, start: int):
    def run(data: bytes) -> int:
        h = start
        for b in data:
            h = (h * factor + b) & 0xFFFFFFFF
        return h

    return run


def _fnv(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * 0x811C9DC5 & 0xFFFFFFFF) ^ b
    return h


def _dek(data: bytes) -> int:
    h = len(data)
    for b in data:
        h = (((h << 5) | (h >> 27)) ^ b) & 0xFFFFFFFF
    return h


STRING_HASHES = {"rs": _rs, "djb": _times(33, 5381), "fnv": _fnv, "js": _js, "pjw": _pjw, "sdbm": _times(65599, 0), "dek": _dek}


def _hash_all(names: tuple[str, ...], data: np.ndarray) -> list[np.ndarray]:
    """STRING_HASHES of the rows of a matrix of bytes, which are of one length."""
    out = []
    for name in names:
        h = np.full(len(data), {"djb": 5381, "js": 1315423911, "dek": data.shape[1]}.get(name, 0), np.uint32)
        a = 63689
        for b in data.T.astype(np.uint32):
            if name == "rs":
                h, a = h * np.uint32(a) + b, a * 378551 & 0xFFFFFFFF
            elif name in ("djb", "sdbm"):
                h = h * np.uint32(33 if name == "djb" else 65599) + b
            elif name == "fnv":
                h = h * np.uint32(0x811C9DC5) ^ b
            elif name == "js":
                h = h ^ ((h << np.uint32(5)) + b + (h >> np.uint32(2)))
            elif name == "pjw":
                h = (h << np.uint32(4)) + b
                h = (h ^ ((h & np.uint32(0xF0000000)) >> np.uint32(24))) & np.uint32(0x0FFFFFFF)
            elif name == "dek":
                h = (h << np.uint32(5) | h >> np.uint32(27)) ^ b
            else:
                raise ValueError(f"no string hash {name}")
        out.append(h)
    return out


def string_hashes(names: tuple[str, ...], data_hex: Column) -> Column:
    """A struct of bigints: STRING_HASHES of bytes given in hex, by arrays of whole batches.
    Null is null."""

    def run(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(names), len(texts)), np.int64)
        known = texts.notna().to_numpy()
        lengths = np.where(known, texts.str.len().fillna(0), -1).astype(np.int64)
        for n in np.unique(lengths[known]):
            at = np.flatnonzero(lengths == n)
            raw = np.frombuffer(bytes.fromhex("".join(t[: n - n % 2] for t in texts.iloc[at])), np.uint8).reshape(len(at), int(n) // 2)
            out[:, at] = _hash_all(names, raw)
        return pd.DataFrame({name: pd.Series(column, dtype="Int64").where(known) for name, column in zip(names, out, strict=True)})

    return F.pandas_udf(run, ", ".join(f"{name} long" for name in names))(data_hex)


def bloom_words(keys_hex: Column, rows, bits: int = 1 << 20, hashes: tuple[str, ...] = ("rs", "djb", "fnv", "js")):
    """(word, mask): the bit set of a Bloom filter over `rows`, as the words that are not 0;
    bits / 64 rows at most, whatever the number of keys."""
    ship(rows.sparkSession)
    found = rows.select(string_hashes(hashes, keys_hex).alias("h"))
    at = F.explode(F.array(*[F.pmod(F.col(f"h.{h}"), F.lit(bits)).cast("int") for h in hashes])).alias("at")
    each = found.select(at).where("at IS NOT NULL").select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("mask"))
    return each.groupBy("word").agg(F.bit_or("mask").alias("mask"))


class BloomFilter:
    """A bit set under several string hashes for short lists of keys on the driver; tables
    have bloom_words(), and joins use Spark's own runtime filters."""

    def __init__(self, bits: int = 1 << 20, hashes: tuple[str, ...] = ("rs", "djb", "fnv", "js")):
        self.bits, self.hashes = bits, [STRING_HASHES[h] for h in hashes]
        self.field = np.zeros((bits + 7) // 8, np.uint8)

    def add(self, key: bytes) -> None:
        for h in self.hashes:
            at = h(key) % self.bits
            self.field[at >> 3] |= 1 << (at & 7)

    def __contains__(self, key: bytes) -> bool:
        return all(self.field[(at := h(key) % self.bits) >> 3] >> (at & 7) & 1 for h in self.hashes)
