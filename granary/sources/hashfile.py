"""Snapshot hash files: binary traces of file headers and chunk hashes.

Little-endian, packed. A header names the version (1 to 7), the chunking and hashing
methods and the size of a hash; then, for each file, a header, its path, from version 4
on the target of a symbolic link, and its chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.shipping import ship

#: Fixed values of the format.
MAGIC, PATH_BYTES, ID_BYTES = 0xDEADDEAD, 4096, 4096
FIXED, VARIABLE = 1, 2
CHUNKING = {1: "fixed", 2: "variable"}
HASHING = {1: "md5", 2: "sha256", 3: "md5-48", 4: "murmur", 5: "md5-64", 6: "sha1"}
VARIABLE_METHODS = {1: "random", 2: "simple", 3: "rabin"}
PARAMETER_BYTES = 44


@dataclass
class Header:
    version: int
    files: int
    path_root: str
    chunks: int
    chunking: int
    chunk_size: int
    hashing: int
    hash_bytes: int
    sysid: str
    start_time: int
    end_time: int
    total_bytes: int


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def read_header(raw: bytes) -> tuple[Header, int]:
    """The header and where the first file begins."""
    magic, version = struct.unpack_from("<II", raw, 0)
    if magic != MAGIC or not 1 <= version <= 7:
        raise ValueError("not a hash file of a known version")
    at = 8
    (files,) = struct.unpack_from("<Q", raw, at)
    root = _text(raw[at + 8 : at + 8 + PATH_BYTES])
    at += 8 + PATH_BYTES
    (chunks, chunking) = struct.unpack_from("<QI", raw, at)
    (chunk_size,) = struct.unpack_from("<I", raw, at + 12)
    at += 12 + PARAMETER_BYTES
    hashing, bits = struct.unpack_from("<II", raw, at)
    at += 8
    sysid, start, end, total = "", 0, 0, 0
    if version >= 3:
        sysid = _text(raw[at : at + ID_BYTES])
        at += ID_BYTES
        start, end = struct.unpack_from("<QQ", raw, at)
        at += 16
    if version >= 5:
        (total,) = struct.unpack_from("<Q", raw, at)
        at += 8
    return Header(version, files, root, chunks, chunking, chunk_size, hashing, bits // 8, sysid, start, end, total), at


#: Fields of a file header, as the newest versions have them.
FILE_FIELDS = ("file_size", "blocks", "uid", "gid", "perm", "atime", "mtime", "ctime", "hardlinks", "deviceid", "inodenum", "n_chunks")
LINK_MODE, MODE_MASK = 0o120000, 0o170000


def _file_header(version: int) -> tuple[struct.Struct, tuple[str, ...]]:
    """Layout and names of the fixed part, the path aside."""
    if version <= 3:
        return struct.Struct("<QQ"), ("file_size", "n_chunks")
    if version == 4:
        return struct.Struct("<QIIQQQQQQQQ"), tuple(f for f in FILE_FIELDS if f != "blocks")
    return struct.Struct("<QQIIQQQQQQQQ"), FILE_FIELDS


def _record(header: Header) -> tuple[int, int]:
    """Bytes of a chunk, and of the size that it begins with."""
    sized = 0 if header.chunking == FIXED or header.version < 3 else 4 if header.version >= 7 else 8
    return sized + header.hash_bytes + (header.version >= 6), sized


def _files(raw: bytes, header: Header, at: int) -> Iterator[tuple[dict, int]]:
    """Each file's fields, and where its chunks begin."""
    fixed, names = _file_header(header.version)
    width = _record(header)[0]
    for _ in range(header.files):
        fields = dict.fromkeys(FILE_FIELDS, 0)
        path_bytes = target_bytes = 0
        if header.version == 1:  # the path comes first, in a field of its own
            fields["path"] = _text(raw[at : at + PATH_BYTES])
            at += PATH_BYTES
        fields |= dict(zip(names, fixed.unpack_from(raw, at), strict=True))
        at += fixed.size
        if header.version >= 2:
            (path_bytes,) = struct.unpack_from("<I", raw, at)
            at += 4
        if header.version >= 4:
            (target_bytes,) = struct.unpack_from("<I", raw, at)
            at += 4
        if header.version >= 2:
            fields["path"] = raw[at : at + path_bytes].decode("utf-8", "replace")
            at += path_bytes
        fields["target"] = ""
        if header.version >= 4 and fields["perm"] & MODE_MASK == LINK_MODE:
            fields["target"] = raw[at : at + target_bytes].decode("utf-8", "replace")
            at += target_bytes
        yield fields, at
        at += width * fields["n_chunks"]
        if at > len(raw):
            raise ValueError("the hash file ends within a file's chunks")


def _sizes(header: Header, fields: dict, records: np.ndarray, first: int = 0) -> np.ndarray:
    """Sizes of a file's chunks from number `first` on, given as rows of bytes."""
    sized = _record(header)[1]
    if header.chunking == FIXED:
        return np.clip(fields["file_size"] - (first + np.arange(len(records))) * header.chunk_size, 0, header.chunk_size)
    if not sized:
        return np.zeros(len(records), np.int64)
    return np.ascontiguousarray(records[:, :sized]).view(f"<u{sized}")[:, 0].astype(np.int64)


def _records(raw: bytes, header: Header, fields: dict, at: int) -> np.ndarray:
    width = _record(header)[0]
    return np.frombuffer(raw, np.uint8, width * fields["n_chunks"], at).reshape(fields["n_chunks"], width)


def parse(raw: bytes) -> Iterator[tuple[dict, list[tuple[bytes, int, int | None]]]]:
    """Each file's fields and its chunks (hash, size, compression ratio or None)."""
    header, start = read_header(raw)
    sized = _record(header)[1]
    for fields, at in _files(raw, header, start):
        records = _records(raw, header, fields, at)
        sizes = _sizes(header, fields, records).tolist()
        yield fields, [(r[sized : sized + header.hash_bytes].tobytes(), n, int(r[-1]) if header.version >= 6 else None) for r, n in zip(records, sizes, strict=True)]


def _tables(raw: bytes, one_file: bool) -> Iterator[list[pa.Array]]:
    """The columns of read_hash_files but the first, for some files at a time."""
    header, start = read_header(raw)
    sized, hash_bytes, number = _record(header)[1], header.hash_bytes, 0
    held: list[tuple] = []

    def columns() -> list[pa.Array]:
        counts = np.array([len(r) for *_, r in held])
        row = pa.array(np.repeat(np.arange(len(held)), counts))
        every = np.concatenate([r for *_, r in held])
        padded = np.zeros((len(every), max(32, hash_bytes)), np.uint8)
        padded[:, :hash_bytes] = every[:, sized : sized + hash_bytes]
        digits = pa.py_buffer(padded.tobytes().hex().upper().encode())
        ends = np.arange(len(every) + 1, dtype=np.int32) * (2 * padded.shape[1])
        sizes = np.concatenate([_sizes(header, fields, r, low) for _, _, low, fields, r in held])
        ratio = pa.array(every[:, -1].astype(np.int32)) if header.version >= 6 else pa.nulls(len(every), pa.int32())
        take = lambda values, kind: pa.array(values, kind).take(row)
        out = [take([0 if one_file else k for k, *_ in held], pa.int64()), take([f["path"] for *_, f, _ in held], pa.string())]
        out.append(pa.array(np.concatenate([before + low + np.arange(n) for (_, before, low, *_), n in zip(held, counts, strict=True)])))
        out += [pa.StringArray.from_buffers(len(every), pa.py_buffer(ends), digits), pa.array(sizes, pa.int64()), ratio]
        return out + [take([f[name] for *_, f, _ in held], pa.int64()) for name in FILE_FIELDS]

    waiting = 0
    for k, (fields, at) in enumerate(_files(raw, header, start)):
        records = _records(raw, header, fields, at)
        for low in range(0, len(records), ROWS):
            held.append((k, number if one_file else 0, low, fields, records[low : low + ROWS]))
            waiting += len(held[-1][-1])
            if waiting >= ROWS:
                yield columns()
                held, waiting = [], 0
        number += len(records)
    if held:
        yield columns()


def build_header(files: int, chunks: int, total: int, version: int = 7, chunking: int = VARIABLE, chunk_size: int = 0, hash_bytes: int = 6, hashing: int = 3, path_root: str = "/", sysid: str = "") -> bytes:
    """The header of a hash file with so many files, chunks and bytes."""
    out = [struct.pack("<II", MAGIC, version), struct.pack("<Q", files), path_root.encode().ljust(PATH_BYTES, b"\0"), struct.pack("<QII", chunks, chunking, chunk_size).ljust(12 + PARAMETER_BYTES, b"\0"), struct.pack("<II", hashing, hash_bytes * 8)]
    if version >= 3:
        out += [sysid.encode().ljust(ID_BYTES, b"\0"), struct.pack("<QQ", 0, 0)]
    if version >= 5:
        out.append(struct.pack("<Q", total))
    return b"".join(out)


def build_file(fields: dict, parts: list[tuple[bytes, int, int]], version: int = 7, chunking: int = VARIABLE) -> bytes:
    """What one file adds to a hash file."""
    fixed, names = _file_header(version)
    path = fields["path"].encode()
    link = version >= 4 and fields.get("perm", 0) & MODE_MASK == LINK_MODE
    target = fields.get("target", "").encode() if link else b""
    out = [path.ljust(PATH_BYTES, b"\0")] if version == 1 else []
    out.append(fixed.pack(*[len(parts) if k == "n_chunks" else fields.get(k, 0) for k in names]))
    if version >= 2:
        out.append(struct.pack("<I", len(path)))
    if version >= 4:
        out.append(struct.pack("<I", len(target)))
    if version >= 2:
        out.append(path + target)
    for digest, size, ratio in parts:
        if chunking == VARIABLE and version >= 3:
            out.append(struct.pack("<I" if version >= 7 else "<Q", size))
        out.append(digest + (bytes([ratio]) if version >= 6 else b""))
    return b"".join(out)


def build(files: list[tuple[dict, list[tuple[bytes, int, int]]]], version: int = 7, chunking: int = VARIABLE, chunk_size: int = 0, hash_bytes: int = 6, hashing: int = 3, path_root: str = "/", sysid: str = "") -> bytes:
    """A hash file with these files; the counterpart of parse()."""
    chunks, total = sum(len(c) for _, c in files), sum(f.get("file_size", 0) for f, _ in files)
    head = build_header(len(files), chunks, total, version, chunking, chunk_size, hash_bytes, hashing, path_root, sysid)
    return head + b"".join(build_file(fields, parts, version, chunking) for fields, parts in files)


#: Chunks of a batch of rows.
ROWS = 1 << 15


def read_hash_files(spark: SparkSession, path: str, one_file_per_trace: bool = False) -> DataFrame:
    """(trace, file_no, path, chunk_no, fp, size, cratio, and the file's fields). fp is
    hex, padded to 32 bytes. With one_file_per_trace all chunks of a trace belong to
    file 0, as when traces come from a list."""
    ship(spark)
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("trace"), "content")
    schema = "trace string, file_no long, path string, chunk_no long, fp string, size long, cratio int, " + ", ".join(f"{f} long" for f in FILE_FIELDS)

    def run(batches):
        for batch in batches:
            for trace, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for columns in _tables(raw.as_py(), one_file_per_trace):
                    yield pa.RecordBatch.from_arrays([pa.array([trace] * len(columns[0]), pa.string()), *columns], names=[c.split(" ")[0] for c in schema.split(", ")])

    return found.mapInArrow(run, schema)
