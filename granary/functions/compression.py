"""Compression of chunks, which no built-in function offers: Arrow arrays through the zstd
codec, value by value, so that a worker holds a batch and what it returns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def _bytes(data: pa.Array) -> Iterator[pa.Buffer | None]:
    for x in data:
        yield x.as_buffer() if x.is_valid else None


@F.arrow_udf(BinaryType())
def zstd_compress(data: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array((None if x is None else codec.compress(x, asbytes=True) for x in _bytes(data)), pa.binary())


@F.arrow_udf(BinaryType())
def zstd_decompress(data: pa.Array, size: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array((None if x is None else codec.decompress(x, n, asbytes=True) for x, n in zip(_bytes(data), size.to_pylist(), strict=True)), pa.binary())


@F.arrow_udf(StringType())
def compressed_fp(data: pa.Array) -> pa.Array:
    """SHA-1 of the compressed bytes, for stores that hash after compression. It depends
    on the version of the codec. The compressed bytes are hashed where they are made."""
    codec = pa.Codec("zstd")
    return pa.array((None if x is None else hashlib.sha1(codec.compress(x)).hexdigest().upper() for x in _bytes(data)), pa.string())
