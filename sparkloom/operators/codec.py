"""Chunk codec: quantise, byte shuffle, compress, 64-byte header; and back.

Only codecs with a host implementation run; the other algorithm ids stay valid and measure as null.
Works on ``keys..., values ARRAY<FLOAT>`` rows, one chunk a row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import ALGORITHMS, HOST_CODECS

#: Bytes that are shuffled together.
SHUFFLE_BYTES = 256 * 1024
ELEMENT = 4
MAGIC, VERSION = b"SLC1", 2
# magic, version, shuffle size, flags, original, payload, bound, scale, low, high, padding: 64 bytes
_HEADER = struct.Struct("<4sIIIQQdddd")
assert _HEADER.size == 64


def shuffle(raw: bytes, size: int = ELEMENT, block: int = SHUFFLE_BYTES) -> bytes:
    """Byte planes of ``size``-byte elements, block by block; leftover bytes follow unchanged."""
    out = []
    for k in range(0, len(raw), block):
        part = raw[k : k + block]
        whole = len(part) // size * size
        if whole <= size:
            out.append(part)
        else:
            out += [np.frombuffer(part[:whole], np.uint8).reshape(-1, size).T.tobytes(), part[whole:]]
    return b"".join(out)


def unshuffle(raw: bytes, size: int = ELEMENT, block: int = SHUFFLE_BYTES) -> bytes:
    """The inverse of :func:`shuffle`."""
    out = []
    for k in range(0, len(raw), block):
        part = raw[k : k + block]
        whole = len(part) // size * size
        if whole <= size:
            out.append(part)
        else:
            out += [np.frombuffer(part[:whole], np.uint8).reshape(size, -1).T.tobytes(), part[whole:]]
    return b"".join(out)


@lru_cache(maxsize=8)
def _codec(name: str) -> pa.Codec:
    return pa.Codec(HOST_CODECS[name])


class Quantised:
    """Codes of values within a bound, with what is needed to restore them."""

    def __init__(self, codes: np.ndarray, bound: float, low: float, high: float):
        self.codes, self.bound, self.low, self.high = codes, bound, low, high


def quantise(x: np.ndarray, bound: float) -> Quantised:
    """Linear quantisation with halves away from zero; values must be finite."""
    v = x.astype(np.float64)
    low, high = (float(v.min()), float(v.max())) if len(v) else (0.0, 0.0)
    span = high - low
    rounding = 2.4e-7 * max(abs(low), abs(high))
    left = bound - rounding - 0.05 * bound
    step = 1.0 if span <= 0 else max(left if left > 0 else max(span / 4e9, 0.1 * rounding), span / 4e9)
    bins = span / (2 * step) * 1.1
    dtype = np.int8 if bins <= 127 else np.int16 if bins <= 32767 else np.int32
    info = np.iinfo(dtype)
    codes = np.clip(np.floor((v - low) / (2 * step) + 0.5), info.min, info.max).astype(dtype)
    return Quantised(codes, step, low, high)


def restore(q: Quantised) -> np.ndarray:
    return (q.codes.astype(np.float64) * (2 * q.bound) + q.low).astype(np.float32)


def encode_chunk(values: np.ndarray, algorithm: str, shuffled: bool, bound: float = 0.0) -> bytes | None:
    """Header and payload of one chunk; null without a host codec.  Chunks with NaN or infinity stay lossless."""
    if algorithm not in HOST_CODECS:
        return None
    values = np.ascontiguousarray(values, np.float32)
    lossy = bound > 0 and len(values) > 0 and bool(np.isfinite(values).all())
    low = high = step = 0.0
    body, width = values.tobytes(), 0
    if lossy:
        q = quantise(values, bound)
        body, width, low, high, step = q.codes.tobytes(), q.codes.itemsize, q.low, q.high, q.bound
    plain = len(body)
    if shuffled:
        body = shuffle(body)
    payload = _codec(algorithm).compress(body, asbytes=True) if plain else b""
    flags = (1 if lossy else 0) | (width << 4) | (int(lossy) << 8) | (ALGORITHMS.index(algorithm) << 9)
    return _HEADER.pack(MAGIC, VERSION, ELEMENT if shuffled else 0, flags, plain, len(payload), step, 2 * step, low, high) + payload


def decode_chunk(raw: bytes) -> np.ndarray:
    """The values of an encoded chunk; bytes without the magic are raw floats."""
    if raw[:4] != MAGIC:
        return np.frombuffer(raw, np.float32)
    magic, version, size, flags, plain, n, step, scale, low, high = _HEADER.unpack_from(raw)
    if not 1 <= version <= VERSION or len(raw) != _HEADER.size + n:
        raise ValueError("an encoded chunk is damaged")
    body = _codec(ALGORITHMS[flags >> 9 & 15]).decompress(raw[_HEADER.size :], plain, asbytes=True) if plain else b""
    if size:
        body = unshuffle(body, size)
    if flags >> 8 & 1:
        dtype = {1: np.int8, 2: np.int16, 4: np.int32}[flags >> 4 & 15]
        return restore(Quantised(np.frombuffer(body, dtype), step, low, high))
    return np.frombuffer(body, np.float32)


def original_size(raw: bytes) -> int:
    """Bytes before compression that a header tells, or the raw length."""
    return _HEADER.unpack_from(raw)[4] if raw[:4] == MAGIC else len(raw)


def _floats(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        v = x.values
        yield np.zeros(0, np.float32) if v is None else v.to_numpy(zero_copy_only=False).astype(np.float32)


def _encode(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [encode_chunk(v, a, bool(s), e) for v, a, s, e in zip(_floats(b.column("values")), b.column("comp_algo").to_pylist(), b.column("shuffle").to_pylist(), b.column("error_bound").to_pylist(), strict=True)]
        sizes = [len(v) * 4 for v in _floats(b.column("values"))]
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=[*b.schema.names[:keep], "encoded", "original_bytes"])


def encode(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, encoded, original_bytes`` of rows ``keys, values, comp_algo, shuffle, error_bound``."""
    cols = [*keys, "comp_algo", "shuffle", "error_bound"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*cols).schema)
    return chunks.select(*cols, "values").mapInArrow(partial(_encode, keep=len(cols)), f"{schema}, encoded binary, original_bytes long")


def _decode(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [None if x is None else decode_chunk(x) for x in b.column(keep).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names[:keep], "values"])


def decode(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, values`` of rows ``keys, encoded``; null stays null."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(*keys).schema)
    return encoded.select(*keys, "encoded").mapInArrow(partial(_decode, keep=len(keys)), f"{schema}, values array<float>")


def raw_if_not_smaller(encoded: Column, raw: Column) -> Column:
    """The encoded bytes where they are smaller than the raw ones."""
    return F.when(F.octet_length(encoded) < F.octet_length(raw), encoded).otherwise(raw)


def is_encoded(raw: Column) -> Column:
    """Whether bytes start with the magic of an encoded chunk."""
    return F.substring(F.hex(F.substring(raw, 1, 4)), 1, 8) == MAGIC.hex().upper()


def chunk_arrays(chunks: DataFrame) -> DataFrame:
    """``field_id, chunk_id, values``: chunks (bounded by their size) as arrays in order."""
    return chunks.groupBy("field_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("float").alias("v")))), lambda s: s["v"]).alias("values"))


def compression_stats(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """``ratio_total`` counts the header, ``ratio_payload`` does not."""
    n, size = F.col("original_bytes"), F.octet_length("encoded")
    return encoded.select(*keys, "original_bytes", size.alias("encoded_bytes"), (n / size).alias("ratio_total"), F.when(size > 64, n / (size - 64)).alias("ratio_payload"))


def _encode_or_raw(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, sizes = [], []
        for v, a, s, e in zip(_floats(b.column("values")), b.column("comp_algo").to_pylist(), b.column("shuffle").to_pylist(), b.column("error_bound").to_pylist(), strict=True):
            raw = v.tobytes()
            enc = encode_chunk(v, a, bool(s), e)
            # raw bytes that begin like a header would be read as one, so they are always encoded
            out.append(raw if (enc is None or len(enc) >= len(raw)) and raw[:4] != MAGIC else enc if enc is not None else encode_chunk(v, "lz4", False))
            sizes.append(len(raw))
        yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=[*b.schema.names[:keep], "encoded", "original_bytes"])


def encode_or_raw(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Like :func:`encode`, with raw bytes where the encoding is not smaller or has no codec here."""
    cols = [*keys, "comp_algo", "shuffle", "error_bound"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.select(*cols).schema)
    return chunks.select(*cols, "values").mapInArrow(partial(_encode_or_raw, keep=len(cols)), f"{schema}, encoded binary, original_bytes long")
