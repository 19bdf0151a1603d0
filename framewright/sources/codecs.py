"""Codecs as Arrow batch functions. Neural codecs plug in through `Codec`; one deterministic codec is built in.

The built-in one rounds a vector to signed codes of a few bits with one scale and compresses them with zstd."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, FloatType, LongType, StructType


class Codec(Protocol):
    """Encodes and decodes batches of vectors; made once for each task, so it may load a model."""

    def encode(self, vectors: list[np.ndarray]) -> list[bytes]: ...

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]: ...


class RoundedZstd:
    def __init__(self, bits: int = 8, level: int = 19) -> None:
        self.bits, self.level = bits, level

    def encode(self, vectors: list[np.ndarray]) -> list[bytes]:
        import zstandard

        z, top = zstandard.ZstdCompressor(level=self.level), 2 ** (self.bits - 1) - 1
        out = []
        for v in vectors:
            scale = max(float(np.abs(v).max()) if len(v) else 0.0, 1e-8) / top
            codes = np.clip(np.rint(v / scale), -top - 1, top).astype(np.int8)
            out.append(struct.pack("<Bf", self.bits, scale) + z.compress(codes.tobytes()))
        return out

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        return [np.frombuffer(z.decompress(p[5:]), np.int8).astype(np.float32) * struct.unpack_from("<f", p, 1)[0] for p in payloads]


def _apply(df: DataFrame, column: str, out: str, kind: DataType, arrow: pa.DataType, work) -> DataFrame:
    """`df` with the column `out` beside all others: nothing is joined, so repeated and null keys are as good as any."""
    names = [x for x in df.columns if x.lower() != out.lower()]
    schema = StructType([*(df.schema[x] for x in names)]).add(out, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for batch in batches:
            yield pa.record_batch([*map(batch.column, names), pa.array(f(batch.column(column)), arrow)], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def encode(df: DataFrame, array: str, make=RoundedZstd) -> DataFrame:
    """`df` with payload."""
    return _apply(df, array, "payload", BinaryType(), pa.binary(), lambda: (lambda c: lambda x: c.encode([np.array(v, np.float32) for v in x.to_pylist()]))(make()))


def decode(df: DataFrame, make=RoundedZstd, payload: str = "payload") -> DataFrame:
    """`df` with vector, decoded from its payload; a null payload gives a null vector."""

    def work():
        c = make()
        return lambda x: [None if p is None else c.decode([p])[0].tolist() for p in x.to_pylist()]

    return _apply(df, payload, "vector", ArrayType(FloatType()), pa.list_(pa.float32()), work)


def compressed_size(df: DataFrame, column: str, level: int = 19) -> DataFrame:
    """`df` with packed: bytes of a text or binary column after zstd."""

    def work():
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        return lambda x: [None if v is None else len(z.compress(v.encode() if isinstance(v, str) else v)) for v in x.to_pylist()]

    return _apply(df, column, "packed", LongType(), pa.int64(), work)
