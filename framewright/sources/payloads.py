"""Layouts inside container entries: audio codes and their layers, polar latents, legacy video frames.

Bytes to fields and back; the Spark side turns a column of payloads into rows in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.latents import ANCHORS, codebook
from .container import _Cursor, read_semantic_payload, read_video_payload, semantic_payload, video_payload

#: The mark of a zstd frame, of seeded legacy video, and of an I-frame with its shape.
ZSTD_MARK, SEEDED_VIDEO = b"\x28\xb5\x2f\xfd", b"TURV"
PLAIN, PROJECTED, LOSSLESS = range(3)


def _zstd(data: bytes, level: int = 19) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def audio_payload(codes: np.ndarray, layer: int = PLAIN, **fields) -> bytes:
    """Codes (codebooks x steps) and one layer: PROJECTED takes seed, chunk, n_proj, bits, hf_n_proj, hf_bits; LOSSLESS takes residual."""
    packed = _zstd(codes.astype("<i2").tobytes())
    out = struct.pack("<BII", codes.shape[0], codes.shape[1], len(packed)) + packed + bytes([layer])
    if layer == PROJECTED:
        bits, high = fields["bits"], fields.get("hf_bits", b"")
        out += struct.pack("<IHHI", fields["seed"], fields["chunk"], fields["n_proj"], len(bits)) + bits
        out += struct.pack("<HI", fields.get("hf_n_proj", 0), len(high)) + high
    elif layer == LOSSLESS:
        residual = _zstd(fields["residual"].astype("<i2").tobytes())
        out += struct.pack("<I", len(residual)) + residual
    return out


def read_audio_payload(data: bytes) -> dict:
    """Both versions: the first has the compressed codes at once, the second their length and a layer after them."""
    c = _Cursor(data)
    k, t = c.take("BI")
    if data[5:9] == ZSTD_MARK:
        return {"codes": np.frombuffer(_unzstd(data[5:]), "<i2").reshape(k, t), "layer": PLAIN}
    codes = np.frombuffer(_unzstd(c.raw(c.take("I")[0])[1]), "<i2").reshape(k, t)
    (layer,) = c.take("B")
    out = {"codes": codes, "layer": layer}
    if layer == PROJECTED:
        out["seed"], out["chunk"], out["n_proj"], n = c.take("IHHI")
        out["bits"] = c.raw(n)[1]
        if c.at < len(data):
            out["hf_n_proj"], n = c.take("HI")
            out["hf_bits"] = c.raw(n)[1]
    elif layer == LOSSLESS:
        out["residual"] = np.frombuffer(_unzstd(c.raw(c.take("I")[0])[1]), "<i2")
    return out


def polar_payload(x: np.ndarray, norm_bits: int = 3, dir_bits: int = 3, anchors: int = ANCHORS) -> bytes:
    """Rows of latents: the first channels as signed bytes by channel, the others as norm and direction codes."""
    n, c = x.shape
    a = min(anchors, c)
    scales = np.maximum(np.abs(x[:, :a]).max(0) if n else np.zeros(a), 1e-8) / 127
    first = np.clip(np.rint(x[:, :a] / scales), -127, 127).astype(np.int8)
    rest = x[:, a:]
    norm = np.sqrt((rest**2).sum(1))
    half = 1 << (dir_bits - 1)
    index = np.searchsorted(codebook(1 << norm_bits)[0], norm).astype(np.uint8)
    codes = np.clip(np.rint(rest / (norm[:, None] + 1e-8) * half), -half, half - 1).astype(np.int8)
    body = _zstd(scales.astype("<f4").tobytes() + first.tobytes() + index.tobytes() + codes.tobytes())
    return struct.pack("<BBIHHI", norm_bits, dir_bits, n, c, a, len(body)) + body


def read_polar_payload(data: bytes) -> np.ndarray:
    """Both layouts; the older one has no anchors (told by the number at byte 8, which is at most 24 in the newer)."""
    norm_bits, dir_bits, n, c = struct.unpack_from("<BBIH", data)
    (a,) = struct.unpack_from("<H", data, 8)
    if a <= ANCHORS:
        (size,) = struct.unpack_from("<I", data, 10)
        body = _unzstd(data[14 : 14 + size])
    else:
        body, a = _unzstd(data[10 : 10 + a]), 0
    scales = np.frombuffer(body, "<f4", a)
    at = 4 * a
    first = np.frombuffer(body, np.int8, n * a, at).reshape(n, a) * scales
    at += n * a
    index = np.frombuffer(body, np.uint8, n, at)
    codes = np.frombuffer(body, np.int8, n * (c - a), at + n).reshape(n, c - a)
    centres = np.array(codebook(1 << norm_bits)[1])
    return np.concatenate([first, codes / (1 << (dir_bits - 1)) * centres[index][:, None]], 1).astype(np.float32)


def legacy_video(frames: list[tuple[int, int, int, bytes]], size: tuple[int, int], downsample: int, total: int, seed: int | None = None) -> bytes:
    head = SEEDED_VIDEO + struct.pack("<I", seed) if seed is not None else b""
    head += struct.pack("<HHBII", *size, downsample, total, len(frames))
    return head + b"".join(struct.pack("<IBII", i, kind, ref, len(d)) + d for i, kind, ref, d in frames)


def read_legacy_video(data: bytes) -> dict:
    c = _Cursor(data)
    seed = None
    if data[:4] == SEEDED_VIDEO:
        c.at = 4
        (seed,) = c.take("I")
    w, h, down, total, stored = c.take("HHBII")
    frames = []
    for _ in range(stored):
        i, kind, ref, n = c.take("IBII")
        frames.append((i, kind, ref, c.raw(n)[1]))
    return {"base_seed": seed, "width": w, "height": h, "downsample": down, "total": total, "frames": frames}


FRAMES = "file string, frame_idx bigint, frame_type int, ref_idx bigint, seed bigint, data binary"


def legacy_frames(df: DataFrame, file: str = "file", payload: str = "payload") -> DataFrame:
    """One row for each stored frame; seed is the base seed, if there is one, combined with the frame's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = read_legacy_video(data.as_py())
                rows = [(name, i, kind, ref, None if v["base_seed"] is None else v["base_seed"] ^ i, d) for i, kind, ref, d in v["frames"]]
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in FRAMES.split(", ")])

    return df.select(file, payload).mapInArrow(run, FRAMES)


def encode_polar(df: DataFrame, key: str, at: str, vector: str, norm_bits: int = 3, dir_bits: int = 3) -> DataFrame:
    """(key, payload): the vectors of a key, in order of `at`, as one payload. Keys have to be small: an image, a stretch of frames."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(at)
        x = np.array(table.column(vector).to_pylist(), float)
        return pa.table({key: table.column(key).slice(0, 1), "payload": pa.array([polar_payload(x, norm_bits, dir_bits)], pa.binary())})

    return df.select(key, at, vector).groupBy(key).applyInArrow(run, f"{key} {dict(df.dtypes)[key]}, payload binary")


def decode_polar(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, row, vector): the vectors of each payload in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1).to_pylist()):
                found = read_polar_payload(data)
                keys = batch.column(0).take(pa.array([k] * len(found), pa.int64()))
                yield pa.record_batch([keys, pa.array(range(len(found)), pa.int32()), pa.array(found.tolist(), pa.list_(pa.float32()))], names=[key, "row", "vector"])

    return df.select(key, payload).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, row int, vector array<float>")


def encode_semantic(df: DataFrame, keys: list[str], transcript: str = "transcript", rate: int = 16000) -> DataFrame:
    """(keys, payload) from rows with a transcript and, as far as there are such columns, duration_s, embedding, speaking_rate_wpm,
    f0_mean_hz and rms_db; what is missing or null is 0, or 150 words a minute."""
    default = {"duration_s": 0.0, "embedding": [], "speaking_rate_wpm": 150.0, "f0_mean_hz": 0.0, "rms_db": 0.0}
    there = [x for x in default if x in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v = {k: d if r.get(k) is None else r[k] for k, d in default.items()}
                out.append(semantic_payload(1, rate, v["duration_s"], 1, r[transcript] or "", v["embedding"], v["speaking_rate_wpm"], v["f0_mean_hz"], v["rms_db"]))
            yield pa.record_batch([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "payload"])

    kinds = dict(df.dtypes)
    return df.select(*keys, transcript, *there).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", payload binary")


SEMANTIC = "version int, orig_sr bigint, duration_s double, channels int, transcript string, embedding array<float>, speaking_rate_wpm double, f0_mean_hz double, rms_db double"


def inspect_semantic(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, the fields of each semantic payload)."""
    names = [x.split()[0] for x in SEMANTIC.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.float32()), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_semantic_payload(x) for x in batch.column(payload).to_pylist()]
            yield pa.record_batch([*(batch.column(k) for k in keys), *(pa.array([f[n] for f in found], kind) for n, kind in zip(names, kinds))], names=[*keys, *names])

    types = dict(df.dtypes)
    return df.select(*keys, payload).mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + SEMANTIC)


def scales(df: DataFrame, key: str, payload: str = "payload", scale: str = "scale") -> DataFrame:
    """(key, kind, scales, data): what an old image entry's scale says about its payload.

    -1: stored without loss, no scales; 0: the payload begins with a scale for each channel; else one scale for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, found, data = [], [], []
            for p, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = struct.unpack_from("<I", p)[0] if x == 0 else 0
                kind.append("lossless" if x == -1 else "channel" if x == 0 else "global")
                found.append(None if x == -1 else np.frombuffer(p, "<f4", n, 4).tolist() if x == 0 else [x])
                data.append(p[4 + 4 * n :] if x == 0 else p)
            yield pa.record_batch([batch.column(0), pa.array(kind), pa.array(found, pa.list_(pa.float32())), pa.array(data, pa.binary())], names=[key, "kind", "scales", "data"])

    return df.select(key, payload, scale).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, kind string, scales array<float>, data binary")


def _gathered(df: DataFrame, key: str, order: str, columns: list[str], make) -> DataFrame:
    """(key, payload): the rows of a key, in order, as one payload. A payload is one value, so its rows come together in one task."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by(order).select(columns).to_pylist()
        return pa.table({key: table.column(key).slice(0, 1), "payload": pa.array([make(rows)], pa.binary())})

    return df.select(key, *dict.fromkeys([order, *columns])).groupBy(key).applyInArrow(run, f"{key} {dict(df.dtypes)[key]}, payload binary")


def _scattered(df: DataFrame, key: str, payload: str, schema: str, kinds: list[pa.DataType], read) -> DataFrame:
    """(key, fields): the rows that each payload holds, as tuples by read()."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1).to_pylist()):
                rows = list(read(data))
                if rows:
                    keys = batch.column(0).take(pa.array([k] * len(rows), pa.int64()))
                    yield pa.record_batch([keys, *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))], names=[key, *names])

    return df.select(key, payload).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {schema}")


def encode_frames(df: DataFrame, key: str, size: tuple[int, int] = (64, 48), downsample: int = 1, seed: int | None = None) -> DataFrame:
    """Rows (key, frame_idx, frame_type, ref_idx, data) to one legacy video payload for each key; legacy_frames() reads them back."""
    make = lambda rows: legacy_video([tuple(r.values()) for r in rows], size, downsample, max(r["frame_idx"] for r in rows) + 1, seed)
    return _gathered(df, key, "frame_idx", ["frame_idx", "frame_type", "ref_idx", "data"], make)


def encode_chunks(df: DataFrame, key: str, quality: int = 1, size: tuple[int, int] = (64, 48), fps: float = 24.0) -> DataFrame:
    """Rows (key, start, length, data) to one chunked video payload for each key."""
    pad = tuple(-(-x // 64) * 64 for x in size)
    make = lambda rows: video_payload(quality, pad, size, fps, sum(r["length"] for r in rows), [tuple(r.values()) for r in rows])
    return _gathered(df, key, "start", ["start", "length", "data"], make)


def decode_chunks(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, start, length, data) of every chunk of the payloads."""
    return _scattered(df, key, payload, "start bigint, length bigint, data binary", [pa.int64(), pa.int64(), pa.binary()], lambda data: read_video_payload(data)["chunks"])


def encode_codes(df: DataFrame, key: str, codes: str = "codes") -> DataFrame:
    """Rows (key, codes: codebooks x steps) to one audio payload each, without a layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([audio_payload(np.array(x, np.int16)) for x in batch.column(1).to_pylist()], pa.binary())], names=[key, "payload"])

    return df.select(key, codes).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, payload binary")


def decode_codes(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, layer, codes) of audio payloads of both versions."""
    read = lambda data: [(f["layer"], f["codes"].tolist()) for f in (read_audio_payload(data),)]
    return _scattered(df, key, payload, "layer int, codes array<array<int>>", [pa.int32(), pa.list_(pa.list_(pa.int32()))], read)
