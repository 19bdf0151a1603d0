"""The multi-modality container: binary files to entry rows and back.

Files are read by Spark's binaryFile source (any store, one file to a task) and unpacked in Arrow batches. A metadata scan is
an expression that steps from entry to entry, so no payload is copied or leaves the JVM. Writing packs entries in their order, their
payloads in the JVM too; a container is one value, so the entries of one container come together in one task. Names are reduced to
their last part, so none leads out of a folder.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import le_hex, let

#: Fixed values of the format: mark, newest version, modalities. All numbers are little-endian.
MAGIC, VERSION = b"TINY", 8
IMAGE, AUDIO, VIDEO, AV, SEMANTIC = range(5)
SCHEMA = (
    "file string, entry_idx int, version int, modality int, name string, width bigint, height bigint, fps float, total_frames bigint, "
    "sample_rate bigint, bandwidth float, num_samples bigint, channels int, codec_id int, quality int, scale float, "
    "payload_len bigint, aux_payload_len bigint, payload_offset bigint, payload binary, aux_payload binary"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


class _Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        form = "<" + form
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ValueError(f"truncated container at byte {self.at}")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def name(self) -> str:
        (n,) = self.take("H")
        return self.raw(n)[1].decode("utf-8")

    def raw(self, n: int) -> tuple[int, bytes]:
        if self.at + n > len(self.data):
            raise ValueError(f"truncated container at byte {self.at}")
        at = self.at
        self.at += n
        return at, self.data[at : at + n]

    def blob(self, row: dict, name: str, keep: bool) -> None:
        (n,) = self.take("I")
        at, data = self.raw(n)
        row[f"{name}_len"] = n
        if name == "payload":
            row["payload_offset"] = at
        if keep:
            row[name] = data


def entries(data: bytes, keep: bool = True) -> Iterator[dict]:
    """The entries of one container, versions 1 to 8; an unknown modality is read as an image."""
    c = _Cursor(data)
    (magic, version, count) = c.take("4sBH")
    if magic != MAGIC:
        raise ValueError("not a container")
    if not 1 <= version <= VERSION:
        raise ValueError(f"unsupported version {version}")
    for i in range(count):
        kind = c.take("B")[0] if version >= 3 else IMAGE
        row = {"entry_idx": i, "version": version, "modality": kind, "name": c.name()}
        if kind in (VIDEO, AV):
            row["width"], row["height"], row["fps"], row["total_frames"] = c.take("IIfI")
            c.blob(row, "payload", keep)
            if kind == AV:
                row["sample_rate"], row["bandwidth"], row["num_samples"], row["channels"] = c.take("IfIB")
                c.blob(row, "aux_payload", keep)
        elif kind == AUDIO:
            row["sample_rate"], row["bandwidth"], row["num_samples"], row["channels"] = c.take("IfIB")
            c.blob(row, "payload", keep)
        elif kind == SEMANTIC:
            row["sample_rate"], row["num_samples"], row["channels"] = c.take("IIB")
            c.blob(row, "payload", keep)
        elif version >= 8:
            row["width"], row["height"], row["codec_id"], row["quality"] = c.take("HHBB")
            c.blob(row, "payload", keep)
            c.blob(row, "aux_payload", keep)
        else:
            row["width"], row["height"] = c.take("HH")
            c.take("4I")
            (row["scale"],) = c.take("f")
            if version >= 7:
                (row["quality"],) = c.take("B")
            c.blob(row, "payload", keep)
            if version >= 2:
                c.blob(row, "aux_payload", keep)
            if version >= 5 and c.at < len(data) and c.take("B")[0] == 1:
                c.take("I")
                for _ in range(3):
                    c.raw(c.take("I")[0])
        yield row


def entry_heads(row: dict, size: int, aux_size: int) -> tuple[bytes, bytes]:
    """What stands before an entry's payload and before its auxiliary one in version 8; the second is empty if the entry has no such place."""
    name, kind = (row["name"] or "").encode("utf-8"), row["modality"]
    n = lambda k: int(row.get(k) or 0)
    first, length, more = struct.pack("<BH", kind, len(name)) + name, struct.pack("<I", size), struct.pack("<I", aux_size)
    sound = lambda: struct.pack("<IfIB", n("sample_rate"), row.get("bandwidth") or 0.0, n("num_samples"), n("channels"))
    if kind in (VIDEO, AV):
        first += struct.pack("<IIfI", n("width"), n("height"), row.get("fps") or 0.0, n("total_frames")) + length
        return first, sound() + more if kind == AV else b""
    if kind == AUDIO:
        return first + sound() + length, b""
    if kind == SEMANTIC:
        return first + struct.pack("<IIB", n("sample_rate"), n("num_samples"), n("channels")) + length, b""
    return first + struct.pack("<HHBB", n("width"), n("height"), n("codec_id"), n("quality")) + length, more


def pack_entry(row: dict) -> bytes:
    """One entry as version 8 has it."""
    payload, aux = row.get("payload") or b"", row.get("aux_payload") or b""
    before, between = entry_heads(row, len(payload), len(aux))
    return before + payload + (between + aux if between else b"")


def unpack(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Rows (path, content) to one row for each entry. A file that isn't a container, or is cut off, is an error."""
    kinds = {f.name: f.dataType for f in files.sparkSession.createDataFrame([], SCHEMA).schema}
    schema = pa.schema([(n, pa.string() if n in ("file", "name") else pa.binary() if "binary" in str(t).lower() else pa.float32() if "float" in str(t).lower() else pa.int64() if "long" in str(t).lower() else pa.int32()) for n, t in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [{**dict.fromkeys(COLUMNS), "file": file, **e} for e in entries(data.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(path, content).mapInArrow(run, SCHEMA)


def metadata(files: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """(file, entry_idx, version, modality, name, payload_len, aux_payload_len, payload_offset) of all entries, without their payloads.

    Only the entries' heads are looked at, a few bytes each, by expressions. Errors are those of unpack().
    """
    rows = files.select(F.col(path).alias("file"), F.explode(F.array(let(F.col(content), _heads))).alias("_e"))
    return rows.select("file", F.posexplode("_e").alias("entry_idx", "_r")).select("file", "entry_idx", "_r.*").select("file", "entry_idx", "version", *_HEAD[1:])


_HEAD = ["version", "modality", "name", "payload_len", "aux_payload_len", "payload_offset"]
_HEADS = "array<struct<version:int,modality:int,name:string,payload_len:bigint,aux_payload_len:bigint,payload_offset:bigint>>"


def _heads(data: Column) -> Column:
    """The entries' heads in a container's bytes, as _HEADS; data is a bound name, so that its bytes are not copied for each use."""
    byte = lambda at, k: F.hex(F.substring(data, at + (k + 1), 1))

    def number(at: Column, size: int) -> Column:
        """A little-endian number of `size` bytes; 0 beyond the end."""
        return F.coalesce(F.conv(F.concat(*[byte(at, k) for k in reversed(range(size))]), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))

    n = F.lit(0).cast("bigint")
    state = F.struct(F.lit(7).cast("int").alias("at"), F.array().cast(_HEADS).alias("found"))

    def walk(version: Column) -> Column:
        bad = F.when(F.substring(data, 1, 4) != F.lit(MAGIC), F.raise_error(F.lit("not a container"))).when(~version.between(1, VERSION), F.raise_error(F.concat(F.lit("unsupported version "), version.cast("string"))))
        steps = F.filter(F.sequence(F.lit(0), number(F.lit(5), 2).cast("int")), lambda i: i > 0)
        walked = F.aggregate(steps, state, lambda s, _: step(version, s))
        sound = lambda w: F.when(w["at"] > F.length(data), F.raise_error(F.lit("truncated container"))).otherwise(w["found"])
        return F.coalesce(bad.cast(_HEADS), let(walked, sound))

    def step(version: Column, s: Column) -> Column:
        kind = F.when(version >= 3, number(s["at"], 1).cast("int")).otherwise(F.lit(IMAGE))
        start = s["at"] + F.when(version >= 3, 1).otherwise(0)

        def named(h: Column) -> Column:
            kind, at, size = h["kind"], h["at"], h["size"]
            old = F.lit(24) + F.when(version >= 7, 1).otherwise(0)  # sizes, shape, scale, quality
            head = F.when(kind.isin(VIDEO, AV), 16).when(kind == AUDIO, 13).when(kind == SEMANTIC, 9).when(version >= 8, 6).otherwise(old)
            body = at + 2 + size + head  # where the payload's length stands
            image = ~kind.isin(VIDEO, AV, AUDIO, SEMANTIC)
            name = F.decode(F.substring(data, at + 3, size), "UTF-8")
            return let(F.struct(body.cast("int").alias("body"), number(body, 4).alias("n"), name.alias("name"), image.alias("image"), kind.alias("kind")), second)

        def second(h: Column) -> Column:
            after = (h["body"] + 4 + h["n"]).cast("int")
            more = (h["kind"] == AV) | (h["image"] & (version >= 2))
            at = after + F.when(h["kind"] == AV, 13).otherwise(0)
            aux = F.when(more, number(at, 4)).otherwise(n)
            return let(F.struct(h["body"].alias("body"), h["n"].alias("n"), h["name"].alias("name"), h["kind"].alias("kind"), aux.alias("aux"), more.alias("more"), F.when(more, at + 4 + aux).otherwise(after).cast("int").alias("end"), (h["image"] & version.between(5, 7)).alias("turbo")), ended)

        def ended(h: Column) -> Column:
            def skip(at: Column, times: int) -> Column:
                for _ in range(times):
                    at = let(at, lambda a: (a + 4 + number(a, 4)).cast("int"))
                return at

            flag = h["turbo"] & (h["end"] < F.length(data))
            tail = F.when(flag & (number(h["end"], 1) == 1), skip(h["end"] + 5, 3)).when(flag, h["end"] + 1).otherwise(h["end"])
            row = F.struct(version.alias("version"), h["kind"].alias("modality"), h["name"].alias("name"), h["n"].alias("payload_len"), F.when(h["more"], h["aux"]).alias("aux_payload_len"), (h["body"] + 4).cast("bigint").alias("payload_offset"))
            return F.struct(tail.cast("int").alias("at"), F.concat(s["found"], F.array(row)).alias("found"))

        return let(F.struct(kind.alias("kind"), start.cast("int").alias("at"), number(start, 2).cast("int").alias("size")), named)

    return let(number(F.lit(4), 1).cast("int"), walk)


def read(spark: SparkSession, path: str, *, metadata_only: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return metadata(files) if metadata_only else unpack(files)


def pack(rows: DataFrame, by: str = "file") -> DataFrame:
    """(by, content, n_entries): one container for each value of `by`, entries in order of entry_idx.

    Only the entries' fields go to Python, which makes their heads; payloads stay in the JVM and are put between them and gathered
    there. A container holds 65535 entries at most.
    """
    names = [x for x in COLUMNS if x in rows.columns and x not in ("payload", "aux_payload")]
    blob = lambda x: F.coalesce(F.col(x), F.lit(b"")) if x in rows.columns else F.lit(b"")
    payload, aux = blob("payload"), blob("aux_payload")

    @F.arrow_udf("before binary, between binary")
    def heads(fields: pa.Array) -> pa.Array:
        found = [entry_heads(r, r["_size"], r["_aux_size"]) for r in fields.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in (zip(*found) if found else ([], []))], names=["before", "between"])

    fields = F.struct(*names, F.octet_length(payload).alias("_size"), F.octet_length(aux).alias("_aux_size"))
    each = rows.select(F.col(by).alias("_by"), F.col("entry_idx").cast("int").alias("_at"), payload.alias("_payload"), aux.alias("_aux"), heads(fields).alias("_h"))
    last = F.when(F.octet_length("_h.between") > 0, F.col("_aux")).otherwise(F.lit(b""))
    each = each.select("_by", "_at", F.concat("_h.before", "_payload", "_h.between", last).alias("_data"))
    joined = each.groupBy("_by").agg(F.expr("listagg(_data) within group (order by _at nulls last)").alias("_all"), F.count("*").cast("int").alias("_n"))
    head = F.concat(F.lit(MAGIC + bytes([VERSION])), F.unhex(le_hex(F.col("_n"), 2)))
    content = F.when(F.col("_n") > 65535, F.raise_error(F.lit("too many entries for one container")).cast("binary")).otherwise(F.concat(head, "_all"))
    return joined.select(F.col("_by").alias(by), content.alias("content"), F.col("_n").alias("n_entries"))


def write(rows: DataFrame, folder: str) -> None:
    """Containers (file, content) as one file each in a folder: a path that all executors share, or a URI of a store that Arrow's
    file systems reach (file, s3, gs, hdfs)."""
    from pyarrow import fs

    place = lambda: fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, to = place()
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                at = f"{to}/{name.rsplit('/', 1)[-1]}"
                part = f"{at}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, at)  # a repeated task writes the same bytes again
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    store, to = place()
    store.create_dir(to, recursive=True)
    rows.select("file", "content").mapInArrow(save, "n long").agg(F.sum("n")).collect()


def native_bitstream(groups: list[list[bytes]], height: int, width: int) -> bytes:
    out = struct.pack("<HHH", len(groups), height, width)
    for g in groups:
        out += struct.pack("<I", len(g)) + b"".join(struct.pack("<I", len(s)) + s for s in g)
    return out


def read_native_bitstream(data: bytes) -> tuple[list[list[bytes]], int, int]:
    c = _Cursor(data)
    n, h, w = c.take("HHH")
    return [[c.raw(c.take("I")[0])[1] for _ in range(c.take("I")[0])] for _ in range(n)], h, w


#: The mark and fields of a semantic payload.
SEMANTIC_MAGIC = b"SEMA"


def semantic_payload(version: int, rate: int, seconds: float, channels: int, text: str, vector: list[float], wpm: float, f0: float, db: float) -> bytes:
    t = text.encode("utf-8")
    return (
        SEMANTIC_MAGIC + struct.pack("<BIfBH", version, rate, seconds, channels, len(t)) + t
        + struct.pack(f"<B{len(vector)}f", len(vector), *vector) + struct.pack("<fff", wpm, f0, db)
    )


def read_semantic_payload(data: bytes) -> dict:
    c = _Cursor(data)
    if c.take("4s")[0] != SEMANTIC_MAGIC:
        raise ValueError("not a semantic payload")
    version, rate, seconds, channels, n = c.take("BIfBH")
    text = c.raw(n)[1].decode("utf-8")
    vector = list(c.take(f"{c.take('B')[0]}f"))
    wpm, f0, db = c.take("fff")
    return {"version": version, "orig_sr": rate, "duration_s": seconds, "channels": channels, "transcript": text, "embedding": vector, "speaking_rate_wpm": wpm, "f0_mean_hz": f0, "rms_db": db}


#: Fixed value: the mark of a chunked video payload.
VIDEO_MAGIC = b"SSF2"


def video_payload(quality: int, padded: tuple[int, int], size: tuple[int, int], fps: float, frames: int, chunks: list[tuple[int, int, bytes]]) -> bytes:
    head = VIDEO_MAGIC + struct.pack("<HHHHHfII", quality, *padded, *size, fps, frames, len(chunks))
    return head + b"".join(struct.pack("<III", s, n, len(d)) + d for s, n, d in chunks)


def read_video_payload(data: bytes) -> dict:
    c = _Cursor(data)
    if c.take("4s")[0] != VIDEO_MAGIC:
        raise ValueError("not a chunked video payload")
    quality, pw, ph, w, h, fps, frames, n = c.take("HHHHHfII")
    chunks = []
    for _ in range(n):
        start, length, size = c.take("III")
        chunks.append((start, length, c.raw(size)[1]))
    return {"quality": quality, "pad_w": pw, "pad_h": ph, "width": w, "height": h, "fps": fps, "frames": frames, "chunks": chunks}
