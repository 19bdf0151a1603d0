"""What several corpus operators share: words, written intermediate tables, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import let as let

#: A word is a run of characters other than the ASCII white space (bytes.split() has the same rule).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local session (tests), where driver and executors are one process, gets a temporary folder if none is named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


#: Makes Spark delete the shuffle files of an execution when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors, frees the write's shuffles."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once all that was derived from it is written itself."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running(df: DataFrame, order: list[Column], sums: dict[str, str], number: str | None = None) -> DataFrame:
    """`df` with running sums over all rows in an order, the row itself left out: {new column: summed column}; number: rows before it.

    Rows are dealt out by range, so no task sees more than its range; only one row for each range goes through one task.
    """
    at, each = "_range", {**sums, **({number: None} if number else {})}
    what = lambda source: F.lit(1).cast("long") if source is None else F.col(source)
    ranged = materialize(df.repartitionByRange(*order).withColumn(at, F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(at).agg(*[F.sum(what(source)).alias(f"_{name}_") for name, source in each.items()])
    before = W.orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(at, *[F.coalesce(F.sum(f"_{name}_").over(before), F.lit(0)).alias(f"_{name}_") for name in each])
    inside = W.partitionBy(at).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(starts), at)  # a row for each range: as many as shuffle partitions
    for name, source in each.items():
        out = out.withColumn(name, F.sum(what(source)).over(inside) - what(source) + F.col(f"_{name}_"))
    return out.drop(at, *[f"_{name}_" for name in each])


def word_array(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one. JVM only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the published splitmix64 constants): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: For word hashes: which bytes are white space, A-Z lower-cased, and a random number for each byte at each of the first places.
_SPACE_BYTE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER_BYTE = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_PLACES = 64
_AT_PLACE = np.random.default_rng(20).integers(0, 1 << 64, _PLACES * 256, np.uint64)


def hash_words(texts: list[bytes], lower: bool = False, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the number of words of each text.

    A hash is the sum of a random number for each byte and its place in the word, mixed with the length: no word is made as
    an object. lower: A-Z count as a-z.
    """
    found, lengths_of, many = [], [], np.zeros(len(texts), np.int64)
    for lo, hi in _runs(texts, piece):
        flat = np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)
        size = np.array([len(t) + 1 for t in texts[lo:hi]])
        inside = np.zeros(len(flat) + 2, bool)
        np.logical_not(_SPACE_BYTE[flat], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        many[lo:hi] = np.diff(np.searchsorted(starts, np.append(0, np.cumsum(size))))
        if not len(starts):
            continue
        chars = flat[inside[1:-1]]
        chars = _LOWER_BYTE[chars] if lower else chars
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(chars)) - np.repeat(first, lengths)
        if lengths.max() <= _PLACES:
            value = _AT_PLACE[(place << 8) | chars]
        else:
            value = np.where(place < _PLACES, _AT_PLACE[(np.minimum(place, _PLACES - 1) << 8) | chars], mix(((place << 8) | chars).astype(np.uint64)))
        found.append(np.add.reduceat(value, first))
        lengths_of.append(lengths)
    if not found:
        return np.zeros(0, np.uint64), many
    with np.errstate(over="ignore"):
        return mix(np.concatenate(found) + np.concatenate(lengths_of).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), many


def _runs(texts: list[bytes], piece: int) -> Iterator[tuple[int, int]]:
    """Numbers of texts, from and to, that are about `piece` bytes together (one text at least)."""
    lo = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= piece:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHasher:
    """64-bit hashes of words, remembered up to about `limit` distinct words so that memory stays bounded."""

    def __init__(self, limit: int = 400_000) -> None:
        self.seen, self.limit = _Memo(), limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > self.limit:
            self.seen.clear()
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of an Arrow batch that each hold about `limit` bytes of `column` (one row at least)."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def grouped(items: list, size: Callable, limit: int) -> Iterator[list]:
    """Runs of items of about `limit` in all (one item at least)."""
    out, total = [], 0
    for x in items:
        out.append(x)
        total += size(x)
        if total >= limit:
            yield out
            out, total = [], 0
    if out:
        yield out
