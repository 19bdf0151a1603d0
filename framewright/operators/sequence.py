"""Ordered samples and frames: gaps, chunks, blocks, overlapping frames, tiles. Windows are always inside a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interpolate(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds `filled`: linear between the nearest values around, held at both ends; null only if a key has no value."""
    w = W.partitionBy(*keys).orderBy(at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("i"), F.col(value).alias("v")))
    prev = F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    nxt = F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))
    a = F.when(F.col("_n.i") > F.col("_p.i"), (F.col(at) - F.col("_p.i")) / (F.col("_n.i") - F.col("_p.i"))).otherwise(F.lit(0.0))
    mixed = (1 - a) * F.col("_p.v") + a * F.col("_n.v")
    return df.withColumn("_p", prev).withColumn("_n", nxt).withColumn("filled", F.coalesce(mixed, F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")


def blend(prev: Column, nxt: Column, a: Column) -> Column:
    return F.least(F.greatest((1 - a) * prev + a * nxt, F.lit(0.0)), F.lit(1.0))


def forward_fill(df: DataFrame, keys: list[str], at: str, value: str, default: float = 0.0) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("filled", F.coalesce(F.last(value, True).over(w), F.lit(default)))


def number(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Rows of a key numbered from 0."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1)


def chunks(df: DataFrame, keys: list[str], at: str, value: str, size: int = 8) -> DataFrame:
    """(keys, chunk, start, length, values): tumbling by position; the last one may be short."""
    grouped = df.groupBy(*keys, F.floor(F.col(at) / size).alias("chunk")).agg(
        F.min(at).alias("start"), F.count("*").alias("length"), F.sort_array(F.collect_list(F.struct(at, value))).alias("_v")
    )
    return grouped.withColumn("values", F.transform("_v", lambda s: s[value])).drop("_v")


def blocks(df: DataFrame, keys: list[str], at: str, size: int = 1024) -> DataFrame:
    """(keys, block, length, pts): pts is the number of samples before the block."""
    counted = df.groupBy(*keys, F.floor(F.col(at) / size).alias("block")).agg(F.count("*").alias("length"))
    w = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return counted.withColumn("pts", F.coalesce(F.sum("length").over(w), F.lit(0).cast("bigint")))


def reshape(df: DataFrame, keys: list[str], at: str, size: int = 128) -> DataFrame:
    """Drops the tail beyond a multiple of `size` and adds channel and position of a row-major (size, n) layout."""
    n = F.floor(F.count("*").over(W.partitionBy(*keys)) / size)
    t = df.withColumn("_n", n).filter(F.col(at) < F.col("_n") * size)
    return t.withColumn("channel", F.floor(F.col(at) / F.col("_n"))).withColumn("position", F.pmod(F.col(at), F.col("_n"))).drop("_n")


def pad_short(df: DataFrame, key: str, at: str, value: str, size: int) -> DataFrame:
    """(key, at, value) with zeros after the end of those sequences that are shorter than `size`; `at` counts from 0."""
    df = df.select(key, F.col(at).cast("bigint").alias(at), F.col(value).cast("double").alias(value))
    short = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < size)
    return df.unionByName(short.select(key, F.explode(F.sequence(F.col("_n"), F.lit(size - 1).cast("bigint"))).alias(at), F.lit(0.0).alias(value)))


def frames(df: DataFrame, keys: list[str], at: str, size: int = 512, hop: int = 128) -> DataFrame:
    """One row for each frame that a sample is in: frame, offset. Frames that would run over the end are left out."""
    n = F.count("*").over(W.partitionBy(*keys))
    last = F.floor((F.col("_n") - size) / hop)
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(at) - size + 1) / hop))
    high = F.least(last, F.floor(F.col(at) / hop))
    t = df.withColumn("_n", n).withColumn("_low", low).withColumn("_high", high).filter("_high >= _low")
    return t.withColumn("frame", F.explode(F.sequence("_low", "_high"))).withColumn("offset", F.col(at) - F.col("frame") * hop).drop("_n", "_low", "_high")


def pre_emphasis(df: DataFrame, keys: list[str], at: str, value: str, a: float = 0.97) -> DataFrame:
    return df.withColumn("emphasised", F.col(value) - a * F.coalesce(F.lag(value).over(W.partitionBy(*keys).orderBy(at)), F.lit(0.0)))


BLOCK = 256


def recursion(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float, float]) -> np.ndarray:
    """The filter a0 y[t] = b0 x[t] + b1 x[t-1] + b2 x[t-2] - a1 y[t-1] - a2 y[t-2], block by block.

    Inside a block outputs are a matrix times the inputs plus a matrix times the two numbers that the block before left.
    """
    b0, b1, b2, a1, a2 = (v / a[0] for v in (*b, *a[1:]))
    step = np.array([[-a1, 1.0], [-a2, 0.0]])  # how the state moves on without input
    push = np.array([b1 - a1 * b0, b2 - a2 * b0])  # what an input adds to the next state
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    impulse = np.array([b0, *((p @ push)[0] for p in powers[: BLOCK - 1])])
    lag = np.arange(BLOCK)[None, :] - np.arange(BLOCK)[:, None]
    inside = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)  # row: input, column: output
    left = np.stack([powers[BLOCK - 1 - i] @ push for i in range(BLOCK)])
    blocks = np.pad(x.astype(float), (0, -len(x) % BLOCK)).reshape(-1, BLOCK)
    out, ends = blocks @ inside, blocks @ left
    carried = np.stack([p[0] for p in powers[:BLOCK]], 1)
    state = np.zeros(2)
    for k in range(len(blocks)):
        out[k] += state @ carried
        state = powers[BLOCK] @ state + ends[k]
    return out.reshape(-1)[: len(x)]


def de_emphasis(df: DataFrame, key: str, at: str, value: str, a: float = 0.97) -> DataFrame:
    """The inverse recursion y[t] = x[t] + a y[t-1]; a signal goes to one task, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        return pd.DataFrame({key: pdf[key], at: pdf[at], "restored": recursion(pdf[value].to_numpy(float), (1.0, 0.0, 0.0), (1.0, -a, 0.0))})

    kinds = dict(df.dtypes)
    return df.select(key, at, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, restored double")


def frame_seed(base: int, index: Column) -> Column:
    return F.lit(base).cast("bigint").bitwiseXOR(index.cast("bigint"))


def tiles(df: DataFrame, size: int) -> DataFrame:
    """Rows (ty, tx, y, x) of tiles to rows (row, col) of the image."""
    return df.withColumn("row", F.col("ty") * size + F.col("y")).withColumn("col", F.col("tx") * size + F.col("x"))


def from_reference(df: DataFrame, keys: list[str], at: str, ref: str, value: str) -> DataFrame:
    """Rows with a reference joined to the row it names: adds ref_value. Rows that name a missing row are left out."""
    there = df.select(*keys, F.col(at).alias(ref), F.col(value).alias("ref_value"))
    return df.filter(F.col(ref).isNotNull()).join(there, [*keys, ref])


def missing_references(df: DataFrame, keys: list[str], at: str, ref: str) -> DataFrame:
    return df.filter(F.col(ref).isNotNull()).join(df.select(*keys, F.col(at).alias(ref)), [*keys, ref], "left_anti")


def resample(df: DataFrame, keys: list[str], at: str, value: str, source: int, target: int) -> DataFrame:
    """Linear resampling of samples numbered from 0: each gap gives the new samples that fall into it."""
    n = F.count("*").over(W.partitionBy(*keys))
    w = W.partitionBy(*keys).orderBy(at)
    t = df.withColumn("_n", n).withColumn("_m", F.floor(F.col("_n") * target / source)).withColumn("_v2", F.coalesce(F.lead(value).over(w), F.col(value)))
    # new sample j lies at j * (n - 1) / (m - 1)
    step = F.when(F.col("_m") > 1, (F.col("_n") - 1) / (F.col("_m") - 1)).otherwise(F.lit(0.0))
    t = t.withColumn("_s", step)
    low = F.when(F.col("_s") > 0, F.ceil(F.col(at) / F.col("_s") - 1e-9)).otherwise(F.lit(0))
    high = F.when(F.col("_s") > 0, F.ceil((F.col(at) + 1) / F.col("_s") - 1e-9) - 1).otherwise(F.col("_m") - 1)
    high = F.when(F.col(at) == F.col("_n") - 1, F.col("_m") - 1).otherwise(high)
    t = t.withColumn("_low", low.cast("bigint")).withColumn("_high", F.least(high, F.col("_m") - 1).cast("bigint")).filter("_high >= _low")
    t = t.withColumn("j", F.explode(F.sequence("_low", "_high")))
    a = F.least(F.greatest(F.col("j") * F.col("_s") - F.col(at), F.lit(0.0)), F.lit(1.0))
    return t.select(*keys, "j", (F.col(value) * (1 - a) + F.col("_v2") * a).alias("value"))

