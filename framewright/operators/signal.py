"""Signals: levels, spectra, speaker embeddings, post-filtering. Sums are Spark's; only transforms of one signal use numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as s_
from . import latents as la
from .sequence import frames, recursion

#: Coefficients of the embedding, its frequency range, the band searched for the pitch.
COEFFICIENTS, MEL_LOW, MEL_HIGH = 20, 80.0, 7600.0
PITCH_LOW, PITCH_HIGH = 80.0, 500.0


def rms(value: Column) -> Column:
    return F.sqrt(F.avg(value * value))


def rms_db(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(1e-8)))


def levels(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rms, rms_db and mean_abs for each key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(rms(v).alias("rms"), F.avg(F.abs(v)).alias("mean_abs")).withColumn("rms_db", rms_db(F.col("rms")))


def noise_floor(df: DataFrame, keys: list[str], magnitude: str, part: float = 0.10) -> DataFrame:
    """The 10th percentile (linear between ranks) of the magnitudes of each key, exactly; null magnitudes don't count.

    Magnitudes are counted in 64 buckets for each power of two, which tells where the ranks lie; only the values of those
    buckets are then counted one by one. No task sees all values of a key.
    """
    m = F.col(magnitude)
    bucket = F.when(m > 0, F.floor(F.log2(m) * 64)).otherwise(F.lit(-1 << 40)).cast("bigint")
    t = df.filter(m.isNotNull()).select(*keys, m.alias("_m"), bucket.alias("_b"))
    up = lambda what: W.partitionBy(*keys).orderBy(what).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = t.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(up("_b")))
    n = F.sum("_c").over(W.partitionBy(*keys))
    counted = counted.withColumn("_x", (n - 1) * F.lit(part)).withColumn("_low", F.floor("_x")).withColumn("_high", F.ceil("_x"))
    holds = lambda rank: (F.col(rank) >= F.col("_upto") - F.col("_c")) & (F.col(rank) < F.col("_upto"))
    hit = counted.filter(holds("_low") | holds("_high")).select(*keys, "_b", (F.col("_upto") - F.col("_c")).alias("_base"), "_x", "_low", "_high")
    # two buckets for each key at most
    values = t.join(hit, [*keys, "_b"]).groupBy(*keys, "_b", "_base", "_x", "_low", "_high", "_m").agg(F.count("*").alias("_c"))
    inside = W.partitionBy(*keys, "_b").orderBy("_m").rowsBetween(W.unboundedPreceding, W.currentRow)
    values = values.withColumn("_upto", F.col("_base") + F.sum("_c").over(inside))
    found = values.groupBy(*keys).agg(*[F.max(F.when(holds(r), F.col("_m"))).alias(f"_v{r}") for r in ("_low", "_high")], F.first("_x").alias("_x"), F.first("_low").alias("_low"))
    return found.select(*keys, (F.col("_v_low") + (F.col("_v_high") - F.col("_v_low")) * (F.col("_x") - F.col("_low"))).alias("noise"))


def wiener_gain(m: Column, noise: Column, a: float = 0.85) -> Column:
    return a * F.greatest(m - noise, F.lit(0.0)) / F.greatest(m, F.lit(1e-10)) + (1 - a)


def dominant(df: DataFrame, keys: list[str], freq: str, power: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The frequency with the most power, the lowest on ties; within a band, both ends included, if one is given."""
    t = df.filter(F.col(freq).between(low, high)) if low is not None else df
    return t.groupBy(*keys).agg(F.max_by(freq, F.struct(F.col(power), -F.col(freq))).alias("dominant"))


def mono(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The mean over channels of each (keys)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def taper(size: int, part: float = 0.25) -> np.ndarray:
    """A periodic window that is flat but for cosine flanks over `part` of its length."""
    edge = np.minimum(np.arange(size), size - np.arange(size))
    return np.where(edge >= part * size / 2, 1.0, 0.5 - 0.5 * np.cos(2 * np.pi * edge / (part * size)))


def spectrum(df: DataFrame, key: str, at: str, value: str, rate: int, size: int = 512, hop: int = 256) -> DataFrame:
    """(key, bin, freq, power): the mean power spectrum over frames, each less its mean and tapered; a sine of amplitude a has a peak of a * a / 2.

    Frames are transformed where they are gathered, each for itself, and averaged by Spark. Signals shorter than a frame have no row.
    """
    gathered = frames(df.select(key, at, value), [key], at, size, hop).groupBy(key, "frame").agg(F.sort_array(F.collect_list(F.struct("offset", value))).alias("_x"))
    gathered = gathered.select(key, F.transform("_x", lambda s: s[value]).alias("x"))
    window = taper(size)
    scale = 1.0 / window.sum() ** 2

    @F.pandas_udf("array<double>")
    def power(x: pd.Series) -> pd.Series:
        t = np.stack(x.to_numpy()).astype(float)
        m = np.abs(np.fft.rfft((t - t.mean(1, keepdims=True)) * window, axis=1)) ** 2 * scale
        m[:, 1 : size // 2 + size % 2] *= 2  # all but the first, and the last of an even size
        return pd.Series(list(m))

    each = gathered.select(key, F.posexplode(power("x")).alias("bin", "p"))
    return each.groupBy(key, "bin").agg(F.avg("p").alias("power")).withColumn("freq", F.col("bin") * (rate / size))


def mel_filters(rate: int, size: int, n: int = COEFFICIENTS) -> list[tuple[int, int, float]]:
    """(filter, bin, weight) of triangles between bins: the corners, evenly spaced on the mel scale, are rounded down to whole bins."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    corners = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(MEL_LOW), mel(min(MEL_HIGH, rate / 2)), n + 2)]
    last = size // 2
    at = [min(max(math.floor(f / (rate / 2) * last), 0), last) for f in corners]
    out = []
    for k, (lo, mid, hi) in enumerate(zip(at, at[1:], at[2:])):
        out += [(k, b, (b - lo) / (mid - lo)) for b in range(lo + 1, mid)]
        out += [(k, b, (hi - b) / (hi - mid)) for b in range(mid, hi)]
    return out


def embedding(power: DataFrame, key: str, rate: int, size: int = 512) -> DataFrame:
    """(key, embedding): the cosine transform of log mel energies, of unit length. Tables of fixed size are broadcast."""
    spark = power.sparkSession
    filters = spark.createDataFrame(mel_filters(rate, size), "m int, bin int, w double")
    cosines = spark.createDataFrame(
        [(k, m, math.sqrt((1 if k == 0 else 2) / COEFFICIENTS) * math.cos(math.pi * k * (2 * m + 1) / (2 * COEFFICIENTS))) for k in range(COEFFICIENTS) for m in range(COEFFICIENTS)],
        "_k int, m int, w double",
    )
    every = power.select(key).distinct().withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(COEFFICIENTS - 1))))
    energy = power.join(F.broadcast(filters), "bin").groupBy(key, "m").agg(F.sum(F.col("power") * F.col("w")).alias("e"))
    logs = every.join(energy, [key, "m"], "left").withColumn("e", F.log(F.greatest(F.coalesce("e", F.lit(0.0)), F.lit(1e-10))))
    c = logs.join(F.broadcast(cosines), "m").groupBy(key, "_k").agg(F.sum(F.col("e") * F.col("w")).alias("c"))
    v = c.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_k", "c"))).alias("_v")).select(key, F.transform("_v", lambda s: s["c"]).alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.select(key, F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")).alias("embedding"))


def pitch(power: DataFrame, key: str) -> DataFrame:
    """(key, f0): the strongest frequency of the speech band, the lowest of equal ones."""
    return dominant(power, [key], "freq", "power", PITCH_LOW, PITCH_HIGH).withColumnRenamed("dominant", "f0")


def speaking_stats(df: DataFrame, transcripts: DataFrame, key: str, at: str, value: str, rate: int, size: int = 1024, hop: int = 512, text: str = "text") -> DataFrame:
    """(key, wpm, f0, rms_db) of the signals that have a transcript: words a minute (50 to 350), pitch, loudness.

    Pitch is 0 for signals shorter than a frame. transcripts: (key, text), one row for each key; a null text has no words.
    """
    n = s_.word_count(F.coalesce(F.col(text), F.lit("")))
    level = df.groupBy(key).agg(rms(F.col(value)).alias("_rms"), (F.count("*") / rate).alias("_seconds"))
    heard = level.join(pitch(spectrum(df, key, at, value, rate, size, hop), key), key, "left").join(transcripts.select(key, n.alias("_n")), key)
    return heard.select(key, s_.words_per_minute(F.col("_n"), F.col("_seconds")).alias("wpm"), F.coalesce("f0", F.lit(0.0)).alias("f0"), rms_db(F.col("_rms")).alias("rms_db"))


def post_filter(df: DataFrame, key: str, at: str, value: str, rate: int) -> DataFrame:
    """(key, at, filtered): emphasis, a 3 dB bell at 4 kHz, spectral noise suppression, contrast, de-emphasis, level restored.

    One signal goes to one task, as the recursions run over all of it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        x = pdf[value].to_numpy(float)
        before = math.sqrt((x**2).mean()) if len(x) else 0.0
        y = np.append(x[:1], x[1:] - 0.97 * x[:-1])
        amp, w0 = 10 ** (3 / 40), 2 * math.pi * min(4000.0, rate * 0.45) / rate
        al = math.sin(w0) / (2 * 0.707)
        b, a = (1 + al * amp, -2 * math.cos(w0), 1 - al * amp), (1 + al / amp, -2 * math.cos(w0), 1 - al / amp)
        y = recursion(y, b, a)
        size, hop = 512, 128
        if len(y) >= size:
            hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
            padded = np.pad(y, (size // 2, size // 2 + (-len(y)) % hop), mode="reflect")
            starts = np.arange(0, len(padded) - size + 1, hop)
            spec = np.fft.rfft(padded[starts[:, None] + np.arange(size)] * hann, axis=1)
            mag = np.abs(spec)
            noise = np.quantile(mag, 0.10, axis=0)
            gain = 0.85 * np.maximum(mag - noise, 0) / np.maximum(mag, 1e-10) + 0.15
            back = np.fft.irfft(spec * gain, size, axis=1) * hann
            out, norm = np.zeros(len(padded)), np.zeros(len(padded))
            for s, f in zip(starts, back):
                out[s : s + size] += f
                norm[s : s + size] += hann**2
            y = (out / np.maximum(norm, 1e-8))[size // 2 : size // 2 + len(y)]
        t = y * math.pi / 2
        y = np.sin(t + (50 / 750) * np.sin(4 * t))
        z = recursion(y, (1.0, 0.0, 0.0), (1.0, -0.97, 0.0))
        after = math.sqrt((z**2).mean()) if len(z) else 0.0
        return pd.DataFrame({key: pdf[key], at: pdf[at], "filtered": np.clip(z * (before / after) if after > 1e-8 else z, -1, 1)})

    kinds = dict(df.dtypes)
    return df.select(key, at, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, filtered double")


def _high_passed(x: np.ndarray, rate: int, cutoff: float) -> np.ndarray:
    """A fourth-order Butterworth high-pass as two second-order sections."""
    w0 = 2 * math.pi * min(cutoff, rate * 0.49) / rate
    cs = math.cos(w0)
    for q in (0.541196100146197, 1.306562964876377):  # of the two sections of order four
        al = math.sin(w0) / (2 * q)
        x = recursion(x, ((1 + cs) / 2, -(1 + cs), (1 + cs) / 2), (1 + al, -2 * cs, 1 - al))
    return x


def high_pass(df: DataFrame, key: str, at: str, value: str, rate: int, cutoff: float = 8000.0) -> DataFrame:
    """(key, at, high); a signal goes to one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        return pd.DataFrame({key: pdf[key], at: pdf[at], "high": _high_passed(pdf[value].to_numpy(float), rate, cutoff)})

    kinds = dict(df.dtypes)
    return df.select(key, at, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {at} {kinds[at]}, high double")


#: Fixed values of the high-frequency layer: what its seed is combined with, projections, samples of a column, amplitude.
HIGH_SALT, HIGH_PROJECTIONS, HIGH_CHUNK, HIGH_SCALE = 0xCAFEBABE, 32, 128, 0.02


def high_layer(df: DataFrame, key: str, at: str, value: str, rate: int, seed: int, chunk: int = HIGH_CHUNK, projections: int = HIGH_PROJECTIONS) -> DataFrame:
    """(key, chunks, bits): what lies above 8 kHz as signs of random projections.

    The high-passed signal, cut to a multiple of `chunk`, is laid out row by row as (chunk, chunks); each column is rotated and
    projected, and the signs are packed column after column. Signals shorter than a chunk give no bits.
    """
    turn, sign = la.rotation(chunk, seed ^ HIGH_SALT), la.signs(chunk, projections, seed ^ HIGH_SALT)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _high_passed(pdf.sort_values(at)[value].to_numpy(float), rate, 8000.0)
        n = len(y) // chunk
        columns = y[: n * chunk].reshape(chunk, n).T
        return pd.DataFrame({key: pdf[key].iloc[:1], "chunks": [n], "bits": [np.packbits(columns @ turn.T @ sign >= 0).tobytes()]})

    return df.select(key, at, value).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, chunks bigint, bits binary")


def from_high_layer(layers: DataFrame, key: str, seed: int, chunk: int = HIGH_CHUNK, projections: int = HIGH_PROJECTIONS, scale: float = HIGH_SCALE) -> DataFrame:
    """(key, idx, correction): the signal that the bits stand for, to be added to a decoded one (latents.add_to_prefix)."""
    turn, sign = la.rotation(chunk, seed ^ HIGH_SALT), la.signs(chunk, projections, seed ^ HIGH_SALT)

    @F.pandas_udf("array<double>")
    def restored(bits: pd.Series) -> pd.Series:
        out = []
        for b in bits:
            n = len(b) * 8 // projections
            plus = np.unpackbits(np.frombuffer(b, np.uint8))[: n * projections].reshape(n, projections) * 2.0 - 1
            out.append(((plus @ sign.T) * (scale / projections) @ turn).T.reshape(-1))
        return pd.Series(out)

    return layers.select(key, F.posexplode(restored("bits")).alias("idx", "correction"))
