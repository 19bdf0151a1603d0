"""Rules and reports: size tiers, bandwidth floors, the model catalogue, compression and fidelity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import AUDIO_EXTS, basename, clamp, extension, is_music, is_speech, modality, sha12, thousands
from ..operators.latents import psnr, verdict

#: Lower end (percent) of each tier, quality, norm bits, direction bits, residual, downsampling, kbps, lossless.
TIERS = [
    (0.0, 1, 3, 3, False, 4, 1.5, False),
    (1.0, 2, 3, 3, True, 4, 3.0, False),
    (3.0, 3, 4, 4, True, 2, 6.0, False),
    (8.0, 5, 6, 6, True, 1, 12.0, False),
    (15.0, 5, 8, 8, True, 1, 24.0, False),
    (90.0, 5, 8, 8, True, 1, 24.0, True),
]
#: The lowest bandwidths (kbps) for a batch with speech, and for one with music.
SPEECH_FLOOR, MUSIC_FLOOR = 12.0, 24.0
FIELDS = ["quality", "norm_bits", "dir_bits", "with_residual", "residual_downsample", "audio_bandwidth", "lossless"]


def rules(spark: SparkSession) -> DataFrame:
    """The tiers as a table with half-open ranges."""
    ends = [t[0] for t in TIERS[1:]] + [float("inf")]
    rows = [(float("-inf") if i == 0 else t[0], ends[i], *t[1:]) for i, t in enumerate(TIERS)]
    return spark.createDataFrame(rows, "lo_pct double, hi_pct double, quality int, norm_bits int, dir_bits int, with_residual boolean, residual_downsample int, audio_bandwidth double, lossless boolean").withColumn("use_turbo", F.lit(False))


def tier_params(pct: Column) -> Column:
    """The parameters of a target size as a struct; a chain of conditions, so no join is needed."""
    out = None
    for low, *values in reversed(TIERS):
        s = F.struct(*[F.lit(v).alias(n) for n, v in zip(FIELDS, values)])
        out = s if out is None else F.when(pct < _next(low), s).otherwise(out)
    return out


def _next(low: float) -> float:
    lows = [t[0] for t in TIERS]
    return lows[lows.index(low) + 1]


def target_bytes(size: Column, pct: Column) -> Column:
    return (size * pct / 100).cast("bigint")


def describe(p: Column) -> Column:
    """A tier's parameters in words; parts that don't apply are left out. No tier asks for the turbo mode."""
    text = lambda name: p[name].cast("string")
    return F.concat_ws(
        ", ",
        F.concat(F.lit("quality="), text("quality")),
        F.concat(F.lit("norm_bits="), text("norm_bits")),
        F.concat(F.lit("dir_bits="), text("dir_bits")),
        F.when(p["with_residual"], F.concat(F.lit("residual(downsample="), text("residual_downsample"), F.lit(")"))).otherwise("no_residual"),
        F.concat(F.lit("audio="), text("audio_bandwidth"), F.lit("kbps")),
        F.when(p["lossless"], "lossless"),
    )


def bandwidth(files: DataFrame, path: str, asked: float) -> DataFrame:
    """One row (has_speech, has_music, bandwidth): one speech or music file lifts the whole batch."""
    audio = extension(F.col(path)).isin(AUDIO_EXTS)
    flags = files.agg(F.coalesce(F.bool_or(audio & is_speech(F.col(path))), F.lit(False)).alias("has_speech"), F.coalesce(F.bool_or(audio & is_music(F.col(path))), F.lit(False)).alias("has_music"))
    return flags.withColumn("bandwidth", F.greatest(F.lit(asked), F.when(F.col("has_speech"), SPEECH_FLOOR).otherwise(0.0), F.when(F.col("has_music"), MUSIC_FLOOR).otherwise(0.0)))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The model catalogue, a JSON object of objects, as rows sorted by id."""
    entry = "struct<type:string,model_name:string,quality:int,sample_rate:int,description:string,local_path:string>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("id", "m")).select("id", "m.*").orderBy("id")


def expert_id(kind: Column, quality: Column) -> Column:
    """The catalogue's name for a kind of model; another kind is an error."""
    return F.when(kind == "compressai", F.concat(F.lit("img_mbt2018_q"), F.coalesce(quality, F.lit(1)).cast("string"))).when(kind == "encodec", "aud_encodec_24k").otherwise(
        F.raise_error(F.concat(F.lit("unknown kind: "), kind))
    )


def listed(models: DataFrame, cached_paths: DataFrame) -> DataFrame:
    """Catalogue rows with a flag for files that are there."""
    return models.join(cached_paths.select(F.col("path").alias("local_path"), F.lit(True).alias("_there")).distinct(), "local_path", "left").withColumn("cached", F.coalesce("_there", F.lit(False))).drop("_there")


def known_only(rows: DataFrame, models: DataFrame, key: str) -> DataFrame:
    return rows.join(models.select(key), key, "left_semi")


def unknown(rows: DataFrame, models: DataFrame, key: str) -> DataFrame:
    return rows.join(models.select(key), key, "left_anti")


def ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, (1 - after / before) * 100).otherwise(F.lit(0.0))


def share_of_target(actual: Column, target: Column) -> Column:
    return F.when(target > 0, actual / target * 100).otherwise(F.lit(float("inf")))


def counts(files: DataFrame, path: str) -> DataFrame:
    """Images, and all other files as audio."""
    m = modality(F.col(path))
    return files.filter(m.isNotNull()).agg(F.count_if(m == "image").alias("images"), F.count_if(m != "image").alias("audio"))


def needs_residual(asked: Column, got_psnr: Column, target_psnr: Column) -> Column:
    return asked | F.coalesce(got_psnr < target_psnr, F.lit(False))


def match_originals(entries: DataFrame, originals: DataFrame) -> DataFrame:
    """Entries with the path of the original of the same base name, or null; all entries stay. One original for each name."""
    one = originals.groupBy(basename(F.col("path")).alias("name")).agg(F.max("path").alias("original"))
    return entries.join(one, "name", "left")


def by_position(entries: DataFrame, originals: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Entries with the original of the same position in a list, or null beyond its end; all entries stay."""
    return entries.join(originals.select(*keys, at, "original"), [*keys, at], "left")


def psnr_report(entries: DataFrame, original: str, restored: str, is_image: Column) -> DataFrame:
    """entries with psnr and verdict: images are compared value by value, both limited to 0..1; others, and those without an
    original, have neither."""
    d = F.zip_with(F.col(original), F.col(restored), lambda a, b: clamp(a.cast("double"), 0.0, 1.0) - clamp(b.cast("double"), 0.0, 1.0))
    mse = F.aggregate(d, F.lit(0.0), lambda a, v: a + v * v) / F.size(original)
    out = entries.withColumn("psnr", F.when(is_image & F.col(original).isNotNull(), psnr(mse)))
    return out.withColumn("verdict", verdict(F.col("psnr")))


def first_by_extension(originals: DataFrame, recovered: DataFrame) -> DataFrame:
    """Each original with the first recovered file (by path) of its extension; none: no row."""
    first = recovered.groupBy(extension(F.col("path")).alias("ext")).agg(F.min("path").alias("recovered"))
    return originals.withColumn("ext", extension(F.col("path"))).join(first, "ext")


def fidelity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds short hashes of two contents and whether they are equal."""
    return pairs.withColumn("hash_a", sha12(F.col(a))).withColumn("hash_b", sha12(F.col(b))).withColumn("exact", F.col("hash_a") == F.col("hash_b"))


def fidelity_report(pairs: DataFrame, a: str, b: str, lossless: Column) -> DataFrame:
    """fidelity() of the rows that were packed without loss, with the outcome in words; other rows have no fidelity step."""
    rows = fidelity(pairs.filter(lossless), a, b)
    return rows.withColumn("outcome", F.when(F.col("exact"), "EXACT MATCH").otherwise("LOSSY (AI-reconstructed)"))


def saved_line(before: Column, after: Column) -> Column:
    """What is printed about a container: its bytes and how much smaller it is."""
    return F.format_string("%s bytes, %.1f%% smaller", thousands(after), ratio(before, after).cast("double"))


def target_line(target: Column, actual: Column) -> Column:
    return F.format_string("Target: %s bytes / Actual: %s bytes (%.1f%% of target)", thousands(target), thousands(actual), share_of_target(actual, target).cast("double"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")
