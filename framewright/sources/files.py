"""File sets: any store that Spark reads, one row for each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ALL_EXTS, basename, extension, modality


def scan(spark: SparkSession, folder: str, *, content: bool = False, exts: list[str] = ALL_EXTS) -> DataFrame:
    """path, name, ext, modality, length (and content) of the files of a folder, not of its subfolders, by name.

    Without content only the listing is read (Spark prunes the column, so no file is opened).
    """
    files = spark.read.format("binaryFile").load(folder)
    cols = ["path", basename(F.col("path")).alias("name"), extension(F.col("path")).alias("ext"), modality(F.col("path")).alias("modality"), "length"]
    rows = files.select(*cols, *(["content"] if content else []))
    return rows.filter(F.col("ext").isin(exts)).orderBy("name")


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file with its content; an unsupported extension is an error."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", "content", extension(F.col("path")).alias("ext"))
    bad = F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path")))
    return f.withColumn("modality", F.when(F.col("ext").isin(ALL_EXTS), modality(F.col("path"))).otherwise(bad))


def has_stream(streams: Column, kind: str = "audio") -> Column:
    """Whether an array of stream structs has one of a type; null counts as none."""
    return F.coalesce(F.exists(streams, lambda s: s["type"] == kind), F.lit(False))
