"""Streaming extensions; the batch operators stay usable on each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_levels(events: DataFrame, at: str = "ts", value: str = "value", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count, sum and RMS for each tumbling window and event type; rows later than the watermark are left out."""
    t = events.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    v = F.col(value)
    return t.groupBy(F.window("_t", width), "event_type").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.sqrt(F.avg(v * v)).alias("rms")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total", "rms"
    )


def fill_forward(events: DataFrame, key: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """Each row with the last value of its key that was not null, 0 before the first; the state is one number for each key."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0.0
        out = []
        for pdf in frames:
            out.append(pdf)
        pdf = pd.concat(out).sort_values(order)
        filled = []
        for v in pdf[value]:
            last = last if pd.isna(v) else float(v)
            filled.append(last)
        state.update((last,))
        yield pd.DataFrame({key: k[0], order: pdf[order].to_numpy(), "filled": filled})

    kinds = dict(events.dtypes)
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {order} {kinds[order]}, filled double", "last double", "append", GroupStateTimeout.NoTimeout
    )
