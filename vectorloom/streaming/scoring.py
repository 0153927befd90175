"""Streams: scoring with a fitted model, windowed profiles, and metrics as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import metrics


def score_stream(spark: SparkSession, path: str, schema: str, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New Parquet files of a folder as a scored stream. Predictions are projections, so the stream keeps no state."""
    return predict(spark.readStream.schema(schema).parquet(path))


def windowed_profile(stream: DataFrame, at_col: str, value_col: str, window: str = "1 hour", late: str = "2 hours", by: list[str] = ()) -> DataFrame:
    """(window start and end, by, n, mean, min, max); rows later than the watermark are left out, closed windows leave the state."""
    w = stream.withWatermark(at_col, late).groupBy(F.window(at_col, window).alias("w"), *by)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias("mean"), F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "min", "max")


def follow_metrics(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Give the rows of each batch of new metrics files to ``sink`` (idempotent by batch number).

    Files are checked as ``read_metrics`` does: a bad one stops the stream.
    """
    files = spark.readStream.text(path, wholetext=True)
    return files.writeStream.foreachBatch(lambda batch, n: sink(metrics.checked(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
