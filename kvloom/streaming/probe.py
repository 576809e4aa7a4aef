"""Streams against a static table: the outer-row join as a stream, and merged counts over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_semi(stream: DataFrame, inner: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a stream whose key is in a static table; no state is kept between batches."""
    return stream.join(inner.select(key).distinct(), key, "left_semi")


def windowed_matches(stream: DataFrame, inner: DataFrame, time: str, width: str, late: str, key: str = "key") -> DataFrame:
    """window_start, n: matches per event-time window; rows later than `late` are dropped by the watermark."""
    hit = stream_semi(stream.withWatermark(time, late), inner, key)
    return hit.groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")
