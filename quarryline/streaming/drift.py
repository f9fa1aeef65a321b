"""Running counts of events by window, for drift over time; an addition to the batch audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, category: str, value: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and category: rows, sum and mean of value. Works on streams (rows later than `late` are dropped by the watermark) and tables."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    by = marked.groupBy(F.window(time, window).alias("w"), category).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return by.select(F.col("w.start").alias("window_start"), category, "n", "total", "mean")


def without_repeats(events: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Events once by key; on a stream, repeats within the watermark's time go."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
