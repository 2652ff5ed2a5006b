"""Streaming twins: coverage and bins of readings that arrive continuously."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(readings: DataFrame, keys: list[str], ts: str, value: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Mean, SD and count per source and tumbling bin; a bin is final once the watermark has passed it."""
    v = F.when(~F.isnan(value), F.col(value))
    return (
        readings.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w"))
        .agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
        .select(*keys, F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), "mean", "sd", "n")
    )


def stream_coverage(readings: DataFrame, keys: list[str], ts: str, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches without gaps as sessions.  A session's end is its last reading plus the gap, and it
    splits at a step of the gap itself; the batch operator splits only beyond it."""
    return (
        readings.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end_at"))
        .select(*keys, F.col("w.start").alias("start_at"), "end_at", "n")
    )
