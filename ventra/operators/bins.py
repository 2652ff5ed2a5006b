"""Fixed bins over time: session statistics, aligned bins, down-sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import present


def session_stats(readings: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample SD, least and largest of the readings of each source."""
    v = present(value)
    return readings.where(v.isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def time_bins(readings: DataFrame, spans: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """Statistics per bin from ``lo`` to past ``hi`` of ``spans`` (keys, lo, hi); empty bins have n 0.

    Bins are half open but for the last, which takes its end.  Readings outside the bins don't count.
    The bin number is computed, so readings meet their bin by equality.
    """
    n = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / width)).cast("bigint")
    grid = spans.where("lo is not null").withColumn("n_bins", n)
    spine = grid.select(*keys, "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("bin"))
    v = present(value)
    inside = readings.where(v.isNotNull()).join(grid, keys).where((F.col(time) >= F.col("lo")) & (F.col(time) <= F.col("lo") + F.col("n_bins") * width))
    at = F.least(F.floor((F.col(time) - F.col("lo")) / width), F.col("n_bins") - 1)
    stats = inside.groupBy(*keys, at.alias("bin")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n")
    )
    rows = spine.join(stats, [*keys, "bin"], "left")
    start = F.col("lo") + F.col("bin") * width
    return rows.select(*keys, start.alias("bin_start"), (start + width).alias("bin_end"), "mean", "sd", "min", "max", F.coalesce("n", F.lit(0)).alias("n"))


def aligned_bins(readings: DataFrame, anchors: DataFrame, keys: list[str], time: str, signals: list[str], before: float, after: float, width: float) -> DataFrame:
    """Mean and standard error per bin around an anchor time (``keys, anchor``), all bins present.

    Half-open bins from ``-before`` on; a reading on the last edge is left out; one reading has no error.
    """
    n = int((before + after) / width)
    rel = F.col(time) - F.col("anchor")
    at = F.floor((rel + before) / width)
    inside = readings.join(anchors, keys).where((rel >= -before) & (at < n))
    aggs: list[Column] = []
    for s in signals:
        v = present(s)
        aggs += [F.avg(v).alias(f"{s}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{s}_sem")]
    stats = inside.groupBy(*keys, at.alias("bin")).agg(*aggs)
    spine = anchors.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    start = F.col("bin") * width - before
    return spine.join(stats, [*keys, "bin"], "left").select(*keys, start.alias("bin_start"), (start + width).alias("bin_end"), *[f"{s}_{k}" for s in signals for k in ("mean", "sem")])


def down_sample(readings: DataFrame, keys: list[str], time: str, line: str, value: str, rate: float) -> DataFrame:
    """First reading per ``round(t * rate)``, halves to the even number."""
    kept = readings.where(present(value).isNotNull())
    slot = F.rint(F.col(time) * rate).cast("bigint")
    first = F.min_by(F.struct(time, value), F.struct(time, line))
    return kept.groupBy(*keys, slot.alias("slot")).agg(first.alias("__f")).select(*keys, "slot", F.col(f"__f.{time}").alias(time), F.col(f"__f.{value}").alias(value))


def minute_means(readings: DataFrame, keys: list[str], time: str, value: str, minute: int = 60) -> DataFrame:
    """Mean per minute (of so many units of ``time``), also as a share of the source's largest; the largest is joined, not windowed."""
    per = readings.where(present(value).isNotNull()).groupBy(*keys, F.floor(F.col(time) / minute).alias("minute")).agg(F.avg(value).alias("mean"))
    top = per.groupBy(*keys).agg(F.max("mean").alias("__top"))
    return per.join(top, keys).select(*keys, "minute", "mean", F.when(F.col("__top") != 0, F.col("mean") / F.col("__top")).alias("scaled"))
