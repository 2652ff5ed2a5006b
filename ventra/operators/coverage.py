"""Where a signal is continuous, and which event windows that covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import neighbours
from .grid import explode_between
from .neighbours import with_neighbour, with_neighbours


def coverage_intervals(readings: DataFrame, keys: list[str], time: str, max_gap: int, block: int) -> DataFrame:
    """``keys, start_at, end_at`` of stretches whose successive readings lie at most ``max_gap`` apart.

    ``time`` is a whole number; rows with a null time are left out, repeated times count once.  Only
    the edges of stretches meet again after the first pass, not the readings.
    """
    times = readings.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("t")).distinct()
    both = with_neighbours(times, keys, "t", ["t"], block)
    opens = F.col("__prev").isNull() | (F.col("t") - F.col("__prev.t") > max_gap)
    closes = F.col("__next").isNull() | (F.col("__next.t") - F.col("t") > max_gap)
    edges = both.where(opens | closes).select(*keys, "t", opens.alias("opens"), closes.alias("closes"))
    paired = with_neighbour(edges, keys, "t", ["t"], block * 16, following=True).where("opens")
    return paired.select(*keys, F.col("t").alias("start_at"), F.when(F.col("closes"), F.col("t")).otherwise(F.col("__near.t")).alias("end_at"))


def trim_intervals(intervals: DataFrame, margin: float) -> DataFrame:
    """Intervals shrunk by ``margin`` at both ends; those shorter than twice the margin go."""
    kept = intervals.where(F.col("end_at") - F.col("start_at") >= 2 * margin)
    return kept.withColumns({"start_at": F.col("start_at") + margin, "end_at": F.col("end_at") - margin})


def points_in_windows(points: DataFrame, windows: DataFrame, keys: list[str], time: str, width: int = 60_000) -> DataFrame:
    """Points joined to the windows (``start_at, end_at``, ends included) that hold them; all in whole numbers.

    A window stands in each piece of ``width`` it touches and a point in one, so they meet by
    equality and no pairs of a whole key are made.
    """
    first, last = F.floor(F.col("start_at") / width), F.floor(F.col("end_at") / width)
    pieces = explode_between(windows.where("start_at <= end_at").withColumns({"__first": first, "__last": last}), "__first", "__last", "__piece").drop("__first", "__last")
    placed = points.where(F.col(time).isNotNull()).withColumn("__piece", F.floor(F.col(time) / width))
    return placed.join(pieces, [*keys, "__piece"]).where(F.col(time).between(F.col("start_at"), F.col("end_at"))).drop("__piece")


def classify_windows(windows: DataFrame, coverage: DataFrame, keys: list[str], block: int, min_duration: float = 30.0, time_limit: int = 5_400_000) -> DataFrame:
    """Adds ``status`` and ``reason`` to event windows (``window_id, start_at, end_at`` in ms, ``duration`` in s).

    ``filtered`` (a time is missing, too short, reversed or too late), ``fully_covered`` (inside one
    interval), ``partially_covered`` (touches one) or ``unavailable``; the first that holds.

    The intervals of a source don't overlap, so the last one that starts at or before a window's start
    tells whether it is inside, and the last one that starts at or before its end whether it is touched.
    """
    c = coverage.select(*keys, F.col("start_at").alias("__at"), F.col("end_at").alias("__end"))
    asked = F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("start_at").alias("at")), F.struct(F.lit(False).alias("first"), F.col("end_at").alias("at"))))
    ends = windows.select("window_id", *keys, "start_at", "end_at", asked.alias("a")).select("*", F.col("a.at").cast("bigint").alias("__at"))
    near = neighbours(ends, c, keys, "__at", "__end", block)
    holds = F.col("left.v") >= F.when(F.col("a.first"), F.col("end_at")).otherwise(F.col("start_at"))
    flags = near.groupBy("window_id").agg(F.bool_or(holds & F.col("a.first")).alias("__in"), F.bool_or(holds & ~F.col("a.first")).alias("__touch"))
    looked = windows.join(flags, "window_id", "left")
    missing = F.col("start_at").isNull() | F.col("end_at").isNull()
    short = F.col("duration").isNull() | (F.col("duration") < min_duration)
    late = (F.col("start_at") > time_limit) | (F.col("end_at") > time_limit)
    reason = F.when(missing, "missing time").when(short, "too short").when(F.col("start_at") > F.col("end_at"), "reversed").when(late, "beyond limit")
    status = F.when(reason.isNotNull(), "filtered").when(F.col("__in"), "fully_covered").when(F.col("__touch"), "partially_covered").otherwise("unavailable")
    return looked.withColumns({"status": status, "reason": reason}).drop("__in", "__touch")
