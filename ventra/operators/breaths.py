"""Extremes, breath cycles, valid periods and interval traces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import whole_groups
from ..session import durable
from .asof import neighbours
from .neighbours import beside, with_neighbour, with_neighbours, with_rank


def local_extremes(readings: DataFrame, keys: list[str], time: str, value: str, block: int) -> DataFrame:
    """Readings strictly above (``peak``) or below (``trough``) both neighbours; ``time`` whole and unique."""
    b = with_neighbours(readings.select(*keys, time, value), keys, time, [value], block)
    v, p, n = F.col(value), F.col(f"__prev.{value}"), F.col(f"__next.{value}")
    kind = F.when((v > p) & (v > n), "peak").when((v < p) & (v < n), "trough")
    return b.select(*keys, time, value, kind.alias("kind")).where("kind is not null")


def peak_intervals(peaks: DataFrame, keys: list[str], time: str, block: int) -> DataFrame:
    """Adds the ordinal of each peak and the time to the next one (null for the last)."""
    return with_rank(with_neighbour(peaks, keys, time, [time], block, following=True), keys, time, [], block, "ordinal").withColumn(
        "interval", F.col(f"__near.{time}") - F.col(time)
    ).drop("__near")


def peak_bins(peaks: DataFrame, anchors: DataFrame, keys: list[str], time: str, value: str, before: int, after: int, width: int, block: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts, rates per minute, and mean and standard error of amplitude, interval and ``extra`` columns (widths)
    around an anchor; the last interval of a bin is left out, one peak has no error.

    Times are milliseconds.
    """
    n = (before + after) // width
    rel = F.col(time) - F.col("anchor")
    inside = peaks.join(anchors, keys).where((rel >= -before) & (rel < n * width - before)).withColumn("bin", F.floor((rel + before) / width))
    near = with_neighbour(inside, [*keys, "bin"], time, [time], block, following=True)
    measured = {"amplitude": F.col(value), "interval": F.col(f"__near.{time}") - F.col(time), **{c: F.col(c) for c in extra}}
    aggs = [F.count(F.lit(1)).alias("n_peaks")]
    for name, v in measured.items():
        aggs += [F.avg(v).alias(name), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{name}_sem")]
    stats = near.groupBy(*keys, "bin").agg(*aggs)
    spine = anchors.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("bin"))
    rows = spine.join(stats, [*keys, "bin"], "left")
    count = F.coalesce("n_peaks", F.lit(0))
    columns = [x for name in measured for x in (name, f"{name}_sem")]
    return rows.select(*keys, (F.col("bin") * width - before).alias("bin_start"), count.alias("n_peaks"), (count * 60_000 / width).alias("per_minute"), *columns)


def cycles(extremes: DataFrame, keys: list[str], time: str, value: str, block: int) -> DataFrame:
    """Breath cycles: troughs and peaks of a source zipped by their place.

    A first peak before the first trough is dropped, a last trough after the last peak too, and both
    are cut to the same number.  Per cycle: times and values of trough and peak, time in, time out to
    the next trough, total, duty, pressure swing, drive (swing per second in), peak to peak.  Sources without both kinds go.
    """
    ends = extremes.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "peak", F.col(time))).alias("__p"), F.min(F.when(F.col("kind") == "trough", F.col(time))).alias("__t")
    )
    ranked = with_rank(extremes, [*keys, "kind"], time, [], block, "k").join(ends, keys)
    late = (F.col("kind") == "peak") & (F.col("__t") > F.col("__p"))
    ranked = ranked.withColumn("k", F.when(late, F.col("k") - 1).otherwise(F.col("k"))).where("k > 0")
    side = lambda kind, a, b: ranked.where(F.col("kind") == kind).select(*keys, "k", F.col(time).alias(a), F.col(value).alias(b))
    pairs = durable(side("trough", "trough_t", "trough_v").join(side("peak", "peak_t", "peak_v"), [*keys, "k"]))  # used twice below
    near = with_neighbour(pairs, keys, "k", ["trough_t", "peak_t"], following=True)
    t_in = F.col("peak_t") - F.col("trough_t")
    t_out = F.col("__near.trough_t") - F.col("peak_t")
    swing = F.abs(F.col("peak_v") - F.col("trough_v"))
    return near.select(
        *keys, "k", "trough_t", "peak_t", t_in.alias("t_in"), t_out.alias("t_out"), (t_in + t_out).alias("t_total"),
        F.try_divide(t_in.cast("double"), t_in + t_out).alias("duty"), swing.alias("swing"), F.try_divide(swing * 1000, t_in).alias("drive"),
        (F.col("__near.peak_t") - F.col("peak_t")).alias("peak_to_peak"),
    )


def cycle_summary(breaths: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Means and population deviations (``_sd``) of cycles at several levels at once (grouping sets)."""
    columns = levels[0]
    sets = breaths.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in columns])
    per_second = F.try_divide(F.lit(1000.0), F.col("peak_to_peak"))
    measured = {c: F.col(c) for c in ("t_in", "t_out", "t_total", "duty", "drive", "swing", "peak_to_peak")} | {"frequency": per_second}
    return sets.agg(F.count(F.lit(1)).alias("n"), *[x for c, v in measured.items() for x in (F.avg(v).alias(c), F.stddev_pop(v).alias(f"{c}_sd"))])


def valid_periods(
    peaks: DataFrame, keys: list[str], time: str, min_peaks: int = 50, interval_window: int = 10, break_multiplier: float = 2.0, block: int = 3_600_000, size: int = 4096
) -> DataFrame:
    """``keys, period_no, start_at, end_at, n_peaks`` of runs of regular peaks.

    A run breaks at an interval more than ``break_multiplier`` times the median of the last
    ``interval_window`` intervals since the last break, itself included; runs of fewer than
    ``min_peaks`` are left out.

    What a peak hangs on is at most that many intervals before it, so a source is scanned in blocks of
    ``size`` peaks, all at once: first as if each block began after a break, then once more those
    that the block before leaves other intervals to, until none changes.  As a block of many more peaks than
    ``interval_window`` soon forgets what came before it, two or three rounds do, and the last ones are small.
    Runs over a cut are put together by one row per block; ``block`` is the width in time for ranking peaks.  Null times are left out; null keys are one source; peaks at one time count each.
    """
    kinds = dict(peaks.dtypes)
    at = [*keys, "__b"]
    rows = with_rank(peaks.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("bigint").alias("__t")), keys, "__t", [], block, "__place")
    rows = durable(rows.select(*keys, "__t", F.floor((F.col("__place") - 1) / size).alias("__b")))
    order = Window.partitionBy(*keys).orderBy("__b")
    last = rows.groupBy(*at).agg(F.max("__t").alias("__t"))
    entries = durable(last.select(*at, F.lag("__t").over(order).alias("__before"), F.array().cast("array<bigint>").alias("__recent")))
    names = [*at, "i", "start_at", "end_at", "n", "goes_on", "exit"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", __b bigint, i bigint, start_at bigint, end_at bigint, n bigint, goes_on boolean, exit array<bigint>"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, at):
            first = group.iloc[0]
            before = None if pd.isna(first["__before"]) else int(first["__before"])
            recent = [int(x) for x in first["__recent"]]
            runs: list[list] = []  # start, end, peaks, whether it is the run of the block before
            for t in group["__t"].tolist():
                fresh = before is None
                if not fresh:
                    gap = t - before
                    recent = [*recent, gap][-interval_window:]
                    middle = sorted(recent)
                    middle = (middle[(len(middle) - 1) // 2] + middle[len(middle) // 2]) / 2
                    if gap > break_multiplier * middle:
                        fresh, recent = True, []
                if fresh or not runs:
                    runs.append([t, t, 0, not fresh])
                runs[-1][1], runs[-1][2], before = t, runs[-1][2] + 1, t
            key = [None if pd.isna(first[k]) else first[k] for k in at]
            yield pd.DataFrame([[*key, i, *run, recent if i + 1 == len(runs) else None] for i, run in enumerate(runs)], columns=names)

    pieces: DataFrame | None = None
    todo = entries
    while True:
        ready = beside(rows, todo, at).repartition(*at).sortWithinPartitions(*at, "__t")
        got = ready.mapInPandas(scan, schema)
        if pieces is not None:
            mark = todo.select(*at, F.lit(True).alias("__again"))
            got = got.unionByName(beside(pieces, mark, at, "left").where("__again is null").drop("__again"))
        pieces = durable(got)
        left = pieces.where("exit is not null").select(*at, F.lag("exit").over(order).alias("__left"))
        now = F.coalesce("__left", F.array().cast("array<bigint>"))
        seen = durable(beside(entries, left, at).select(*at, "__before", now.alias("__recent"), (now != F.col("__recent")).alias("__new")))
        entries = seen.drop("__new")
        todo = seen.where("__new").drop("__new")
        if todo.isEmpty():
            break

    # a run is named by the block and place it begins in; blocks that one run goes through hand the name on
    begun = F.struct("__b", "i")
    ends = pieces.groupBy(*at).agg(F.max(F.when(~F.col("goes_on"), begun)).alias("__own"))
    ends = ends.select(*at, F.last("__own", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__open"))
    named = beside(pieces, ends, at).withColumn("__run", F.when(F.col("goes_on"), F.col("__open")).otherwise(begun))
    runs = named.groupBy(*keys, "__run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n_peaks")).where(F.col("n_peaks") >= min_peaks)
    ranked = with_rank(durable(runs), keys, "start_at", ["end_at"], block, "__no")
    return ranked.select(*keys, (F.col("__no") - 1).alias("period_no"), F.col("start_at").cast(kinds[time]).alias("start_at"), F.col("end_at").cast(kinds[time]).alias("end_at"), "n_peaks")


def period_bins(extremes: DataFrame, periods: DataFrame, readings: DataFrame, keys: list[str], time: str, value: str, width: int | Column, block: int, signals: tuple[str, ...] = ("temp", "activity")) -> DataFrame:
    """Breath cycles and readings in whole bins of ``width`` (a number or an expression over ``periods``) from the start of each period:
    ``keys, period_no, bin, bin_start, bin_end``, means of the cycles formed inside the bin, and of each
    signal its mean and standard error.

    ``extremes``: keys, time, value, ``kind``; ``periods``: keys, ``period_no, start_at, end_at`` (which don't overlap
    within keys); ``readings``: keys, time, signals.  Bins are half open; a last partial bin is left out, as
    are bins with fewer than two peaks or troughs.  A signal without readings in a bin is null, with one its
    error is.
    """
    spans = periods.select(*keys, "period_no", "start_at", "end_at", (F.lit(width) if isinstance(width, int) else width).cast("bigint").alias("__w"))
    spans = durable(spans.withColumn("__n", F.floor((F.col("end_at") - F.col("start_at")) / F.col("__w"))).where("__n > 0"))
    starts = spans.select(*keys, F.col("start_at").cast("bigint").alias(time), F.col("start_at").cast("double").alias("__s"))
    own = [*keys, "period_no"]

    def placed(df: DataFrame) -> DataFrame:
        inside = neighbours(df, starts, keys, time, "__s", block).withColumn("start_at", F.col("left.v").cast("bigint")).drop("left", "right")
        inside = inside.join(spans.select(*keys, "period_no", "start_at", "__n", "__w"), [*keys, "start_at"])
        return inside.withColumn("bin", F.floor((F.col(time) - F.col("start_at")) / F.col("__w"))).where(F.col("bin") < F.col("__n"))

    found = durable(placed(extremes.select(*keys, time, value, "kind")))
    enough = found.groupBy(*own, "bin").agg(F.count_if(F.col("kind") == "peak").alias("p"), F.count_if(F.col("kind") == "trough").alias("t")).where("p >= 2 and t >= 2")
    formed = cycles(found.select(*own, "bin", time, value, "kind"), [*own, "bin"], time, value, block)
    means = cycle_summary(formed, [[*own, "bin"]]).join(enough.select(*own, "bin"), [*own, "bin"])
    stats = []
    for s in signals:
        v = F.when(~F.isnan(s), F.col(s))
        stats += [F.avg(v).alias(f"{s}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{s}_sem")]
    beside_ = placed(readings.select(*keys, time, *signals)).groupBy(*own, "bin").agg(*stats)
    rows = means.join(beside_, [*own, "bin"], "left").join(spans.select(*own, "start_at", "__w"), own)
    start = F.col("start_at") + F.col("bin") * F.col("__w")
    return rows.select(*own, "bin", start.alias("bin_start"), (start + F.col("__w")).alias("bin_end"), *[c for c in means.columns if c not in {*own, "bin"}], *[f"{s}_{k}" for s in signals for k in ("mean", "sem")])


def peaks_per_period(peaks: DataFrame, periods: DataFrame, keys: list[str], time: str, block: int) -> DataFrame:
    """Peaks inside each period, ends included, with the rate per minute (times in milliseconds).

    Periods of a source don't overlap, so a peak can only be in the last one that starts at or before it.
    """
    starts = periods.select(*keys, F.col("start_at").alias(time), F.col("end_at").alias("__e"))
    inside = neighbours(peaks.select(*keys, time), starts, keys, time, "__e", block).where(F.col(time) <= F.col("left.v"))
    counts = inside.groupBy(*keys, F.col("left.t").alias("start_at")).agg(F.count(F.lit(1)).alias("__n"))
    counted = periods.select(*keys, "period_no", "start_at", "end_at").join(counts, [*keys, "start_at"], "left")
    counted = counted.select(*keys, "period_no", "start_at", "end_at", F.coalesce("__n", F.lit(0)).alias("n_inside"))
    return counted.withColumn("per_minute", F.try_divide(F.col("n_inside") * 60_000.0, F.col("end_at") - F.col("start_at")))


def interval_trace(peaks: DataFrame, keys: list[str], time: str, block: int, trim: int = 0) -> DataFrame:
    """Breath-to-breath intervals stamped at the earlier breath, ``trim`` taken off both ends of a source."""
    distinct = peaks.where(F.col(time).isNotNull()).select(*keys, time).distinct()
    near = with_neighbour(distinct, keys, time, [time], block, following=True).where("__near is not null")
    trace = near.select(*keys, time, (F.col(f"__near.{time}") - F.col(time)).alias("interval"))
    ranked = with_rank(trace, keys, time, [], block, "place", "n")
    return ranked.where((F.col("n") > 2 * trim) & (F.col("place") > trim) & (F.col("place") <= F.col("n") - trim)).drop("place", "n")


def trace_segments(trace: DataFrame, keys: list[str], time: str, width: int) -> DataFrame:
    """Whole segments of ``width`` from each source's first breath, with the breaths inside and the
    R² of a straight line through their intervals (0 for a flat line)."""
    spans = trace.groupBy(*keys).agg(F.min(time).alias("lo"), F.max(time).alias("hi")).withColumn("n_segments", F.floor((F.col("hi") - F.col("lo")) / width))
    spine = spans.where("n_segments > 0").select(*keys, "lo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_segments") - 1)).alias("segment"))
    at = F.floor((F.col(time) - F.col("lo")) / width)
    inside = trace.join(spans, keys).withColumn("segment", at).where("segment < n_segments")
    y, x = F.col("interval").cast("double"), (F.col(time) - F.col("lo")).cast("double") / 1000
    r2 = F.when(F.var_pop(y) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.regr_r2(y, x)))
    stats = inside.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n_breaths"), r2.alias("drift_r2"))
    rows = spine.join(stats, [*keys, "segment"], "left")
    start = F.col("lo") + F.col("segment") * width
    return rows.select(*keys, "segment", start.alias("start_at"), (start + width).alias("end_at"), F.coalesce("n_breaths", F.lit(0)).alias("n_breaths"), "drift_r2")


def peak_summary(peaks: DataFrame, spans: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per source of ``spans`` (keys, ``lo``, ``hi`` in ms): peaks, their mean height and interval, and peaks a minute.

    ``peaks`` has ``interval`` (ms to the next, null for the last).  A source without peaks has
    ``n_peaks`` 0 and nulls; one whose readings share one time has no rate.
    """
    sums = peaks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_height"), F.avg("interval").alias("mean_interval"))
    n = F.coalesce("n", F.lit(0))
    rate = F.when(n > 0, F.try_divide(n * 60_000.0, F.col("hi") - F.col("lo")))
    return spans.join(sums, keys, "left").select(*keys, n.alias("n_peaks"), "mean_height", "mean_interval", rate.alias("per_minute"))
