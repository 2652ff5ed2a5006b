"""Filtered pressure, breaths, photometry peaks and interval spectra per source and segment.

A segment is a whole stretch without gaps.  Kernels run in tasks that read sorted rows.  Where what a reading
hangs on reaches a known number of readings (filters, smoothing, rolling quantiles), a segment of any length
is cut into pieces that overlap by that reach.  How far a prominence or a breath's onset reaches hangs on the
readings themselves, so there a task holds one whole segment at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.batches import whole_groups
from .neighbours import beside, with_neighbour, with_neighbours, with_rank


def segmented(readings: DataFrame, keys: list[str], time: str, value: str, max_gap: int, block: int) -> DataFrame:
    """Adds ``segment``: the first time of the stretch without gaps that a reading lies in.

    Stretches are found in pieces of ``block`` on the time axis, and one row per piece carries the open
    stretch on to the next.
    """
    near = with_neighbour(readings, keys, time, [time], block)
    opens = F.col("__near").isNull() | (F.col(time) - F.col(f"__near.{time}") > max_gap)
    within = Window.partitionBy(*keys, "__piece").orderBy(time)
    rows = near.withColumns({"__piece": F.floor(F.col(time) / block), "__open": F.when(opens, F.col(time))})
    rows = rows.withColumn("segment", F.last("__open", True).over(within))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "__piece").agg(F.max("__open").alias("__last"))
    last = last.select(*keys, "__piece", F.last("__last", True).over(before).alias("__before"))
    rows = beside(rows, last, [*keys, "__piece"]).withColumn("segment", F.coalesce("segment", "__before"))
    return rows.select(*keys, "segment", time, value)


PIECE = 16_384  # readings of a segment that one piece holds besides its reach


def in_pieces(segments: DataFrame, keys: list[str], time: str, reach: int, size: int = PIECE, block: int = 3_600_000) -> DataFrame:
    """Segments cut into pieces of ``size`` readings that also hold ``reach`` readings of their neighbours.

    Adds ``__piece``, ``__own`` (the piece a reading belongs to), ``__place`` and ``__of`` (its place in the segment, from 1,
    and the segment's readings), ``__lo`` and ``__hi`` (the segment's first and last time).
    """
    ids = [*keys, "segment"]
    ranked = with_rank(segments, ids, time, [], block, "__place", "__of")
    ends = segments.groupBy(*ids).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    at = F.col("__place") - 1
    last = F.floor((F.col("__of") - 1) / size)
    pieces = F.sequence(F.floor(F.greatest(at - reach, F.lit(0)) / size), F.least(F.floor((at + reach) / size), last))
    return beside(ranked, ends, ids).withColumn("__own", F.floor(at / size)).withColumn("__piece", F.explode(pieces))


def per_segment(segments: DataFrame, keys: list[str], time: str, schema: str, kernel: Callable[[pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
    """Runs ``kernel`` on each whole segment, or on each piece of ``in_pieces``, rows sorted by time; None gives no rows."""
    cut = "__piece" in segments.columns
    ids = [*keys, "segment", "__piece"] if cut else [*keys, "segment"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for group in whole_groups(batches, ids):
            got = kernel(group.reset_index(drop=True))
            if got is None or not len(got):
                continue
            for c in ids:
                got[c] = group[c].iloc[0]
            held.append(got)
            n += len(got)
            if n >= 10_000:  # short segments leave the task together
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    kinds = dict(segments.dtypes)
    full = ", ".join(f"{c} {kinds[c]}" for c in ids) + ", " + schema
    names = [p.strip().split(" ")[0] for p in full.split(",")]
    ordered = segments.repartition(*ids).sortWithinPartitions(*ids, time)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in run(batches):
            yield out[names]

    return ordered.mapInPandas(named, full).drop("__piece")


def _rate(ms: np.ndarray) -> float:
    """Samples per second from the median step."""
    step = np.diff(ms)
    step = step[step > 0]
    return 1000.0 / float(np.median(step)) if len(step) else 0.0


def _own(g: pd.DataFrame) -> np.ndarray:
    return (g["__own"] == g["__piece"]).to_numpy()


def preprocess(segments: DataFrame, keys: list[str], value: str, low: float = 0.2, high: float = 0.02, margin: int = 1000, size: int = PIECE) -> DataFrame:
    """High-pass, low-pass, and the low-pass smoothed and its slope; null within ``margin`` of a segment's ends.

    ``low`` and ``high`` are cut-offs as shares of the sampling rate.  Segments of fewer than 36
    readings have nulls.  The slope is per second, by the mean step of the segment.
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        ms, x, own = g["ms"].to_numpy(np.int64), g[value].to_numpy(float), _own(g)
        lo, hi, n = (int(g[c].iloc[0]) for c in ("__lo", "__hi", "__of"))
        names = ("highpass", "lowpass", "smoothed", "slope")
        out = pd.DataFrame({"ms": ms, "raw": x})
        if n < 36 or hi <= lo or not own.any():
            return out.assign(**{k: np.nan for k in names})[own]
        rate = (n - 1) * 1000.0 / (hi - lo)
        inner = (ms >= lo + margin) & (ms <= hi - margin)
        lowpass = dsp.zero_phase(x, low, 1.0)
        found = (dsp.zero_phase(x, high, 1.0, high=True), lowpass, dsp.smooth(lowpass), dsp.smooth(lowpass, True, rate))
        return out.assign(**{k: np.where(inner, v, np.nan) for k, v in zip(names, found)})[own]

    reach = 2 * max(dsp.reach(low), dsp.reach(high, True)) + 36
    return per_segment(in_pieces(segments, keys, "ms", reach, size), keys, "ms", "ms bigint, raw double, highpass double, lowpass double, smoothed double, slope double", kernel)


def smoothed(segments: DataFrame, keys: list[str], value: str, name: str, derivative: bool = False, half: int = 17, size: int = PIECE) -> DataFrame:
    """Quadratic smoothing over 2·half+1 readings, or its slope per reading, as ``name``; readings nearer than ``half`` to a segment's ends are left out."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2 * half + 1:
            return None
        y = dsp.smooth(g[value].to_numpy(float), derivative, half=half)
        keep = _own(g) & (g["__place"] > half).to_numpy() & (g["__place"] <= g["__of"] - half).to_numpy()
        return pd.DataFrame({"ms": g["ms"], name: y})[keep]

    return per_segment(in_pieces(segments, keys, "ms", half, size), keys, "ms", f"ms bigint, {name} double", kernel)


def rolling_quantiles(segments: DataFrame, keys: list[str], value: str, window: int, upper: float = 0.8, lower: float = 0.2, size: int = PIECE) -> DataFrame:
    """Centred rolling quantiles over ``window`` readings, fewer at the ends of a segment."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        roll = g[value].astype(float).rolling(window, center=True, min_periods=1)
        return pd.DataFrame({"ms": g["ms"], "upper": roll.quantile(upper), "lower": roll.quantile(lower)})[_own(g)]

    return per_segment(in_pieces(segments, keys, "ms", window, size), keys, "ms", "ms bigint, upper double, lower double", kernel)


def detect_breaths(segments: DataFrame, keys: list[str], pressure: str, prominence: float = 3.0, distance_s: float = 0.05, envelope: int = 41, depth: float = 0.45) -> DataFrame:
    """Inspiratory dips of the pressure and the shoulder before each.

    Dips of enough prominence that reach at least ``depth`` of the way down the envelope between the
    rolling 80 % and 20 % quantiles; the shoulder is where the slope before the dip begins to fall.
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame | None:
        ms, p = g["ms"].to_numpy(np.int64), g[pressure].to_numpy(float)
        rate = _rate(ms)
        if len(p) < 5 or not rate:
            return None
        peaks = dsp.find_peaks(-p, prominence, max(1, round(distance_s * rate)))
        roll = pd.Series(p).rolling(envelope, center=True, min_periods=1)
        top, bottom = roll.quantile(0.8).to_numpy(), roll.quantile(0.2).to_numpy()
        peaks = peaks[top[peaks] - p[peaks] >= depth * np.maximum(top[peaks] - bottom[peaks], 1e-6)]
        slope = np.gradient(p, ms / 1000.0) if len(np.unique(ms)) == len(ms) else np.gradient(p)
        starts = np.r_[0, peaks[:-1]] if len(peaks) else peaks
        onset = dsp.onsets(slope, starts, peaks)
        return pd.DataFrame({"n": range(1, len(peaks) + 1), "peak_ms": ms[peaks], "shoulder_ms": ms[onset], "peak_v": p[peaks], "shoulder_v": p[onset]})

    return per_segment(segments, keys, "ms", "n bigint, peak_ms bigint, shoulder_ms bigint, peak_v double, shoulder_v double", kernel)


def transient_peaks(segments: DataFrame, keys: list[str], value: str, prominence: float = 0.05, amplitude: float = 0.01) -> DataFrame:
    """Peaks with width at half prominence (in ms) and time to the next; small ones are dropped after
    widths and before intervals."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame | None:
        ms, x = g["ms"].to_numpy(np.int64), g[value].to_numpy(float)
        if len(x) < 3:
            return None
        peaks = dsp.find_peaks(x, prominence)
        if not len(peaks):
            return None
        width = dsp.peak_widths(x, peaks) * float(np.median(np.diff(ms)))
        keep = x[peaks] > amplitude
        at = ms[peaks][keep]
        return pd.DataFrame({"peak_ms": at, "amplitude": x[peaks][keep], "width_ms": width[keep], "interval_ms": np.r_[np.diff(at), np.nan][: len(at)], "peak_no": range(1, len(at) + 1)})

    return per_segment(segments, keys, "ms", "peak_ms bigint, amplitude double, width_ms double, interval_ms double, peak_no bigint", kernel)


def interval_spectra(trace: DataFrame, keys: list[str], segment_ms: int = 50_000, rate: float = 10.0, nfft: int = 2048) -> DataFrame:
    """Spectral density of breath intervals per segment, resampled by a spline.

    ``trace``: keys, ms, interval (ms).  Segments are cut from each source's first breath; each takes
    one breath more on both sides.  Those with fewer than four breaths, not covered, or with a
    spline that falls to zero are left out (``segment_log`` tells).  Returns the frequencies up to the Nyquist rate.
    """
    if segment_ms <= 0 or rate <= 0 or segment_ms * rate < 100_000 or nfft < 100:
        raise ValueError("length, rate and nfft must be positive, and a segment must hold a window of 100 samples")
    span = trace.groupBy(*keys).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    rows = trace.join(span, keys).withColumn("own", F.floor((F.col("ms") - F.col("lo")) / segment_ms))
    # padding: the breath before a segment's first and the one after its last belong to it too
    near = with_neighbours(rows, keys, "ms", ["own"], segment_ms * 8)
    segs = F.array_distinct(F.array("own", F.coalesce(F.col("__prev.own"), F.col("own")), F.coalesce(F.col("__next.own"), F.col("own"))))
    padded = near.withColumn("segment", F.explode(segs)).where(F.col("lo") + (F.col("segment") + 1) * segment_ms <= F.col("hi"))
    padded = padded.withColumn("start", F.col("lo") + F.col("segment") * segment_ms).select(*keys, "segment", "ms", "interval", "start")

    def kernel(g: pd.DataFrame) -> pd.DataFrame | None:
        t, y = (g["ms"] - g["start"]).to_numpy(float) / 1000, g["interval"].to_numpy(float) / 1000
        length = segment_ms / 1000
        if len(t) < 4 or t[0] > 0 or t[-1] < length - 1 / rate:
            return None
        at = np.arange(int(length * rate)) / rate
        x = dsp.spline(t, y, at)
        if not np.isfinite(x).all() or (x <= 0).any():
            return None
        f, p = dsp.welch(x, rate, 100, nfft=nfft)
        return pd.DataFrame({"k": range(len(f)), "frequency": f, "density": p})

    return per_segment(padded, keys, "ms", "k bigint, frequency double, density double", kernel)


def segment_log(segments: DataFrame, spectra: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Each segment of ``trace_segments`` with ``status`` ``accepted`` (it has a spectrum) or ``rejected`` and the ``reason``:
    fewer than ``least`` breaths, or not covered by breaths from end to end with positive intervals."""
    have = spectra.select(*keys, "segment").distinct().withColumn("__has", F.lit(True))
    rows = segments.join(have, [*keys, "segment"], "left")
    reason = F.when(F.col("__has"), None).when(F.col("n_breaths") < least, f"fewer than {least} breaths").otherwise("not covered by positive intervals")
    return rows.withColumn("status", F.when(F.col("__has"), "accepted").otherwise("rejected")).withColumn("reason", reason).drop("__has")


def spectrum_metrics(spectra: DataFrame, keys: list[str], band: float = 0.25, resolution: float = 0.1, drift: DataFrame | None = None) -> DataFrame:
    """Mean spectrum per source: ``fmax, psd_max`` (the largest value, at the lowest of equal frequencies), ``auc`` within
    ``band`` of it (Simpson), ``n_segments, resolution`` and ``warnings``.

    ``resolution`` is the sampling rate over the length of a Welch window.  Warnings: the peak is at zero, below the
    resolution or near the Nyquist limit, or ``drift`` (keys, ``drift_dominated``) says so of the source.
    """
    mean = spectra.groupBy(*keys, "k", "frequency").agg(F.avg("density").alias("density"), F.count(F.lit(1)).alias("n"))
    top = mean.groupBy(*keys).agg(F.min_by(F.struct("frequency", "density"), F.struct(-F.col("density"), "frequency")).alias("m"), F.max("frequency").alias("limit"), F.max("n").alias("n_segments"))
    near = mean.join(top, keys).where(F.abs(F.col("frequency") - F.col("m.frequency")) <= band)
    curve = near.groupBy(*keys, F.col("m.frequency").alias("fmax"), F.col("m.density").alias("psd_max"), "limit", "n_segments").agg(F.sort_array(F.collect_list(F.struct("frequency", "density"))).alias("c"))
    flags = curve.join(drift.select(*keys, "drift_dominated"), keys, "left") if drift is not None else curve.withColumn("drift_dominated", F.lit(False))

    @F.pandas_udf("double")
    def area(c: pd.Series) -> pd.Series:
        return c.map(lambda x: dsp.simpson(np.array([p["density"] for p in x]), np.array([p["frequency"] for p in x])))

    f = F.col("fmax")
    warning = F.concat_ws(
        "; ", F.when(f == 0, "peak at zero frequency").when(f < resolution, "peak below the resolution").when(f > 0.8 * F.col("limit"), "peak near the Nyquist limit"),
        F.when(F.col("drift_dominated"), "drift may dominate"),
    )
    return flags.select(*keys, "fmax", "psd_max", area("c").alias("auc"), "n_segments", F.lit(resolution).alias("resolution"), warning.alias("warnings"))


def pooled_spectrum(spectra: DataFrame, by: list[str]) -> DataFrame:
    """Mean density per frequency over all segments of each ``by`` (none: over all), with their number."""
    return spectra.groupBy(*by, "k").agg(F.min("frequency").alias("frequency"), F.avg("density").alias("density"), F.count(F.lit(1)).alias("n_segments"))
