"""Whole analyses over many recordings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, asof, bins, breaths, coverage, signals
from ..session import durable

FILE = ["recording_id", "file_no"]
HOUR = 3_600_000


def pressure_analysis(readings: DataFrame, events: DataFrame, behaviour: str | None = None, bin_ms: int = 10_000, atm_bin_ms: int = 300_000, max_gap: int = 5_000, min_peaks: int = 50) -> dict[str, DataFrame]:
    """Event-aligned pressure analysis.

    ``readings``: FILE, ms, line_no, smoothedpressure, temp, activity, atmpressure; ``events``: FILE, window_id,
    event, start_at, end_at in ms, duration in s, and ``bin_ms`` where windows have bins of their own.  Breaths are found at once and kept; the rest are lazy tables: coverage, windows, breaths, periods, per_bin,
    per_period, per_window, overall, atm_session, atm_bins, intervals, spectra, spectrum_metrics.
    """
    names = ["smoothedpressure", "temp", "activity", "atmpressure"]
    master = durable(align.first_valid(readings, FILE, "ms", "line_no", names))
    pressure = master.where(align.present("smoothedpressure").isNotNull())
    cover = coverage.coverage_intervals(pressure, FILE, "ms", max_gap, HOUR)
    usable = coverage.trim_intervals(cover, 1000)
    chosen = events if behaviour is None else events.where(F.col("event") == behaviour)
    windows = coverage.classify_windows(chosen, usable, FILE, HOUR)
    covered = windows.where("status = 'fully_covered'")

    segments = signals.segmented(pressure.select(*FILE, "ms", "smoothedpressure"), FILE, "ms", "smoothedpressure", max_gap, HOUR)
    found = signals.detect_breaths(segments, FILE, "smoothedpressure")
    # a breath may lie in several windows
    inside = coverage.points_in_windows(found, covered.select(*FILE, "window_id", "start_at", "end_at"), FILE, "peak_ms")
    keys = [*FILE, "window_id"]
    extremes = inside.select(*keys, F.col("peak_ms").alias("ms"), F.col("peak_v").alias("v"), F.lit("peak").alias("kind")).unionByName(
        inside.select(*keys, F.col("shoulder_ms").alias("ms"), F.col("shoulder_v").alias("v"), F.lit("trough").alias("kind"))
    ).dropDuplicates([*keys, "ms", "kind"])
    extremes = durable(extremes)  # what follows looks at the breaths many times, and never at the readings again
    peaks = extremes.where("kind = 'peak'")
    periods = durable(breaths.valid_periods(peaks, keys, "ms", min_peaks))
    in_period = durable(coverage.points_in_windows(extremes, periods, keys, "ms"))
    own = [*keys, "period_no"]
    cycles = breaths.cycles(in_period.select(*own, "ms", "v", "kind"), own, "ms", "v", HOUR)
    beside = coverage.points_in_windows(master.select(*FILE, "ms", "temp", "activity"), covered.select(*FILE, "window_id", "start_at", "end_at"), FILE, "ms").select(*keys, "ms", "temp", "activity")
    if "bin_ms" in events.columns:  # each window its own
        periods = periods.join(events.select("window_id", "bin_ms"), "window_id")
        per_bin = breaths.period_bins(extremes, periods, beside, keys, "ms", "v", F.col("bin_ms"), HOUR)
    else:
        per_bin = breaths.period_bins(extremes, periods, beside, keys, "ms", "v", bin_ms, HOUR)
    atm = master.where(align.present("atmpressure").isNotNull())
    axis = pressure.groupBy(*FILE).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    trace = breaths.interval_trace(in_period.where("kind = 'peak'"), own, "ms", HOUR, trim=10)
    spectra = signals.interval_spectra(durable(trace), own)
    return {
        "coverage": cover, "windows": windows, "breaths": inside, "periods": periods, "per_bin": per_bin,
        "per_period": breaths.cycle_summary(cycles, [own]), "per_window": breaths.cycle_summary(cycles, [keys]), "overall": breaths.cycle_summary(cycles, [FILE]),
        "atm_session": bins.session_stats(atm, FILE, "atmpressure"), "atm_bins": bins.time_bins(atm, axis, FILE, "ms", "atmpressure", atm_bin_ms),
        "intervals": trace, "spectra": spectra, "spectrum_metrics": signals.spectrum_metrics(spectra, keys),
    }


def photometry_analysis(photometry: DataFrame, telemetry: DataFrame, injections: DataFrame, before_ms: int, after_ms: int, bin_ms: int) -> dict[str, DataFrame]:
    """Injection-aligned photometry analysis.

    ``photometry``: FILE, ms, dFoF_465; ``telemetry``: FILE, ms, temp, activity; ``injections``: FILE, anchor (ms).
    Returns peaks, peak_bins, signal_bins and raw (telemetry interpolated at the photometry's times).
    """
    if min(before_ms, after_ms, bin_ms) <= 0:
        raise ValueError("before, after and bin must be positive")
    near = photometry.join(injections, FILE).where(F.col("ms").between(F.col("anchor") - before_ms, F.col("anchor") + after_ms))
    segments = near.select(*FILE, F.col("anchor").alias("segment"), "ms", "dFoF_465")
    peaks = signals.transient_peaks(segments, FILE, "dFoF_465").select(*FILE, F.col("peak_ms").alias("ms"), "amplitude", "width_ms", "interval_ms", "peak_no")
    raw = near.select(*FILE, "ms", "dFoF_465")
    for s in ("temp", "activity"):
        side = asof.neighbours(raw, telemetry.where(align.present(s).isNotNull()), FILE, "ms", s, HOUR)
        raw = side.withColumn(s, asof.interpolated("ms")).drop("left", "right")
    return {
        "peaks": peaks, "peak_bins": breaths.peak_bins(peaks.withColumnRenamed("amplitude", "height"), injections, FILE, "ms", "height", before_ms, after_ms, bin_ms, HOUR, ("width_ms",)),
        "signal_bins": bins.aligned_bins(raw, injections, FILE, "ms", ["dFoF_465", "temp", "activity"], before_ms, after_ms, bin_ms), "raw": raw,
    }


def batch_status(config: DataFrame, recordings: DataFrame) -> DataFrame:
    """What a batch run can do with each configuration row, all rows at once.

    ``no_recording``, ``no_time``, ``bad_bin`` or ``ready``; the rows that are ready run as one job.
    """
    known = recordings.select(*FILE, F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "no_recording").when(F.length(F.trim(F.coalesce("video_time", F.lit("")))) == 0, "no_time")
    status = status.when(F.col("bin_size").isNull() | (F.col("bin_size") <= 0), "bad_bin").otherwise("ready")
    return config.join(known, FILE, "left").withColumn("status", status).drop("__known")


def batch_run(config: DataFrame, recordings: DataFrame, readings: DataFrame, events: DataFrame, min_peaks: int = 50) -> dict[str, DataFrame]:
    """The pressure analysis for all rows of a batch configuration in one job.

    ``config``: ``config_id``, FILE, ``behaviour, video_time, bin_size`` (s); the rest as in ``pressure_analysis``, with
    ``event_id``.  Each row that is ready (``batch_status``) takes the events of its recording that are exactly its
    behaviour, with bins of its own size.  Returns the tables of ``pressure_analysis``, whose ``window_id`` is
    ``config_id-event_id``, and ``batch``: ``config_id, status, n_windows, n_covered, n_periods, n_bins``, where status is
    that of ``batch_status``, ``no_windows`` (no event of the behaviour is covered), ``no_periods`` or ``complete``.
    """
    rows = durable(batch_status(config, recordings))
    ready = rows.where("status = 'ready'").select("config_id", *FILE, F.col("behaviour").alias("event"), (F.col("bin_size") * 1000).cast("bigint").alias("bin_ms"))
    windows = durable(events.join(ready, [*FILE, "event"]).withColumn("window_id", F.concat_ws("-", "config_id", "event_id")))
    tables = pressure_analysis(readings, windows.select(*FILE, "window_id", "event", "start_at", "end_at", "duration", "bin_ms"), min_peaks=min_peaks)
    of = windows.select("window_id", "config_id").distinct()
    count = lambda name, df, what: df.join(of, "window_id").groupBy("config_id").agg(F.count(what).alias(name))
    statuses = durable(tables["windows"].select("window_id", F.when(F.col("status") == "fully_covered", 1).alias("covered")))
    batch = rows.select("config_id", "status")
    for part in (count("n_windows", statuses, F.lit(1)), count("n_covered", statuses, "covered"), count("n_periods", tables["periods"], F.lit(1)), count("n_bins", tables["per_bin"], F.lit(1))):
        batch = batch.join(part, "config_id", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_windows", "n_covered", "n_periods", "n_bins")}
    status = F.when(F.col("status") != "ready", F.col("status")).when(n["n_covered"] == 0, "no_windows").when(n["n_periods"] == 0, "no_periods").otherwise("complete")
    return {**tables, "batch": batch.select("config_id", status.alias("status"), *[v.alias(c) for c, v in n.items()])}
