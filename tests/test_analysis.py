"""Analysis operators and kernels on small vectors.  Fixed values: the short vectors of coverage, windows, bins, cycles and periods are expected results that must be met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventra.functions import dsp
from ventra.operators import align, asof, bins, breaths, coverage


def df_of(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_coverage_and_trim(spark):
    d = df_of(spark, [("r", t) for t in (0, 1000, 3000, 4500)], "k string, t long")
    c = coverage.coverage_intervals(d, ["k"], "t", 1000, 700)
    assert sorted((r.start_at, r.end_at) for r in c.collect()) == [(0, 1000), (3000, 3000), (4500, 4500)]
    iv = df_of(spark, [(0.0, 10.0), (20.0, 21.0)], "start_at double, end_at double")
    assert [tuple(r) for r in coverage.trim_intervals(iv, 1).collect()] == [(1.0, 9.0)]


def test_classify_windows(spark):
    w = df_of(
        spark,
        [(i, "r", "sleep", int(x[0] * 1000), int(x[1] * 1000), x[2]) if x[0] is not None else (i, "r", "sleep", None, 40000, 40.0) for i, x in enumerate([(0.0, 40.0, 40.0), (-20.0, 20.0, 40.0), (80.0, 120.0, 40.0), (-100.0, -50.0, 50.0), (150.0, 200.0, 50.0), (20.0, 25.0, 5.0), (None, 40.0, 40.0)])],
        "window_id long, k string, event string, start_at long, end_at long, duration double",
    )
    cover = df_of(spark, [("r", -10_000, 100_000)], "k string, start_at long, end_at long")
    got = [r.status for r in coverage.classify_windows(w, cover, ["k"], 30_000).orderBy("window_id").collect()]
    assert got == ["fully_covered", "partially_covered", "partially_covered", "unavailable", "unavailable", "filtered", "filtered"]


def test_first_valid_and_trim(spark):
    d = df_of(spark, [("r", 0, 1, None), ("r", 0, 2, 99.0), ("r", 1, 3, 1.0), ("r", 2, 4, float("nan"))], "k string, t int, line int, p double")
    got = {r.t: r.p for r in align.first_valid(d, ["k"], "t", "line", ["p"]).collect()}
    assert got == {0: 99.0, 1: 1.0, 2: None}
    assert [r.t for r in align.trim_to_valid(d, ["k"], "t", ["p"], "p").orderBy("line").collect()] == [0, 0, 1]


def test_subsecond(spark):
    d = df_of(spark, [("r", 5.0, i) for i in range(3)], "k string, s double, line int")
    assert sorted(r.t_s for r in align.spread_within_second(d, ["k"], "s", "line", F.lit(2.0)).collect()) == [5.0, 5.5, 6.0]


def test_day_first(spark):
    cases = [
        ("07/03/2023 01:00:00 AM", "2023-07-03", False), ("03/07/2023 01:00:00 AM", "2023-07-03", True),  # the day itself, either way
        ("04/09/2022 x", "2022-08-30", True), ("09/04/2022 x", "2022-08-30", False),  # the nearer of both
        ("25/02/2024", "2024-01-01", True), ("02/25/2024", "2024-12-31", False),  # one is no date
        ("05/06/2021", "2024-05-06", False), ("5/6/2021", "2024-06-05", True),  # same day and month in another year
        ("31/02/2024", "2024-02-28", True), ("no date", "2024-02-28", False), (None, "2024-02-28", False), ("04/09/2022", None, False),
    ]
    d = df_of(spark, cases, "t string, near string, want boolean").withColumn("near", F.col("near").cast("timestamp_ntz"))
    assert [tuple(r) for r in d.where(align.day_first(F.col("t"), F.col("near")) != F.col("want")).collect()] == []


def test_interpolate_and_nearest(spark):
    src = df_of(spark, [("r", 10, 36.0), ("r", 20, 38.0)], "k string, t long, v double")
    tgt = df_of(spark, [("r", t) for t in (0, 10, 15, 20, 30)], "k string, t long")
    n = asof.neighbours(tgt, src, ["k"], "t", "v", 7)
    assert [r.x for r in n.select("t", asof.interpolated("t").alias("x")).orderBy("t").collect()] == [None, 36.0, 37.0, 38.0, None]
    grid = df_of(spark, [("r", t, float(t)) for t in (0, 10, 20, 30)], "k string, t long, v double")
    tgt = df_of(spark, [("r", t) for t in (-5, 5, 16, 35)], "k string, t long")
    n = asof.neighbours(tgt, grid, ["k"], "t", "v", 8)
    assert [r.x for r in n.select("t", asof.nearest("t").alias("x")).orderBy("t").collect()] == [0.0, 0.0, 20.0, 30.0]


def test_bins(spark):
    atm = df_of(spark, [("r", t, v) for t, v in ((0, 100.0), (10, 102.0), (70, 110.0), (120, 114.0))], "k string, t long, v double")
    spans = df_of(spark, [("r", 0, 120)], "k string, lo long, hi long")
    got = bins.time_bins(atm, spans, ["k"], "t", "v", 60).orderBy("bin_start").collect()
    assert [(r.mean, round(r.sd**2, 6), r.n) for r in got] == [(101.0, 2.0, 2), (112.0, 8.0, 2)]
    sig = df_of(spark, [("r", t, y) for t, y in ((90, 1.0), (100, 3.0), (110, 5.0), (130, 7.0), (150, 9.0))], "k string, t long, y double")
    got = bins.aligned_bins(sig, df_of(spark, [("r", 120)], "k string, anchor long"), ["k"], "t", ["y"], 30, 30, 30).orderBy("bin_start").collect()
    assert [r.y_mean for r in got] == [3.0, 7.0] and got[0].y_sem == pytest.approx(2 / 3**0.5) and got[1].y_sem is None
    d = df_of(spark, [("r", t, i, v) for i, (t, v) in enumerate(((0.0, 100.0), (0.5, 100.0), (1.0, 101.0), (1.5, 101.0), (2.0, 102.0)))], "k string, t double, line int, v double")
    assert [r.v for r in bins.down_sample(d, ["k"], "t", "line", "v", 1.0).orderBy("slot").collect()] == [100.0, 101.0, 101.0]


def test_cycles(spark):
    ext = [("r", t, 5.0, "peak") for t in (1000, 3000, 5000)] + [("r", t, 10.0, "trough") for t in (500, 2500, 4500)]
    got = breaths.cycles(df_of(spark, ext, "rec string, ms long, v double, kind string"), ["rec"], "ms", "v", 900).orderBy("k").collect()
    assert [(r.t_in, r.t_out, r.t_total, r.peak_to_peak, r.swing) for r in got] == [(500, 1500, 2000, 2000, 5.0)] * 2 + [(500, None, None, None, 5.0)]


def test_periods_and_traces(spark):
    p = df_of(spark, [("r", t) for t in (0, 1, 2, 10, 11, 12)], "k string, ms long")
    got = breaths.valid_periods(p, ["k"], "ms", 3, 3, 2.0).orderBy("period_no").collect()
    assert [(r.start_at, r.end_at) for r in got] == [(0, 2), (10, 12)]
    t = df_of(spark, [("r", x) for x in (0, 1, 1, 3, 2, 4)], "k string, ms long")
    assert [(r.ms, r.interval) for r in breaths.interval_trace(t, ["k"], "ms", 2).orderBy("ms").collect()] == [(i, 1) for i in range(4)]
    t = df_of(spark, [("r", x) for x in range(22)], "k string, ms long")
    assert [r.ms for r in breaths.interval_trace(t, ["k"], "ms", 5, trim=3).orderBy("ms").collect()] == list(range(3, 18))


def test_periods_do_not_hang_on_blocks(spark):
    import random

    random.seed(12)
    data = []
    for key in ("a", "b", None):
        t = -2000
        for _ in range(400):
            t += random.choice([0, 3, 4, 5, 5, 6, 9, 14, 40])
            data.append((key, t, 0))
    want = []
    for key in ("a", "b", None):
        times = sorted(t for k, t, _ in data if k == key)
        runs, recent = [[times[0]]], []
        for before, t in zip(times, times[1:]):
            recent = [*recent, t - before][-10:]
            if t - before > 2 * np.median(recent):
                runs.append([])
                recent = []
            runs[-1].append(t)
        want += [(key, i, r[0], r[-1], len(r)) for i, r in enumerate([r for r in runs if len(r) >= 4])]
    d = df_of(spark, [*data, ("c", None, 0), ("d", 5, 0)], "k string, ms long, period_no int")
    for size in (40, 4096):
        got = [tuple(r) for r in breaths.valid_periods(d, ["k"], "ms", 4, 10, 2.0, 100, size).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert breaths.valid_periods(d.limit(0), ["k"], "ms").count() == 0


def test_filters():
    t = np.arange(0, 4, 1 / 500)
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 100 * t)
    assert np.abs(dsp.zero_phase(slow, 10, 500) - slow)[200:-200].max() < 0.02
    assert np.abs(dsp.zero_phase(fast, 10, 500))[200:-200].max() < 0.01
    assert np.abs(dsp.zero_phase(np.full(500, 7.0), 1, 500, high=True)).max() < 1e-6
    assert np.abs(dsp.smooth(t[:200] ** 2, True, 500) - 2 * t[:200]).max() < 1e-8
    assert np.abs(dsp.smooth(t[:200] ** 2) - t[:200] ** 2).max() < 1e-10


def test_peaks_and_widths():
    x = np.array([0, 0.2, 0, 0.4, 0, 0.3, 0])
    p = dsp.find_peaks(x, 0.05)
    assert p.tolist() == [1, 3, 5] and np.allclose(dsp.peak_widths(x, p), 1.0)
    dips = np.zeros(250)
    dips[[50, 125, 200]] = -8
    assert dsp.find_peaks(-dips, 3, 25).tolist() == [50, 125, 200]
    assert dsp.local_maxima(np.array([0, 1, 1, 1, 0])).tolist() == [2]
    assert dsp.find_peaks(np.array([0, 5, 0, 6, 0.0]), 1, 3).tolist() == [3]


def test_onsets():
    def plain(slope, a, b):  # the rule in words, reading by reading
        part = list(slope[a:b])
        g = part.index(min(part)) if part else 0
        if g == 0:
            return a
        turns = [i for i in range(1, g) if part[i - 1] >= 0 > part[i]]
        level = min(range(g), key=lambda i: abs(part[i]))
        since = turns[-1] if turns else level if part[level] > dsp.LEVEL_SLOPE else 0
        bound = dsp.ONSET_SHARE * min(part[since:g])
        return a + next((i for i in range(since, g) if part[i] <= bound), g - 1)

    rng = np.random.default_rng(5)
    for _ in range(200):
        slope = np.round(np.cumsum(rng.normal(0, 0.4, 60)), 1)
        cuts = np.sort(rng.choice(60, 6, replace=False))
        starts, peaks = np.r_[0, cuts[:-1]], cuts
        assert dsp.onsets(slope, starts, peaks).tolist() == [plain(slope, a, b) for a, b in zip(starts, peaks)]
    assert len(dsp.onsets(slope, np.array([], int), np.array([], int))) == 0


def test_filter_and_prominences_against_plain_steps():
    rng = np.random.default_rng(6)
    for share, high in ((0.3, False), (0.02, False), (0.01, True)):
        x = np.cumsum(rng.normal(size=400))
        (b1, a1), (b2, a2) = dsp._sections(share, 1.0, high)
        b, a = np.convolve(b1, b2), np.convolve(a1, a2)

        def once(v):  # the recursion itself, after a long stand at the first reading
            v = np.r_[np.full(3000, v[0]), v]
            y = np.zeros(len(v) + 3)
            w = np.r_[np.full(3, v[0]), v]
            y[:3] = v[0] * b.sum() / a.sum()
            for i in range(3, len(w)):
                y[i] = b @ w[i - 3 : i + 1][::-1] - a[1:] @ y[i - 3 : i][::-1]
            return y[3003:]

        padded = np.r_[2 * x[0] - x[12:0:-1], x, 2 * x[-1] - x[-2:-14:-1]]
        assert np.allclose(dsp.zero_phase(x, share, 1.0, high), once(once(padded)[::-1])[::-1][12:-12], atol=1e-8)
        p = dsp.local_maxima(x)
        prom, left, right = dsp.prominences(x, p)
        for i, q in enumerate(p):
            lo = max([j + 1 for j in range(q) if x[j] > x[q]], default=0)
            hi = min([j for j in range(q, len(x)) if x[j] > x[q]], default=len(x))
            assert prom[i] == pytest.approx(x[q] - max(x[lo : q + 1].min(), x[q:hi].min()))
            assert x[left[i]] == x[lo : q + 1].min() and x[right[i]] == x[q:hi].min()


def test_long_signals_take_seconds():
    import time

    x = np.cumsum(np.random.default_rng(7).normal(size=2_700_000))
    start = time.time()
    dsp.zero_phase(x, 10, 500)
    dsp.find_peaks(x, 3, 25)
    assert time.time() - start < 60


def test_spline_spectrum_simpson():
    x = np.array([0, 1, 2.5, 3, 4.2, 6])
    assert np.allclose(dsp.spline(x, x**3, np.linspace(0, 6, 50)), np.linspace(0, 6, 50) ** 3)
    t = np.arange(500) / 10
    f, p = dsp.welch(np.sin(2 * np.pi * 0.2 * t), 10, 500)
    assert abs(f[p.argmax()] - 0.2) < 0.03 and len(f) == 1025
    for n in (5, 6, 9, 10):
        g = np.linspace(0, 2, n)
        assert dsp.simpson(g**2, g) == pytest.approx(8 / 3)


def test_points_in_windows(spark):
    import random

    random.seed(11)
    points = [(random.choice("ab"), random.randrange(-200, 200)) for _ in range(60)]
    wins = [(random.choice("ab"), i, s := random.randrange(-200, 200), s + random.choice([-1, 0, 5, 150])) for i in range(40)]
    got = coverage.points_in_windows(df_of(spark, points, "k string, t long"), df_of(spark, wins, "k string, w long, start_at long, end_at long"), ["k"], "t", 17)
    want = sorted((k, t, w) for k, t in points for kk, w, s, e in wins if k == kk and s <= t <= e)
    assert sorted((r.k, r.t, r.w) for r in got.collect()) == want


def test_pooled_spectrum_and_missing_columns(spark):
    from ventra.operators import signals, summaries

    s = spark.createDataFrame([("a", 0, 0.0, 1.0), ("b", 0, 0.0, 3.0), ("a", 1, 0.5, 2.0)], "k_ string, k int, frequency double, density double")
    assert sorted(map(tuple, signals.pooled_spectrum(s, []).collect())) == [(0, 0.0, 2.0, 2), (1, 0.5, 2.0, 1)]
    assert signals.pooled_spectrum(s.limit(0), ["k_"]).count() == 0
    heads = spark.createDataFrame([(1, '﻿"A" ;b', 0), (2, None, 0), (3, "a,B,c", 0)], "id int, h string, column_name_ int")
    assert sorted(map(tuple, summaries.missing_columns(heads, ["id"], "h", ("a", "b")).collect())) == [(2, "a"), (2, "b")]


def test_peak_summary_edges(spark):
    from ventra.operators import breaths

    peaks = spark.createDataFrame([("a", 1.0, 500), ("a", 3.0, None), ("c", 2.0, None)], "k string, v double, interval long")
    spans = spark.createDataFrame([("a", 0, 60_000), ("b", 0, 10), ("c", 5, 5)], "k string, lo long, hi long")
    got = {r.k: tuple(r)[1:] for r in breaths.peak_summary(peaks, spans, ["k"], "v").collect()}
    assert got == {"a": (2, 2.0, 500.0, 2.0), "b": (0, None, None, None), "c": (1, 2.0, None, None)}
    assert breaths.peak_summary(peaks.limit(0), spans.limit(0), ["k"], "v").count() == 0


def test_segments_are_whole_stretches(spark):
    from ventra.operators import signals

    # one stretch over three multiples of the block, a gap, and a second stretch
    times = [*range(-3000, 4000, 10), *range(9000, 9300, 10)]
    x = {t: np.sin(t / 70) + (6 if t in (0, 1000) else 0) for t in times}
    d = df_of(spark, [("r", t, float(v)) for t, v in x.items()], "k string, ms long, v double")
    segs = signals.segmented(d, ["k"], "ms", "v", 50, 1000)
    assert {(r.segment, r.n) for r in segs.groupBy("segment").agg(F.count("*").alias("n")).collect()} == {(-3000, 700), (9000, 30)}
    got = signals.transient_peaks(segs, ["k"], "v", prominence=5.0).orderBy("peak_ms").collect()
    assert [(r.segment, r.peak_ms, r.peak_no, r.interval_ms) for r in got[:1]] == [(-3000, 0, 1, 1000.0)] and [r.peak_ms for r in got] == [0, 1000]
    clean = {r.ms: r.lowpass for r in signals.preprocess(segs, ["k"], "v", margin=100).where("segment = -3000").collect()}
    want = dsp.zero_phase(np.array([x[t] for t in times[:700]]), 20.0, 100.0)
    assert all(clean[t] == pytest.approx(w) for t, w in list(zip(times, want))[20:-20])


def test_pieces_of_segments_give_what_the_whole_gives(spark):
    from ventra.operators import signals, summaries

    rng = np.random.default_rng(16)
    data = [(k, t, float(v)) for k in ("r", None) for t, v in zip(range(0, 30_000, 10), np.cumsum(rng.normal(size=3000)))] + [("s", t, 1.0) for t in range(0, 200, 10)]
    segs = signals.segmented(df_of(spark, data, "k string, ms long, v double"), ["k"], "ms", "v", 50, 1000).cache()
    for run in (
        lambda n: signals.preprocess(segs, ["k"], "v", size=n),
        lambda n: summaries.lowpass_sweep(segs, ["k"], "v", size=n),
        lambda n: signals.smoothed(segs, ["k"], "v", "y", size=n),
        lambda n: signals.rolling_quantiles(segs, ["k"], "v", 15, size=n),
    ):
        whole, cut = ({(r["k"], r["ms"]): [x for x in r if isinstance(x, float)] for r in run(n).collect()} for n in (100_000, 700))
        assert whole.keys() == cut.keys() and all(np.allclose(whole[k], cut[k], atol=1e-7, equal_nan=True) for k in whole)


def test_batch_run_of_many_rows(spark):
    from ventra.plans import pipelines

    times = range(0, 120_000, 100)
    rows = [("r", 1, t, i, float(4 * np.sin(2 * np.pi * t / 2000)), 36.0 + t / 60_000, 1.0, None) for i, t in enumerate(times)]
    readings = df_of(spark, rows, "recording_id string, file_no int, ms long, line_no int, smoothedpressure double, temp double, activity double, atmpressure double")
    events = df_of(spark, [(1, "r", 1, "sleep", 10_000, 110_000, 100.0), (2, "r", 1, "sleep", 100_000, 200_000, 100.0), (3, "r", 1, "eat", 0, 1000, 1.0)], "event_id long, recording_id string, file_no int, event string, start_at long, end_at long, duration double")
    config = [(1, "r", 1, "sleep", "12:00:00", 20), (2, "r", 1, "sleep", "12:00:00", 50), (3, "r", 1, "eat", "12:00:00", 10), (4, "r", 1, "sleep", " ", 10), (5, "r", 1, "sleep", "x", 0), (6, "q", 1, "sleep", "x", 5), (7, "r", 1, None, "x", 5)]
    config = df_of(spark, config, "config_id long, recording_id string, file_no int, behaviour string, video_time string, bin_size int")
    known = df_of(spark, [("r", 1)], "recording_id string, file_no int")
    got = pipelines.batch_run(config, known, readings, events, min_peaks=5)
    out = {r.config_id: tuple(r)[1:] for r in got["batch"].collect()}
    assert out == {
        1: ("complete", 2, 1, 1, 4), 2: ("complete", 2, 1, 1, 1), 3: ("no_windows", 1, 0, 0, 0), 4: ("no_time", 0, 0, 0, 0),
        5: ("bad_bin", 0, 0, 0, 0), 6: ("no_recording", 0, 0, 0, 0), 7: ("no_windows", 0, 0, 0, 0),
    }
    bins_ = [r for r in got["per_bin"].orderBy("window_id", "bin").collect() if r.window_id == "1-1"]
    # 200 temperatures a bin, rising a degree a minute
    assert all(r.t_total == 2000 and r.frequency == pytest.approx(0.5) and r.temp_mean == pytest.approx(36 + (r.bin_start + 9950) / 60_000) and r.activity_sem == 0 for r in bins_)


def test_wall_clock_files_are_kept_in_time_since_start(spark, tmp_path):
    from datetime import datetime

    from ventra.plans import reference

    start = datetime(2024, 3, 31, 0, 59, 0)  # a minute before Berlin's clocks go forward
    files = [("e", 1, "Europe/Berlin", "elapsed", "s", 1.0, start), ("w", 1, "Europe/Berlin", "wall", "min", 60.0, start)]
    df_of(spark, files, "recording_id string, file_no int, tz string, clock_kind string, time_unit string, interval_s double, device_start_utc timestamp").write.parquet(str(tmp_path / "recording_files.parquet"))
    rows = [("e", 0.0, 1), ("e", 1.5, 2), ("w", 0.0, 3), ("w", 61.0, 4), ("w", 62.0, 5), ("w", None, 6)]
    lines = [(i, r, 1, i, t, 20.0, 36.0 + i % 2) for r, t, i in rows]
    df_of(spark, lines, "row_id long, recording_id string, file_no int, line_no int, timesincereference double, smoothedpressure double, temp double").write.parquet(str(tmp_path / "telemetry.parquet"))
    d = str(tmp_path)
    got = sorted(((r.recording_id, r.ms) for r in reference.readings(spark, d).collect()), key=lambda x: (x[1] is None, x))
    assert got.pop() == ("w", None)
    assert got == [("e", 0), ("e", 1500), ("w", 0), ("w", 60_000), ("w", 120_000)]
    assert {(r.recording_id, r.ms) for r in reference.preprocessed_pressure(spark, d).collect()} == set(got)
