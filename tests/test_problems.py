"""The general problems: nulls, empty tables, ties, repeated rows, clashing columns, brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventra.operators import drift, grid, instants, intervals, rejects, spikes
from ventra.operators.neighbours import with_neighbours, with_rank


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


# neighbours


def test_neighbours_and_ranks_across_blocks(spark):
    random.seed(1)
    data = [(random.choice(["a", "a", None]), t) for t in random.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(data, "k string, t long")
    got = {(r.k, r.t): (r.__prev and r.__prev.t, r.__next and r.__next.t) for r in ()}
    for r in with_neighbours(df, ["k"], "t", ["t"], 7).collect():
        got[r["k"], r["t"]] = (r["__prev"] and r["__prev"]["t"], r["__next"] and r["__next"]["t"])
    for k in ("a", None):
        times = sorted(t for kk, t in data if kk == k)
        for i, t in enumerate(times):
            assert got[k, t] == (times[i - 1] if i else None, times[i + 1] if i + 1 < len(times) else None)
    ranks = {(r["k"], r["t"]): r["rank"] for r in with_rank(df, ["k"], "t", [], 7).collect()}
    assert all(ranks[k, t] == 1 + sum(1 for kk, u in data if kk == k and u < t) for k, t in data)


# 1 drift


def _files(spark, files):
    meta = [(i + 1, "r1", kind, seq) for i, (kind, seq, _) in enumerate(files)]
    lines = [(i + 1, n + 1, text, "x") for i, (_, _, texts) in enumerate(files) for n, text in enumerate(texts)]
    return spark.createDataFrame(lines, "file_id long, line_no int, line_text string, pos string"), spark.createDataFrame(meta, "file_id long, rig_id string, file_kind string, file_seq int")


def test_drift_reports_every_change(spark):
    lines, files = _files(
        spark,
        [
            ("event", 1, ["Behavior,Start (s),Stop (s),Duration (s)", "sleep,1.0,2.0,1.0", "walking,3.0,4.0,1.0"]),
            ("event", 2, ["﻿ behavior ;Start (s);Stop (s);Duration (s)", "4;1,0;2,0;1,0", "5;3,0;4,0;1,0", "broken;line"]),
            ("event", 4, ["Start (s),Stop (s),Duration (s),Ethogram item,FPS", "1.0,2.0,1.0,sleep,25"]),
            ("event", 5, ["Start (s),Stop (s),Duration (s)", ""]),
            ("telemetry", 1, ["# Col 2:,Pressure,x,x,Rate: 500", "Time,Pressure,Temp", "01/01/2024 01:00:00 AM,-1.5,37.0"]),
            ("telemetry", 2, ["Time,Pressure,Luftdruck,Temp", "01/01/2024 01:00:00 AM,-1.5,1001.5,37.0"]),
            ("telemetry", 3, ["Time,Pressure,Temp,P_atm", "01/01/2024 01:00:00 AM,-1.5,37.0,99871", "01/01/2024 01:00:01 AM,-1.5,37.0,99872"]),
            ("telemetry", 4, []),
        ],
    )
    got = drift.schema_changes(lines, files).where(F.col("field_name").isin("AtmPressure", "behavior")).select("file_id", "field_name", "change_kind")
    assert rows(got) == sorted(
        map(
            str,
            [(2, "behavior", "retyped"), (3, "behavior", "renamed"), (3, "behavior", "retyped"), (4, "behavior", "removed")]
            + [(6, "AtmPressure", "added"), (7, "AtmPressure", "renamed"), (7, "AtmPressure", "retyped"), (8, "AtmPressure", "removed")],
        )
    )
    one = drift.unified_rows(lines, files, "telemetry").select("file_id", "line_no", "atmpressure")
    assert rows(one) == ["(5, 3, None)", "(6, 2, 1001.5)", "(7, 2, 998.71)", "(7, 3, 998.72)"]


def test_unified_rows_are_typed(spark):
    lines, files = _files(
        spark,
        [
            ("event", 1, ["Behavior;Start (s);Stop (s);Duration (s)", "sleep;1,5;1:02:03,5;", "walking;-0:01.5;abc;3 s"]),
            ("event", 2, ["Start (s),Bout type,Stop (s),Duration (s),Comment,FPS", '"2",sleep,3,1,"a, b",25']),
            ("event", 3, ["Start (s),Stop (s),Duration (s),Comment", "2,3,1,nothing"]),
        ],
    )
    one = drift.unified_rows(lines, files, "event")
    assert dict(one.dtypes)["start"] == "double" and dict(one.dtypes)["behavior"] == "string"
    got = rows(one.select("file_id", "line_no", "behavior", "start", "stop", "duration", "stop_text", "fps"))
    assert got == sorted(map(str, [(1, 2, "sleep", 1.5, 3723.5, None, "1:02:03,5", None), (1, 3, "walking", -1.5, None, 3.0, "abc", None), (2, 2, "sleep", 2.0, 3.0, 1.0, "3", 25.0), (3, 2, None, 2.0, 3.0, 1.0, "3", None)]))


def test_drift_empty(spark):
    lines, files = _files(spark, [])
    assert drift.schema_changes(lines, files).count() == 0
    assert drift.unified_rows(lines, files, "event").count() == 0


# 2 instants


def _utc(text):
    import datetime

    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text,tz,near,want",
    [
        ("05/09/2024 09:09:15 a.m.", "Europe/Berlin", "2024-09-05 07:20:00", "2024-09-05 07:09:15"),
        ("09/05/2024 09:36:23 AM", "Europe/Berlin", "2024-09-05 07:20:00", "2024-09-05 07:36:23"),
        ("2024-09-05 07:43:43", "Europe/Berlin", "2024-09-05 07:40:00", "2024-09-05 07:43:43"),
        ("45483.69591435", "Europe/Berlin", "2024-07-10 14:30:00", "2024-07-10 14:42:07"),
        ("1725521920500", "Europe/Berlin", "2024-09-05 07:24:00", "2024-09-05 07:38:41"),
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 05:20:00", "2024-11-03 05:30:00"),
        ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 06:20:00", "2024-11-03 06:30:00"),
        ("2024-11-14 21:07:15 CET", "Europe/Berlin", "2024-11-14 20:00:00", "2024-11-14 20:07:15"),
        ("23/04/2025 01:40:16 AM.470", "Europe/Berlin", "2025-04-22 23:30:00", "2025-04-22 23:40:16"),
        ("Sep 5, 2024 09:11:55 AM", "Europe/Berlin", "2024-09-05 07:20:00", "2024-09-05 07:11:55"),
        ("12/10/24 03:45:20", "UTC", "2024-10-12 03:40:00", "2024-10-12 03:45:20"),
        ("31/02/2025 10:07:06 AM", "UTC", "2025-02-28 10:00:00", None),
        ("10/06/2025 27:12:14", "UTC", "2025-06-10 10:00:00", None),
        ("24/07/2024 18:42", "UTC", "2024-07-24 18:40:00", None),
        ("see protocol", "UTC", "2025-02-28 10:00:00", None),
        ("", "UTC", "2025-02-28 10:00:00", None),
        ("x" * 100_000, "UTC", "2025-02-28 10:00:00", None),
        ("1" * 100_000, "UTC", "2025-02-28 10:00:00", None),
        (" " * 100_000 + "2024-09-05 07:43:43 " + " " * 70, "UTC", "2024-09-05 07:40:00", "2024-09-05 07:43:43"),
        ("2024-09-05 07:43:43 +02:00", "UTC", "2024-09-05 05:40:00", "2024-09-05 05:43:43"),
        ("5 Sept. 2024 07:43:43.25 pm", "UTC", "2024-09-05 19:40:00", "2024-09-05 19:43:43"),
        ("20240905T074343Z", "UTC", "2024-09-05 07:40:00", "2024-09-05 07:43:43"),
        (None, "UTC", "2025-02-28 10:00:00", None),
        ("2024-02-29 12:00:00", None, None, "2024-02-29 12:00:00"),
    ],
)
def test_text_instants(spark, text, tz, near, want):
    df = spark.createDataFrame([(1, text, tz, near, 0)], "id long, text string, tz string, near string, y int").withColumn("near", F.col("near").cast("timestamp_ntz"))
    got = [r.utc_us // 1_000_000 + (r.utc_us % 1_000_000 >= 500_000) for r in instants.text_instants(df, "id", "text", "tz", "near").collect()]
    assert got == ([_utc(want)] if want else [])


def test_wall_clock_set_back(spark):
    # the counter steps back an hour at 06:00 UTC, line 4
    lines = [("r", 1, n, 100 + n, t) for n, t in ((1, 0.0), (2, 1200.0), (3, 2400.0), (4, 0.0), (5, 1200.0), (6, float("nan")))]
    lines = spark.createDataFrame(lines, "recording_id string, file_no int, line_no int, row_id long, timesincereference double")
    files = spark.createDataFrame([("r", 1, "America/New_York", "wall", None, 1200.0, "2024-11-03 05:10:00")], "recording_id string, file_no int, tz string, clock_kind string, time_unit string, interval_s double, device_start_utc string")
    files = files.withColumn("device_start_utc", F.col("device_start_utc").cast("timestamp_ntz"))
    got = {r.line_no: r.utc_us // 1_000_000 - _utc("2024-11-03 05:10:00") for r in instants.wall_clock_instants(lines, files).collect()}
    assert got == {1: 0, 2: 1200, 3: 2400, 4: 3600, 5: 4800}
    last = instants.wall_clock_instants(lines, files, last_only=True).collect()
    assert [(r.line_no, r.row_id) for r in last] == [(5, 105)]
    assert instants.wall_clock_instants(lines.limit(0), files).count() == 0


# 4 rejects


def test_rejects(spark):
    lines, files = _files(
        spark,
        [
            ("event", 1, ['Behavior,"Start (s)",Stop (s),Duration (s),Comment', 'sleep,1.5 s,2,0.5,"a, ""b"""', 'sleep,1,2,"1,ok', 'sleep,1,2,1', "sleep,abc,2,1,x", "sleep,NA,,n/a,", "   ", 'no"te,1,2,1,x', "sleep,-0:01.5,0:00:02,-1,x", "sleep,1:70,2,1,x", ' "sleep" , 12 ,2, 3 ,x']),
            ("config", 1, ["telemetry_file;event_file;behaviour;video_time;bin_size", "a;b;c;d; 60 ", "a;b;c;d;0", "a;b;c;d;", 'a;b;"c"x;d;5', "a;b;c;d;5;e"]),
            ("event", 2, ["Start (s)\tStop (s)\tDuration (s)", '\t"1"\t 2', ' "3,5"\t4\t1']),
            ("telemetry", 1, ["Time,x", "bad"]),
        ],
    )
    got = {(r.file_id, r.line_no): r.reason for r in rejects.parse_lines(lines, files).collect()}
    want = {2: None, 3: "quoting", 4: "columns", 5: "value", 6: None, 8: "quoting", 9: "value", 10: "value", 11: None}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == want
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {2: None, 3: "value", 4: "value", 5: "quoting", 6: "columns"}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {2: None, 3: None}
    loaded = {r.line_no: r for r in rejects.parse_lines(lines, files).where("reason is null and file_id = 1").collect()}
    assert (loaded[2].start_s, loaded[2].duration_s, loaded[2].label) == (1.5, 0.5, "sleep")
    assert (loaded[6].start_s, loaded[6].stop_s, loaded[6].duration_s) == (None, None, None)
    assert rejects.parse_lines(lines.limit(0), files).count() == 0


def test_records_across_line_breaks(spark):
    texts = ['Behavior,Start (s),Stop (s),Duration (s),Comment', 'sleep,1,2,1,"first', 'second, ""third""', 'last"', "walking,3,4,1,x", 'digging,5,6,1,"a"', 'sleep,7,8,1,"', '"', "climbing,9,10,1"]
    lines, files = _files(spark, [("event", 1, texts), ("event", 2, [*texts[:5], 'x,1,2,1,"open', *["walking,3,4,1,y"] * 12])])
    for block in (2, 4096):
        got = rejects.assemble_records(lines.where("file_id = 1 and line_no > 1"), block).collect()
        assert sorted((r.line_no, r.line_text) for r in got) == [(2, "\n".join(texts[1:4])), (5, texts[4]), (6, texts[5]), (7, "\n".join(texts[6:8])), (9, texts[8])]
    got = {(r.file_id, r.line_no): r.reason for r in rejects.parse_lines(lines, files, spanning=True).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {2: None, 5: None, 6: None, 7: None, 9: "columns"}
    long = rejects.assemble_records(lines.where("file_id = 2 and line_no > 1"), 4, most=10).collect()
    assert sorted(r.line_no for r in long) == [2, *range(5, 19)]
    assert rejects.parse_lines(lines.limit(0), files, spanning=True).count() == 0


# 5 grid


def test_grid_matches_brute_force_and_fills(spark):
    random.seed(2)
    nan = float("nan")
    data = [(random.choice(["a", "b", None]), random.choice([random.uniform(-3e4, 3e4), nan, 5.0, None]), random.choice([None, 1.0, nan, 3.0])) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, t double, v double").withColumn("status", F.lit("clash"))
    got = {tuple(r) for r in grid.regular_grid(df, ["k"], "t", ["v"], 10.0).where("status <> 'observed'").select("k", "cell_no").collect()}
    want = set()
    for k in ("a", "b", None):
        cells = {math.floor(t / 10) for kk, t, v in data if kk == k and t is not None and v is not None and not math.isnan(t) and not math.isnan(v)}
        want |= {(k, c) for c in range(min(cells), max(cells)) if c not in cells}
    assert got == want
    small = spark.createDataFrame([("a", 5.0, 1.0), ("a", 6.0, 3.0), ("a", 35.0, 5.0), ("a", 205.0, 0.0)], "k string, t double, v double")
    bounds = spark.createDataFrame([("a", -1, 21)], "k string, first_cell long, last_cell long")
    out = {r.cell_no: (r.value, r.status) for r in grid.regular_grid(small, ["k"], "t", ["v"], 10.0, bounds=bounds).collect()}
    assert out[0] == (2.0, "observed") and out[1] == (3.0, "filled") and out[10] == (None, "gap") and out[-1] == (None, "edge") and out[21] == (None, "edge")
    assert sorted(out) == list(range(-1, 22))
    assert grid.regular_grid(small.limit(0), ["k"], "t", ["v"], 10.0).count() == 0


# 6 spikes


def _telemetry(spark, data):
    cols = "recording_id string, file_no int, row_id long, t double, line_no int, smoothedpressure double, temp double, activity double, atmpressure double, value double"
    return spark.createDataFrame(data, cols)


def test_spikes_stuck_and_impossible(spark):
    rng = np.random.default_rng(3)
    data, want = [], set()
    for i in range(3000):
        temp = 37 + 0.3 * math.sin(i / 200) + rng.normal(0, 0.03)
        p = rng.normal(0, 1)
        if i in (500, 501, 502):
            temp, _ = 43.0, want.add((i, "temp"))
        if 1000 <= i < 1040:
            temp, _ = 37.125, want.add((i, "temp"))
        if i == 2000:
            p, _ = -999.0, want.add((i, "smoothedpressure"))
        if i in (980, 1490):  # near and on block edges
            p, _ = 60.0, want.add((i, "smoothedpressure"))
        data.append(("r", 1, i, float(i), i, float(p), float(temp), 0.0, None if i % 4 else float("nan"), 9.0))
    data.append((None, None, 9999, None, None, None, None, None, None, None))
    random.shuffle(data)
    df = _telemetry(spark, data)
    for block in (20_000, 500):
        got = {(r.row_id, r.signal_name) for r in spikes.flag_spikes(df, ["recording_id", "file_no"], "row_id", "t", "line_no", part_rows=block).collect()}
        assert got == want
    assert spikes.flag_spikes(df.limit(0), ["recording_id", "file_no"], "row_id", "t", "line_no").count() == 0


def test_stuck_run_over_many_blocks(spark):
    data = [("r", 1, i, float(i), i, None, 37.0 if 95 <= i < 330 else 37.0 + (i % 7) / 100 + 0.01, None, None, None) for i in range(400)]
    got = {r.row_id for r in spikes.flag_spikes(_telemetry(spark, data), ["recording_id", "file_no"], "row_id", "t", "line_no", part_rows=50).where("reason = 'stuck'").collect()}
    assert got == set(range(95, 330))


def test_residuals_of_pieces_are_those_of_the_whole():
    rng = np.random.default_rng(13)
    for n in (3, 20, 26, 57, 300):
        for window in (25, 11):
            x = np.cumsum(rng.normal(size=n))
            whole = spikes.residuals(x, window)
            cuts = np.sort(rng.choice(np.arange(1, n), min(4, n - 1), replace=False))
            reach, got = window + 2 * spikes.STRIDE, []
            for a, b in zip([0, *cuts], [*cuts, n]):
                got.append(spikes.residuals(x[a:b], window, spikes.Around(before=x[max(0, a - reach) : a], after=x[b : b + reach], n_before=a, n_all=n)))
            assert np.allclose(np.concatenate(got), whole)


def test_spikes_do_not_hang_on_pieces(spark):
    rng = np.random.default_rng(14)
    data = []
    for source, n in (("hot", 2500), ("a", 60), ("b", 60), (None, 90)):
        for i in range(n):
            t = None if source == "hot" and i % 5 == 0 else 7.0 if source == "b" else float(i // 2)  # no time, one time, ties
            temp = 36.6 + rng.normal(0, 0.02)
            stuck = 37.2 if source == "hot" and 1200 <= i < 1900 else None
            p = 90.0 if rng.random() < 0.004 else rng.normal(0, 1)
            data.append((source, 1, len(data), t, i, float(p), float(stuck or temp), 3.0 if i < 45 else 0.0, None if rng.random() < 0.7 else 1000.0, 0.0))
    df = _telemetry(spark, data)
    found = [rows(spikes.flag_spikes(df, ["recording_id", "file_no"], "row_id", "t", "line_no", part_rows=k)) for k in (100_000, 300, 37)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 700
    assert {"stuck", "spike"} == {r.reason for r in spikes.flag_spikes(df, ["recording_id", "file_no"], "row_id", "t", "line_no", part_rows=37).select("reason").distinct().collect()}


def test_what_comes_every_day_is_no_spike(spark):
    rng = np.random.default_rng(15)
    data = []
    for k in range(12 * 144):  # a reading every ten minutes, for twelve days; from eight to nine they are always high
        hour = k % 144 / 6
        value = 36.5 + rng.normal(0, 0.03) + (1.2 if 8 <= hour < 9 else 0.0) + (1.2 if k == 5 * 144 + 100 else 0.0)
        data.append(("r", 1, k, k * 600.0, k, None, float(value), None, None, 0.0))
    df = _telemetry(spark, data)
    for part_rows in (100_000, 100):
        got = [r.row_id for r in spikes.flag_spikes(df, ["recording_id", "file_no"], "row_id", "t", "line_no", part_rows=part_rows).collect()]
        assert 5 * 144 + 100 in got and len(got) <= 3


# 7 intervals


def test_intervals_match_brute_force(spark):
    random.seed(4)
    data = [(random.choice(["a", "a", "a", None]), random.choice([1, 2]), s := random.randrange(4000), s + random.choice([0, 1, 30, 200]), "x") for _ in range(2000)]
    data += [("z", 1, None, 3, "x"), ("z", 1, 5, 3, "x"), ("c", 1, 5, 5, "x")]
    df = spark.createDataFrame(data, "k string, n int, s long, e long, row_kind string")
    want, groups = [], {}
    for k, n, s, e, _ in data:
        if s is not None and s <= e:
            groups.setdefault((k, n), []).append((s, e))
    for (k, n), spans in groups.items():
        spans.sort()
        start, end, count = *spans[0], 1
        for s, e in spans[1:]:
            if s <= end:
                end, count = max(end, e), count + 1
            else:
                want += [(k, n, "period", start, end, count), (k, n, "gap", end, s, 0)]
                start, end, count = s, e, 1
        want.append((k, n, "period", start, end, count))
    for parts in (1, 9):
        assert rows(intervals.merge_intervals(df, ["k", "n"], "s", "e", parts)) == sorted(map(str, want))
    assert intervals.merge_intervals(df.limit(0), ["k", "n"], "s", "e").count() == 0
