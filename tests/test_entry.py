"""Every query with a SQL twin, against DuckDB on the smallest tables; sources and sinks."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from ventra.plans import reference
from ventra import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted({**core.ORACLE, **reference.ORACLE}))
def test_against_sql(spark, tables, name):
    got = entry.queries()[name](spark, DIR)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda rows: sorted(tuple(str(round(float(v), 5) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    assert plain(got.select(cols).collect()) == plain(want.select(*cols).fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["photometry_peaks", "photometry_peak_bins", "batch_run", "segment_log", "pressure_per_bin", "spectrum_metrics", "p1_unified_events"])
def test_queries_without_sql_run(spark, name):
    got = entry.queries()[name](spark, DIR)
    assert got.count() >= 0 and len(set(got.columns)) == len(got.columns)


def test_frames_from_telemetry_text(spark):
    from datetime import datetime

    from ventra.sources import frames

    head = ["# Col 2:,Pressure,x,x,Rate: 4", "# Col 3:,Temp,x,x,Rate: 1", "Time,Pressure,Temp"]
    texts = {
        1: [*head, "03/07/2023 01:00:00 a.m.,,", "03/07/2023 01:00:01 AM,1,36", "03/07/2023 01:00:01 AM,2,x", "03/07/2023 13:00:00 AM,3,37", "no time,4,37"],
        2: [*head, "07/03/2023 11:59:59.5 PM,5,", "07/03/2023 11:59:59.5 PM,6,38", "07/03/2023 11:59:58.25 PM,7,", "07/03/2023 11:59:59 PM,8,39"],
        3: ["# Col 2:,Pressure,x,x,Rate: 0", "x,1"],
        4: ["# Col 2:,Apr,x,x,Rate", "time,a", "04/07/2023 01:00:00 AM.25,1000"],
    }
    lines = spark.createDataFrame([(f, i, t) for f, rows in texts.items() for i, t in enumerate(rows, 1)], "file_path long, line_no int, line string")
    near = spark.createDataFrame([(1, datetime(2023, 7, 3)), (2, datetime(2023, 7, 3)), (4, None)], "file_path long, near timestamp").withColumn("near", __import__("pyspark").sql.functions.col("near").cast("timestamp_ntz"))
    got = sorted((r.file_path, r.t_s, r.pressure, r.temp, r.n_lines) for r in frames.aligned_frame(lines, near, "first_valid").collect())
    assert got == [(1, 0.0, 1.0, 36.0, 1), (1, 0.25, 2.0, None, 1), (2, 0.0, 7.0, None, 1), (2, 1.25, 5.0, 38.0, 2)]
    got = {r.file_path: r.t_s for r in frames.aligned_frame(lines, near, "alignment").where("pressure in (1, 7)").collect()}
    assert got == {1: 3601.0, 2: 86_398.25}
    from ventra.sources.files import telemetry_rows

    forms = {r.file_path: (r.form, r.is_day_first) for r in frames.timestamp_formats(telemetry_rows(lines), near).collect()}
    assert forms == {1: ("none", True), 2: ("before", False), 3: ("none", False), 4: ("after", False)}
    faults = {(r.file_path, r.fault) for r in frames.telemetry_faults(lines).collect()}
    assert faults == {(3, "no header"), (3, "bad rate"), (4, "bad rate"), (4, "no pressure"), (4, "no usable signal")}
    assert frames.aligned_frame(lines.limit(0), near).count() == frames.telemetry_faults(lines.limit(0)).count() == 0
    with pytest.raises(ValueError):
        frames.aligned_frame(lines, near, "now")


def test_readings_are_filled_inside_stretches(spark):
    from ventra.sources.frames import fill_inside

    data = [("a", t, v) for t, v in ((0, None), (1, 1.0), (2, None), (5, None), (6, 7.0), (7, None), (30, 9.0), (31, float("nan")), (33, 12.0), (40, None))] + [(None, 1, 2.0), (None, 2, None), (None, 3, 4.0), ("b", None, 1.0)]
    got = fill_inside(spark.createDataFrame(data, "k string, t long, v double"), ["k"], "t", "v", 6, block=3).collect()
    assert sorted((str(r.k), r.t, r.v, r.was_filled) for r in got) == [
        ("None", 1, 2.0, False), ("None", 2, 3.0, True), ("None", 3, 4.0, False),
        ("a", 1, 1.0, False), ("a", 2, 3.0, True), ("a", 5, 5.0, True), ("a", 6, 7.0, False), ("a", 30, 9.0, False), ("a", 31, 10.5, True), ("a", 33, 12.0, False),
    ]


def test_telemetry_text_and_tables(spark, tmp_path):
    from ventra.sources import files, sinks

    p = tmp_path / "a.asc"
    p.write_text("# Col 2:,Pressure,x,x,Rate: 500\n# Col 3:,Temp,x,x,Rate: 10\n\n# Col 4:,APR,x,x,Rate: 1\nTime,Pressure,Temp,APR\n01/11/2025 05:05:09 PM,1.0,36.0,x\n01/11/2025 05:05:10 PM,,37.5,100\n")
    lines = files.read_lines(spark, str(p))
    assert files.header_lines(lines).first().head == 4
    assert sorted((r.position, r.signal, r.rate_hz) for r in files.channels(lines).collect()) == [(2, "pressure", 500.0), (3, "temp", 10.0), (4, "atm", 1.0)]
    rows = files.telemetry_rows(lines).orderBy("line_no").collect()
    assert [(r.date_text, r.pressure, r.temp, r.atm, r.activity) for r in rows] == [("01/11/2025 05:05:09 PM", 1.0, 36.0, None, None), ("01/11/2025 05:05:10 PM", None, 37.5, 100.0, None)]
    e = tmp_path / "e.csv"
    e.write_text("Scored Behavior,Start (s),Stop (s),Duration (s)\nsleep,90,95,5\neat,60,61,1\nsleep,10,bad,5\n")
    assert sorted((r.event, r.start, r.instance, r.end) for r in files.read_events(spark, str(e)).collect()) == [("eat", 60.0, 1, 61.0), ("sleep", 10.0, 1, None), ("sleep", 90.0, 2, 95.0)]
    assert files.detect_kind(spark, str(e)) == "behaviour"
    f = tmp_path / "f.csv"
    f.write_text("# t_min,dFoF_465,other\n0,0.1,a\n0.5,bad,b\n1,0.2,c\n")
    assert [r.t for r in files.read_photometry(spark, str(f)).orderBy("t").collect()] == [0.0, 60.0]
    assert files.detect_kind(spark, str(f)) == "photometry"
    with pytest.raises(ValueError):
        files.read_batch_config(spark, str(e))
    out = sinks.write_tables({"rows": files.telemetry_rows(lines)}, str(tmp_path / "out"))
    assert spark.read.parquet(out[0]).count() == 2
    sinks.write_run(spark, str(tmp_path / "out"), "complete", {"bin": 10})
    assert '"complete"' in spark.read.text(str(tmp_path / "out" / "run")).first().value


def test_streaming_twin(spark, tmp_path):
    from pyspark.sql import functions as F

    from ventra.streaming.twins import stream_bins, stream_coverage

    src = str(tmp_path / "in")
    spark.createDataFrame([("r", t, float(t)) for t in (0, 10, 70, 4000)], "k string, s long, v double").select("k", F.timestamp_seconds("s").alias("ts"), "v").write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, ts timestamp, v double").parquet(src)
    for n, df in (("bins", stream_bins(stream(), ["k"], "ts", "v")), ("cover", stream_coverage(stream(), ["k"], "ts", "30 seconds"))):
        q = df.writeStream.format("memory").queryName(n).outputMode("complete" if n == "bins" else "append").option("checkpointLocation", str(tmp_path / n)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.mean, r.n) for r in spark.table("bins").orderBy("bin_start").collect()] == [(5.0, 2), (70.0, 1), (4000.0, 1)]
    assert sorted(r.n for r in spark.table("cover").collect())[-1] == 2
