"""Queries for the analysis operators, over recordings, scored events and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, asof, bins, breaths, coverage
from ..operators.neighbours import with_rank
from ..session import durable, table
from .timeline import FILE, HOUR, TIMELINE, readings, valid
from .timeline import valid_sql as _valid_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _ms(c: str):
    return F.when(~F.isnan(c), F.round(F.col(c) * 1000)).cast("bigint")


_COVER = f"""with {TIMELINE}, {_valid_sql('smoothedpressure')}, marked as (
  select *, ms - lag(ms) over (partition by recording_id, file_no order by ms) step from v
), islands as (
  select *, sum(case when step is null or step > 5000 then 1 else 0 end) over (partition by recording_id, file_no order by ms rows unbounded preceding) island from marked
), cover as (
  select recording_id, file_no, min(ms) start_at, max(ms) end_at from islands group by recording_id, file_no, island
)"""


@query(_COVER + " select * from cover")
def coverage_intervals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_intervals(valid(spark, d, "smoothedpressure"), FILE, "ms", 5000, HOUR)


@query(_COVER + " select recording_id, file_no, start_at + 1000 start_at, end_at - 1000 end_at from cover where end_at - start_at >= 2000")
def analyzable_intervals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.trim_intervals(coverage_intervals(spark, d), 1000)


def _windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_file")
    duration = F.when(~F.isnan("duration_s"), F.col("duration_s"))
    return e.select(F.col("event_id").alias("window_id"), *FILE, "event", _ms("start_s").alias("start_at"), _ms("end_s").alias("end_at"), duration.alias("duration"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return coverage.classify_windows(_windows(spark, d), coverage_intervals(spark, d), FILE, HOUR)


_CLASS = (
    _COVER
    + """, w as (
  select event_id window_id, recording_id, file_no, event, case when not isnan(start_s) then cast(round(start_s * 1000) as bigint) end s, case when not isnan(end_s) then cast(round(end_s * 1000) as bigint) end e,
    case when not isnan(duration_s) then duration_s end dur from event_file
), flags as (
  select window_id, bool_or(c.start_at <= s and e <= c.end_at) inside
  from w join cover c using (recording_id, file_no) where e >= c.start_at and s <= c.end_at group by 1
), classed as (
  select w.*, case when s is null or e is null or dur is null or dur < 30 or s > e or s > 5400000 or e > 5400000 then 'filtered'
    when inside then 'fully_covered' when inside is not null then 'partially_covered' else 'unavailable' end status
  from w left join flags using (window_id)
)"""
)


@query(_CLASS + " select window_id, event, status from classed")
def window_classification(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("window_id", "event", "status")


@query(_CLASS + " select status, count(*) n from classed group by 1")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_CLASS + " select window_id, event, s start_at, e end_at from classed where status = 'fully_covered'")
def selected_windows(spark: SparkSession, d: str) -> DataFrame:
    w = _classified(spark, d).where("status = 'fully_covered'")
    return w.select("window_id", "event", "start_at", "end_at")


@query(
    """select event_id, event, row_number() over (partition by recording_id, file_no, event
      order by case when not isnan(start_s) then cast(round(start_s * 1000) as bigint) end nulls last, event_id) instance
    from event_file where event is not null"""
)
def instance_number(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_file").where("event is not null").select("event_id", *FILE, "event", _ms("start_s").alias("ms"))
    return with_rank(e, [*FILE, "event"], "ms", ["event_id"], HOUR, "instance").select("event_id", "event", "instance")


@query(
    f"with {TIMELINE}"
    """ select recording_id, file_no, ms,
      arg_min(smoothedpressure, line_no) filter (smoothedpressure is not null and not isnan(smoothedpressure)) smoothedpressure,
      arg_min(temp, line_no) filter (temp is not null and not isnan(temp)) as temp,
      arg_min(activity, line_no) filter (activity is not null and not isnan(activity)) activity, count(*) n_lines
    from tl where ms is not null group by 1, 2, 3"""
)
def first_valid_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return align.first_valid(readings(spark, d), FILE, "ms", "line_no", ["smoothedpressure", "temp", "activity"])


@query(
    """with r as (select row_id, recording_id, file_no, timesincereference t,
      coalesce(case when not isnan(smoothedpressure) then smoothedpressure end, case when not isnan(temp) then temp end, case when not isnan(activity) then activity end) a,
      case when not isnan(smoothedpressure) then smoothedpressure end p from telemetry)
    select row_id from r join (select recording_id, file_no, min(t) filter (a is not null) lo, max(t) filter (p is not null) hi from r group by all) using (recording_id, file_no)
    where t between lo and hi"""
)
def trim_to_first_valid(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "telemetry").select("row_id", *FILE, "timesincereference", "smoothedpressure", "temp", "activity")
    return align.trim_to_valid(r, FILE, "timesincereference", ["smoothedpressure", "temp", "activity"], "smoothedpressure").select("row_id")


@query(
    """select event_id, round((epoch_us(entered_at) - epoch_us(device_start_utc)) / 1e6, 3) as seconds
    from event_file join recording_files using (recording_id, file_no) where entered_at is not null and device_start_utc is not null"""
)
def time_since_reference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_file").select("event_id", *FILE, "entered_at").join(table(spark, d, "recording_files").select(*FILE, "device_start_utc"), FILE)
    return e.select("event_id", F.round(align.seconds_since("entered_at", "device_start_utc"), 3).alias("seconds")).where("seconds is not null")


@query(
    """select recording_id, file_no, count(*) filter (t < before) n_jumps from (
      select recording_id, file_no, timesincereference t, lag(timesincereference) over (partition by recording_id, file_no order by line_no) before from telemetry)
    group by 1, 2"""
)
def backward_jumps(spark: SparkSession, d: str) -> DataFrame:
    return align.backward_jumps(table(spark, d, "telemetry"), FILE, "timesincereference", "line_no")


@query(
    """select row_id, round(floor(timesincereference) + (row_number() over (partition by recording_id, file_no, floor(timesincereference) order by line_no) - 1) * 0.1, 3) t_s
    from telemetry where timesincereference is not null and not isnan(timesincereference)"""
)
def subsecond_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "telemetry").select("row_id", *FILE, "line_no", F.floor("timesincereference").cast("double").alias("sec")).where("sec is not null")
    return align.spread_within_second(r, FILE, "sec", "line_no", F.lit(10.0)).select("row_id", F.round("t_s", 3).alias("t_s"))


@query(
    r"""select file_id, line_no, round(sum(case when regexp_matches(x, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast(x as double) end), 3) total,
      count(case when regexp_matches(x, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then 1 end) n_numbers
    from (select file_id, line_no, trim(unnest(string_split(line_text, ','))) x from raw_lines) group by 1, 2"""
)
def numeric_coercion(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines").select("file_id", "line_no", F.explode(F.split("line_text", ",", -1)).alias("x"))
    n = align.number(F.col("x"))
    return lines.groupBy("file_id", "line_no").agg(F.round(F.sum(n), 3).alias("total"), F.count(n).alias("n_numbers"))


@query(
    """select event_id window_id, cast(round(start_s * 1000) as bigint) - 8000 start_at, cast(round(end_s * 1000) as bigint) - 8000 end_at, round(duration_s, 3) duration
    from event_file where not isnan(start_s) and not isnan(end_s) and not isnan(duration_s)"""
)
def adjusted_behaviours(spark: SparkSession, d: str) -> DataFrame:
    w = align.shift_windows(_windows(spark, d), F.lit(-8000)).where("start_at is not null and end_at is not null and duration is not null")
    return w.select("window_id", "start_at", "end_at", F.round("duration", 3).alias("duration"))


_ASOF = f"""with {TIMELINE}, {_valid_sql('temp', 'src')}, tgt as ({{tgt}}), b as (
  select tgt.*, l.ms lm, l.temp lv, r.ms rm, r.temp rv
  from tgt asof left join src l on tgt.recording_id = l.recording_id and tgt.file_no = l.file_no and tgt.ms >= l.ms
  asof left join src r on tgt.recording_id = r.recording_id and tgt.file_no = r.file_no and tgt.ms <= r.ms
)"""


@query(
    _ASOF.replace("{tgt}", "select recording_id, file_no, ms, row_id from tl where atmpressure is not null and not isnan(atmpressure)")
    + " select row_id, round(case when lm is null or rm is null then null when lm = rm then lv else lv + (rv - lv) * ((ms - lm) / (rm - lm)) end, 5) as temp from b"
)
def interp_asof(spark: SparkSession, d: str) -> DataFrame:
    targets = readings(spark, d).where(align.present("atmpressure").isNotNull()).select("row_id", *FILE, "ms")
    near = asof.neighbours(targets, valid(spark, d, "temp"), FILE, "ms", "temp", HOUR)
    return near.select("row_id", F.round(asof.interpolated("ms"), 5).alias("temp"))


@query(
    _ASOF.replace("{tgt}", "select recording_id, file_no, cast(round(start_s * 1000) as bigint) ms, event_id from event_file where not isnan(start_s)")
    + " select event_id, case when lm is null then rv when rm is null or ms - lm <= rm - ms then lv else rv end as temp from b"
)
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "event_file").select("event_id", *FILE, _ms("start_s").alias("ms")).where("ms is not null")
    near = asof.neighbours(targets, valid(spark, d, "temp"), FILE, "ms", "temp", HOUR)
    return near.select("event_id", asof.nearest("ms").alias("temp"))


@query(
    """select recording_id, file_no, round(avg(atmpressure), 7) mean, round(stddev_samp(atmpressure), 5) sd, min(atmpressure) min, max(atmpressure) max
    from telemetry where atmpressure is not null and not isnan(atmpressure) group by 1, 2"""
)
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    s = bins.session_stats(table(spark, d, "telemetry"), FILE, "atmpressure")
    return s.withColumns({"mean": F.round("mean", 7), "sd": F.round("sd", 5)})


@query("select recording_id, file_no, min(timesincereference) lo, max(timesincereference) hi from telemetry where not isnan(timesincereference) group by 1, 2")
def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "telemetry").where("not isnan(timesincereference)").groupBy(*FILE).agg(F.min("timesincereference").alias("lo"), F.max("timesincereference").alias("hi"))


@query(
    f"""with {TIMELINE}, {_valid_sql('smoothedpressure', 'p')}, {_valid_sql('atmpressure', 'a')}, g as (
      select recording_id, file_no, min(ms) lo, greatest(1, cast(ceil((max(ms) - min(ms)) / 300000.0) as bigint)) n from p group by 1, 2
    ), spine as (select *, unnest(generate_series(0, n - 1)) b from g),
    s as (select recording_id, file_no, least(cast(floor((ms - lo) / 300000.0) as bigint), n - 1) b, avg(atmpressure) mean, stddev_samp(atmpressure) sd, count(*) c
      from a join g using (recording_id, file_no) where ms between lo and lo + n * 300000 group by 1, 2, 3)
    select recording_id, file_no, lo + b * 300000 bin_start, round(mean, 7) mean, round(sd, 5) sd, coalesce(c, 0) n from spine left join s using (recording_id, file_no, b)"""
)
def time_bins_closed_last(spark: SparkSession, d: str) -> DataFrame:
    spans = valid(spark, d, "smoothedpressure").groupBy(*FILE).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    b = bins.time_bins(valid(spark, d, "atmpressure"), spans, FILE, "ms", "atmpressure", 300_000)
    return b.select(*FILE, "bin_start", F.round("mean", 7).alias("mean"), F.round("sd", 5).alias("sd"), "n")


_ANCHOR = """anchor as (
  select recording_id, file_no, min(cast(round(start_s * 1000) as bigint)) anchor from event_file where event = 'injection' and not isnan(start_s) group by 1, 2)"""


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_file").where("event = 'injection'").select(*FILE, _ms("start_s").alias("ms"))
    return e.groupBy(*FILE).agg(F.min("ms").alias("anchor")).where("anchor is not null")


def _aligned(spark: SparkSession, d: str, signals: list[str]) -> DataFrame:
    return bins.aligned_bins(readings(spark, d).select(*FILE, "ms", *signals), _anchors(spark, d), FILE, "ms", signals, 600_000, 1_200_000, 60_000)


def _aligned_sql(signals: list[str]) -> str:
    cols = ", ".join(
        f"avg({s}) filter (not isnan({s})) {s}_mean, stddev_samp({s}) filter (not isnan({s})) / sqrt(count({s}) filter (not isnan({s}))) {s}_sem" for s in signals
    )
    out = ", ".join(f"round({s}_{k}, {7 if k == 'mean' else 5}) {s}_{k}" for s in signals for k in ("mean", "sem"))
    return f"""with {TIMELINE}, {_ANCHOR}, spine as (select *, unnest(generate_series(0, 29)) b from anchor),
    s as (select recording_id, file_no, cast(floor((ms - anchor + 600000) / 60000.0) as bigint) b, {cols}
      from tl join anchor using (recording_id, file_no) group by 1, 2, 3)
    select recording_id, file_no, b * 60000 - 600000 bin_start, {out} from spine left join s using (recording_id, file_no, b)"""


@query(_aligned_sql(["temp"]))
def signal_bins_mean_sem(spark: SparkSession, d: str) -> DataFrame:
    b = _aligned(spark, d, ["temp"])
    return b.select(*FILE, F.col("bin_start").cast("bigint").alias("bin_start"), F.round("temp_mean", 7).alias("temp_mean"), F.round("temp_sem", 5).alias("temp_sem"))


@query(_aligned_sql(["smoothedpressure", "temp", "activity"]))
def combine_bins(spark: SparkSession, d: str) -> DataFrame:
    b = _aligned(spark, d, ["smoothedpressure", "temp", "activity"])
    rounded = [F.round(c, 7 if c.endswith("_mean") else 5).alias(c) for c in b.columns if c.endswith(("_mean", "_sem"))]
    return b.select(*FILE, F.col("bin_start").cast("bigint").alias("bin_start"), *rounded)


@query(
    f"with {TIMELINE}"
    """ select recording_id, file_no, cast(round_even(ms * 0.0001, 0) as bigint) slot, arg_min(atmpressure, {'t': ms, 'l': line_no}) atmpressure
    from tl where atmpressure is not null and not isnan(atmpressure) and ms is not null group by 1, 2, 3"""
)
def downsample_first_per_bin(spark: SparkSession, d: str) -> DataFrame:
    return bins.down_sample(readings(spark, d).where("ms is not null"), FILE, "ms", "line_no", "atmpressure", 0.0001).select(*FILE, "slot", "atmpressure")


@query(
    f"with {TIMELINE}"
    """, m as (select recording_id, file_no, cast(floor(ms / 60000.0) as bigint) as minute, avg(activity) mean
      from tl where ms is not null and activity is not null and not isnan(activity) group by 1, 2, 3)
    select recording_id, file_no, minute, round(mean, 7) mean, round(mean / nullif(max(mean) over (partition by recording_id, file_no), 0), 7) scaled from m"""
)
def minute_activity(spark: SparkSession, d: str) -> DataFrame:
    m = bins.minute_means(readings(spark, d).where("ms is not null"), FILE, "ms", "activity", 60_000)
    return m.select(*FILE, "minute", F.round("mean", 7).alias("mean"), F.round("scaled", 7).alias("scaled"))


@query(
    f"""with {TIMELINE}, {_valid_sql('smoothedpressure')}, s as (select *, ms - lag(ms) over (partition by recording_id, file_no order by ms) step from v)
    select recording_id, file_no, round(1000.0 / median(step), 6) rate from s where step > 0 group by 1, 2"""
)
def sample_rate(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.neighbours import with_neighbour

    v = with_neighbour(valid(spark, d, "smoothedpressure"), FILE, "ms", ["ms"], HOUR).withColumn("step", F.col("ms") - F.col("__near.ms"))
    return v.where("step > 0").groupBy(*FILE).agg(F.round(F.lit(1000.0) / F.median("step"), 6).alias("rate"))


_EXTREMES = f"""with {TIMELINE}, {_valid_sql('smoothedpressure')}, n as (
  select *, lag(smoothedpressure) over w p, lead(smoothedpressure) over w x from v window w as (partition by recording_id, file_no order by ms)
), ext as (
  select recording_id, file_no, ms, smoothedpressure, case when smoothedpressure > p and smoothedpressure > x then 'peak' when smoothedpressure < p and smoothedpressure < x then 'trough' end kind from n
), e as (select * from ext where kind is not null)"""


def _extremes(spark: SparkSession, d: str) -> DataFrame:
    return durable(breaths.local_extremes(valid(spark, d, "smoothedpressure"), FILE, "ms", "smoothedpressure", HOUR))


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return _extremes(spark, d).where("kind = 'peak' and smoothedpressure > 0").drop("kind")


_PEAKS = _EXTREMES + ", peaks as (select recording_id, file_no, ms, smoothedpressure from e where kind = 'peak' and smoothedpressure > 0)"


@query(_EXTREMES + " select * from e")
def peak_local_max(spark: SparkSession, d: str) -> DataFrame:
    return _extremes(spark, d)


@query(
    _PEAKS
    + """ select *, row_number() over w ordinal, cast(lead(ms) over w - ms as double) as "interval" from peaks window w as (partition by recording_id, file_no order by ms)"""
)
def isi_and_rank(spark: SparkSession, d: str) -> DataFrame:
    return breaths.peak_intervals(_peaks(spark, d), FILE, "ms", HOUR).withColumn("interval", F.col("interval").cast("double"))


@query(
    _PEAKS
    + f""", {_ANCHOR}, spine as (select *, unnest(generate_series(0, 29)) b from anchor), i as (
      select recording_id, file_no, smoothedpressure, ms, cast(floor((ms - anchor + 600000) / 60000.0) as bigint) b from peaks join anchor using (recording_id, file_no)
    ), j as (select *, lead(ms) over (partition by recording_id, file_no, b order by ms) - ms step from i),
    s as (select recording_id, file_no, b, count(*) n_peaks, avg(smoothedpressure) amplitude, stddev_samp(smoothedpressure) / sqrt(count(*)) amplitude_sem,
      avg(step) as "interval", stddev_samp(step) / sqrt(count(step)) interval_sem from j group by 1, 2, 3)
    select recording_id, file_no, b * 60000 - 600000 bin_start, coalesce(n_peaks, 0) n_peaks, round(amplitude, 7) amplitude, round(amplitude_sem, 5) amplitude_sem,
      round("interval", 7) as "interval", round(interval_sem, 5) interval_sem
    from spine left join s using (recording_id, file_no, b)"""
)
def peak_bins(spark: SparkSession, d: str) -> DataFrame:
    b = breaths.peak_bins(_peaks(spark, d), _anchors(spark, d), FILE, "ms", "smoothedpressure", 600_000, 1_200_000, 60_000, HOUR)
    return b.select(*FILE, "bin_start", "n_peaks", F.round("amplitude", 7).alias("amplitude"), F.round("amplitude_sem", 5).alias("amplitude_sem"), F.round("interval", 7).alias("interval"), F.round("interval_sem", 5).alias("interval_sem"))


_CYCLES = (
    _EXTREMES
    + """, ranked as (
  select *, row_number() over (partition by recording_id, file_no, kind order by ms) k,
    min(case when kind = 'peak' then ms end) over (partition by recording_id, file_no) first_p,
    min(case when kind = 'trough' then ms end) over (partition by recording_id, file_no) first_t from e
), zipped as (
  select recording_id, file_no, t.k, t.ms trough_t, t.smoothedpressure trough_v, p.ms peak_t, p.smoothedpressure peak_v
  from (select * from ranked where kind = 'trough') t
  join (select *, case when first_t > first_p then k - 1 else k end kk from ranked where kind = 'peak') p using (recording_id, file_no) where t.k = p.kk
), cyc as (
  select recording_id, file_no, k, trough_t, peak_t, peak_t - trough_t t_in, lead(trough_t) over w - peak_t t_out, lead(trough_t) over w - trough_t t_total,
    abs(peak_v - trough_v) swing, lead(peak_t) over w - peak_t peak_to_peak
  from zipped window w as (partition by recording_id, file_no order by k)
)"""
)


def _breaths(spark: SparkSession, d: str) -> DataFrame:
    return breaths.cycles(_extremes(spark, d), FILE, "ms", "smoothedpressure", HOUR)


@query(
    _CYCLES
    + """ select recording_id, file_no, k, trough_t, peak_t, t_in, cast(t_out as double) t_out, cast(t_total as double) t_total, round(t_in / nullif(t_total, 0), 6) duty, round(swing, 4) swing,
      round(swing * 1000 / nullif(t_in, 0), 5) drive, cast(peak_to_peak as double) peak_to_peak from cyc"""
)
def breath_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _breaths(spark, d).withColumns({"duty": F.round("duty", 6), "swing": F.round("swing", 4), "drive": F.round("drive", 5), **{c: F.col(c).cast("double") for c in ("t_out", "t_total", "peak_to_peak")}})


@query(
    _CYCLES
    + """ select coalesce(recording_id, 'all') recording_id, coalesce(file_no, -1) file_no, count(*) n, round(avg(t_in), 7) t_in, round(avg(t_out), 7) t_out, round(avg(t_total), 7) t_total, round(avg(t_in / nullif(t_total, 0)), 7) duty,
      round(stddev_pop(t_total), 5) t_total_sd, round(avg(1000.0 / nullif(peak_to_peak, 0)), 7) frequency, round(avg(swing), 7) swing,
      round(stddev_pop(t_in), 5) t_in_sd, round(stddev_pop(t_out), 5) t_out_sd, round(stddev_pop(t_in / nullif(t_total, 0)), 5) duty_sd, round(stddev_pop(swing), 5) swing_sd,
      round(stddev_pop(1000.0 / nullif(peak_to_peak, 0)), 5) frequency_sd
    from cyc group by grouping sets ((recording_id, file_no), (recording_id), ())"""
)
def breath_summary(spark: SparkSession, d: str) -> DataFrame:
    s = breaths.cycle_summary(_breaths(spark, d), [FILE, ["recording_id"], []])
    digits = {"t_in": 7, "t_out": 7, "t_total": 7, "duty": 7, "t_total_sd": 5, "frequency": 7, "swing": 7, "t_in_sd": 5, "t_out_sd": 5, "duty_sd": 5, "swing_sd": 5, "frequency_sd": 5}
    return s.select(F.coalesce("recording_id", F.lit("all")).alias("recording_id"), F.coalesce("file_no", F.lit(-1)).alias("file_no"), "n", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(
    _CYCLES
    + """, bins as (select *, cast(floor((peak_t - min(trough_t) over (partition by recording_id, file_no)) / 60000.0) as bigint) bin from cyc)
    select recording_id, file_no, bin, count(*) n, round(avg(t_in), 7) t_in, round(avg(t_total), 7) t_total, round(avg(swing), 7) swing from bins group by 1, 2, 3 having count(*) >= 2"""
)
def binned_cycle_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = _breaths(spark, d)
    b = b.join(b.groupBy(*FILE).agg(F.min("trough_t").alias("lo")), FILE).withColumn("bin", F.floor((F.col("peak_t") - F.col("lo")) / 60_000))
    s = b.groupBy(*FILE, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("t_in").alias("t_in"), F.avg("t_total").alias("t_total"), F.avg("swing").alias("swing"))
    return s.where("n >= 2").select(*FILE, "bin", "n", F.round("t_in", 7).alias("t_in"), F.round("t_total", 7).alias("t_total"), F.round("swing", 7).alias("swing"))


_PERIODS = (
    _PEAKS.replace("with ", "with recursive ", 1)
    + """, pk as (select recording_id, file_no, ms, row_number() over (partition by recording_id, file_no order by ms) k from peaks
), sc as (
  select recording_id, file_no, k, ms, cast([] as bigint[]) recent, 1 run from pk where k = 1
  union all
  select recording_id, file_no, k, ms, case when gap > 3.0 * list_median(r) then cast([] as bigint[]) else r end, run + case when gap > 3.0 * list_median(r) then 1 else 0 end
  from (select pk.recording_id, pk.file_no, pk.k, pk.ms, run, pk.ms - sc.ms gap, list_slice(list_append(recent, pk.ms - sc.ms), greatest(1, len(recent) - 8), len(recent) + 1) r
    from sc join pk on pk.recording_id = sc.recording_id and pk.file_no = sc.file_no and pk.k = sc.k + 1)
), pd as (
  select recording_id, file_no, row_number() over (partition by recording_id, file_no order by min(ms)) - 1 period_no, min(ms) start_at, max(ms) end_at, count(*) n_peaks
  from sc group by recording_id, file_no, run having count(*) >= 10
), pp as (
  select recording_id, file_no, period_no, start_at, end_at, count(peaks.ms) n_inside from pd left join peaks using (recording_id, file_no) where peaks.ms between start_at and end_at group by all
)"""
)


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return breaths.valid_periods(_peaks(spark, d), FILE, "ms", min_peaks=10, interval_window=10, break_multiplier=3.0, block=HOUR)


@query(_PERIODS + " select * from pd")
def valid_periods(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d)


@query(_PERIODS + " select *, round(n_inside * 60000.0 / nullif(end_at - start_at, 0), 6) per_minute from pp")
def peaks_per_period(spark: SparkSession, d: str) -> DataFrame:
    peaks = _peaks(spark, d)
    periods = durable(breaths.valid_periods(peaks, FILE, "ms", min_peaks=10, interval_window=10, break_multiplier=3.0, block=HOUR))
    return breaths.peaks_per_period(peaks, periods, FILE, "ms", HOUR).withColumn("per_minute", F.round("per_minute", 6))


_PERIOD_BINS = (
    _PERIODS
    + """, ex as (
  select e.recording_id, e.file_no, period_no, start_at, kind, ms, smoothedpressure, cast(floor((ms - start_at) / 60000.0) as bigint) bin
  from e join pd on e.recording_id = pd.recording_id and e.file_no = pd.file_no and ms >= start_at and ms < start_at + floor((end_at - start_at) / 60000.0) * 60000
  where kind = 'trough' or smoothedpressure > 0
), rk as (
  select *, row_number() over (partition by recording_id, file_no, period_no, bin, kind order by ms) k,
    min(case when kind = 'peak' then ms end) over w first_p, min(case when kind = 'trough' then ms end) over w first_t,
    count(case when kind = 'peak' then 1 end) over w n_p, count(case when kind = 'trough' then 1 end) over w n_t
  from ex window w as (partition by recording_id, file_no, period_no, bin)
), zp as (
  select recording_id, file_no, period_no, bin, start_at, t.k, t.ms trough_t, p.ms peak_t, abs(p.smoothedpressure - t.smoothedpressure) swing
  from (select * from rk where kind = 'trough' and n_p >= 2 and n_t >= 2) t
  join (select *, case when first_t > first_p then k - 1 else k end kk from rk where kind = 'peak') p using (recording_id, file_no, period_no, bin, start_at) where t.k = p.kk
), cy as (
  select *, peak_t - trough_t t_in, lead(trough_t) over w - trough_t t_total, lead(peak_t) over w - peak_t p2p from zp window w as (partition by recording_id, file_no, period_no, bin order by k)
), bn as (
  select recording_id, file_no, period_no, bin, start_at, count(*) n, avg(t_in) t_in, stddev_pop(t_in) t_in_sd, avg(t_total) t_total, avg(swing) swing, avg(1000.0 / nullif(p2p, 0)) frequency from cy group by 1, 2, 3, 4, 5
), rd as (
  select recording_id, file_no, ms, arg_min(temp, line_no) filter (temp is not null and not isnan(temp)) as temp, arg_min(activity, line_no) filter (activity is not null and not isnan(activity)) activity
  from tl where ms is not null group by 1, 2, 3
), ts as (
  select recording_id, file_no, period_no, bin, avg(temp) temp_mean, stddev_samp(temp) / sqrt(count(temp)) temp_sem, avg(activity) activity_mean, stddev_samp(activity) / sqrt(count(activity)) activity_sem
  from bn join rd using (recording_id, file_no) where ms >= start_at + bin * 60000 and ms < start_at + (bin + 1) * 60000 group by 1, 2, 3, 4
)"""
)


@query(
    _PERIOD_BINS
    + """ select recording_id, file_no, period_no, bin, start_at + bin * 60000 bin_start, n, round(t_in, 7) t_in, round(t_in_sd, 4) t_in_sd, round(t_total, 7) t_total, round(swing, 8) swing, round(frequency, 6) frequency,
      round(temp_mean, 8) temp_mean, round(temp_sem, 5) temp_sem, round(activity_mean, 8) activity_mean, round(activity_sem, 5) activity_sem
    from bn left join ts using (recording_id, file_no, period_no, bin)"""
)
def period_bins(spark: SparkSession, d: str) -> DataFrame:
    e = _extremes(spark, d).where("kind = 'trough' or smoothedpressure > 0")
    periods = durable(breaths.valid_periods(e.where("kind = 'peak'"), FILE, "ms", min_peaks=10, interval_window=10, break_multiplier=3.0, block=HOUR))
    frame = align.first_valid(readings(spark, d), FILE, "ms", "line_no", ["temp", "activity"])
    b = breaths.period_bins(e, periods, frame, FILE, "ms", "smoothedpressure", 60_000, HOUR)
    digits = {"t_in": 7, "t_in_sd": 4, "t_total": 7, "swing": 8, "frequency": 6, "temp_mean": 8, "temp_sem": 5, "activity_mean": 8, "activity_sem": 5}
    return b.select(*FILE, "period_no", "bin", "bin_start", "n", *[F.round(c, n).alias(c) for c, n in digits.items()])


_TRACE = _PEAKS + """, tr as (select * from (select recording_id, file_no, ms, lead(ms) over (partition by recording_id, file_no order by ms) - ms as iv from peaks) where iv is not null)"""


@query(_TRACE + """ select recording_id, file_no, ms, iv as "interval" from tr""")
def ttot_trace(spark: SparkSession, d: str) -> DataFrame:
    return breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR)


@query(
    _TRACE
    + """ select recording_id, file_no, ms, iv as "interval" from (select *, row_number() over (partition by recording_id, file_no order by ms) k, count(*) over (partition by recording_id, file_no) n from tr)
    where n > 20 and k > 10 and k <= n - 10"""
)
def trim_ends(spark: SparkSession, d: str) -> DataFrame:
    return breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR, trim=10)


_SEGMENTS = (
    _TRACE
    + """, sp as (select recording_id, file_no, min(ms) lo, cast(floor((max(ms) - min(ms)) / 50000.0) as bigint) n from tr group by 1, 2),
spine as (select *, unnest(generate_series(0, n - 1)) segment from sp where n > 0),
st as (select recording_id, file_no, cast(floor((ms - lo) / 50000.0) as bigint) segment, count(*) c,
  case when var_pop(cast(iv as double)) = 0 then 0.0 else greatest(0.0, regr_r2(cast(iv as double), (ms - lo) / 1000.0)) end r2
  from tr join sp using (recording_id, file_no) group by 1, 2, 3)"""
)


@query(
    _SEGMENTS
    + """ select recording_id, file_no, segment, lo + segment * 50000 start_at, lo + (segment + 1) * 50000 end_at, coalesce(c, 0) n_breaths, round(r2, 5) drift_r2
    from spine left join st using (recording_id, file_no, segment)"""
)
def segments(spark: SparkSession, d: str) -> DataFrame:
    trace = breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR)
    return breaths.trace_segments(trace, FILE, "ms", 50_000).withColumn("drift_r2", F.round("drift_r2", 5))


@query(
    _SEGMENTS
    + """ select recording_id, file_no, count(*) n_segments, bool_or(coalesce(r2, 0) > 0.3) drift_dominated, round(max(r2), 5) worst_r2
    from spine left join st using (recording_id, file_no, segment) group by 1, 2"""
)
def drift_r2(spark: SparkSession, d: str) -> DataFrame:
    s = breaths.trace_segments(breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR), FILE, "ms", 50_000)
    return s.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_segments"), F.bool_or(F.coalesce("drift_r2", F.lit(0)) > 0.3).alias("drift_dominated"), F.round(F.max("drift_r2"), 5).alias("worst_r2")
    )


@query("select lower(telemetry_file) dest, count(*) n from batch_config where telemetry_file is not null group by 1 having count(*) > 1")
def dispatch_collisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "batch_config").where("telemetry_file is not null")
    return c.groupBy(F.lower("telemetry_file").alias("dest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select event_type, count(*) n, cast(sum(cast(round(value * 100) as bigint)) as bigint) cents, min(ts) first_ts, max(ts) last_ts from events group by 1")
def event_type_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("select recording_id, file_no, least(count(*), cast(floor(600 * ln(1 + count(*) * 5 / 1200.0)) as bigint)) n_bins from telemetry group by 1, 2")
def dynamic_bins(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "telemetry").groupBy(*FILE).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*FILE, F.least("n", F.floor(F.lit(600) * F.log(1 + F.col("n") * 5 / F.lit(1200.0)))).alias("n_bins"))


def _segments(spark: SparkSession, d: str, signal: str = "smoothedpressure") -> DataFrame:
    from ..operators.signals import segmented

    return segmented(durable(valid(spark, d, signal)), FILE, "ms", signal, 5000, HOUR)


@query()
def preprocessed_pressure(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import preprocess

    from ..operators.signals import segmented

    # readings that are missing inside a stretch are filled in first, so that the filters see even steps
    return preprocess(segmented(durable(_filled(spark, d)), FILE, "ms", "smoothedpressure", 5000, HOUR), FILE, "smoothedpressure")


@query(
    _COVER
    + """ select recording_id, file_no, ms,
      round(quantile_cont(smoothedpressure, 0.8) over (partition by recording_id, file_no, island order by ms rows between 7 preceding and 7 following), 6) upper,
      round(quantile_cont(smoothedpressure, 0.2) over (partition by recording_id, file_no, island order by ms rows between 7 preceding and 7 following), 6) lower
    from islands""".replace(") upper", ") as upper").replace(") lower", ") as lower")
)
def rolling_quantile(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import rolling_quantiles

    q = rolling_quantiles(_segments(spark, d), FILE, "smoothedpressure", 15)
    return q.select(*FILE, "ms", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"))


_TAPS = [3 * (3 * 17 * 17 + 3 * 17 - 1 - 5 * k * k) / ((2 * 17 - 1) * (2 * 17 + 1) * (2 * 17 + 3)) for k in range(-17, 18)]


@query(
    _COVER
    + ", s as (select recording_id, file_no, ms, "
    + " + ".join(f"({w!r}) * " + (f"lead(smoothedpressure, {k}) over w" if k > 0 else f"lag(smoothedpressure, {-k}) over w" if k < 0 else "smoothedpressure") for k, w in zip(range(-17, 18), _TAPS))
    + " y, row_number() over w r, count(*) over (partition by recording_id, file_no, island) n from islands window w as (partition by recording_id, file_no, island order by ms))"
    + " select recording_id, file_no, ms, round(y, 6) smoothed from s where r > 17 and r <= n - 17"
)
def savgol_smooth(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import smoothed

    s = smoothed(_segments(spark, d), FILE, "smoothedpressure", "smoothed")
    return s.select(*FILE, "ms", F.round("smoothed", 6).alias("smoothed"))


@query()
def detected_breaths(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import detect_breaths

    return detect_breaths(_segments(spark, d), FILE, "smoothedpressure")


@query()
def transient_peaks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import transient_peaks as run

    return run(_segments(spark, d, "temp"), FILE, "temp", prominence=0.05)


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import interval_spectra

    return interval_spectra(durable(breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR)), FILE)


@query()
def interval_spectra(spark: SparkSession, d: str) -> DataFrame:
    return _spectra(spark, d)


@query(
    _CLASS
    + """ select window_id, event, status, cast(s / 1000.0 as decimal(18, 3)) || '_' || cast(e / 1000.0 as decimal(18, 3)) window_key
    from classed where status = 'fully_covered'"""
)
def window_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.sinks import window_key

    w = _classified(spark, d).where("status = 'fully_covered'")
    return w.select("window_id", "event", "status", window_key("start_at", "end_at").alias("window_key"))


@query()
def segment_log(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import interval_spectra as run
    from ..operators.signals import segment_log as log

    trace = durable(breaths.interval_trace(_peaks(spark, d), FILE, "ms", HOUR))
    return log(breaths.trace_segments(trace, FILE, "ms", 50_000), run(trace, FILE), FILE)


@query()
def spectrum_metrics(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import spectrum_metrics as run

    return run(_spectra(spark, d), FILE, drift=drift_r2(spark, d))


def _analysis(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    from .pipelines import pressure_analysis

    r = readings(spark, d).select(*FILE, "ms", "line_no", "smoothedpressure", "temp", "activity", "atmpressure").where("ms is not null")
    return pressure_analysis(r, _windows(spark, d), min_peaks=5)


def _photometry(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The injection-aligned analysis; the smoothed pressure stands for the fluorescence, of which the tables have none."""
    from .pipelines import photometry_analysis

    r = durable(align.first_valid(readings(spark, d), FILE, "ms", "line_no", ["smoothedpressure", "temp", "activity"]))
    trace = r.where(align.present("smoothedpressure").isNotNull()).select(*FILE, "ms", F.col("smoothedpressure").alias("dFoF_465"))
    return photometry_analysis(trace, r.select(*FILE, "ms", "temp", "activity"), _anchors(spark, d), 600_000, 1_200_000, 60_000)


@query()
def photometry_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _photometry(spark, d)["peaks"]


@query()
def photometry_peak_bins(spark: SparkSession, d: str) -> DataFrame:
    return _photometry(spark, d)["peak_bins"]


_PHOTO = f"""with {TIMELINE}, {_ANCHOR}, fr as (
  select recording_id, file_no, ms, arg_min(smoothedpressure, line_no) filter (smoothedpressure is not null and not isnan(smoothedpressure)) p,
    arg_min(temp, line_no) filter (temp is not null and not isnan(temp)) as temp, arg_min(activity, line_no) filter (activity is not null and not isnan(activity)) activity
  from tl where ms is not null group by 1, 2, 3
), nr as (select fr.*, anchor from fr join anchor using (recording_id, file_no) where p is not null and ms between anchor - 600000 and anchor + 1200000),
st as (select recording_id, file_no, ms, temp from fr where temp is not null), sa as (select recording_id, file_no, ms, activity from fr where activity is not null),
raw as (
  select nr.recording_id, nr.file_no, nr.ms, nr.anchor, nr.p,
    case when tl_.ms is null or tr.ms is null then null when tl_.ms = tr.ms then tl_.temp else tl_.temp + (tr.temp - tl_.temp) * ((nr.ms - tl_.ms) / (tr.ms - tl_.ms)) end as temp,
    case when al.ms is null or ar.ms is null then null when al.ms = ar.ms then al.activity else al.activity + (ar.activity - al.activity) * ((nr.ms - al.ms) / (ar.ms - al.ms)) end activity
  from nr asof left join st tl_ on nr.recording_id = tl_.recording_id and nr.file_no = tl_.file_no and nr.ms >= tl_.ms
  asof left join st tr on nr.recording_id = tr.recording_id and nr.file_no = tr.file_no and nr.ms <= tr.ms
  asof left join sa al on nr.recording_id = al.recording_id and nr.file_no = al.file_no and nr.ms >= al.ms
  asof left join sa ar on nr.recording_id = ar.recording_id and nr.file_no = ar.file_no and nr.ms <= ar.ms
)"""


@query(_PHOTO + " select recording_id, file_no, ms, p, round(temp, 5) as temp, round(activity, 5) activity from raw")
def photometry_raw(spark: SparkSession, d: str) -> DataFrame:
    r = _photometry(spark, d)["raw"]
    return r.select(*FILE, "ms", F.col("dFoF_465").alias("p"), F.round("temp", 5).alias("temp"), F.round("activity", 5).alias("activity"))


@query(
    _PHOTO
    + """, spine as (select *, unnest(generate_series(0, 29)) b from anchor), s as (
      select recording_id, file_no, cast(floor((ms - anchor + 600000) / 60000.0) as bigint) b, avg(p) p, stddev_samp(p) / sqrt(count(p)) p_sem, avg(temp) as temp, avg(activity) activity from raw group by 1, 2, 3)
    select recording_id, file_no, b * 60000 - 600000 bin_start, round(p, 8) p, round(p_sem, 5) p_sem, round(temp, 8) as temp, round(activity, 8) activity from spine left join s using (recording_id, file_no, b)"""
)
def photometry_signal_bins(spark: SparkSession, d: str) -> DataFrame:
    b = _photometry(spark, d)["signal_bins"]
    digits = {"p": ("dFoF_465_mean", 8), "p_sem": ("dFoF_465_sem", 5), "temp": ("temp_mean", 8), "activity": ("activity_mean", 8)}
    return b.select(*FILE, F.col("bin_start").cast("bigint").alias("bin_start"), *[F.round(c, n).alias(k) for k, (c, n) in digits.items()])


@query()
def pressure_windows(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d)["windows"].select("window_id", "event", "status")


@query()
def pressure_per_bin(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d)["per_bin"]


@query()
def pressure_per_period(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d)["per_period"]


@query()
def pressure_overall(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d)["overall"]


@query()
def pressure_per_window(spark: SparkSession, d: str) -> DataFrame:
    return _analysis(spark, d)["per_window"]


@query(
    """select config_id, case when r.recording_id is null then 'no_recording' when length(trim(coalesce(video_time, ''))) = 0 then 'no_time'
      when bin_size is null or bin_size <= 0 then 'bad_bin' else 'ready' end status
    from batch_config c left join recording_files r using (recording_id, file_no)"""
)
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    from .pipelines import batch_status as run

    return run(table(spark, d, "batch_config"), table(spark, d, "recording_files")).select("config_id", "status")


@query()
def batch_run(spark: SparkSession, d: str) -> DataFrame:
    from .pipelines import batch_run as run

    r = readings(spark, d).select(*FILE, "ms", "line_no", "smoothedpressure", "temp", "activity", "atmpressure").where("ms is not null")
    events = _windows(spark, d).withColumnRenamed("window_id", "event_id")
    return run(table(spark, d, "batch_config"), table(spark, d, "recording_files"), r, events, min_peaks=5)["batch"]


@query(
    f"with {TIMELINE}, {_ANCHOR}"
    + """ select recording_id, file_no, anchor, greatest(lo, anchor - 600000) start_at, least(hi, anchor + 1200000) end_at
    from anchor join (select recording_id, file_no, min(ms) lo, max(ms) hi from tl group by 1, 2 having max(ms) is not null) using (recording_id, file_no)"""
)
def clipped_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import clip_window

    span = readings(spark, d).where("ms is not null").groupBy(*FILE).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    return clip_window(_anchors(spark, d).join(span, FILE), 600_000, 1_200_000).select(*FILE, "anchor", "start_at", "end_at")


@query(
    _EXTREMES
    + f""", {_valid_sql('activity', 'act')}, m as (select recording_id, file_no, ms, smoothedpressure from e where kind = 'peak')
    select recording_id, file_no, ms, m.smoothedpressure, act.activity from m join act using (recording_id, file_no, ms)"""
)
def marker_values(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import marker_values as run

    return run(_extremes(spark, d).where("kind = 'peak'").drop("kind"), valid(spark, d, "activity"), FILE, "ms")


@query(
    _EXTREMES
    + """, k as (select *, row_number() over (partition by recording_id, file_no, kind order by ms) k from e),
    cnt as (select recording_id, file_no, count(*) filter (kind = 'peak') np, count(*) filter (kind = 'trough') nt from e group by 1, 2)
    select recording_id, file_no, ms, smoothedpressure, kind from k join cnt using (recording_id, file_no)
    where k <= case when kind = 'peak' then case when nt > 0 then least(np, nt) else np end else case when np > 0 then least(np, nt) else nt end end"""
)
def equal_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import equal_counts as run

    e = _extremes(spark, d)
    a, b = run(e.where("kind = 'peak'"), e.where("kind = 'trough'"), FILE, "ms", HOUR)
    return a.unionByName(b)


@query(
    _PERIODS
    + _CLASS[_CLASS.index(", marked as ("):]
    + """, cw as (select window_id, recording_id, file_no, s, e from classed where status = 'fully_covered')
    select recording_id, file_no, window_id, 'Overall Time Window' what, null::bigint period_no, s start_at, e end_at, null::bigint n_peaks, null::double per_minute from cw
    union all select recording_id, file_no, window_id, 'Valid Period', period_no, start_at, end_at, n_inside, round(n_inside * 60000.0 / nullif(end_at - start_at, 0), 6)
    from cw join pp using (recording_id, file_no) where start_at >= s and end_at <= e"""
)
def window_peak_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import window_peak_counts as run

    w = _classified(spark, d).where("status = 'fully_covered'").select("window_id", *FILE, "start_at", "end_at")
    return run(w, peaks_per_period(spark, d).drop("per_minute"), FILE).withColumn("per_minute", F.round("per_minute", 6))


@query(
    _SEGMENTS
    + """ select count(*) filter (coalesce(c, 0) >= 4) n_accepted, count(*) filter (coalesce(c, 0) < 4) n_rejected, count(distinct recording_id) n_windows,
      count(distinct case when r2 > 0.3 then recording_id end) n_warned
    from spine left join st using (recording_id, file_no, segment)"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import run_summary as run

    return run(segments(spark, d), "recording_id", "n_breaths >= 4", "drift_r2 > 0.3")


@query()
def lowpass_sweep(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import lowpass_sweep as run

    return run(_segments(spark, d), FILE, "smoothedpressure")


_SLOPE = [k / 3570 for k in range(-17, 18)]


@query(
    _COVER
    + ", s as (select recording_id, file_no, ms, "
    + " + ".join(f"({w!r}) * " + (f"lead(smoothedpressure, {k}) over w" if k > 0 else f"lag(smoothedpressure, {-k}) over w" if k < 0 else "smoothedpressure") for k, w in zip(range(-17, 18), _SLOPE))
    + " y, row_number() over w r, count(*) over (partition by recording_id, file_no, island) n from islands window w as (partition by recording_id, file_no, island order by ms))"
    + " select recording_id, file_no, ms, round(y, 6) slope from s where r > 17 and r <= n - 17"
)
def savgol_slope(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import smoothed

    s = smoothed(_segments(spark, d), FILE, "smoothedpressure", "slope", derivative=True)
    return s.select(*FILE, "ms", F.round("slope", 6).alias("slope"))


def _telemetry_lines(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "raw_files").where("file_kind = 'telemetry'").select("file_id")
    lines = table(spark, d, "raw_lines").where("length(trim(line_text)) > 0").join(files, "file_id", "left_semi")
    return lines.select(F.col("file_id").alias("file_path"), "line_no", F.col("line_text").alias("line"))


_TELEMETRY_LINES = """with l as (
  select file_id, line_no, line_text from raw_lines
  where file_id in (select file_id from raw_files where file_kind = 'telemetry') and length(trim(line_text)) > 0
)"""


@query(_TELEMETRY_LINES + " select file_id, coalesce(min(case when lower(ltrim(line_text)) like 'time%' then line_no end), 0) head from l group by 1")
def header_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import header_lines

    return header_lines(_telemetry_lines(spark, d)).withColumnRenamed("file_path", "file_id")


@query(
    _TELEMETRY_LINES
    + r""", c as (
      select file_id, line_no, regexp_extract(line_text, '^\s*#\s*Col\s+(\d+):', 1) col, lower(trim(split_part(line_text, ',', 2))) name,
        trim(regexp_extract(split_part(line_text, ',', 5), ':\s*(.*)$', 1)) rate from l
    ), named as (
      select *, case when name in ('temp', 'temperature') then 'temp' when name = 'pressure' then 'pressure'
        when name in ('activity', 'act') then 'activity' when name = 'apr' then 'atm' end signal from c where col <> ''
    ), first as (
      select file_id, signal, arg_min(col, line_no) col, arg_min(rate, line_no) rate from named where signal is not null group by 1, 2
    ) select file_id, cast(col as int) "position", signal,
      case when regexp_full_match(rate, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast(rate as double) end rate_hz from first"""
)
def channel_map(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import channels

    return channels(_telemetry_lines(spark, d)).withColumnRenamed("file_path", "file_id")


def _near(spark: SparkSession, d: str) -> DataFrame:
    """The time each file is aligned to: when it was received."""
    return table(spark, d, "raw_files").where("file_kind = 'telemetry'").select(F.col("file_id").alias("file_path"), F.col("received_at").alias("near"))


_CHANNELS = r""", c as (
  select file_id, line_no, regexp_extract(line_text, '^\s*#\s*Col\s+(\d+):', 1) col, lower(trim(split_part(line_text, ',', 2))) as name,
    trim(regexp_extract(split_part(line_text, ',', 5), ':\s*(.*)$', 1)) rate from l
), ch as (
  select file_id, signal, cast(arg_min(col, line_no) as int) pos, arg_min(case when regexp_full_match(rate, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast(rate as double) end, line_no) rate_hz
  from (select *, case when name in ('temp', 'temperature') then 'temp' when name = 'pressure' then 'pressure' when name in ('activity', 'act') then 'activity' when name = 'apr' then 'atm' end signal from c where col <> '')
  where signal is not null group by 1, 2
), hd as (
  select file_id, coalesce(min(case when lower(ltrim(line_text)) like 'time%' then line_no end), 0) head from l group by 1
), val as (
  select l.file_id, line_no, signal, case when regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast(x as double) end v
  from (select l.file_id, l.line_no, signal, trim(split_part(line_text, ',', pos)) x from l join ch using (file_id)) l join hd using (file_id) where line_no > head
), body as (
  select file_id, line_no, trim(split_part(line_text, ',', 1)) date_text from l join hd using (file_id) where line_no > head
), fmt as (
  select file_id, first_text, case when regexp_matches(x, '\.\d{1,6}\s*(AM|PM)\b', 'i') then 'before' when regexp_matches(x, '(AM|PM)\.\d{1,6}\b', 'i') then 'after' else 'none' end form,
    case when a is null then false when a = month(received_at) and b = day(received_at) then false when b = month(received_at) and a = day(received_at) then true when a > 12 then true when b > 12 then false
      else abs(date_diff('day', cast(received_at as date), make_date(y, b, a))) < abs(date_diff('day', cast(received_at as date), make_date(y, a, b))) end is_day_first
  from (select *, try_cast(regexp_extract(x, '^(\d{1,2})/(\d{1,2})/(\d{4})', 1) as int) a, try_cast(regexp_extract(x, '^(\d{1,2})/(\d{1,2})/(\d{4})', 2) as int) b,
      try_cast(regexp_extract(x, '^(\d{1,2})/(\d{1,2})/(\d{4})', 3) as int) y
    from (select file_id, arg_min(date_text, line_no) first_text, replace(regexp_replace(regexp_replace(arg_min(date_text, line_no), 'a\.m\.', 'AM', 'gi'), 'p\.m\.', 'PM', 'gi'), '..', '.') x from body group by 1)
    join raw_files using (file_id))
)"""
_STAMPS = r""", parts as (
  select file_id, line_no, form, is_day_first, regexp_extract(x, '^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?\s*([AaPp][Mm])(?:\.(\d{1,6}))?\s*$', ['a', 'b', 'y', 'h', 'mi', 's', 'f', 'ap', 'g']) p
  from (select *, replace(regexp_replace(regexp_replace(date_text, 'a\.m\.', 'AM', 'gi'), 'p\.m\.', 'PM', 'gi'), '..', '.') x from body join fmt using (file_id))
), written as (
  select file_id, line_no, form, case when p.a <> '' and (p.f <> '') = (form = 'before') and (p.g <> '') = (form = 'after') and cast(p.h as int) between 1 and 12 and cast(p.mi as int) < 60 and cast(p.s as int) < 60 then
    epoch_us(try_cast(p.y || '-' || case when is_day_first then p.b || '-' || p.a else p.a || '-' || p.b end as date))
      + (((cast(p.h as int) % 12 + case when upper(p.ap) = 'PM' then 12 else 0 end) * 60 + cast(p.mi as int)) * 60 + cast(p.s as int)) * cast(1000000 as bigint) + cast(rpad(p.f || p.g, 6, '0') as bigint) end us
  from parts
), stamped as (
  select w.file_id, line_no, us + case when form = 'none' then cast((row_number() over (partition by w.file_id, us order by line_no) - 1) * round_even(1000000 / coalesce(rate_hz, 1.0), 0) as bigint) else 0 end us
  from written w left join (select file_id, arg_min(case when signal = 'atm' then 1.0 else rate_hz end, case signal when 'pressure' then 0 when 'temp' then 1 when 'activity' then 2 else 3 end) rate_hz from ch group by 1) m using (file_id)
)"""


@query(_TELEMETRY_LINES + _CHANNELS + " select file_id, first_text, is_day_first from fmt")
def dayfirst_decision(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import telemetry_rows
    from ..sources.frames import timestamp_formats as run

    return run(telemetry_rows(_telemetry_lines(spark, d)), _near(spark, d)).select(F.col("file_path").alias("file_id"), "first_text", "is_day_first")


@query(
    _TELEMETRY_LINES + _CHANNELS + _STAMPS
    + """ select file_id, any_value(form) form, count(*) n_lines, count(us) n_read, min(us) first_us, max(us) last_us
    from stamped join fmt using (file_id) group by 1"""
)
def timestamp_formats(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import frames
    from ..sources.files import telemetry_rows

    lines = _telemetry_lines(spark, d)
    rows = telemetry_rows(lines)
    formats = frames.timestamp_formats(rows, _near(spark, d))
    read = frames.timestamps(rows, formats, frames.master_rates(lines)).join(formats.select("file_path", "form"), "file_path")
    sums = read.groupBy("file_path").agg(F.any_value("form").alias("form"), F.count(F.lit(1)).alias("n_lines"), F.count("us").alias("n_read"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return sums.withColumnRenamed("file_path", "file_id")


@query(
    _TELEMETRY_LINES + _CHANNELS + _STAMPS
    + """, fr as (
      select file_id, us, arg_min(v, line_no) filter (signal = 'pressure' and v is not null) pressure, arg_min(v, line_no) filter (signal = 'temp' and v is not null) as temp,
        arg_min(v, line_no) filter (signal = 'activity' and v is not null) activity, arg_min(v, line_no) filter (signal = 'atm' and v is not null) atm
      from stamped left join val using (file_id, line_no) where us is not null group by 1, 2
    ), st as (select file_id, min(us) first_us from fr where coalesce(pressure, temp, activity) is not null group by 1)
    select file_id, us, round((us - epoch_us(received_at)) / 1e6, 6) t_s, pressure, temp, activity, atm from fr join st using (file_id) join raw_files using (file_id) where us >= first_us"""
)
def aligned_frame(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.frames import aligned_frame as run

    f = run(_telemetry_lines(spark, d), _near(spark, d), "alignment")
    return f.select(F.col("file_path").alias("file_id"), "us", F.round("t_s", 6).alias("t_s"), "pressure", "temp", "activity", "atm")


@query(
    _TELEMETRY_LINES + _CHANNELS
    + """, g as (select file_id, head = 0 no_head, n is null no_channel, coalesce(bad, false) bad, coalesce(pressure, false) pressure, coalesce(usable, false) usable from hd
      left join (select file_id, count(*) n, bool_or(coalesce(rate_hz <= 0, true)) bad, bool_or(signal = 'pressure') pressure from ch group by 1) using (file_id)
      left join (select file_id, bool_or(v is not null and signal <> 'atm') usable from val group by 1) using (file_id))
    select file_id, fault from (select file_id, unnest([case when no_head then 'no header' end, case when no_channel then 'no channel' end, case when bad then 'bad rate' end,
      case when not pressure then 'no pressure' end, case when not usable then 'no usable signal' end]) fault from g) where fault is not null"""
)
def telemetry_faults(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.frames import telemetry_faults as run

    return run(_telemetry_lines(spark, d)).withColumnRenamed("file_path", "file_id")


_FILLED = f"""with {TIMELINE}, fr as (
  select recording_id, file_no, ms, arg_min(smoothedpressure, line_no) filter (smoothedpressure is not null and not isnan(smoothedpressure)) p from tl where ms is not null group by 1, 2, 3
), pl as (select *, row_number() over (partition by recording_id, file_no order by ms) k from fr), nb as (
  select *, last(case when p is not null then {{'k': k, 'p': p, 'ms': ms}} end ignore nulls) over (partition by recording_id, file_no order by ms rows unbounded preceding) l,
    first(case when p is not null then {{'k': k, 'p': p, 'ms': ms}} end ignore nulls) over (partition by recording_id, file_no order by ms rows between current row and unbounded following) r
  from pl
)"""


@query(
    _FILLED
    + """ select recording_id, file_no, ms, round(case when p is null then l.p + (r.p - l.p) * (k - l.k) / (r.k - l.k) else p end, 6) smoothedpressure, p is null was_filled
    from nb where p is not null or (l is not null and r is not null and r.ms - l.ms <= 5000)"""
)
def filled_pressure(spark: SparkSession, d: str) -> DataFrame:
    f = _filled(spark, d)
    return f.withColumn("smoothedpressure", F.round("smoothedpressure", 6))


def _filled(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.frames import fill_inside

    frame = align.first_valid(readings(spark, d), FILE, "ms", "line_no", ["smoothedpressure"])
    return fill_inside(frame, FILE, "ms", "smoothedpressure", 5000, HOUR // 1000)


CONFIG_COLUMNS = ("telemetry_file", "event_file", "behaviour", "video_time", "bin_size", "probe_time")


@query(
    f"""select file_id, column_name from (
      select file_id, list_transform(string_split_regex(lower(coalesce(line_text, '')), '[,;\\t]'), lambda x: trim(x, ' "' || chr(65279) || chr(13))) names
      from raw_lines join raw_files using (file_id) where file_kind = 'config' and line_no = 1
    ), (select unnest({list(CONFIG_COLUMNS)}) column_name) where not list_contains(names, column_name)"""
)
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import missing_columns as run

    files = table(spark, d, "raw_files").where("file_kind = 'config'").select("file_id")
    heads = table(spark, d, "raw_lines").where("line_no = 1").select("file_id", "line_text").join(files, "file_id")
    return run(heads, ["file_id"], "line_text", CONFIG_COLUMNS)


@query("select recording_id, file_no, string_agg(event, '|' order by event) labels from (select distinct recording_id, file_no, event from event_file where event is not null) group by 1, 2")
def label_lists(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.summaries import label_lists as run

    return run(table(spark, d, "event_file"), FILE, "event").select(*FILE, F.array_join("labels", "|").alias("labels"))


@query(
    _PEAKS
    + """, i as (select *, lead(ms) over (partition by recording_id, file_no order by ms) - ms step from peaks),
    s as (select recording_id, file_no, count(*) n, avg(smoothedpressure) h, avg(step) i from i group by 1, 2),
    sp as (select recording_id, file_no, min(ms) lo, max(ms) hi from v group by 1, 2)
    select recording_id, file_no, coalesce(n, 0) n_peaks, round(h, 6) mean_height, round(i, 4) mean_interval,
      round(case when n > 0 and hi > lo then n * 60000.0 / (hi - lo) end, 6) per_minute from sp left join s using (recording_id, file_no)"""
)
def peak_summary(spark: SparkSession, d: str) -> DataFrame:
    peaks = breaths.peak_intervals(_peaks(spark, d), FILE, "ms", HOUR)
    spans = valid(spark, d, "smoothedpressure").groupBy(*FILE).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    s = breaths.peak_summary(peaks, spans, FILE, "smoothedpressure")
    return s.select(*FILE, "n_peaks", F.round("mean_height", 6).alias("mean_height"), F.round("mean_interval", 4).alias("mean_interval"), F.round("per_minute", 6).alias("per_minute"))


@query()
def pooled_spectrum(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.signals import pooled_spectrum as run

    return run(_spectra(spark, d), [])
