"""The registered queries of the core: problems 1, 2, 4, 5, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.drift import schema_changes, unified_rows
from .operators.grid import regular_grid
from .operators.instants import text_instants, wall_clock_instants
from .operators.intervals import merge_intervals
from .operators.rejects import parse_lines
from .operators.spikes import flag_spikes
from .plans.timeline import TIMELINE, with_counted_seconds
from .session import table

FILE = ["recording_id", "file_no"]


def p1_schema_changes(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_schema_changes(spark, d).where(F.col("field_name").isin("AtmPressure", "behavior")).select("file_id", "field_name", "change_kind")


def p1_unified_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return unified_rows(table(spark, d, "raw_lines"), table(spark, d, "raw_files"), "telemetry")


def p1_unified_events(spark: SparkSession, d: str) -> DataFrame:
    return unified_rows(table(spark, d, "raw_lines"), table(spark, d, "raw_files"), "event")


def _seconds(micros: str) -> F.Column:
    return F.floor((F.col(micros) + 500_000) / 1_000_000).cast("bigint")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "recording_files")
    config = table(spark, d, "batch_config").select("config_id", *FILE, "video_time")
    config = config.join(files.select(*FILE, "tz", "device_start_utc"), FILE, "left")
    videos = text_instants(config, "config_id", "video_time", "tz", "device_start_utc")
    lines = wall_clock_instants(table(spark, d, "telemetry"), files, last_only=True)
    return videos.select(F.lit("batch_config").alias("src"), F.col("config_id").cast("bigint").alias("row_key"), _seconds("utc_us").alias("utc_s")).unionByName(
        lines.select(F.lit("telemetry").alias("src"), F.col("row_id").cast("bigint").alias("row_key"), _seconds("utc_us").alias("utc_s"))
    )


def p2_wall_lines(spark: SparkSession, d: str) -> DataFrame:
    return wall_clock_instants(table(spark, d, "telemetry"), table(spark, d, "recording_files"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files")).where("reason is null").drop("reason")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))
    return rows.where("reason is not null").select("file_id", "line_no", "reason")


def p5_series(spark: SparkSession, d: str) -> DataFrame:
    elapsed = table(spark, d, "recording_files").where("clock_kind = 'elapsed'")
    return regular_grid(table(spark, d, "telemetry"), FILE, "timesincereference", ["temp", "atmpressure"], 10.0, sources=elapsed).withColumn("value", F.round("value", 6))


def p5_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The series of whole files: extended to the cells of the file's first and last line, whatever that line reads."""
    files = table(spark, d, "recording_files").where("clock_kind = 'elapsed'")
    lines = table(spark, d, "telemetry").where("not isnan(timesincereference)").join(files.select(*FILE), FILE, "left_semi")
    cell = lambda f: F.floor(f("timesincereference") / 10.0)
    bounds = lines.groupBy(*FILE).agg(cell(F.min).alias("first_cell"), cell(F.max).alias("last_cell"))
    grid = regular_grid(table(spark, d, "telemetry"), FILE, "timesincereference", ["temp", "atmpressure"], 10.0, bounds=bounds, sources=files)
    return grid.withColumn("value", F.round("value", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_series(spark, d).where("status <> 'observed'").select(*FILE, "signal_name", "cell_no")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    telemetry = table(spark, d, "telemetry")
    rows = with_counted_seconds(telemetry, table(spark, d, "recording_files"))  # the season follows the hour of the day
    return flag_spikes(rows, FILE, "row_id", "timesincereference", "line_no", season="counted_s", n_rows=telemetry.count())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flags(spark, d).select("row_id", "signal_name")


def p7_periods(spark: SparkSession, d: str) -> DataFrame:
    """All periods and gaps of scored bouts, with the number of rows in each."""
    ms = lambda c: F.when(~F.isnan(c), F.round(F.col(c) * 1000)).cast("bigint")
    events = table(spark, d, "event_file").select(*FILE, "event", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"))
    labels = table(spark, d, "behaviour_list").select(F.col("label").alias("event"))
    return merge_intervals(events.join(labels, "event", "left_semi"), [*FILE, "event"], "start_ms", "end_ms")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = p7_periods(spark, d).where("row_kind = 'gap' or n_rows > 1")
    return rows.select("row_kind", *FILE, "event", F.col("from_at").alias("from_ms"), F.col("to_at").alias("to_ms"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_schema_changes, p1_unified_telemetry, p1_unified_events, p2_found, p2_wall_lines, p4_found, p4_loaded,
        p5_found, p5_series, p5_bounded, p6_found, p6_flags, p7_found, p7_periods,
    )
}

_BOUTS = """
with bouts as (
  select recording_id, file_no, event, cast(round(start_s * 1000) as bigint) s, cast(round(end_s * 1000) as bigint) e, count(*) n
  from event_file
  where event in (select label from behaviour_list) and not isnan(start_s) and not isnan(end_s)
    and start_s is not null and end_s is not null and end_s >= start_s
  group by all
), seen as (
  select *, max(e) over (partition by recording_id, file_no, event order by s, e rows between unbounded preceding and 1 preceding) before
  from bouts
), marked as (
  select *, sum(case when before is null or s > before then 1 else 0 end)
    over (partition by recording_id, file_no, event order by s, e rows unbounded preceding) island
  from seen
), periods as (
  select recording_id, file_no, event, island, min(s) from_at, max(e) to_at, sum(n) n_rows
  from marked group by all
), gaps as (
  select recording_id, file_no, event, to_at from_at,
    lead(from_at) over (partition by recording_id, file_no, event order by island) to_at
  from periods
)"""

_GRID = """
with cells as (
  select recording_id, file_no, signal_name, cast(floor(t / 10.0) as bigint) cell_no, avg(v) v
  from (
    select recording_id, file_no, timesincereference t, 'temp' signal_name, temp v from telemetry
    union all
    select recording_id, file_no, timesincereference, 'atmpressure', atmpressure from telemetry
  ) join recording_files using (recording_id, file_no)
  where clock_kind = 'elapsed' and v is not null and not isnan(v) and t is not null and not isnan(t)
  group by all
), pairs as (
  select *, lead(cell_no) over w next_no, lead(v) over w next_v
  from cells window w as (partition by recording_id, file_no, signal_name order by cell_no)
), missing as (
  select *, unnest(generate_series(cell_no + 1, next_no - 1)) n from pairs where next_no > cell_no + 1
)"""

_REJECTS = r"""
with t as (
  select file_id, file_kind, line_no, rtrim(line_text, chr(13) || chr(10)) x from raw_lines join raw_files using (file_id) where file_kind in ('event', 'config')
), b as (
  select file_id, file_kind, ltrim(x, chr(65279)) header, regexp_replace(ltrim(x, chr(65279)), '"[^"]*"', '', 'g') bare from t where line_no = 1
), h as (
  select file_id, file_kind, header, case when c >= s and c >= t then ',' when s >= t then ';' else chr(9) end d
  from (select *, length(bare) - length(replace(bare, ',', '')) c, length(bare) - length(replace(bare, ';', '')) s, length(bare) - length(replace(bare, chr(9), '')) t from b)
), n as (
  select *, list_transform(regexp_extract_all(header || d, '([ ]*"(?:[^"]|"")*"[ ]*|[^"' || d || ']*)' || d, 1), lambda v: lower(trim(trim(v), '"'))) names from h
), k as (
  select *, list_position(list_transform(names, lambda v: contains(v, 'start')), true) a, list_position(list_transform(names, lambda v: contains(v, 'duration')), true) z, list_position(list_transform(names, lambda v: contains(v, 'bin_size')), true) q from n
), f as (
  select t.file_id, t.file_kind, line_no, a, z, q, len(names) width, regexp_full_match(x, '(?:\s*"(?:[^"]|"")*"\s*|[^"' || d || ']*)(?:' || d || '(?:\s*"(?:[^"]|"")*"\s*|[^"' || d || ']*))*') whole,
    list_transform(regexp_extract_all(x || d, '([ ]*"(?:[^"]|"")*"[ ]*|[^"' || d || ']*)' || d, 1), lambda v: trim(replace(regexp_replace(trim(v), '^"(.*)"$', '\1'), '""', '"'))) p
  from t join k using (file_id) where line_no > 1 and trim(x, ' ' || chr(9) || chr(13) || chr(10)) <> ''
), v as (
  select *, case when file_kind = 'event' then coalesce(p[a], '') end start, case when file_kind = 'event' then coalesce(p[z], '') end duration, case when q is not null then p[q] end bin from f
), r as (
  select file_id, line_no, case when not whole then 'quoting' when len(p) <> width then 'columns'
    when file_kind = 'config' then case when q is not null and not (regexp_full_match(bin, '[0-9]+') and try_cast(bin as hugeint) between 1 and 2147483647) then 'value' end
    when not (start in ('', 'NA', 'n/a') or regexp_full_match(start, '[+-]?(\d+([.,]\d*)?|[.,]\d+)(\s+s)?') or regexp_full_match(start, '-?(\d{1,2}:[0-5]\d|[0-5]?\d):[0-5]\d([.,]\d+)?')) then 'value'
    when not (duration in ('', 'NA', 'n/a') or regexp_full_match(duration, '[+-]?(\d+([.,]\d*)?|[.,]\d+)(\s+s)?') or regexp_full_match(duration, '-?(\d{1,2}:[0-5]\d|[0-5]?\d):[0-5]\d([.,]\d+)?')) then 'value'
    when duration like '-%' and regexp_matches(duration, '[1-9]') then 'value' end reason
  from v
) select file_id, line_no, reason from r where reason is not null"""

_SERIES = """, series as (
  select recording_id, file_no, signal_name, cell_no, v as "value", 'observed' status from cells
  union all
  select recording_id, file_no, signal_name, n, case when next_no - cell_no - 1 <= 6 then v + (next_v - v) * (n - cell_no) / (next_no - cell_no) end, case when next_no - cell_no - 1 <= 6 then 'filled' else 'gap' end from missing
)"""

ORACLE = {
    "p2_wall_lines": f"with {TIMELINE} select recording_id, file_no, cast(line_no as bigint) line_no, row_id, cast(tl_wi.since + tl_wf.start as bigint) utc_us from tl_wi join telemetry using (row_id)"
    " join (select recording_id, file_no, epoch_us(device_start_utc) as start from recording_files) tl_wf using (recording_id, file_no)",
    "p5_series": _GRID + _SERIES + ' select recording_id, file_no, signal_name, cell_no, round("value", 6) as "value", status from series',
    "p5_bounded": _GRID
    + _SERIES
    + """, b as (
  select recording_id, file_no, signal_name, cast(floor(min(timesincereference) / 10.0) as bigint) f, cast(floor(max(timesincereference) / 10.0) as bigint) l
  from telemetry join recording_files using (recording_id, file_no), (select unnest(['temp', 'atmpressure']) signal_name)
  where clock_kind = 'elapsed' and not isnan(timesincereference) group by 1, 2, 3
), e as (select b.*, lo, hi from b left join (select recording_id, file_no, signal_name, min(cell_no) lo, max(cell_no) hi from cells group by 1, 2, 3) using (recording_id, file_no, signal_name))
select recording_id, file_no, signal_name, cell_no, round("value", 6) as "value", status from series
union all select recording_id, file_no, signal_name, unnest(generate_series(f, coalesce(lo - 1, l))), null, 'edge' from e
union all select recording_id, file_no, signal_name, unnest(generate_series(hi + 1, l)), null, 'edge' from e""",
    "p4_found": _REJECTS,
    "p5_found": _GRID + " select recording_id, file_no, signal_name, n as cell_no from missing",
    "p7_found": _BOUTS
    + """
select 'period' row_kind, recording_id, file_no, event, from_at from_ms, to_at to_ms from periods where n_rows > 1
union all select 'gap', recording_id, file_no, event, from_at, to_at from gaps where to_at is not null""",
    "p7_periods": _BOUTS
    + """
select recording_id, file_no, event, 'period' row_kind, from_at, to_at, cast(n_rows as bigint) n_rows from periods
union all select recording_id, file_no, event, 'gap', from_at, to_at, 0 from gaps where to_at is not null""",
}
