"""One timeline for all recordings: milliseconds since the start of the device, whatever clock a file counts by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align
from ..operators.instants import micros, wall_clock_files, wall_clock_units, wall_clock_us
from ..session import table, written

FILE = ["recording_id", "file_no"]
HOUR = 3_600_000  # milliseconds; the width of the pieces of a source's time axis


def on_timeline(telemetry: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``ms``.  Counters of seconds are scaled; wall-clock counters, which follow local time in s, ms or min,
    are brought to instants with the one row per file that tells their unit and clock changes.

    A null or NaN time has a null ``ms``, as has every line of a wall-clock file without start or zone.
    """
    clocks = wall_clock_files(telemetry, files).drop("last", "last_line")
    kinds = files.where("clock_kind = 'wall'").select(*FILE, F.lit(True).alias("is_wall")).dropDuplicates(FILE)
    clocks = written(kinds.join(clocks, FILE, "left"))  # as a table its size is known: sent to the readings while small
    t = F.when(~F.isnan("timesincereference"), F.col("timesincereference"))
    since = F.round((wall_clock_us(t, F.col("line_no")) - F.col("start_us")) / 1000)
    ms = F.when(F.col("is_wall"), since).otherwise(F.round(t * 1000)).cast("bigint")
    return telemetry.join(clocks, FILE, "left").select(*telemetry.columns, ms.alias("ms"))


def with_counted_seconds(telemetry: DataFrame, files: DataFrame, name: str = "counted_s") -> DataFrame:
    """Adds the file's own counter in seconds: local time for wall-clock files, whatever unit they count in."""
    units = written(wall_clock_units(telemetry, files).select(*FILE, "unit_us"))
    seconds = F.col("timesincereference") * F.coalesce(F.col("unit_us") / 1_000_000, F.lit(1.0))
    return telemetry.join(units, FILE, "left").select(*telemetry.columns, seconds.alias(name))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry of all files with ``ms`` since the start of the device."""
    return on_timeline(table(spark, d, "telemetry"), table(spark, d, "recording_files"))


def valid(spark: SparkSession, d: str, signal: str) -> DataFrame:
    """Readings of a signal, one per time: the first valid one in the order of lines."""
    r = readings(spark, d).where(align.present(signal).isNotNull())
    return align.first_valid(r, FILE, "ms", "line_no", [signal]).drop("n_lines")


def _off(us: str) -> str:
    return f"(epoch_us(timezone(tz, make_timestamptz(cast({us} as bigint)))) - cast({us} as bigint))"


#: The timeline in SQL: ``tl`` is ``telemetry`` with ``ms``.
TIMELINE = f"""tl_wf as (
  select recording_id, file_no, tz, lower(trim(time_unit)) unit, interval_s, epoch_us(device_start_utc) start_us from recording_files where clock_kind = 'wall'
), tl_sp as (
  select recording_id, file_no, max(timesincereference) hi, min(timesincereference) lo, count(*) n, arg_min(timesincereference, {{'l': line_no, 'r': row_id}}) first_t
  from telemetry where timesincereference is not null and not isnan(timesincereference) group by 1, 2
), tl_wu as (
  select *, start_us + {_off('start_us')} local_us, case when unit in ('s', 'sec', 'seconds') then 1e6 when unit = 'ms' then 1e3 when unit in ('min', 'minutes') then 6e7
    when (hi - lo) / (n * interval_s) > 31.6 then 1e3 when (hi - lo) / (n * interval_s) < 0.129 then 6e7 else 1e6 end unit_us
  from tl_wf join tl_sp using (recording_id, file_no) where start_us is not null and tz is not null
), tl_wb as (
  select *, {_off('(local_us + round(lo * unit_us) - 86400000000)')} > {_off('(local_us + round(hi * unit_us) + 86400000000)')} set_back from tl_wu
), tl_fl as (
  select recording_id, file_no, min(line_no) fold from (
    select *, lag(t) over (partition by recording_id, file_no order by line_no) before from (
      select recording_id, file_no, line_no, max(timesincereference) t, any_value(unit_us) unit_us from telemetry join tl_wb using (recording_id, file_no)
      where set_back and timesincereference is not null and not isnan(timesincereference) group by 1, 2, 3)
  ) where (before - t) * unit_us > 1800000000 group by 1, 2
), tl_wl as (
  select row_id, start_us, tz, coalesce(line_no >= fold, null) late, start_us + round(first_t * unit_us) - 60000000 first_us, cast(local_us + round(timesincereference * unit_us) as bigint) l
  from telemetry join tl_wb using (recording_id, file_no) left join tl_fl using (recording_id, file_no) where timesincereference is not null and not isnan(timesincereference)
), tl_wc as (
  select *, l - {_off('(l - 86400000000)')} u1, l - {_off('(l + 86400000000)')} u2 from tl_wl
), tl_wi as (
  select row_id, case when u1 = u2 then u1 when u1 + {_off('u1')} = l and u2 + {_off('u2')} = l then case when coalesce(late, u1 < first_us) then u2 else u1 end
    when u2 + {_off('u2')} = l then u2 else u1 end - start_us since from tl_wc
), tl as (
  select telemetry.*, case when tl_wf.recording_id is not null then cast(round(since / 1000.0) as bigint)
    when not isnan(timesincereference) then cast(round(timesincereference * 1000) as bigint) end ms
  from telemetry left join tl_wf on telemetry.recording_id = tl_wf.recording_id and telemetry.file_no = tl_wf.file_no left join tl_wi using (row_id)
)"""


def valid_sql(signal: str, name: str = "v") -> str:
    """``valid`` in SQL, as the further table ``name`` after ``TIMELINE``."""
    return f"""{name} as (
  select recording_id, file_no, ms, arg_min({signal}, line_no) {signal} from tl where {signal} is not null and not isnan({signal}) and ms is not null group by 1, 2, 3)"""
