"""Raw readings on a common timeline: duplicates folded, ends trimmed, seconds since an origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .instants import day_number, micros
from .neighbours import with_neighbour, with_rank


def number(text: Column) -> Column:
    """Double of a plain number, null for anything else (never an error, no type suffixes)."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def present(name: str) -> Column:
    """A value with NaN as null."""
    return F.when(~F.isnan(F.col(name)), F.col(name))


def first_valid(readings: DataFrame, keys: list[str], time: str, line: str, signals: list[str]) -> DataFrame:
    """One row per time: of each signal the first value, in the order of lines, that is not null or NaN."""
    firsts = [F.min_by(F.col(s), F.when(present(s).isNotNull(), F.col(line))).alias(s) for s in signals]
    return readings.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(*firsts, F.count(F.lit(1)).alias("n_lines"))


def trim_to_valid(readings: DataFrame, keys: list[str], time: str, anchors: list[str], last: str) -> DataFrame:
    """Rows from the first with any of ``anchors`` to the last with ``last``; sources without both go."""
    some = F.coalesce(*[present(a) for a in anchors]).isNotNull()
    ends = readings.groupBy(*keys).agg(F.min(F.when(some, F.col(time))).alias("__a"), F.max(F.when(present(last).isNotNull(), F.col(time))).alias("__b"))
    return readings.join(ends, keys).where(F.col(time).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def backward_jumps(readings: DataFrame, keys: list[str], time: str, line: str) -> DataFrame:
    """Number of lines per source whose time is before that of the line before."""
    near = with_neighbour(readings.select(*keys, time, line), keys, line, [time])
    return near.groupBy(*keys).agg(F.count_if(F.col(time) < F.col(f"__near.{time}")).cast("bigint").alias("n_jumps"))


def spread_within_second(readings: DataFrame, keys: list[str], second: str, line: str, rate: Column) -> DataFrame:
    """Adds ``t_s``: lines of one written second are set apart by the sampling step, in line order."""
    ranked = with_rank(readings, [*keys, second], line, [], out="__k")
    step = F.round(F.lit(1_000_000) / rate)
    return ranked.withColumn("t_s", F.col(second) + (F.col("__k") - 1) * step / 1_000_000).drop("__k")


def seconds_since(ts: str, origin: str) -> Column:
    """Seconds from one zoneless timestamp to another, exact to the microsecond."""
    return (micros(ts) - micros(origin)) / F.lit(1_000_000.0)


def shift_windows(windows: DataFrame, offset: Column) -> DataFrame:
    """Starts and ends moved; durations and negative times stay."""
    return windows.withColumns({"start_at": F.col("start_at") + offset, "end_at": F.col("end_at") + offset})


def slash_date(text: Column) -> list[Column]:
    """The two leading numbers and the year of ``a/b/yyyy`` at the start of a text, null where it has no such form."""
    form = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})"
    return [F.nullif(F.regexp_extract(text, form, i), F.lit("")).cast("int") for i in (1, 2, 3)]


def day_first(text: Column, near: Column) -> Column:
    """Whether ``a/b/yyyy`` at the start of a text is day first, judged by a date that it should lie near.

    Both readings that exist in the calendar are weighed: one of the same day and month as ``near`` (in any
    year) comes first, then the one with fewer days between, then month first.  Text without such a date,
    or no ``near``, is month first; an impossible date is day first if its first number can be no month.
    """
    a, b, year = slash_date(text)

    def reading(day: Column, month: Column, first: bool) -> Column:
        elsewhere = (day != F.dayofmonth(near)) | (month != F.month(near))
        days = F.abs(day_number(year, month, day) - F.unix_date(near.cast("date")))
        return F.when(days.isNotNull(), F.struct(elsewhere.alias("elsewhere"), days.alias("days"), F.lit(first).alias("first")))

    likeliest = F.array_min(F.array_compact(F.array(reading(b, a, False), reading(a, b, True))))
    return F.coalesce(likeliest["first"], a > 12, F.lit(False))
