"""From the text of telemetry files to frames on one timeline, many files in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import day_first, first_valid, present
from ..operators.instants import DAY, day_number, micros
from ..operators.neighbours import with_rank
from ..session import durable
from .files import SIGNALS, channels, header_lines, telemetry_rows

_STAMP = r"(?i)^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?\s*([AP]M)(?:\.(\d{1,6}))?\s*$"


def _plain(text: Column) -> Column:
    """AM and PM in one spelling, doubled points as one."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)a\.m\.", "AM"), r"(?i)p\.m\.", "PM"), F.lit(".."), F.lit("."))


def timestamp_formats(rows: DataFrame, near: DataFrame) -> DataFrame:
    """How each file writes its times, judged by its first line: ``file_path, first_text, form, is_day_first``.

    ``rows``: ``file_path, line_no, date_text``; ``near``: ``file_path, near``, the time the file is aligned to.
    ``form`` is ``before`` or ``after`` (fractions of the second before or after AM/PM) or ``none``.  A file
    without ``near`` is month first; files without lines have no row.
    """
    first = rows.where("date_text is not null").groupBy("file_path").agg(F.min_by("date_text", "line_no").alias("first_text"))
    text = _plain(F.col("first_text"))
    form = F.when(text.rlike(r"(?i)\.\d{1,6}\s*(AM|PM)\b"), "before").when(text.rlike(r"(?i)(AM|PM)\.\d{1,6}\b"), "after").otherwise("none")
    return first.join(near.select("file_path", "near"), "file_path", "left").select("file_path", "first_text", form.alias("form"), day_first(text, F.col("near")).alias("is_day_first"))


def timestamps(rows: DataFrame, formats: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``us``, the microseconds since 1970 of each line's written time, without zone.

    A line that is not written in its file's form, or is no possible time, has a null.  Where the form has no
    fractions, the lines of one written second are set apart by the sampling step of ``rates`` (``file_path,
    rate_hz``), in the order of lines.
    """
    part = lambda i: F.nullif(F.regexp_extract(_plain(F.col("date_text")), _STAMP, i), F.lit(""))
    read = rows.join(formats.select("file_path", "form", "is_day_first"), "file_path").join(rates.select("file_path", "rate_hz"), "file_path", "left")
    read = read.withColumn("__p", F.array(*[part(i) for i in range(1, 10)]))
    p = lambda i: F.col("__p")[i - 1]
    whole = lambda i: p(i).try_cast("int")
    a, b = whole(1), whole(2)
    days = day_number(whole(3), F.when(F.col("is_day_first"), b).otherwise(a), F.when(F.col("is_day_first"), a).otherwise(b))
    hour = F.when(whole(4).between(1, 12), whole(4) % 12 + F.when(F.upper(p(8)) == "PM", 12).otherwise(0))
    clock = F.when((whole(5) < 60) & (whole(6) < 60), (hour * 60 + whole(5)) * 60 + whole(6))
    fits = F.when(F.col("form") == "before", p(7).isNotNull() & p(9).isNull()).when(F.col("form") == "after", p(9).isNotNull() & p(7).isNull()).otherwise(p(7).isNull() & p(9).isNull())
    fraction = F.rpad(F.coalesce(p(7), p(9), F.lit("0")), 6, "0").try_cast("bigint")
    # exploded, so that a later filter on it is not pushed below, where each text would be matched many times
    read = read.select("*", F.explode(F.array(F.when(fits, (days * DAY + clock) * 1_000_000 + fraction))).alias("us")).drop("__p")
    ranked = with_rank(read, ["file_path", "us"], "line_no", [], out="__k")
    step = F.rint(1_000_000 / F.coalesce("rate_hz", F.lit(1.0)))
    apart = F.when(F.col("form") == "none", (F.col("__k") - 1) * step).otherwise(0).cast("bigint")
    return ranked.withColumn("us", F.col("us") + apart).select(*rows.columns, "us")


def master_rates(lines: DataFrame) -> DataFrame:
    """``file_path, rate_hz``: the rate of the pressure, else the temperature, else the activity, else 1."""
    order = F.when(F.col("signal") == "pressure", 0).when(F.col("signal") == "temp", 1).when(F.col("signal") == "activity", 2).otherwise(3)
    rate = F.when(order < 3, F.col("rate_hz")).otherwise(1.0)
    return channels(lines).groupBy("file_path").agg(F.min_by(rate, order).alias("rate_hz"))


def aligned_frame(lines: DataFrame, near: DataFrame, origin: str = "first_valid") -> DataFrame:
    """Telemetry files as one table on their timelines: ``file_path, us, t_s, pressure, temp, activity, atm, n_lines``.

    ``lines``: ``file_path, line_no, line``; ``near``: ``file_path, near``, the time each file is aligned to.  Times
    are read in the file's own form and order of day and month; lines of one time are one row with the first
    value of each signal; rows before the first value of pressure, temperature or activity are left out.
    ``t_s`` counts from there (``first_valid``) or from ``near`` (``alignment``; null without it) and may be negative.

    A file without a value of those three signals has no row (``telemetry_faults`` tells); lines without
    a readable time are left out; signals a file lacks are null; repeated lines fold; empty tables give no rows.
    """
    if origin not in ("first_valid", "alignment"):
        raise ValueError("origin must be 'first_valid' or 'alignment'")
    rows = telemetry_rows(lines)
    stamped = timestamps(rows, timestamp_formats(rows, near), master_rates(lines))
    frame = durable(first_valid(stamped, ["file_path"], "us", "line_no", list(SIGNALS)))
    some = F.coalesce("pressure", "temp", "activity").isNotNull()
    start = frame.where(some).groupBy("file_path").agg(F.min("us").alias("__first")).join(near.select("file_path", micros("near").alias("__near")), "file_path", "left")
    zero = F.col("__first") if origin == "first_valid" else F.col("__near")
    kept = frame.join(start, "file_path").where(F.col("us") >= F.col("__first"))
    return kept.select("file_path", "us", ((F.col("us") - zero) / 1_000_000).alias("t_s"), *SIGNALS, "n_lines")


def telemetry_faults(lines: DataFrame) -> DataFrame:
    """What keeps a telemetry file from being aligned: ``file_path, fault``, a row for each.

    ``no header`` (no line that starts with time), ``no channel`` (no known ``# Col`` line), ``bad rate`` (a channel's
    rate is missing, unreadable or not above zero), ``no pressure`` (no channel of it) and ``no usable signal``
    (no value of pressure, temperature or activity).  Blank files have no lines and no row.
    """
    files = lines.select("file_path").distinct()
    heads = header_lines(lines)
    of = channels(lines).groupBy("file_path").agg(F.bool_or(F.coalesce(F.col("rate_hz") <= 0, F.lit(True))).alias("bad"), F.bool_or(F.col("signal") == "pressure").alias("pressure"))
    some = telemetry_rows(lines).groupBy("file_path").agg(F.bool_or(F.coalesce("pressure", "temp", "activity").isNotNull()).alias("usable"))
    seen = files.join(heads, "file_path", "left").join(of, "file_path", "left").join(some, "file_path", "left")
    faults = F.array(
        F.when(F.coalesce("head", F.lit(0)) == 0, "no header"), F.when(F.col("bad").isNull(), "no channel"), F.when(F.col("bad"), "bad rate"),
        F.when(~F.coalesce("pressure", F.lit(False)), "no pressure"), F.when(~F.coalesce("usable", F.lit(False)), "no usable signal"),
    )
    return seen.select("file_path", F.explode(F.array_compact(faults)).alias("fault"))


def fill_inside(frame: DataFrame, keys: list[str], time: str, value: str, max_gap: int, block: int = 4096) -> DataFrame:
    """``keys, time, value, was_filled``: rows without a value inside a stretch get one on the line between the
    values beside them, by their place among the rows and not by time.

    A stretch ends where more than ``max_gap`` lies between two values.  Rows between two stretches, before
    the first value or after the last are left out, as are those with a null time; NaN is no value; several
    rows at one time are told apart by nothing but must not occur (see ``first_valid``).
    """
    from ..operators.asof import neighbours

    rows = frame.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("bigint").alias(time), present(value).alias(value))
    placed = durable(with_rank(rows, keys, time, [], block * 1000, "__place"))
    known = placed.where(F.col(value).isNotNull())
    near = neighbours(placed.where(F.col(value).isNull()), known, keys, "__place", value, block)
    near = near.withColumnsRenamed({"left": "__l", "right": "__r"})
    near = neighbours(near, known.withColumn("__at", F.col(time).cast("double")), keys, "__place", "__at", block)
    share = (F.col("__place") - F.col("__l.t")) / (F.col("__r.t") - F.col("__l.t"))
    line = F.col("__l.v") + (F.col("__r.v") - F.col("__l.v")) * share
    filled = near.where(F.col("right.v") - F.col("left.v") <= max_gap)
    return known.select(*keys, time, value, F.lit(False).alias("was_filled")).unionByName(filled.select(*keys, time, line.alias(value), F.lit(True).alias("was_filled")))
