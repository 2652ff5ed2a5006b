"""Mixed timestamp formats and time zones to one instant in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import with_neighbour

DAY = 86_400

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _forms() -> list[str]:
    """Every format; a named group ends in the number of its format, since a name can stand only once."""
    out = []

    def time(k: int) -> str:
        return (
            rf"(?<hh{k}>\d{{1,2}}):(?<mi{k}>\d{{2}}):(?<ss{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,9}}))?"
            rf"(?:\s?(?<ap{k}>[ap])\.?m\.?(?:\.(?<g{k}>\d{{1,9}}))?)?(?:\s?(?<z{k}>Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}}))?"
        )

    month = lambda k: rf"(?<mon{k}>{'|'.join(_MONTHS)})[a-z]*\.?"
    out.append(rf"(?<y0>\d{{4}})[-/.](?<m0>\d{{1,2}})[-/.](?<d0>\d{{1,2}})[T\s]\s*{time(0)}")
    out.append(rf"(?<a1>\d{{1,2}})[-/.](?<b1>\d{{1,2}})[-/.](?<c1>\d{{4}}|\d{{2}})[T\s]\s*{time(1)}")
    out.append(rf"(?<d2>\d{{1,2}})\s{month(2)}\s(?<y2>\d{{4}}),?\s{time(2)}")
    out.append(rf"{month(3)}\s(?<d3>\d{{1,2}}),?\s(?<y3>\d{{4}}),?\s{time(3)}")
    out.append(r"(?<y4>\d{4})(?<m4>\d{2})(?<d4>\d{2})T?(?<hh4>\d{2})(?<mi4>\d{2})(?<ss4>\d{2})(?<z4>Z|[+-]\d{2}:?\d{2})?")
    out.append(r"(?<ms5>\d{13})|(?<s5>\d{9,10})")
    out.append(r"(?<serial6>\d{5}\.\d{3,})")
    return out


#: Every format, as one alternation of named groups around which only blanks may stand.
FORMATS = rf"(?iU)\A\s*+(?:{'|'.join(_forms())})\s*+\z"
#: Minutes east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_PARTS = ("y", "m", "d", "a", "b", "c", "hh", "mi", "ss", "f", "g", "ap", "z", "mon", "ms", "s", "serial")


def split_times(text: Column) -> Column:
    """Components of a text as an array of strings in the order of ``_PARTS``, empty where the format has none;
    null where no format fits the whole text.

    The text is matched once: the match is replaced by all named groups in a fixed order, of which those of
    formats that were not met are empty.
    """
    groups = "\u0001".join("".join(f"${{{n}}}" for n in _named(part)) for part in _PARTS)
    return F.split(F.when(text.rlike(FORMATS), F.regexp_replace(text, FORMATS, groups)), "\u0001", -1)


def _named(part: str) -> list[str]:
    import re

    return re.findall(rf"\(\?<({part}\d)>", FORMATS)


def day_number(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 in the Gregorian calendar; null for a date that does not exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1900, 2199) & m.between(1, 12) & (d >= 1) & (d <= length)
    year = F.when(m <= 2, y - 1).otherwise(y)  # years from March on, so that the leap day comes last
    month = (m + 9) % 12
    days = year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((month * 153 + 2) / 5) + d - 1
    return F.when(ok, (days - 719_468).cast("bigint"))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def offset_s(utc_s: Column, tz: Column) -> Column:
    """Seconds east of UTC of the zone at an instant."""
    at = F.timestamp_add("SECOND", utc_s.cast("int"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.timestamp_diff("SECOND", at, F.convert_timezone(F.lit("UTC"), tz, at))


def _local_candidates(local_us: Column, tz: Column) -> Column:
    """Instants of a local time: with the offset of the day before and of the day after."""
    s = F.floor(local_us / 1_000_000)
    return F.array(*[local_us - offset_s(s + shift, tz) * 1_000_000 for shift in (-DAY, DAY)])


def text_instants(
    texts: DataFrame, id_: str, text: str, tz: str, near_utc: str, within_s: int = 1200
) -> DataFrame:
    """One UTC instant for each text that tells a possible date and a time to the second.

    Returns ``id_, utc_us, n_readings, is_near``.  A text may have several readings (day or month
    first, two-digit years, local time, UTC, either side of a clock change); the one nearest to
    ``near_utc`` is taken, and ``is_near`` tells whether it lies within ``within_s``.  Where
    ``near_utc`` is null the first reading in the order day first, local time, earlier offset is
    taken; where ``tz`` is null local time is read as UTC.

    Nulls, empty texts and texts without a possible date and time (seconds included) give no row;
    blanks around a time don't matter, however many; repeated rows give a row each; other columns are ignored.
    """

    base = texts.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(tz).alias("tz"), micros(near_utc).alias("near"))
    base = base.withColumn("parts", split_times(F.col("text")))
    t = lambda k: F.nullif(F.col("parts")[_PARTS.index(k)], F.lit(""))
    whole = lambda k: t(k).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(t("mon"))).cast("int")
    zone_text = F.upper(t("z"))
    sign = F.when(zone_text.startswith("-"), -1).otherwise(1)
    written = sign * (F.substring(zone_text, 2, 2).try_cast("int") * 60 + F.right(zone_text, F.lit(2)).try_cast("int"))
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    off = F.when(zone_text.rlike("^[+-]"), written).otherwise(F.try_element_at(known, zone_text))
    instant = F.coalesce(t("ms").try_cast("bigint") * 1000, t("s").try_cast("bigint") * 1_000_000)
    p = base.select(
        "id", "tz", "near", whole("y").alias("y"), F.coalesce(month, whole("m")).alias("m"), whole("d").alias("d"), whole("a").alias("a"), whole("b").alias("b"), whole("c").alias("c"),
        (F.length(t("c")) == 2).alias("two"), whole("hh").alias("hh"), whole("mi").alias("mi"), whole("ss").alias("ss"),
        F.rpad(F.substring(F.coalesce(t("f"), t("g"), F.lit("0")), 1, 6), 6, "0").try_cast("bigint").alias("us"),
        F.when(F.lower(t("ap")) == "p", 1).when(t("ap").isNotNull(), 0).alias("pm"), off.alias("off"), off.isNotNull().alias("zone"),
        instant.alias("instant_us"), t("serial").try_cast("double").alias("serial"),
    )
    c = F.col
    hour = F.when(c("pm").isNull(), c("hh")).when(c("hh").between(1, 12), c("hh") % 12 + c("pm") * 12)
    clock = F.when(hour.between(0, 23) & c("mi").between(0, 59) & c("ss").between(0, 59), ((hour * 60 + c("mi")) * 60 + c("ss")).cast("bigint") * 1_000_000 + c("us"))
    century = c("c") + F.when(c("two"), 2000).otherwise(0)
    days = F.array(
        day_number(c("y"), c("m"), c("d")),
        day_number(century, c("b"), c("a")),
        day_number(century, c("a"), c("b")),
        F.when(c("two"), day_number(c("a") + 2000, c("b"), c("c"))),
    )
    wall = F.filter(F.transform(days, lambda x: x * DAY * 1_000_000 + c("clock")), lambda x: x.isNotNull())
    # a spreadsheet serial counts days from 1899-12-30; eight decimals carry a second with room to spare
    serial = F.when(c("serial").isNotNull(), F.array(F.round((c("serial") - 25_569) * DAY).cast("bigint") * 1_000_000))
    p = p.withColumn("clock", clock).withColumn("wall", F.coalesce(serial, wall))
    zone = F.coalesce(c("tz"), F.lit("UTC"))
    free = F.flatten(F.transform(c("wall"), lambda x: F.concat(_local_candidates(x, zone), F.array(x))))
    fixed = F.transform(c("wall"), lambda x: x - c("off").cast("bigint") * 60_000_000)
    readings = F.when(c("instant_us").isNotNull(), F.array("instant_us")).when(c("zone"), fixed).otherwise(free)
    p = p.withColumn("readings", F.array_distinct(readings))
    ranked = F.transform(c("readings"), lambda x, i: F.struct(F.coalesce(F.abs(x - c("near")), F.lit(0).cast("bigint")).alias("far"), i.alias("i"), x.alias("us")))
    # texts without a reading go here; as a filter this would be pushed below and the text matched once more for each part
    p = p.select("id", "near", "readings", F.explode(F.array_compact(F.array(F.array_min(ranked)))).alias("best"))
    return p.select(
        c("id").alias(id_),
        c("best.us").alias("utc_us"),
        F.size("readings").alias("n_readings"),
        (c("near").isNotNull() & (c("best.far") < within_s * 1_000_000)).alias("is_near"),
    )


def wall_clock_units(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Unit of the counter of each file of clock kind ``wall`` that has lines, a zone and a start, one row per file:
    ``recording_id, file_no, tz, start_us, unit_us, first_t, lo, hi, last, last_line``.

    The unit is the declared one or else the one of s, ms and min whose step fits ``interval_s`` best.
    One pass with partial aggregation.
    """
    keys = ["recording_id", "file_no"]
    wall = files.where("clock_kind = 'wall' and device_start_utc is not null and tz is not null").select(
        *keys, "tz", F.lower(F.trim("time_unit")).alias("unit"), F.col("interval_s").cast("double").alias("interval_s"), micros("device_start_utc").alias("start_us")
    )
    wall = wall.dropDuplicates(keys)
    t = F.col("timesincereference").cast("double")
    x = lines.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "row_id", t.alias("t")).where("t is not null and not isnan(t)")
    spans = x.join(wall.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.max_by(F.struct("row_id", "t"), F.struct("line_no", "row_id")).alias("last"),
        F.max("line_no").alias("last_line"),
        F.min_by("t", F.struct("line_no", "row_id")).alias("first_t"),
        F.max("t").alias("hi"),
        F.min("t").alias("lo"),
        F.count(F.lit(1)).alias("n"),
    )
    f = wall.join(spans, keys)
    step = (F.col("hi") - F.col("lo")) / (F.col("n") * F.col("interval_s"))
    fits = F.when(step > 31.6, F.lit(1000.0)).when(step < 0.129, F.lit(1_000_000 * 60.0)).otherwise(F.lit(1_000_000.0))
    unit = F.when(F.col("unit").isin("s", "sec", "seconds"), F.lit(1_000_000.0)).when(F.col("unit") == "ms", F.lit(1000.0))
    unit = unit.when(F.col("unit").isin("min", "minutes"), F.lit(60_000_000.0)).otherwise(fits)
    return f.select(*keys, "tz", "start_us", unit.alias("unit_us"), "first_t", "lo", "hi", "last", "last_line")


def wall_clock_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """What turns the counter of each file of clock kind ``wall`` into instants, one row per file: the columns of
    ``wall_clock_units``, ``local_us`` (local time of the start) and ``fold_line``.

    That is the line from which on a local time that occurs twice (clocks set back) is the second of the
    two: where the counter steps back by more than half an hour.  Only files in which clocks are set back
    are looked at line by line.
    """
    keys = ["recording_id", "file_no"]
    f = wall_clock_units(lines, files)
    f = f.withColumn("local_us", F.col("start_us") + offset_s(F.floor(F.col("start_us") / 1_000_000), F.col("tz")) * 1_000_000)
    ends = [offset_s(F.floor(_counted(F.col(v)) / 1_000_000) + s, F.col("tz")) for v, s in (("lo", -DAY), ("hi", DAY))]
    f = f.withColumn("set_back", ends[0] > ends[1])
    t = F.col("timesincereference").cast("double")
    x = lines.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), t.alias("t")).where("t is not null and not isnan(t)")
    back = x.join(f.where("set_back").select(*keys, "unit_us"), keys)
    back = with_neighbour(back.groupBy(*keys, "line_no").agg(F.max("t").alias("t"), F.first("unit_us").alias("unit_us")), keys, "line_no", ["t"])
    folds = back.where((F.col("__near.t") - F.col("t")) * F.col("unit_us") > 1800 * 1_000_000).groupBy(*keys).agg(F.min("line_no").alias("fold_line"))
    return f.join(folds, keys, "left").drop("set_back", "lo", "hi")


def _counted(t: Column) -> Column:
    return (F.col("local_us") + F.round(t * F.col("unit_us"))).cast("bigint")


def wall_clock_us(t: Column, line_no: Column) -> Column:
    """Instant in microseconds of a counter value, beside the columns of ``wall_clock_files``."""
    counted = _counted(t)
    c = _local_candidates(counted, F.col("tz"))
    valid = lambda u: u + offset_s(F.floor(u / 1_000_000), F.col("tz")) * 1_000_000 == counted
    first_us = F.col("start_us") + F.round(F.col("first_t") * F.col("unit_us")) - 60_000_000
    second = F.coalesce(line_no >= F.col("fold_line"), c[0] < first_us)
    return F.when(c[0] == c[1], c[0]).when(valid(c[0]) & valid(c[1]), F.when(second, c[1]).otherwise(c[0])).when(valid(c[1]), c[1]).otherwise(c[0])


def wall_clock_instants(lines: DataFrame, files: DataFrame, last_only: bool = False) -> DataFrame:
    """UTC instants of the lines of recordings whose counter follows the local clock of the site.

    ``lines``: ``recording_id, file_no, line_no, row_id, timesincereference``; ``files``:
    ``recording_id, file_no, tz, clock_kind, time_unit, interval_s, device_start_utc``.  Returns
    ``recording_id, file_no, line_no, row_id, utc_us`` for files of clock kind ``wall``; with
    ``last_only`` just for the line with the highest number.

    Unit and clock changes: see ``wall_clock_files``.  A local time that occurs twice is also the second of
    the two if the first would lie before the file's first line.  A local time that a clock change leaves
    out is read with the offset before.

    Lines with a null or NaN time have no row (the highest numbered line with a time is the last);
    files without start, zone or lines have none; repeated lines have a row each.
    """
    keys = ["recording_id", "file_no"]
    f = wall_clock_files(lines, files)
    if last_only:
        rows = f.withColumns({"row_id": F.col("last.row_id"), "t": F.col("last.t"), "line_no": F.col("last_line")})
    else:
        t = F.col("timesincereference").cast("double")
        rows = lines.select(*keys, F.col("line_no").cast("bigint").alias("line_no"), "row_id", t.alias("t")).where("t is not null and not isnan(t)").join(f, keys)
    return rows.select(*keys, "line_no", "row_id", wall_clock_us(F.col("t"), F.col("line_no")).alias("utc_us"))
