"""Files as received: telemetry text, scored events, photometry, batch configurations."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import number
from ..operators.neighbours import with_rank

#: Names of channels in telemetry files and the signal each holds.
CHANNELS = {"temp": "temp", "temperature": "temp", "pressure": "pressure", "activity": "activity", "act": "activity", "apr": "atm"}
SIGNALS = ("pressure", "temp", "activity", "atm")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file_path, line_no, line`` of text files, blank lines left out, numbered from 1 per file.

    Files are read in splits, never whole; numbers come from the order of splits and of lines in them.
    """
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")
    )
    raw = raw.where(F.length(F.trim("line")) > 0)
    return with_rank(raw, ["file_path"], "__at", ["__id"], block=1, out="line_no").select("file_path", F.col("line_no").cast("int").alias("line_no"), "line")


def header_lines(lines: DataFrame) -> DataFrame:
    """``file_path, head``: the first line that starts with ``time``, 0 where there is none."""
    is_head = F.lower(F.ltrim("line")).startswith("time")
    return lines.groupBy("file_path").agg(F.coalesce(F.min(F.when(is_head, F.col("line_no"))), F.lit(0)).alias("head"))


def channels(lines: DataFrame) -> DataFrame:
    """``file_path, position, signal, rate_hz`` from the ``# Col n:`` lines; the first of a signal counts."""
    parts = F.split("line", ",")
    col = F.regexp_extract("line", r"^\s*#\s*Col\s+(\d+):", 1)
    name = F.lower(F.trim(F.try_element_at(parts, F.lit(2))))
    known = F.create_map(*[F.lit(x) for pair in CHANNELS.items() for x in pair])
    rate = number(F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("")), r":\s*(.*)$", 1))
    rows = lines.where(F.length(col) > 0).select("file_path", "line_no", col.cast("int").alias("position"), known[name].alias("signal"), rate.alias("rate_hz")).where("signal is not null")
    first = rows.groupBy("file_path", "signal").agg(F.min_by(F.struct("position", "rate_hz"), "line_no").alias("c"))
    return first.select("file_path", F.col("c.position").alias("position"), "signal", F.col("c.rate_hz").alias("rate_hz"))


def telemetry_rows(lines: DataFrame) -> DataFrame:
    """``file_path, line_no, date_text, pressure, temp, activity, atm`` of telemetry files of any layout."""
    layout = channels(lines).groupBy("file_path").pivot("signal", list(SIGNALS)).agg(F.first("position"))
    body = lines.join(header_lines(lines), "file_path").where("line_no > head").join(layout, "file_path", "left")
    parts = F.split("line", ",")
    at = lambda s: number(F.try_element_at(parts, F.col(s))).alias(s)
    return body.select("file_path", "line_no", F.trim(parts[0]).alias("date_text"), *[at(s) for s in SIGNALS])


def _column(names: list[str], part: str) -> str:
    for n in names:
        if part in n.lower():
            return n
    raise ValueError(f"no column with {part!r} among {names}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scored events: ``event, instance, start, end, duration`` by the first header that contains each name."""
    raw = spark.read.csv(path, header=True)
    event, start, stop, duration = (_column(raw.columns, p) for p in ("behavior", "start (s)", "stop (s)", "duration (s)"))
    col = lambda c: number(F.col(f"`{c}`"))
    rows = raw.select(F.col(f"`{event}`").alias("event"), col(start).alias("start"), col(stop).alias("end"), col(duration).alias("duration"), F.monotonically_increasing_id().alias("__id"))
    rows = rows.withColumn("__ms", F.round(F.col("start") * 1000).cast("bigint"))
    return with_rank(rows, ["event"], "__ms", ["__id"], 3_600_000, "instance").select("event", F.col("instance").cast("int").alias("instance"), "start", "end", "duration")


def read_photometry(spark: SparkSession, path: str) -> DataFrame:
    """Photometry: minutes to seconds, known signals only, rows with any gap dropped; none left is an error."""
    raw = spark.read.csv(path, header=True)
    if "# t_min" not in raw.columns:
        raise ValueError("no column '# t_min'")
    kept = [c for c in ("dFoF_465", "dFoF_405", "Z_465") if c in raw.columns]
    rows = raw.select((number(F.col("`# t_min`")) * 60).alias("t"), *[number(F.col(c)).alias(c) for c in kept]).na.drop()
    if rows.isEmpty():
        raise ValueError("no usable rows")
    return rows


def detect_kind(spark: SparkSession, path: str) -> str:
    """``behaviour``, ``photometry`` or ``unknown`` from the header."""
    try:
        names = " ".join(spark.read.csv(path, header=True).columns).lower()
    except Exception:
        return "unknown"
    if "start" in names and "stop" in names:
        return "behaviour"
    return "photometry" if "dfof_465" in names else "unknown"


def listing(folder: str, extensions: tuple[str, ...]) -> str:
    """Names of the files with these endings, for messages about files that are missing."""
    if not os.path.isdir(folder):
        return f"no folder {folder}"
    found = sorted(f for f in os.listdir(folder) if f.lower().endswith(extensions))
    return ", ".join(found) or "none"


REQUIRED = ("telemetry_file", "event_file", "behaviour", "video_time", "bin_size")


def read_batch_config(spark: SparkSession, path: str) -> DataFrame:
    """Batch configuration from CSV or XLSX; a missing column is an error, other columns stay."""
    if path.lower().endswith(".csv"):
        config = spark.read.csv(path, header=True)
    elif path.lower().endswith((".xlsx", ".xlsm")):
        rows = _sheet(path)
        config = spark.createDataFrame([[*r, *[None] * len(rows[0])][: len(rows[0])] for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))
    else:
        raise ValueError(f"not a CSV or XLSX file: {path}")
    missing = [c for c in REQUIRED if c not in config.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return config


def _sheet(path: str) -> list[list[str | None]]:
    """Cells of the first sheet of a small workbook."""
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]))
    out = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: list[str | None] = []
        for c in row.findall("m:c", ns):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r", "A1"))[0]:
                at = at * 26 + ord(letter) - 64
            value = c.find("m:v", ns)
            text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) or None
            cells += [None] * (at - 1 - len(cells)) + [shared[int(text)] if c.get("t") == "s" and text else text]
        out.append(cells)
    return out


def collisions(config: DataFrame, dest: Column) -> DataFrame:
    """Destinations that more than one row would write to, case ignored."""
    return config.groupBy(F.lower(dest).alias("dest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
