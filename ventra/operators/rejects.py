"""Rows that fail to parse: set apart with the reason while the valid rows load."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")
MISSING = ("", "NA", "n/a")
_NUMBER = re.compile(r"([+-]?)(\d+(?:[.,]\d*)?|[.,]\d+)(?:\s+s)?", re.A)
_CLOCK = re.compile(r"(-?)(?:(\d{1,2}):([0-5]\d)|(\d{1,2})):([0-5]\d(?:[.,]\d+)?)", re.A)
_STRAY = {d: re.compile(rf'(?:\s*"(?:[^"]|"")*"\s*|[^"{d}]*)(?:{d}(?:\s*"(?:[^"]|"")*"\s*|[^"{d}]*))*') for d in DELIMITERS}


class Reject(Exception):
    """Why a line does not load."""


def delimiter_of(header: str) -> str:
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=bare.count)


def fields_of(line: str, delimiter: str) -> list[str]:
    """Fields of one record; a structural fault raises."""
    read = lambda x: next(csv.reader(io.StringIO(x, newline=""), delimiter=delimiter, strict=True, skipinitialspace=True), [])
    try:
        fields = read(line)
    except csv.Error as e:
        try:  # blanks between a closing quote and the delimiter don't matter
            fields = read(re.sub(rf'"[ \t]+(?={delimiter}|$)' if delimiter != "\t" else r'" +(?=\t|$)', '"', line))
        except csv.Error:
            raise Reject("quoting") from e
    # the reader lets a quote inside an unenclosed field pass
    if '"' in line and not _STRAY[delimiter].fullmatch(line):
        raise Reject("quoting")
    return fields


def seconds_of(text: str) -> float | None:
    """Seconds from a number or a clock time, None where missing."""
    text = text.strip()
    if text in MISSING:
        return None
    if m := _NUMBER.fullmatch(text):
        return float(m[1] + m[2].replace(",", "."))
    if m := _CLOCK.fullmatch(text):
        minutes = int(m[2]) * 60 + int(m[3]) if m[2] else int(m[4])
        if minutes >= 60 and not m[2]:
            raise Reject("value")
        return (minutes * 60 + float(m[5].replace(",", "."))) * (-1 if m[1] else 1)
    raise Reject("value")


def bin_size_of(text: str) -> int:
    text = text.strip()
    if not re.fullmatch(r"[0-9]+", text) or int(text) <= 0 or int(text) >= 2**31:
        raise Reject("value")
    return int(text)


def _named(header: list[str], *parts: str) -> int | None:
    for i, name in enumerate(header):
        if any(p in name for p in parts):
            return i
    return None


BEHAVIOUR = ("behav", "act", "event", "verhalten", "comportement", "ethogram", "beh", "bout type")
_OUT = (
    "file_id bigint, line_no int, file_kind string, reason string, label string, start_s double, stop_s double, duration_s double, "
    "telemetry_file string, event_file string, behaviour string, video_time string, bin_size int"
)


def assemble_records(lines: DataFrame, block: int = 4096, most: int = 1000) -> DataFrame:
    """Lines (``file_id, line_no, line_text``) put together to records where a quoted value goes on after a line break.

    A line belongs to the record before it if an odd number of quotes stands before it in its file; a
    record has the number of its first line.  Quotes are counted within blocks of ``block`` lines and one
    row per block carries the count on, so a file of any size is spread.  A quote that is never closed would
    swallow the rest of its file: what reaches over more than ``most`` lines stays as single lines, of
    which the reader then refuses those with the quotes.  Null texts count as empty.
    """
    text = F.coalesce("line_text", F.lit(""))
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2
    rows = lines.select("file_id", "line_no", text.alias("line_text"), odd.alias("__odd"), F.floor(F.col("line_no") / block).alias("__b"))
    within = Window.partitionBy("file_id", "__b").orderBy("line_no")
    across = Window.partitionBy("file_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file_id", "__b").agg(F.sum("__odd").alias("__n")).select("file_id", "__b", F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__q", F.coalesce(F.sum("__odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(carried, ["file_id", "__b"]).withColumn("__start", F.when((F.col("__q") + F.col("__before")) % 2 == 0, F.col("line_no")))
    last = rows.groupBy("file_id", "__b").agg(F.max("__start").alias("__n")).select("file_id", "__b", F.max("__n").over(across).alias("__open"))
    first = F.coalesce(F.last("__start", True).over(within), F.col("__open"), F.col("line_no"))
    rows = rows.join(last, ["file_id", "__b"]).select("file_id", "line_no", "line_text", first.alias("__record"))
    size = rows.groupBy("file_id", "__record").agg(F.count(F.lit(1)).alias("__lines"))
    rows = rows.join(size, ["file_id", "__record"]).withColumn("__record", F.when(F.col("__lines") <= most, F.col("__record")).otherwise(F.col("line_no")))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line_text")))  # at most ``most`` lines
    whole = rows.groupBy("file_id", F.col("__record").alias("line_no")).agg(parts.alias("__p"))
    return whole.select("file_id", "line_no", F.array_join(F.transform("__p", lambda x: F.regexp_replace(x["line_text"], "[\\r\\n]+$", "")), "\n").alias("line_text"))


def parse_lines(lines: DataFrame, files: DataFrame, spanning: bool = False) -> DataFrame:
    """Every line after the header of event and config files, loaded or with the reason it can't be.

    ``lines``: ``file_id, line_no, line_text``; ``files``: ``file_id, file_kind``.  Returns the typed
    fields; ``reason`` is null for loaded lines, else ``quoting`` (a double quote that neither encloses
    a whole field nor is doubled inside one), ``columns`` (not as many fields as the header) or
    ``value`` (start, duration or bin_size is unusable), the first that holds; a rejected line's
    fields are null.

    With ``spanning`` records are first put together across line breaks inside quotes (``assemble_records``);
    without, a record is a line, as where a stray quote must not touch the lines after it.  Blank and null
    lines are passed over;
    files without line 1 have no header and are left out; an event file without start or duration,
    or a config file without bin_size, has no such check.  Lines meet their file's header in a shuffle
    join that adaptive execution splits where one file holds much of the data.
    """
    kinds = files.select("file_id", "file_kind").where(F.col("file_kind").isin("event", "config"))
    heads = lines.where("line_no = 1").select("file_id", F.col("line_text").alias("header")).join(kinds, "file_id")
    records = assemble_records(lines.where("line_no > 1")) if spanning else lines
    body = records.where("line_no > 1 and length(trim(translate(line_text, '\\t\\r\\n', '   '))) > 0")
    body = body.select("file_id", "line_no", "line_text").join(heads, "file_id")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple] = {}
        for pdf in batches:
            out = []
            for file_id, line_no, text, header, kind in zip(pdf["file_id"], pdf["line_no"], pdf["line_text"], pdf["header"], pdf["file_kind"]):
                got = known.get((header, kind))
                if got is None:
                    header_text = (header or "").lstrip("﻿").rstrip("\r\n")
                    d = delimiter_of(header_text)
                    try:
                        names = [n.strip().strip('"').strip().casefold() for n in fields_of(header_text, d)]
                    except Reject:
                        names = [n.strip().strip('"').strip().casefold() for n in header_text.split(d)]
                    if kind == "event":
                        places = (_named(names, "start"), _named(names, "stop"), _named(names, "duration"))
                        label = next((i for i, n in enumerate(names) if i not in places and any(p in n for p in BEHAVIOUR)), None)
                    else:
                        places = tuple(_named(names, n) for n in ("telemetry_file", "event_file", "behaviour", "video_time", "bin_size"))
                        label = None
                    if len(known) > 10_000:
                        known.clear()
                    got = known[header, kind] = (d, len(names), places, label)
                d, width, places, label = got
                typed: list = [None] * 9
                reason = None
                try:
                    row = fields_of(text.rstrip("\r\n"), d)
                    if len(row) != width:
                        raise Reject("columns")
                    at = lambda i: row[i].strip() if i is not None else ""
                    if kind == "event":
                        start = seconds_of(at(places[0]))
                        duration = seconds_of(at(places[2]))
                        if duration is not None and duration < 0:
                            raise Reject("value")
                        try:
                            stop = seconds_of(at(places[1]))
                        except Reject:  # the stop time is no ground for refusal
                            stop = None
                        typed[:4] = [at(label) or None, start, stop, duration]
                    else:
                        size = bin_size_of(at(places[4])) if places[4] is not None else None
                        typed[4:] = [*(at(i) or None for i in places[:4]), size]
                except Reject as e:
                    reason = str(e)
                out.append((file_id, line_no, kind, reason, *typed))
            names_ = [c.split()[0] for c in _OUT.split(", ")]
            frame = pd.DataFrame(out, columns=names_, dtype=object)
            yield frame.astype({"start_s": float, "stop_s": float, "duration_s": float})

    got = body.mapInPandas(parse, _OUT)
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("start_s", "stop_s", "duration_s")})
