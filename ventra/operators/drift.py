"""Schemas that drift between files: one consistent table, and a report of every change."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .neighbours import with_neighbour


@dataclass(frozen=True)
class Field:
    """A column of the consistent table: words of its name, the value forms it comes in, its type.

    An ``any_name`` field comes under names that can't be foreseen; a column that no other field explains
    is taken for it if its values have one of the forms.
    """

    name: str
    words: tuple[str, ...]
    kinds: tuple[str, ...]
    type: str = "string"
    any_name: bool = False


#: The consistent schemas with the words of their fields' own names.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "telemetry": (
        Field("Time", ("time",), ("text",)),
        Field("Pressure", ("pressure",), ("signed",), "double"),
        Field("Temp", ("temp", "temperature"), ("small",), "double"),
        Field("Activity", ("activity",), ("count",), "double"),
        Field("AtmPressure", ("atm", "pressure"), ("hpa", "pa"), "double", any_name=True),
        Field("Humidity", ("humidity",), ("small",), "double"),
        Field("Light", ("light",), ("count",), "double"),
    ),
    "event": (
        Field("behavior", ("behavior", "behaviour"), ("words", "count"), any_name=True),
        Field("start", ("start",), ("small", "signed", "text"), "seconds"),
        Field("stop", ("stop",), ("small", "signed", "text"), "seconds"),
        Field("duration", ("duration",), ("small", "signed", "text"), "seconds"),
        Field("modifier", ("modifier",), ("words",)),
        Field("observer", ("observer",), ("words",)),
        Field("comment", ("comment",), ("words",)),
        Field("media", ("media", "file"), ("words",)),
        Field("fps", ("fps",), ("count",), "double"),
    ),
}
#: Most rounds, when likeness counts as settled, least likeness of words and of names for a pair.
_ROUNDS, _STILL, _WORD, _ACCEPT = 60, 1e-4, 0.85, 0.3
_PRESSURES = ("hpa", "pa")  # forms that only one field has


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower().replace("_", " ")) or [name.lower()]


def _alike(a: str, b: str) -> float:
    """Dice of letter pairs, less a tenth; whole words count in full and prefixes nearly so."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.9
    p, q = {a[i : i + 2] for i in range(len(a) - 1)}, {b[i : i + 2] for i in range(len(b) - 1)}
    return 1.8 * len(p & q) / (len(p) + len(q)) if p and q else 0.0


@lru_cache(maxsize=10_000)
def _explained(name: str, fields: tuple[Field, ...]) -> list[tuple[float, list[tuple[str, float, str]]]]:
    """For each field how much of a name it explains, and by which of its words; of them first those no other field has."""
    shared = _shared(fields)
    out = []
    for f in fields:
        best = [(w, *max(((_alike(w, v), v) for v in f.words), key=lambda x: (x[0], -shared[x[1]]))) for w in _words(name)]
        kept = [(w, s, v) for w, s, v in best if s >= _WORD]
        out.append((sum(s for _, s, _ in kept) / len(best), kept))
    return out


@lru_cache(maxsize=100)
def _shared(fields: tuple[Field, ...]) -> dict[str, int]:
    return {w: sum(w in f.words for f in fields) for f in fields for w in f.words}


def flood(columns: list[tuple[str, str]], fields: tuple[Field, ...]) -> list[str | None]:
    """Field of each column (name, value form) by similarity flooding, None where there is none.

    Both schemas are graphs: the file holds columns, a column has words and a value form.  Pairs of
    nodes pass their likeness on along edges of the same kind until it no longer changes; then pairs
    of column and field are taken from the likeliest down, each node once.  So a column under a name
    that says nothing goes to the field that is left and has its form.
    """
    pairs: dict[tuple, int] = {}
    start: list[float] = []

    def node(key: tuple, sim: float) -> int:
        if key not in pairs:
            pairs[key] = len(start)
            start.append(sim)
        return pairs[key]

    edges: list[tuple[int, int, str]] = []
    root = node(("file",), 1.0)
    shared = _shared(fields)
    first: dict[tuple[int, int], float] = {}
    for i, (name, kind) in enumerate(columns):
        for j, (f, (sim, words)) in enumerate(zip(fields, _explained(name, fields))):
            first[i, j] = sim
            here = node(("column", i, j), sim)
            edges.append((root, here, "holds"))
            for w, s, v in words:
                edges.append((here, node(("word", w, v), s / shared[v]), "word"))
            if kind in f.kinds:
                edges.append((here, node(("form", kind, j), 1.0 if kind in _PRESSURES else 0.5), "form"))
    n = len(start)
    flow = np.zeros((n, n))
    for a, b in ((0, 1), (1, 0)):
        out: dict[tuple[int, str], int] = {}
        for e in edges:
            out[e[a], e[2]] = out.get((e[a], e[2]), 0) + 1
        for e in edges:
            flow[e[b], e[a]] += 1 / out[e[a], e[2]]
    sigma0 = np.array(start)
    sigma = sigma0.copy()
    for _ in range(_ROUNDS):
        new = sigma0 + sigma + flow @ (sigma0 + sigma)
        new /= new.max()
        moved = np.abs(new - sigma).max()
        sigma = new
        if moved < _STILL:
            break
    ranked = sorted(first, key=lambda ij: (-sigma[pairs["column", *ij]], ij))
    field_of: list[str | None] = [None] * len(columns)
    used: set[int] = set()
    for by_name in (True, False):  # what names and decisive forms tell, then what is left
        for i, j in ranked:
            kind, f = columns[i][1], fields[j]
            if field_of[i] is not None or j in used:
                continue
            named = first[i, j] >= _ACCEPT and (kind not in _PRESSURES or kind in f.kinds) or kind in _PRESSURES and kind in f.kinds
            if named if by_name else f.any_name and kind in f.kinds:
                field_of[i] = f.name
                used.add(j)
    return field_of


def _split(text: Column, delimiter: Column) -> Column:
    """Fields of a line by its delimiter, quotes respected."""
    parts = F.lit(None).cast("array<string>")
    for d in (",", ";", "\t"):
        quoted = F.split(text, rf'{d}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
        plain = F.split(text, d, -1)
        parts = F.when(delimiter == d, F.when(text.contains('"'), quoted).otherwise(plain)).otherwise(parts)
    bare = lambda x: F.when(x.startswith('"'), F.trim(F.regexp_replace(x, '^"(.*)"$', "$1"))).otherwise(x)
    return F.transform(parts, lambda x: bare(F.trim(x)))


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def headers(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Header of each telemetry and event file: ``file_id, file_kind, head_line, delimiter, names``."""
    kinds = files.select("file_id", "file_kind").where(F.col("file_kind").isin("telemetry", "event"))
    maybe = lines.where((F.col("line_no") == 1) | F.lower(F.substring("line_text", 1, 40)).contains("time"))
    text = F.regexp_replace(F.col("line_text"), "^[\\uFEFF]+|[\\r\\n]+$", "")
    found = maybe.select("file_id", "line_no", text.alias("text")).join(kinds, "file_id")
    is_time = F.lower(F.regexp_replace("text", '^[\\s"]+', "")).startswith("time")
    found = found.where(F.when(F.col("file_kind") == "event", F.col("line_no") == 1).otherwise(is_time))
    heads = found.groupBy("file_id", "file_kind").agg(F.min("line_no").alias("head_line"), F.min_by("text", "line_no").alias("text"))
    n = {d: _count(F.col("text"), d) for d in (",", ";", "\t")}
    delimiter = F.when((n[";"] > n[","]) & (n[";"] >= n["\t"]), ";").when(n["\t"] > n[","], "\t").otherwise(",")
    heads = heads.withColumn("delimiter", delimiter)
    return heads.select("file_id", "file_kind", "head_line", "delimiter", _split(F.col("text"), F.col("delimiter")).alias("names"))


def field_rows(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines below the header with as many fields as it: ``file_id, line_no, parts``."""
    text = F.regexp_replace(F.col("line_text"), "[\\r\\n]+$", "")
    body = lines.select("file_id", "line_no", text.alias("text")).where("length(trim(text)) > 0").join(heads.hint("shuffle_hash"), "file_id")
    body = body.where("line_no > head_line").withColumn("parts", _split(F.col("text"), F.col("delimiter")))
    return body.where(F.size("parts") == F.size("names"))


def profiles(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Per file, its columns in order: name, form of most values (``whole, decimal, text``) and value kind.

    Counts are combined before the shuffle, so a file of any size costs a few rows.
    """
    v = F.col("v")
    # most cells are plain numbers and cost one pattern; only the others are looked at further
    cells = rows.select("file_id", F.posexplode("parts").alias("pos", "v")).where("length(v) > 0")
    cells = cells.withColumn("n", F.regexp_extract("v", r"[+-]?\d+(?:[.,]\d+)?", 0))
    plain, point = F.col("n") == v, F.col("n").contains(".") | F.col("n").contains(",")
    whole = plain & ~point
    decimal = (plain & point) | (~plain & v.rlike(r"^[+-]?(\d+[.,]|[.,]\d+)$"))
    size = F.abs(F.expr("try_cast(replace(n, ',', '.') as double)"))
    count = lambda c, name: F.count_if(c).alias(name)
    by = cells.groupBy("file_id", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        count(whole, "whole"),
        count(decimal, "decimal"),
        count(size.between(850, 1100), "hpa"),
        count(whole & size.between(85_000, 110_000), "pa"),
        count(v.startswith("-") & (whole | decimal), "negative"),
        count(~plain & v.rlike("^[^0-9]*[A-Za-z]{3}"), "words"),
    )
    text = F.col("n") - F.col("whole") - F.col("decimal")
    form = F.when(F.col("n").isNull(), None).when((F.col("whole") >= F.col("decimal")) & (F.col("whole") >= text), "whole")
    form = form.when(F.col("decimal") >= text, "decimal").otherwise("text")
    half = F.col("n") / 2
    kind = F.when(F.col("n").isNull(), "none").when(F.col("hpa") > half, "hpa").when(F.col("pa") > half, "pa").when(F.col("words") > half, "words")
    kind = kind.when(text > half, "text").when(F.col("negative") > half / 2, "signed").when(F.col("whole") > half, "count").otherwise("small")
    seen = by.groupBy("file_id").agg(F.collect_list(F.struct("pos", form.alias("form"), kind.alias("kind"))).alias("seen"))  # an entry per column
    of = heads.select("file_id", "file_kind", "names").join(seen, "file_id", "left")
    place = F.map_from_entries(F.transform("seen", lambda x: F.struct(x["pos"], F.struct(x["form"], x["kind"]))))
    of = of.withColumn("seen", place)

    def column(name: Column, i: Column) -> Column:
        got = F.try_element_at("seen", i)
        return F.struct(i.alias("pos"), name.alias("name"), got["form"].alias("form"), F.coalesce(got["kind"], F.lit("none")).alias("kind"))

    return of.select("file_id", "file_kind", F.transform("names", column).alias("columns"))


def match_fields(profiled: DataFrame) -> DataFrame:
    """``file_id, file_kind, columns, fields``: the consistent field of each column; flooding runs once per
    different set of names and forms.  The result, one row per file, is kept."""
    plain = lambda c: F.lower(F.trim(c["name"]))
    in_order = F.array_sort(F.transform("columns", lambda c: F.struct(F.coalesce(plain(c), F.lit("")).alias("plain"), c["kind"].alias("kind"), c["pos"].alias("pos"), c.alias("c"))))
    signed = profiled.select("file_id", "file_kind", in_order.alias("sorted"))
    signed = signed.withColumn("signature", F.to_json(F.transform("sorted", lambda x: F.struct(x["c"]["name"].alias("name"), x["kind"].alias("kind")))))
    signed = durable(signed)  # one row per file, used for the layouts and for the files

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            found = []
            for kind, sig in zip(pdf["file_kind"], pdf["signature"]):
                found.append(flood([(c.get("name") or "", c["kind"]) for c in json.loads(sig)], SCHEMAS[kind]))
            yield pdf.assign(fields=found)

    # layouts are few bytes but much work, so they are spread by number, not by size
    n = int(profiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schemas = signed.select("file_kind", "signature").distinct().repartition(n, "signature")
    matched = schemas.mapInPandas(match, "file_kind string, signature string, fields array<string>")
    matched = signed.join(matched, ["file_kind", "signature"])
    return durable(matched.select("file_id", "file_kind", F.transform("sorted", lambda x: x["c"]).alias("columns"), "fields"))


def schema_changes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every change of a field between a file and the one before it in its rig and kind.

    Returns ``file_id, file_kind, field_name, change_kind, old_name, new_name, old_form, new_form``.
    ``added`` or ``removed`` where one file has the field, ``renamed`` where the names differ by more
    than case and surrounding blanks, ``retyped`` where the form of most non-blank values differs; a
    field may have both of the last two.  The first file of a rig and kind has no change; a file
    without a header has no fields; a field without values has no form and is not retyped; lines with
    another number of fields than the header don't count; null rigs form one rig.
    """
    heads = headers(lines, files)
    matched = match_fields(profiles(field_rows(lines, heads), heads))
    have = F.filter(F.arrays_zip("fields", "columns"), lambda x: x["fields"].isNotNull())
    held = F.map_from_entries(F.transform(have, lambda x: F.struct(x["fields"], F.struct(x["columns"]["name"].alias("name"), x["columns"]["form"].alias("form")))))
    of_kind = files.where(F.col("file_kind").isin("telemetry", "event")).select("rig_id", "file_kind", "file_seq", "file_id")
    of_kind = of_kind.join(matched.select("file_id", held.alias("held")), "file_id", "left")
    pairs = with_neighbour(of_kind, ["rig_id", "file_kind"], "file_seq", ["file_id", "held"]).where("__near.file_id is not null")
    names = F.create_map(*[x for k, fs in SCHEMAS.items() for x in (F.lit(k), F.array(*[F.lit(f.name) for f in fs]))])
    rows = pairs.select("file_id", "file_kind", F.col("held").alias("new"), F.col("__near.held").alias("old"), F.explode(names[F.col("file_kind")]).alias("field_name"))
    rows = rows.withColumns({"a": F.try_element_at("old", "field_name"), "b": F.try_element_at("new", "field_name")})
    plain = lambda c: F.lower(F.trim(c))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    found = F.array(
        F.when(F.col("a").isNull() & F.col("b").isNotNull(), "added"),
        F.when(F.col("a").isNotNull() & F.col("b").isNull(), "removed"),
        F.when(both & (plain(F.col("a.name")) != plain(F.col("b.name"))), "renamed"),
        F.when(both & (F.col("a.form") != F.col("b.form")), "retyped"),
    )
    rows = rows.withColumn("change_kind", F.explode(F.array_compact(found)))
    return rows.select(
        "file_id", "file_kind", "field_name", "change_kind",
        F.col("a.name").alias("old_name"), F.col("b.name").alias("new_name"), F.col("a.form").alias("old_form"), F.col("b.form").alias("new_form"),
    )


def _cast(text: Column, to: str) -> Column:
    """A value in the type of its field; null where it has no such reading (``parse_lines`` tells why)."""
    if to == "string":
        return text
    digits = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+))(?:\s*[A-Za-z%]+)?\s*$", 1)
    number = F.replace(F.nullif(digits, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    if to == "double":
        return number
    part = lambda i: F.regexp_extract(text, r"^\s*(-?)(?:(\d{1,2}):)?(\d{1,2}):([0-5]\d(?:[.,]\d+)?)\s*$", i)
    clock = F.coalesce(part(2).try_cast("int"), F.lit(0)) * 3600 + part(3).try_cast("int") * 60 + F.replace(part(4), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(number, F.when(part(1) == "-", -clock).otherwise(clock))


def unified_rows(lines: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """All files of a kind as one table: ``file_id, line_no`` and one column per consistent field, in its type.

    Numbers are doubles whatever their decimal mark, times of events are seconds whether written as
    numbers or as ``[h:]mm:ss``, and the room's air pressure is in hPa, be it hPa or Pa in the file
    (``atmpressure_text`` and the like keep what was written).  Fields a file lacks are null, as are blank
    values and values without a reading in their type; lines with another number of fields than the header
    are left out (they are the business of ``parse_lines``).
    """
    heads = headers(lines, files).where(F.col("file_kind") == kind)
    rows = field_rows(lines, heads)
    matched = match_fields(profiles(rows, heads)).select("file_id", F.transform("columns", lambda c: c["pos"]).alias("at"), "fields")
    rows = rows.select("file_id", "line_no", "parts").join(matched, "file_id")
    out = ["file_id", "line_no"]
    texts = []
    for f in SCHEMAS[kind]:
        place = F.try_element_at("at", F.array_position("fields", f.name).cast("int"))
        value = F.when(F.array_contains("fields", f.name), F.try_element_at("parts", place + 1))
        name = f.name.lower()
        typed = F.when(F.length(value) > 0, value)
        if f.type == "string":
            out.append(typed.alias(name))
            continue
        cast = _cast(typed, f.type)
        out.append((F.when(cast > 10_000, cast / 100).otherwise(cast) if f.name == "AtmPressure" else cast).alias(name))
        texts.append(typed.alias(f"{name}_text"))
    return rows.select(*out, *texts)
