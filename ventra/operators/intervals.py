"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

_LOW = np.iinfo(np.int64).min


def _entity_change(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's entity differs from the row before; the first row counts as changed."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        v = pdf[k]
        same = v.eq(v.shift()) | (v.isna() & v.shift().isna())
        new[1:] |= ~same.to_numpy()[1:]
    return new


def _running_end(end: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Largest end so far within the entity, the row itself included."""
    group = np.cumsum(new) - 1
    order = np.unique(end)
    rank = np.searchsorted(order, end) + group * len(order)  # later groups rank above all earlier ones
    return order[np.maximum.accumulate(rank) - group * len(order)]


def _key(row: pd.Series) -> tuple:
    return tuple(None if pd.isna(x) else x for x in row)


def _islands(pdf: pd.DataFrame, new: np.ndarray, carried: tuple[tuple, int, int] | None):
    """Per row: largest end so far, start of its period, largest end before it, whether a gap precedes it.

    ``carried`` holds (entity, largest end, period start) of the row before the first one here, given
    only if that row has the same entity.
    """
    s, e = pdf["__start"].to_numpy(np.int64), pdf["__end"].to_numpy(np.int64)
    new = new.copy()
    if carried:
        new[0] = False
        reached = _running_end(np.r_[carried[1], e], np.r_[True, new])
        before, reached = reached[:-1], reached[1:]
    else:
        reached = _running_end(e, new)
        before = np.r_[_LOW, reached[:-1]]
    gap = ~new & (s > before)
    at = np.maximum.accumulate(np.where(new | gap, np.arange(len(s)), -1))
    label = np.where(at >= 0, s[np.maximum(at, 0)], carried[2] if carried else 0)
    return reached, label, before, gap


def merge_intervals(intervals: DataFrame, keys: list[str], start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Continuous periods per entity and the gaps between them.

    ``start`` and ``end`` are whole numbers.  Rows that overlap, nest or touch belong to one period.
    Returns ``keys, row_kind, from_at, to_at, n_rows``: a ``period`` with the number of its rows, or a
    ``gap`` (``n_rows`` 0) from the end of a period to the start of the next of the same entity.

    Rows with a null start or end, or with the end before the start, are left out; null keys form
    one entity; repeated rows count each; columns not named are ignored; no rows give no rows.

    The rows are range-sorted by entity, start and end, so an entity of any size spreads over
    partitions.  One summary per partition (its last entity and that entity's largest end) is
    combined in order, and each partition is scanned again with what reaches it from before.  Only
    those summaries, one small row per partition, pass the driver.
    """
    spark = intervals.sparkSession
    clean = intervals.select(*keys, F.col(start).cast("bigint").alias("__start"), F.col(end).cast("bigint").alias("__end"))
    clean = clean.where(F.col("__start") <= F.col("__end"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = clean.repartitionByRange(n, *keys, "__start", "__end").sortWithinPartitions(*keys, "__start", "__end")
    ordered = durable(ordered.withColumn("__part", F.spark_partition_id()))

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the partition's last entity: largest end, start of its last period as far as known here."""
        lead, last, top, opened, part = None, None, _LOW, _LOW, -1
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["__part"].iloc[0])
            new = _entity_change(pdf, keys)
            lead = _key(pdf[keys].iloc[0]) if lead is None else lead
            carried = (last, top, opened) if last is not None and _key(pdf[keys].iloc[0]) == last else None
            reached, label, _, _ = _islands(pdf, new, carried)
            last, top, opened = _key(pdf[keys].iloc[-1]), int(reached[-1]), int(label[-1])
        if last is not None:
            yield pd.DataFrame({"part": [part], "only": [lead == last], "top": [top], "opened": [opened], **{f"k{i}": [k] for i, k in enumerate(last)}})

    kinds = dict(clean.dtypes)
    schema = "part int, only boolean, top bigint, opened bigint, " + ", ".join(f"k{i} {kinds[k]}" for i, k in enumerate(keys))
    carry: dict[int, tuple[tuple, int, int]] = {}
    reach: tuple[tuple, int, int] | None = None
    for part, only, top, opened, *key in sorted((tuple(r) for r in ordered.mapInPandas(summaries, schema).collect()), key=lambda r: r[0]):
        if reach:
            carry[part] = reach
        if reach and only and reach[0] == tuple(key):
            # starts are sorted: the last period opens here only if it starts after all that came before
            reach = (reach[0], max(top, reach[1]), opened if opened > reach[1] else reach[2])
        else:
            reach = (tuple(key), top, opened)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Gaps, and the parts of periods that lie in each batch, labelled with the period's start."""
        state: tuple[tuple, int, int] | None = None
        fresh = True
        for pdf in batches:
            if not len(pdf):
                continue
            if fresh:
                state, fresh = carry.get(int(pdf["__part"].iloc[0])), False
            new = _entity_change(pdf, keys)
            carried = state if state and _key(pdf[keys].iloc[0]) == state[0] else None
            reached, label, before, gap = _islands(pdf, new, carried)
            cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | new[1:]])
            out = pdf[keys].iloc[cut].copy()
            out["row_kind"], out["from_at"] = "period", label[cut]
            out["to_at"] = np.maximum.reduceat(pdf["__end"].to_numpy(np.int64), cut)
            out["n_rows"] = np.diff(np.r_[cut, len(pdf)])
            yield out
            if gap.any():
                g = pdf[keys][gap].copy()
                g["row_kind"], g["from_at"], g["to_at"], g["n_rows"] = "gap", before[gap], pdf["__start"].to_numpy()[gap], 0
                yield g
            state = (_key(pdf[keys].iloc[-1]), int(reached[-1]), int(label[-1]))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row_kind string, from_at bigint, to_at bigint, n_rows bigint"
    parts = ordered.mapInPandas(scan, schema)
    return parts.groupBy(*keys, "row_kind", "from_at").agg(F.max("to_at").alias("to_at"), F.sum("n_rows").alias("n_rows"))
