"""Counts and look-ups for reports: peaks per window, run totals, markers, filter comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from .coverage import points_in_windows
from .neighbours import with_rank
from .signals import PIECE, in_pieces, per_segment


def clip_window(bounds: DataFrame, before: float, after: float) -> DataFrame:
    """``start_at, end_at``: the window around ``anchor`` inside ``lo`` and ``hi``."""
    return bounds.withColumns({"start_at": F.greatest(F.col("lo"), F.col("anchor") - before), "end_at": F.least(F.col("hi"), F.col("anchor") + after)})


def within(df: DataFrame, time: str, start: float, end: float) -> DataFrame:
    """Rows between two times, both included."""
    return df.where(F.col(time).between(start, end))


def window_peak_counts(windows: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window without counts, and one per valid period inside it with peaks and rate.

    ``windows``: keys, window_id, start_at, end_at; ``periods``: keys, period_no, start_at, end_at, n_inside (times in ms).
    """
    empty = F.lit(None).cast("bigint")
    over = windows.select(*keys, "window_id", F.lit("Overall Time Window").alias("what"), empty.alias("period_no"), "start_at", "end_at", empty.alias("n_peaks"))
    p = periods.select(*keys, "period_no", F.col("start_at").alias("__s"), F.col("end_at").alias("__e"), "n_inside")
    inside = points_in_windows(p, windows, keys, "__s").where(F.col("__e") <= F.col("end_at"))
    valid = inside.select(*keys, "window_id", F.lit("Valid Period").alias("what"), "period_no", F.col("__s").alias("start_at"), F.col("__e").alias("end_at"), F.col("n_inside").alias("n_peaks"))
    return over.unionByName(valid).withColumn("per_minute", F.try_divide(F.col("n_peaks") * 60_000.0, F.col("end_at") - F.col("start_at")))


def marker_values(markers: DataFrame, signal: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Signal values at the very times of markers; markers without a reading there are left out."""
    return markers.join(signal, [*keys, time])


def equal_counts(peaks: DataFrame, troughs: DataFrame, keys: list[str], time: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both lists cut to the shorter where a source has both; left as they are where it has one."""
    a, b = with_rank(peaks, keys, time, [], block, "__k", "__n"), with_rank(troughs, keys, time, [], block, "__k", "__n")
    na, nb = (x.select(*keys, F.col("__n").alias("__m")).distinct() for x in (a, b))
    cut = lambda x, other: x.join(other, keys, "left").where((F.col("__k") <= F.coalesce("__m", "__n"))).drop("__k", "__n", "__m")
    return cut(a, nb), cut(b, na)


def run_summary(segments: DataFrame, key: str, accepted: str, drift: str) -> DataFrame:
    """Accepted and rejected segments, windows seen, windows with drift, as one row."""
    return segments.agg(
        F.count_if(F.expr(accepted)).alias("n_accepted"), F.count_if(~F.expr(accepted)).alias("n_rejected"),
        F.count_distinct(key).alias("n_windows"), F.count_distinct(F.when(F.expr(drift), F.col(key))).alias("n_warned"),
    )


def lowpass_sweep(segments: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4), size: int = PIECE) -> DataFrame:
    """Low-pass filtered signal at several cut-offs (shares of the sampling rate), one column each; segments
    of fewer than 36 readings have no rows."""
    names = [f"low_{round(s * 100)}" for s in shares]

    def kernel(g: pd.DataFrame) -> pd.DataFrame | None:
        x, ms, own = g[value].to_numpy(float), g["ms"].to_numpy(np.int64), (g["__own"] == g["__piece"]).to_numpy()
        if g["__of"].iloc[0] < 36 or not own.any():
            return None
        return pd.DataFrame({"ms": ms, "raw": x, **{n: dsp.zero_phase(x, s, 1.0) for n, s in zip(names, shares)}})[own]

    reach = 2 * max(dsp.reach(s) for s in shares) + 36
    return per_segment(in_pieces(segments, keys, "ms", reach, size), keys, "ms", "ms bigint, raw double, " + ", ".join(f"{n} double" for n in names), kernel)


def label_lists(events: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The sorted different labels of each source; nulls are left out.  Labels are made different
    before they are listed, so a list is as long as the vocabulary, not as the source."""
    distinct = events.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    return distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(label)).alias("labels"))


def missing_columns(headers: DataFrame, keys: list[str], header: str, required: tuple[str, ...]) -> DataFrame:
    """A row for each required column that a header line, in any of its delimiters, doesn't name.

    Case, blanks and quotes don't matter; a null header names nothing.
    """
    names = F.transform(F.split(F.lower(F.coalesce(header, F.lit(""))), "[,;\\t]"), lambda x: F.regexp_replace(x, '^[\\s"\\uFEFF]+|[\\s"]+$', ""))
    return headers.select(*keys, F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), names)).alias("column_name"))
