"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import with_neighbour

#: Missing cells are made in runs of this many, so that no array grows with a gap.
RUN = 10_000


def _present(name: str):
    """The value as double, NaN and infinities as null."""
    x = F.col(name).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def explode_between(df: DataFrame, first: str, last: str, out: str) -> DataFrame:
    """One row for each whole number from ``first`` to ``last``; none where last < first."""
    runs = df.where(F.col(first) <= F.col(last)).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(last) - F.col(first)) / RUN)))
    )
    start = F.col(first) + F.col("__from") * RUN
    return runs.withColumn(out, F.explode(F.sequence(start, F.least(start + (RUN - 1), F.col(last))))).drop("__from")


def regular_grid(
    readings: DataFrame,
    keys: list[str],
    time: str,
    signals: list[str],
    step: float,
    max_fill_cells: int = 6,
    bounds: DataFrame | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """A regular series per source and signal.

    Returns ``keys, signal_name, cell_no, value, status``; cell ``n`` covers ``[n*step, (n+1)*step)``.
    ``status``: ``observed`` (value = mean of the cell's readings), ``filled`` (missing, linearly
    interpolated between the neighbouring observed cells, gap of at most ``max_fill_cells``),
    ``gap`` (missing, longer gap, value null), ``edge`` (between a bound and the first or last
    observed cell, value null).  ``bounds`` (keys, ``first_cell``, ``last_cell``; one row per key)
    extends the series to those cells; without it a series runs from its first to its last reading.
    ``sources`` (keys) restricts the work to those sources; it meets the cells, not the readings.

    Rows whose time or value is null, NaN or infinite are no readings; duplicates and order do not
    matter; a source without readings of a signal has no series unless bounded; null keys form
    one source; columns not named are ignored.
    """
    cell = F.floor(_present(time) / F.lit(float(step))).cast("bigint")
    wide = readings.select(*[F.col(k) for k in keys], cell.alias("cell_no"), *[_present(s).alias(s) for s in signals])
    some = F.coalesce(*[F.col(s) for s in signals]).isNotNull() & F.col("cell_no").isNotNull()
    wide = wide.where(some).groupBy(*keys, "cell_no").agg(*[F.avg(s).alias(s) for s in signals])
    if sources is not None:
        wide = wide.join(sources.select(*keys).distinct(), keys, "left_semi")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal_name"), F.col(s).alias("value")) for s in signals]))
    cells = wide.select(*keys, "cell_no", pairs.alias("__p")).select(*keys, "__p.signal_name", "cell_no", "__p.value").where("value is not null")
    id_ = [*keys, "signal_name"]
    cells = with_neighbour(cells, id_, "cell_no", ["cell_no", "value"], following=True)
    observed = cells.select(*id_, "cell_no", "value", F.lit("observed").alias("status"))
    gaps = cells.where(F.col("__near.cell_no") > F.col("cell_no") + 1).select(
        *id_,
        F.col("cell_no").alias("__a"),
        F.col("value").alias("__va"),
        F.col("__near.cell_no").alias("__b"),
        F.col("__near.value").alias("__vb"),
        (F.col("cell_no") + 1).alias("__first"),
        (F.col("__near.cell_no") - 1).alias("__last"),
    )
    missing = explode_between(gaps, "__first", "__last", "cell_no")
    share = (F.col("cell_no") - F.col("__a")) / (F.col("__b") - F.col("__a"))
    short = F.col("__b") - F.col("__a") - 1 <= max_fill_cells
    missing = missing.select(
        *id_,
        "cell_no",
        F.when(short, F.col("__va") + (F.col("__vb") - F.col("__va")) * share).alias("value"),
        F.when(short, "filled").otherwise("gap").alias("status"),
    )
    series = observed.unionByName(missing)
    if bounds is None:
        return series
    span = cells.groupBy(*id_).agg(F.min("cell_no").alias("__lo"), F.max("cell_no").alias("__hi"))
    limits = bounds.select(*keys, F.col("first_cell").cast("bigint").alias("__f"), F.col("last_cell").cast("bigint").alias("__l"))
    limits = limits.withColumn("signal_name", F.explode(F.array(*[F.lit(s) for s in signals])))
    edge = limits.join(span, id_, "left")
    sides = F.explode(
        F.array(
            F.struct(F.col("__f").alias("a"), F.coalesce(F.col("__lo") - 1, F.col("__l")).alias("b")),
            F.struct((F.col("__hi") + 1).alias("a"), F.col("__l").alias("b")),
        )
    )
    edge = edge.select(*id_, sides.alias("__s")).select(*id_, F.col("__s.a").alias("__first"), F.col("__s.b").alias("__last"))
    edge = explode_between(edge, "__first", "__last", "cell_no")
    return series.unionByName(edge.select(*id_, "cell_no", F.lit(None).cast("double").alias("value"), F.lit("edge").alias("status")))
