"""Nearest and interpolated readings at given times, without sorting a source in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(targets: DataFrame, source: DataFrame, keys: list[str], time: str, value: str, block: int) -> DataFrame:
    """For each target row the source readings at or before it and at or after it.

    Returns the target's columns with structs ``left`` and ``right`` (``t, v``), null where there is none.
    ``time`` is a whole number in both; ``block`` is the width of the pieces of the time axis that
    are sorted on their own.  What reaches a piece from outside comes from one summary row per piece.
    Source rows with a null time or value are no readings; of several at one time the largest value
    counts; targets with a null time have no neighbours; null keys match each other.
    """
    t = F.col(time)
    read = F.struct(t.alias("t"), F.col(value).cast("double").alias("v"))
    src = source.where(t.isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    src = src.groupBy(*keys, time).agg(F.max(value).alias(value))
    src = src.select(*keys, t.alias("__t"), read.alias("__s"), F.lit(None).cast(_struct_type(targets)).alias("__row"))
    tgt = targets.select(*keys, t.alias("__t"), F.lit(None).cast(src.schema["__s"].dataType).alias("__s"), F.struct(*targets.columns).alias("__row"))
    both = src.unionByName(tgt).withColumn("__b", F.floor(F.col("__t") / block))
    part = Window.partitionBy(*keys, "__b")
    # at one time a reading comes first in either direction, so that an exact hit is its own neighbour
    reading_first = F.col("__s").isNull().cast("int")
    asc = part.orderBy("__t", reading_first).rowsBetween(Window.unboundedPreceding, 0)
    desc = part.orderBy(F.col("__t").desc(), reading_first).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"left": F.last("__s", True).over(asc), "right": F.last("__s", True).over(desc)})
    edge = both.groupBy(*keys, "__b").agg(F.max("__s").alias("__last"), F.min("__s").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(*keys, "__b", F.last("__last", True).over(before).alias("__l"), F.last("__first", True).over(after).alias("__r"))
    cond = F.col("x.__b").eqNullSafe(F.col("e.__b"))
    for k in keys:
        cond = cond & F.col(f"x.{k}").eqNullSafe(F.col(f"e.{k}"))
    rows = both.where("__row is not null").alias("x").join(edge.alias("e"), cond, "left")
    known = F.col("x.__t").isNotNull()
    return rows.select(
        "x.__row.*", F.when(known, F.coalesce("x.left", "e.__l")).alias("left"), F.when(known, F.coalesce("x.right", "e.__r")).alias("right")
    )


def _struct_type(df: DataFrame):
    return df.schema


def interpolated(time: str) -> Column:
    """Linear value between ``left`` and ``right``; null outside the readings, the reading itself on a hit."""
    span = (F.col("right.t") - F.col("left.t")).cast("double")
    share = (F.col(time) - F.col("left.t")) / span
    line = F.col("left.v") + (F.col("right.v") - F.col("left.v")) * share
    return F.when(F.col("left").isNull() | F.col("right").isNull(), None).when(span == 0, F.col("left.v")).otherwise(line)


def nearest(time: str) -> Column:
    """Value of the nearer of ``left`` and ``right``, the left on a tie; the end readings beyond the ends."""
    to_left, to_right = F.col(time) - F.col("left.t"), F.col("right.t") - F.col(time)
    return F.when(F.col("left").isNull(), F.col("right.v")).when(F.col("right").isNull() | (to_left <= to_right), F.col("left.v")).otherwise(F.col("right.v"))
