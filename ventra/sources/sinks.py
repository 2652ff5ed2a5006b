"""Result tables to folders, with the run's settings beside them."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet", by: dict[str, list[str]] | None = None) -> list[str]:
    """One directory per table, header kept where a CSV table is empty; ``by`` partitions a table."""
    out = []
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if by and name in by:
            writer = writer.partitionBy(*by[name])
        path = f"{folder}/{name}"
        writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)
        out.append(path)
    return out


def write_run(spark: SparkSession, folder: str, status: str, settings: dict) -> None:
    """The run's record as one JSON line, rewritten at each state."""
    record = json.dumps({"status": status, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **settings}, default=str)
    spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run")


def window_key(start: str, end: str) -> Column:
    """Name of a window for files and sheets: its ends in seconds to the millisecond, ``start_end``; times are whole milliseconds."""
    seconds = lambda c: (F.col(c) / F.lit(1000).cast("decimal(18,0)")).cast("decimal(18,3)").cast("string")
    return F.concat_ws("_", seconds(start), seconds(end))


def write_per_window(df: DataFrame, folder: str, key: str = "window_key") -> None:
    """One CSV folder per window, with a header; a window without rows writes nothing."""
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(folder)


def export_periods(per_period: DataFrame, per_bin: DataFrame, keys: list[str]) -> DataFrame:
    """Periods as exported: those without a bin are left out."""
    return per_period.join(per_bin.select(*keys).distinct(), keys, "left_semi")


def with_separators(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A row of nulls after each group, for people who read the sheet; ``__row`` gives the order in a group."""
    blank = df.select(*keys).distinct().select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes], *[F.col(k).alias(f"__{k}") for k in keys], F.lit(1).alias("__blank"))
    rows = df.select(*df.columns, *[F.col(k).alias(f"__{k}") for k in keys], F.lit(0).alias("__blank"))
    return rows.unionByName(blank).orderBy(*[f"__{k}" for k in keys], "__blank", *order).drop("__blank", *[f"__{k}" for k in keys])
