"""Previous/next row per key without gathering a key in one task.

A plain ``lag`` sorts everything a key holds in one task.  Here the order axis is cut into
blocks: the window runs per (key, block), and the rows at block edges get their neighbour
from a window over one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_neighbours(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = 4096, prev: bool = True, next: bool = True) -> DataFrame:
    """Adds structs ``__prev`` and ``__next`` with ``cols`` of the rows before and after, of the same keys.

    ``order`` is a whole-number column without nulls and unique per key.  The first (last) row of a
    key gets null.  Null keys form one group.
    """
    pick: Column = F.struct(*[F.col(c) for c in cols])
    blocked = df.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    inner, across = Window.partitionBy(*keys, "__block").orderBy(order), Window.partitionBy(*keys).orderBy("__block")
    edges = blocked.groupBy(*keys, "__block").agg(F.min_by(pick, F.col(order)).alias("__first"), F.max_by(pick, F.col(order)).alias("__last"))
    edges = edges.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after")
    )
    rows = blocked.withColumns({"__prev": F.lag(pick).over(inner), "__next": F.lead(pick).over(inner)})
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(edges, same, "left").withColumns({"__prev": F.coalesce("__prev", "__before"), "__next": F.coalesce("__next", "__after")})
    drop = ["__block", "__b", "__before", "__after", *[f"__k{i}" for i in range(len(keys))]]
    return joined.drop(*drop, *([] if prev else ["__prev"]), *([] if next else ["__next"]))


def with_neighbour(df: DataFrame, keys: list[str], order: str, cols: list[str], block: int = 4096, following: bool = False) -> DataFrame:
    """As above, one side only, as ``__near``."""
    return with_neighbours(df, keys, order, cols, block, not following, following).withColumnRenamed("__next" if following else "__prev", "__near")


def with_rank(df: DataFrame, keys: list[str], order: str, then: list[str], block: int = 4096, out: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the 1-based place of each row among those of its keys by ``order`` (a whole number, nulls last) and ``then``.

    Rows are ranked within blocks of the order axis, and blocks are offset by the counts of those
    before them, so no task sorts a whole key.  ``total`` names a column for the number of rows.
    """
    top = F.lit(2**62)
    blocked = df.withColumn("__block", F.coalesce(F.floor(F.col(order) / F.lit(block)), top))
    inner = Window.partitionBy(*keys, "__block").orderBy(F.col(order).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in then])
    counts = blocked.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    counts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__off", "__all")
    same = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ranked = blocked.withColumn("__r", F.row_number().over(inner)).join(counts, same)
    ranked = ranked.withColumn(out, (F.col("__r") + F.col("__off")).cast("bigint"))
    if total:
        ranked = ranked.withColumn(total, F.col("__all").cast("bigint"))
    return ranked.drop("__block", "__b", "__r", "__off", "__all", *[f"__k{i}" for i in range(len(keys))])


def beside(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows joined to the one row of ``table`` with the same keys, nulls included; the columns of ``table`` follow."""
    renamed = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(keys))])
