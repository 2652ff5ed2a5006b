"""Sources mixed to target weights by pivotal rounding and a reduction tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import whole_groups
from ..session import durable

SHARD = 8_192  # documents whose fractions one task settles among themselves
FAN = 256  # residuals that meet in one group of the next level


def amounts(held: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens each source is to give: its share of ``total``, at most its tokens times its repeats.

    What sources can't give is spread over those that can give more, in proportion to their shares.
    """
    cap = {s: held.get(s, 0) * repeats for s, (_, repeats) in targets.items()}
    give = {s: 0.0 for s in targets}
    free = {s for s, (w, _) in targets.items() if cap[s] > 0 and w > 0}
    rest = total
    while free:
        weight = sum(targets[s][0] for s in free)
        over = {s for s in free if targets[s][0] / weight * rest >= cap[s]}
        if not over:
            give.update({s: targets[s][0] / weight * rest for s in free})
            break
        for s in over:
            give[s] = float(cap[s])
            rest -= cap[s]
        free -= over
        if rest <= 0:
            break
    return give


def pivot(sizes: list[int], shares: list[float], draws: np.ndarray) -> tuple[list[int], tuple[int, float] | None]:
    """Ones and zeros for fractions: pairs pass mass (share times size) on until one is whole.

    The sum of share times size does not change, and each keeps its expectation.  Returns the whole
    values (-1 for the one left) and the index and share of that one, if any.  With sizes in falling
    order the pairs are of like size, and so the one left is small.
    """
    out = [-1] * len(sizes)
    at, p = -1, 0.0
    for j, (s, q) in enumerate(zip(sizes, shares)):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[j] = int(q > 0.5)
            continue
        if at < 0:
            at, p = j, q
            continue
        r = sizes[at]
        up, down = min((1 - p) * r, q * s), min(p * r, (1 - q) * s)  # mass to the first, mass from it
        if draws[j] * (up + down) < down:
            p, q = p + up / r, q - up / s
        else:
            p, q = p - down / r, q + down / s
        first, second = (x <= 1e-9 or x >= 1 - 1e-9 for x in (p, q))
        if first:
            out[at] = int(p > 0.5)
        if second:
            out[j] = int(q > 0.5)
        if first and second:
            at = -1
        elif first:
            at, p = j, q
    return out, ((at, p) if at >= 0 else None)


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 0, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Copies of each document so that each source has its target share of all tokens.

    ``sizes``: ``doc_id, source, n_tokens``; ``targets``: ``source, target_share, max_repeats`` (a small table of
    sources, read to the driver with one sum per source).  ``total_tokens`` defaults to the tokens of the
    listed sources.  Returns (``doc_id, source, n_tokens, copies``, one row for each row of a listed source) and the
    report (``source, target_share, reached_share, target_tokens, reached_tokens, held_tokens, n_documents, n_used,
    max_copies, max_repeats, short``).

    Every document of a source gets the whole part of the source's repeats; the fractions are rounded
    by pivotal pairing within shards of about ``shard`` documents, from the largest to the smallest, and
    the one fraction each shard leaves goes up a tree, ``FAN`` to a group, so a source of any size is
    spread.  The last fraction of a source is drawn by its own share.  So every document is used as often
    as its fraction says in the mean over seeds, and the amount is met within one document, as a rule
    a small one.  No document is used more than ``max_repeats`` times.

    Rows with null or unlisted sources are not mixed; documents without tokens have 0 copies; repeated
    rows are used each; null shares or repeats count as 0; a source without documents, or with too
    few, is short, and the others make up for it in proportion.
    """
    spark = sizes.sparkSession
    goals = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.limit(10_001).collect() if r.source is not None}
    if len(goals) > 10_000:
        raise ValueError("more than 10,000 sources")
    listed = spark.createDataFrame([(s,) for s in goals], "source string")
    rows = sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = durable(rows.join(F.broadcast(listed), "source", "left_semi"))
    sums = {r.source: (r.t, r.n) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    held = {s: t for s, (t, _) in sums.items()}
    total = float(total_tokens if total_tokens is not None else sum(held.values()))
    give = amounts(held, goals, total)
    plan = []
    for s, (share, repeats) in goals.items():
        per = give[s] / held[s] if held.get(s) else 0.0
        base = min(int(per + 1e-9), repeats)
        n = sums.get(s, (0, 0))[1]
        plan.append((s, base, max(0.0, per - base) if base < repeats else 0.0, max(1, math.ceil(n / shard))))
    plans = F.broadcast(spark.createDataFrame(plan, "source string, base int, frac double, shards int"))
    work = rows.join(plans, "source").withColumn("__order", F.xxhash64(F.lit(seed), "doc_id", "n_tokens"))
    work = work.withColumn("node", F.pmod("__order", "shards").cast("bigint"))
    work = work.withColumn("frac", F.when(F.col("n_tokens") > 0, F.col("frac")).otherwise(0.0))
    work = work.withColumn("base", F.when(F.col("n_tokens") > 0, F.col("base")).otherwise(0))
    cols = ["doc_id", "source", "n_tokens", "base", "frac", "__order", "node"]
    schema = "doc_id bigint, source string, n_tokens bigint, base int, frac double, `__order` bigint, node bigint, copies int"

    def settled(g: pd.DataFrame, root: bool) -> pd.DataFrame:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, abs(int(g["__order"].iloc[0])), len(g)])
        ones, left = pivot(g["n_tokens"].tolist(), g["frac"].tolist(), rng.random(len(g)))
        out = g[cols].copy()
        if left and root:
            ones[left[0]] = int(rng.random() < left[1])
        elif left:
            out.iloc[left[0], cols.index("frac")] = left[1]
        out["copies"] = pd.array([b + o if o >= 0 else None for b, o in zip(g["base"], ones)], dtype="Int32")
        return out

    def level(df: DataFrame, root: bool) -> DataFrame:
        def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in whole_groups(batches, ["source", "node"]):
                yield settled(g, root)

        ordered = df.select(*cols).repartition("source", "node").sortWithinPartitions("source", "node", F.col("n_tokens").desc(), "__order", "doc_id")
        return durable(ordered.mapInPandas(settle, schema))

    # leaves, then FAN of their residuals to a group, up to one group a source
    parts: list[DataFrame] = []
    pending, nodes = work, max((p[3] for p in plan), default=1)
    while True:
        done = level(pending, root=nodes == 1)
        parts.append(done.where("copies is not null"))
        if nodes == 1:
            break
        nodes = math.ceil(nodes / FAN)
        pending = done.where("copies is null").withColumn("node", F.floor(F.col("node") / FAN))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = chosen.select("doc_id", "source", "n_tokens", "copies")

    used = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("n_tokens").alias("held_tokens"), F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("copies") > 0).alias("n_used"), F.max("copies").alias("max_copies"),
    )
    goal_rows = [(s, w, r, w * total, bool(give[s] < w * total - 1)) for s, (w, r) in goals.items()]
    report = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, target_tokens double, short boolean").join(used, "source", "left")
    everything = used.agg(F.sum("reached_tokens").alias("__all"))
    report = report.join(F.broadcast(everything), how="left", on=F.lit(True))
    nil = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = report.select(
        "source", "target_share", F.coalesce(F.col("reached_tokens") / F.nullif("__all", F.lit(0)), F.lit(0.0)).alias("reached_share"), "target_tokens",
        nil("reached_tokens"), nil("held_tokens"), nil("n_documents"), nil("n_used"), nil("max_copies"), "max_repeats", "short",
    )
    return chosen, report
