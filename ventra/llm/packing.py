"""Items into containers of fixed capacity: sum-of-squares packing, shard by shard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import whole_groups

SHARD = 20_000  # documents that one task packs for one capacity


class Levels:
    """Open containers by fill level; each item goes where the sum of squared counts grows least."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> int:
        """Container for an item of 1 to ``capacity``; ties go to the fullest container."""
        top = self.capacity - size
        n = self.count
        if top == 0:
            return self.new()
        levels = np.flatnonzero(n[: top + 1])
        best, at = 2 * int(n[size]) + 1, 0  # a new container
        if len(levels):
            change = 2 - 2 * n[levels] + 2 * n[levels + size]
            if levels[-1] == top:  # a full container is no longer counted
                change[-1] = 1 - 2 * n[top]
            k = len(change) - 1 - int(change[::-1].argmin())
            if change[k] <= best:
                at = int(levels[k])
        if at:
            box = self.open[at].pop()
            n[at] -= 1
        else:
            box = self.new()
        if at + size < self.capacity:
            n[at + size] += 1
            self.open.setdefault(at + size, []).append(box)
        return box

    def joined(self) -> dict[int, int]:
        """At the end: half-empty containers whose contents fit together, by the one they join."""
        left = sorted(((level, b) for level, boxes in self.open.items() for b in boxes), reverse=True)
        into: dict[int, int] = {}
        room: list[tuple[int, int]] = []  # free space and container, least space first
        from bisect import bisect_left, insort

        for level, box in left:
            k = bisect_left(room, (level, -1))
            if k < len(room):
                free, host = room.pop(k)
                into[box] = host
                if free > level:
                    insort(room, (free - level, host))
            else:
                insort(room, (self.capacity - level, box))
        return into


def pack(sizes: DataFrame, packs: DataFrame, n_items: int, shard: int = SHARD) -> DataFrame:
    """Pieces of items (``doc_id, n_tokens``) in containers of each capacity of ``packs``
    (``pack_name, capacity_tokens``; a small table, read to the driver).

    Returns ``pack_name, capacity_tokens, shard, container_no, doc_id, piece_no, token_from, n_tokens``; a
    container is (pack_name, shard, container_no).  An item larger than the capacity fills whole
    containers and leaves its rest as an item; no other is split.  Items are packed in the order of
    a hash of their id, online, by the sum-of-squares rule; containers left half empty at the end
    of a shard are joined where they fit.

    Items of no size have one row with null container; null sizes count as none; repeated rows
    are packed each; packs with a null or no capacity are left out; no items give no rows.  Only ids
    and sizes are shuffled, to tasks of about ``shard`` items (``n_items`` tells how many there are), and
    no task holds more, whatever the source of the items.
    """
    shards = max(1, math.ceil(n_items / shard))
    sized = [(r.pack_name, int(r.capacity_tokens)) for r in packs.select("pack_name", "capacity_tokens").distinct().limit(1001).collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if len(sized) > 1000:
        raise ValueError("more than 1000 capacities")
    options = F.array(*[F.struct(F.lit(p).alias("pack_name"), F.lit(c).alias("capacity_tokens")) for p, c in sorted(sized, key=str)]) if sized else None
    items = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.xxhash64("doc_id").alias("__order"))
    items = items.withColumn("shard", F.pmod("__order", F.lit(shards)).cast("int"))
    items = items.withColumn("p", F.explode(options)) if sized else items.limit(0).withColumn("p", F.lit(None).cast("struct<pack_name:string,capacity_tokens:int>"))
    items = items.select("p.*", "shard", "__order", "doc_id", "n_tokens")
    ids = ["pack_name", "capacity_tokens", "shard"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ids):
            capacity = int(group["capacity_tokens"].iloc[0])
            levels = Levels(capacity)
            doc, no, piece, start, size = [], [], [], [], []
            for d, n in zip(group["doc_id"].tolist(), group["n_tokens"].tolist()):
                whole, rest = divmod(n, capacity)
                boxes = [levels.new() for _ in range(whole)]
                if rest:
                    boxes.append(levels.place(rest))
                if not boxes:
                    boxes = [None]
                doc += [d] * len(boxes)
                no += boxes
                piece += range(len(boxes))
                start += [k * capacity for k in range(len(boxes))]
                size += [capacity] * whole + ([rest] if rest or not whole else [])
            into = levels.joined()
            out = pd.DataFrame({"doc_id": doc, "piece_no": piece, "token_from": start, "n_tokens": size})
            out["container_no"] = pd.array([into.get(b, b) for b in no], dtype="Int64")
            for c in ids:
                out[c] = group[c].iloc[0]
            yield out[[*ids, "container_no", "doc_id", "piece_no", "token_from", "n_tokens"]]

    schema = "pack_name string, capacity_tokens int, shard int, container_no bigint, doc_id bigint, piece_no int, token_from bigint, n_tokens bigint"
    return items.repartition(*ids).sortWithinPartitions(*ids, "__order", "doc_id").mapInPandas(fill, schema)


def fill_report(pieces: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of space used."""
    boxes = pieces.where("container_no is not null").groupBy("pack_name", "capacity_tokens", "shard", "container_no").agg(F.sum("n_tokens").alias("n"))
    return boxes.groupBy("pack_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), (F.sum("n") / F.sum("capacity_tokens")).alias("fill")
    )
