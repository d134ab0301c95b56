"""Sharding by a minimax contiguous partition (operator 3), in DataFrame operations only.

Equal texts form an atomic group, and groups stand in the order of their text's
SHA-256.  Shards are consecutive groups, cut so that the largest shard is as
small as any cut allows: the smallest capacity is searched by halving, and a
capacity is feasible if filling shard after shard up to it needs no more than
the given number of shards.

The sizes summed up to each group are computed in two steps (sums of 4,096 ranges
of the hash, then within a range), so no task holds all groups.  Filling only asks
for the last group that ends at or before a point.  The driver answers from a
summary: of up to ``_STRETCHES`` stretches the first and last end.  Where that
leaves the answer open, the capacity is bounded from both sides, and the parts in
question (at most one per shard) are summarised anew by as many stretches, until
both bounds and both fillings agree.  The parts shrink by the stretches per shard
squared or so, so a few rounds do.  The result is exact; the driver holds some
ten thousand numbers, whatever the number of groups.

A null text counts as an empty one.  Rows that repeat are rows of one group.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import written

_RANGES, _STRETCHES, _CELLS = 4096, 1 << 15, 256
OVERHEAD = 16


class _Summary:
    """Known ends of groups: sorted stretches (first, last) with nothing known between."""

    def __init__(self, stretches: list[tuple[int, int]], total: int):
        self.total = total
        self.put(stretches)

    def put(self, stretches: list[tuple[int, int]]) -> None:
        self.stretches = sorted(stretches)
        self.first = [a for a, _ in self.stretches]

    def last_end(self, x: int) -> tuple[int, int]:
        """Bounds of the last end at or before x (0 is one)."""
        i = bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        a, b = self.stretches[i]
        return (b, b) if b <= x else (a, a if a == b else min(x, b - 1))

    def fill(self, capacity: int, shards: int, high: bool) -> list[int] | None:
        """Ends of the shards when filled up to ``capacity``, by the lower or higher bounds."""
        at, ends = 0, []
        while at < self.total:
            if len(ends) == shards:
                return None
            to = self.last_end(at + capacity)[high]
            if to <= at:
                return None
            ends.append(to)
            at = to
        return ends

    def least(self, low: int, shards: int, high: bool) -> int:
        a, b = low, max(low, self.total)
        while a < b:
            m = (a + b) // 2
            if self.fill(m, shards, high) is None:
                a = m + 1
            else:
                b = m
        return a


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """Where the shards end, on the line of summed sizes; ``groups`` has ``bytes`` and ``end``."""
    total, largest = groups.agg(F.max("end"), F.max("bytes")).first()
    if total is None:
        return []
    low = max(largest, -(-total // shards))

    def summary(width: int, where: Column | None = None) -> list[tuple[int, int]]:
        part = groups if where is None else groups.where(where)
        return [(r[1], r[2]) for r in part.groupBy(F.floor(F.col("end") / F.lit(width))).agg(F.min("end"), F.max("end")).collect()]

    known = _Summary(summary(total // _STRETCHES + 1), total)
    while True:
        sure, hope = known.least(low, shards, False), known.least(low, shards, True)
        slow, fast = known.fill(hope, shards, False), known.fill(sure, shards, True)
        if sure == hope and slow == fast:
            return fast
        # every point that a filling with a capacity between the bounds may ask for, and the open stretches there
        asked: list[list[int]] = []
        a = b = 0
        for _ in range(shards):
            x, y = a + hope, b + sure
            a, b = known.last_end(x)[0], known.last_end(y)[1]
            inside = [s for s in known.stretches if s[0] < s[1] and x < s[1] and s[0] <= y]
            if inside and asked and inside[0][0] <= asked[-1][1]:
                asked[-1][1] = max(asked[-1][1], inside[-1][1])
            elif inside:
                asked.append([inside[0][0], inside[-1][1]])
        width = sum(q - p for p, q in asked) // _STRETCHES + 1
        where = functools.reduce(lambda u, v: u | v, [F.col("end").between(p, q) for p, q in asked])
        known.put([s for s in known.stretches if not any(p <= s[0] and s[1] <= q for p, q in asked)] + summary(width, where))


def sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row; slots count from 0 in each shard."""
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), (F.octet_length(plain) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(plain).alias("text_crc32"), F.unhex(F.sha2(plain, 256)).alias("hash"))
    range_ = F.conv(F.substring(F.hex("hash"), 1, 3), 16, 10).cast("int")
    groups = written(rows.groupBy("hash").agg(F.sum("size").alias("bytes")).withColumn("range", range_))
    before = groups.groupBy("range").agg(F.sum("bytes").alias("sum")).select(
        "range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))  # 4,096 rows at most
    ends = written(groups.join(F.broadcast(before), "range").select("hash", "bytes", (
        F.col("before") + F.sum("bytes").over(Window.partitionBy("range").orderBy("hash"))).alias("end")))
    at = cuts(ends, shards)
    shard = sum(((F.col("end") > c).cast("int") for c in at[:-1]), F.lit(0))
    placed = written(rows.join(ends.select("hash", shard.alias("shard")), "hash").select(
        "id", "size", "text_crc32", "hash", "shard", F.pmod(F.xxhash64("id", "hash"), F.lit(_CELLS)).alias("cell")))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows")).select(
        "shard", "cell", (F.sum("rows").over(Window.partitionBy("shard").orderBy("cell")) - F.col("rows")).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "hash"))
    return placed.join(F.broadcast(cells), ["shard", "cell"]).select(  # 256 rows a shard at most
        "id", "size", "text_crc32", "shard", (F.col("first") + number - 1).alias("slot"))
