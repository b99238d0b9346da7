"""Sharding by minimax contiguous partition: shards of nearly equal bytes that never split a group.

Groups (here: equal texts) stand in the order of their smallest id and are cut into contiguous shards so
that the largest shard is as small as possible. A capacity is feasible if filling shards greedily in order
needs no more than the wanted number; the smallest feasible one is found by bisection, and the cuts are
those of its greedy filling.

The driver never holds all groups. They are sorted in ranges, which gives each its rank; sums over runs of
ranks bound where each shard can end for a given capacity. Only where that leaves a check of a capacity
undecided are the runs at those ends summed in finer runs, down to single groups. Runs that one check has
split stay split for the next, so few are looked into. The answer is exact, and a group of a third of all
rows is one item like any other.

Rows are numbered within their shards by another sort in ranges, with ties broken by the place of the row, so
neither equal nor outlying ids gather in one task.

Null texts count as empty. Groups without any id come first, in the order of a digest of the text, which also
orders groups with equal smallest ids. An empty table gives an empty result. Columns other than the id and the
text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small

#: Runs whose sums the driver asks for at once, and single groups near the cuts that it asks for at once.
RANGES, NEAR = 2048, 50_000


def fill(sums: Sequence[int], shards: int, capacity: int) -> list[int] | None:
    """How many items are behind each shard if items with these running sums fit into so many, else None."""
    ends, start = [], 0
    for _ in range(shards):
        ends.append(bisect_right(sums, start + capacity))
        if ends[-1] == len(sums):
            return ends
        start = sums[ends[-1] - 1] if ends[-1] else 0
    return None


def bisect(low: int, high: int, feasible: Callable[[int], bool]) -> int:
    """The smallest feasible capacity in low..high; high is feasible."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def _sums(sizes: Sequence[int]) -> list[int]:
    out: list[int] = []
    for s in sizes:
        out.append(s + (out[-1] if out else 0))
    return out


def smallest_capacity(sizes: Sequence[int], shards: int) -> int:
    """The least capacity for which greedy filling of ordered atomic sizes needs at most so many shards."""
    if not sizes:
        return 0
    sums = _sums(sizes)
    return bisect(max(-(-sums[-1] // shards), *sizes, 0), sums[-1], lambda c: fill(sums, shards, c) is not None)


class Run(NamedTuple):
    """Groups of consecutive ranks: the first rank, how many, and their sum. width: a power of two that divides the first."""

    at: int
    n: int
    size: int
    width: int


class Runs:
    """What the driver knows of the ordered groups: sums over runs, split where a question needs it."""

    def __init__(self, placed: DataFrame, groups: int, ranges: int, near: int):
        self.placed, self.ranges, self.near = placed, ranges, near
        width = 1 << (-(-groups // ranges) - 1).bit_length()
        self.items = self._read(placed, width)

    @staticmethod
    def _read(rows: DataFrame, width: int) -> list[Run]:
        """The runs of this width; callers bound their number."""
        of = rows.groupBy(F.expr(f"at div {width}L").alias("run")).agg(F.min("at").alias("at"), F.count("*").alias("n"), F.sum("size").alias("size"))
        return sorted(Run(r["at"], r["n"], r["size"], width) for r in of.collect())

    def split(self, which: set[int]) -> None:
        """Replace these items by finer runs, by single groups if they are few."""
        groups = sum(self.items[i].n for i in which)
        share = 1 << max(1, (self.ranges // len(which)).bit_length() - 1)
        made = [x for i, x in enumerate(self.items) if i not in which]
        for width in {self.items[i].width for i in which}:
            own = [self.items[i].at // width for i in which if self.items[i].width == width]
            rows = self.placed.filter(F.col("at").between(min(own) * width, (max(own) + 1) * width - 1) & F.expr(f"at div {width}L").isin(own))
            made += self._read(rows, 1 if groups <= self.near else max(1, width // share))
        self.items = sorted(made)

    def ends(self, shards: int, capacity: int, exact: bool = False) -> list[int] | None:
        """Ranks behind each shard (rough ones unless exact) if shards of this capacity hold all groups, else None.

        low and high bound the end of a shard: filling whole runs from the least possible start ends no later than
        filling groups, and no shard ends beyond the greatest possible start and the capacity.
        """
        while True:
            sums = _sums([x.size for x in self.items])
            total, low, high, out, doubt = sums[-1], 0, 0, [], []
            for _ in range(shards):
                i, j = bisect_right(sums, low + capacity), bisect_right(sums, high + capacity)
                low = sums[i - 1] if i else 0
                inside = j < len(sums) and self.items[j].n > 1
                high = high + capacity if inside else sums[j - 1] if j else 0
                doubt.append([x for x in range(i, min(j, len(sums) - 1) + 1) if self.items[x].n > 1])
                out.append(self.items[i].at if i < len(sums) else self.items[-1].at + self.items[-1].n)
                if low == total:
                    break
            if high < total:
                return None
            if low == total and not (exact and any(doubt)):
                return out
            every = {x for d in doubt for x in d}
            self.split(every if len(every) <= self.ranges // 2 else set(next(d for d in doubt if d)[: self.ranges // 2]))


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """df, stored, with its rank from 0 by these columns in the column at. A sort in ranges; the offset of each range is
    the sum of the counts before it."""
    order = df.repartitionByRange(*by).sortWithinPartitions(*by)
    order = order.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    order = materialise(order, "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = order.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))  # a row a range
    return order.join(F.broadcast(offset), "_part").withColumn("at", F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def cuts(groups: DataFrame, shards: int, ranges: int = RANGES, near: int = NEAR, order: Sequence[str] = ("key",)) -> list[tuple]:
    """The order columns of the last group of each shard but the last; fewer if groups run out.

    groups: the order columns (together unique), size long.
    """
    placed = materialise(ranked(groups, *order), "ranked-groups")
    n, total, largest = placed.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    if not n:
        return []
    runs = Runs(placed, n, ranges, near)
    capacity = bisect(max(-(-total // shards), largest), total, lambda c: runs.ends(shards, c) is not None)
    last = [e - 1 for e in runs.ends(shards, capacity, exact=True) if e < n]
    rows = placed.filter(F.col("at").isin(last)).select("at", *order).collect()  # less than `shards`
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["at"])]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, near: int = NEAR) -> DataFrame:
    """id, size (bytes and 1), text_crc32, group_key (smallest id of the group), shard, slot (gapless from 0 in each shard).

    The texts are read once, into a narrow table; after that only ids, sizes and digests move. Slots follow the ids.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(
        F.col(id_col).alias("id"),
        F.col(id_col).cast("long").alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    row = materialise(row, "shard-rows")
    order = ("named", "first", "digest")
    alike = row.groupBy("digest").agg(F.min("key").alias("key"), F.sum("size").alias("size"), F.count("*").alias("n"))
    alike = alike.select("digest", F.col("key").isNotNull().alias("named"), F.coalesce("key", F.lit(0)).alias("first"), "size", "n")
    alike = materialise(alike, "shard-groups")
    ends = cuts(alike.select(*order, "size"), shards, ranges, near, order)
    copies = alike.filter("n > 1").select("digest", "named", "first")
    row = row.join(small(copies, 100_000), "digest", "left")
    row = row.withColumn("named", F.coalesce("named", F.col("key").isNotNull())).withColumn("first", F.coalesce("first", "key", F.lit(0)))
    group = F.struct(*order)
    ends_of = F.array(*(F.struct(F.lit(named).alias("named"), F.lit(first).cast("long").alias("first"), F.lit(bytes(digest)).alias("digest")) for named, first, digest in ends))
    row = row.withColumn("shard", F.size(F.filter(ends_of, lambda e: e < group)) if ends else F.lit(0))
    row = row.select("id", "key", "size", "crc", F.when(F.col("named"), F.col("first")).alias("group_key"), "shard", "tie")
    out = ranked(row, "shard", "key", "tie")
    first = out.groupBy("shard").agg(F.min("at").alias("_first"))
    out = out.join(F.broadcast(first), "shard")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "group_key", F.col("shard").cast("int").alias("shard"), (F.col("at") - F.col("_first")).alias("slot"))
