"""Shards by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text, and stays whole. Groups sorted by size, largest
first, each enter the open bin with the tightest remaining capacity that holds
them; a balanced tree of remaining capacities finds it. The capacity is the least,
in small steps, at which the wanted number of bins is enough; a group over a
shard's share has a bin to itself and the others share the rest.

Groups of one size are alike to the packing: a bin that takes one stays the
tightest until the next no longer fits. So the driver packs runs, and sees a size
and a number of groups for each distinct size of a group: different sizes add up
to all bytes, so there are at most the root of twice these. Which of a size's
groups goes into which of its bins follows from their running number by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.common import materialize

OVERHEAD, AT_ONCE, HEAVY = 16, 100_000, 1000


class Remaining:
    """A treap of (remaining capacity, bin): balanced by priorities that a hash of the key gives."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below key, the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Remaining._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = Remaining._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], Remaining._merge(a[3], b)
        return b[0], b[1], Remaining._merge(a, b[2]), b[3]

    def add(self, capacity: int, bin_: int) -> None:
        key = (capacity, bin_)
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, (key, (bin_ * 0x9E3779B1 + capacity * 0x85EBCA6B) & 0xFFFFFFFF, None, None)), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and gives the least capacity that is size or more, or None."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        low = b
        while low[2] is not None:
            low = low[2]
        _, rest = self._split(b, (low[0][0], low[0][1] + 1))
        self.root = self._merge(a, rest)
        return low[0]


def pack(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, number, bin) of runs(size, number) of groups in best-fit-decreasing order; a group over the capacity has a bin to itself. None if it takes over `most` bins."""
    free, bins, out = Remaining(), 0, []
    for size, n in sorted(runs, reverse=True):
        while n:
            at = free.take(size)
            if at is None:
                at, bins = (max(capacity, size), bins), bins + 1
                if most is not None and bins > most:
                    return None
            k = min(n, at[0] // size)
            out.append((size, k, at[1]))
            n -= k
            free.add(at[0] - k * size, at[1])
    return out


def pack_into(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """pack() at the least capacity, in steps that grow from a 4096th of the share, that needs no more bins than shards."""
    left, bins = sum(s * n for s, n in runs), shards
    for size, n in sorted(runs, reverse=True):  # those that have a bin to themselves
        for _ in range(n):
            if bins <= 1 or size * bins <= left:
                break
            left, bins = left - size, bins - 1
        else:
            continue
        break
    low = max(1, -(-left // bins))
    step, k = max(1, low // 4096), 0
    while (out := pack(runs, low + step * k * (k + 1) // 2, shards)) is None:
        k += 1
    return out


def _numbered(df: DataFrame, by: str, slice_: str, order: list[str], name: str) -> DataFrame:
    """df with a running number from 0 for each value of `by`, counted by slices."""
    before = Window.partitionBy(by).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(by, slice_).agg(F.count("*").alias("n")).select(by, slice_, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy(by, slice_).orderBy(*order)
    return df.withColumn("row", F.row_number().over(inner)).join(offsets, [by, slice_]).withColumn(name, F.col("before") + F.col("row") - 1).drop("before", "row", slice_)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of docs.

    A null text has no bytes and is in one group with empty texts. Repeated rows
    are rows of one group, each with its own slot. Ties in size are broken by the
    group's hash. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")))
    group = ["h", "text_crc32", "size"]
    groups = materialize(rows.groupBy(*group).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()  # a row for each distinct size
    total = sum(r.rows for r in sizes)
    stops: dict[int, list[int]] = {}
    into: dict[int, list[int]] = {}
    for size, n, bin_ in pack_into([(r.bytes, r.n) for r in sizes], shards) if sizes else []:
        of = stops.setdefault(size, [])
        of.append((of[-1] if of else 0) + n)
        into.setdefault(size, []).append(bin_)
    bins = docs.sparkSession.createDataFrame([(k, stops[k], into[k]) for k in stops], "bytes long, stops array<long>, bins array<int>")
    slices = 1 + max((r.n for r in sizes), default=0) // AT_ONCE
    numbered = _numbered(groups.withColumn("slice", F.pmod(F.xxhash64("h", "text_crc32"), F.lit(slices))), "bytes", "slice", group, "number")
    placed = materialize(numbered.join(bins, "bytes").select(*group, "rows", F.expr("element_at(bins, 1 + size(filter(stops, s -> s <= number)))").alias("shard")))
    # groups of a thousandth of all rows, a thousand at most, meet their rows in a broadcast
    heavy = F.col("rows") * HEAVY > total
    some = rows.join(F.broadcast(placed.filter(heavy).select(*group, F.col("shard").alias("its"))), group, "left")
    others = some.filter("its is null").drop("its").join(placed.filter(~heavy).select(*group, "shard"), group)
    cut = F.pmod(F.xxhash64("doc_id", "h", F.when(F.col("doc_id").isNull(), F.spark_partition_id())), F.lit(1 + total // AT_ONCE))
    every = materialize(some.filter("its is not null").withColumnRenamed("its", "shard").select(*rows.columns, "shard").unionByName(others.select(*rows.columns, "shard")).withColumn("part", cut))
    out = _numbered(every, "shard", "part", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
