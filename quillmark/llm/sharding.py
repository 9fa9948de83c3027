"""Sharding by best-fit-decreasing bin packing.

Groups (equal texts) are indivisible. They are taken from the largest to the
smallest, and each enters the bin with the tightest remaining capacity that
holds it; the bin is found in a balanced tree over remaining capacities.
`fixed_bins` looks for a capacity, least but for a share of TOLERANCE, that needs no more than
a given number of bins, so that bin sizes come out near equal.

Every group is packed, and the driver holds no group. Best fit puts groups of one size into the same bin
until it is full, so it is run on sizes and their numbers of groups: one step for each size and bin, with the same
outcome as group by group. Sizes are rounded up to 1 + BITS binary digits (sizes below 2 ** (1 + BITS) are exact, others at most
1/2048 too large, and never above the capacity if the group is not), so there are at most 2 ** BITS * 64 sizes at any number of documents.
Groups of a size are numbered in parts by hash, and a number tells the bin by the table of steps (size, numbers, bin, groups in each of
consecutive bins); that has about as many rows as sizes and shards together, and is broadcast only up to BROADCAST_STEPS.

Documents get their group's shard by a join on a hash of the text, groups of many copies by a broadcast of their own, as
there are fewer than HOT_SHARE of them. Slots are numbered in (shard, hash of the row and a salt) parts whose number
follows the input, and each part starts where the counts of earlier parts end.

Nulls and odd input: a null text has size 1 and forms one group with other null
texts, apart from the empty text; its checksum is 0. A null doc_id is hashed as
null. Repeated rows share a group, so also a shard, and get slots of their own. Extra columns are not looked at. An
empty table gives no rows. A group larger than a bin fills that bin alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import written

#: Binary digits of a size after the first, and the share of the least capacity that `fixed_bins` may miss it by.
BITS, TOLERANCE = 11, 1 / 8192
#: Rows that one task numbers, about; a group of more than 1/HOT_SHARE of all rows is hot; steps that are broadcast at most.
PART_ROWS, HOT_SHARE, BROADCAST_STEPS = 50_000, 4096, 500_000


class Remaining:
    """AA tree of (remaining capacity, bin): insert, and take the least entry that holds a size."""

    def __init__(self):
        self.root = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = self._insert(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the entry with the least capacity >= size; of equals the lowest bin."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            self.root = self._delete(self.root, best)
        return best

    # a node is [key, level, left, right]

    @staticmethod
    def _skew(t):
        if t and t[2] and t[2][1] == t[1]:
            left = t[2]
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[3] and t[3][3] and t[1] == t[3][3][1]:
            right = t[3]
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def _insert(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._insert(t[side], key)
        return self._split(self._skew(t))

    def _delete(self, t, key):
        if t is None:
            return None
        if key < t[0]:
            t[2] = self._delete(t[2], key)
        elif key > t[0]:
            t[3] = self._delete(t[3], key)
        elif t[2] is None and t[3] is None:
            return None
        elif t[2] is None:
            near = t[3]
            while near[2]:
                near = near[2]
            t[0] = near[0]
            t[3] = self._delete(t[3], near[0])
        else:
            near = t[2]
            while near[3]:
                near = near[3]
            t[0] = near[0]
            t[2] = self._delete(t[2], near[0])
        low = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if low < t[1]:
            t[1] = low
            if t[3] and low < t[3][1]:
                t[3][1] = low
        t = self._skew(t)
        t[3] = self._skew(t[3])
        if t[3]:
            t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        t[3] = self._split(t[3])
        return t


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (size, first, end, bin, each) and the number of bins: of the groups of a size, number i goes to bin + (i - first) // each.

    counts gives the number of groups of each size. A group above the capacity gets a bin of its own. Ends early once it needs more than `most` bins.
    """
    tree, steps, bins = Remaining(), [], 0
    for size in sorted(counts, reverse=True):
        at, n = 0, counts[size]
        while at < n:
            found = tree.take(size)
            if found is None:
                break
            k = min(n - at, found[0] // size)
            steps.append((size, at, at + k, found[1], k))
            at += k
            if found[0] > k * size:
                tree.insert((found[0] - k * size, found[1]))
        if at < n:
            each = max(1, capacity // size)
            steps.append((size, at, n, bins, each))
            opened = -(-(n - at) // each)
            if most is not None and bins + opened > most:
                return steps, bins + opened
            for b in range(bins, bins + opened):
                left = capacity - size * min(each, n - at - (b - bins) * each)
                if left > 0:
                    tree.insert((left, b))
            bins += opened
    return steps, bins


def fixed_bins(counts: dict[int, int], bins: int) -> list[tuple[int, int, int, int, int]]:
    """Steps at a capacity that needs at most `bins` bins."""
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    low = max(max(counts), -(-total // bins))
    width = max(1, int(low * TOLERANCE))
    # at most the largest group above an even share is always enough
    found, high, step = best_fit_decreasing(counts, low, bins), low, width
    while found[1] > bins:
        low, high, step = high, high + step, 2 * step
        found = best_fit_decreasing(counts, high, bins)
    while high - low > width:
        middle = (low + high) // 2
        tried = best_fit_decreasing(counts, middle, bins)
        if tried[1] <= bins:
            found, high = tried, middle
        else:
            low = middle
    return found[0]


def rounded(size: Column, capacity: int | None = None) -> Column:
    """The size rounded up to 1 + BITS binary digits, but not across the capacity."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - BITS, F.lit(0))).cast("long")
    up = size + F.pmod(-size, unit)
    return up if capacity is None else F.when(size <= capacity, F.least(up, F.lit(capacity))).otherwise(up)


def in_order(rows: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """rows (written, with a column part) with their number from 0 in each of the groups, in order of part, then order; no task holds more than a part of a group."""
    inside = Window.partitionBy(*groups, "part").orderBy(*order)
    counts = rows.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.withColumn("own", F.row_number().over(inside) - 1).join(starts, [*groups, "part"]).withColumn(name, F.col("start") + F.col("own")).drop("part", "own", "start")


def assign(docs: DataFrame, bins: int | None = 8, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and shard of every document: `bins` shards, or as few of `capacity` bytes as best fit finds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("g"),
    )
    rows = written(rows, "sized")
    n_rows = rows.count()
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies"))
    # g is a hash, so a part by its value is a part by chance
    parts = max(1, n_rows // PART_ROWS)
    groups = written(groups.select("g", "copies", rounded(F.col("bytes"), capacity).alias("bytes"), F.pmod(F.col("g"), F.lit(parts)).cast("int").alias("part")), "groups")
    counts = {r.bytes: r.n for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # at most 2 ** BITS * 64
    steps = fixed_bins(counts, bins) if capacity is None else best_fit_decreasing(counts, capacity)[0]
    table = docs.sparkSession.createDataFrame(steps, "bytes long, first long, end long, bin int, each long")
    if len(steps) <= BROADCAST_STEPS:
        table = F.broadcast(table)
    placed = in_order(groups, ["bytes"], ["g"], "number").join(table, "bytes").where("number >= first AND number < end")
    placed = written(placed.select("g", "copies", (F.col("bin") + F.floor((F.col("number") - F.col("first")) / F.col("each"))).cast("int").alias("shard")), "placed")
    hot = F.col("copies") * HOT_SHARE > n_rows
    by_copy = F.broadcast(placed.where(hot).select("g", F.col("shard").alias("own")))  # fewer than HOT_SHARE rows
    found = rows.join(by_copy, "g", "left")
    some = found.where("own IS NULL").drop("own").join(placed.where(~hot).select("g", "shard"), "g")
    return found.where("own IS NOT NULL").withColumnRenamed("own", "shard").unionByName(some).select("doc_id", "size", "text_crc32", "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with slot, gapless from 0 in each shard, without a task that holds a whole shard, nor all rows of one doc_id."""
    # written with their parts: equal rows may swap their slots in another run, but not within one
    rows = written(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int")), "sharded")
    parts = max(1, rows.count() // PART_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "salt"), F.lit(parts))).drop("salt")
    return in_order(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")


def report(docs: DataFrame, bins: int = 8) -> DataFrame:
    return numbered(assign(docs, bins)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
