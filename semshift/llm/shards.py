"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Best fit decreasing looks at sizes only, so the driver packs a histogram of group sizes: a run of n groups of one size
enters the tightest bin that still has room, found in a balanced tree, as many at once as fit (after one has entered, that bin is still the
tightest), which gives the very bins that placing them one by one gives. Distinct sizes number at most
sqrt(2 x total bytes), whatever the number of groups. Groups get their bins by rank, without meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stored, table


class _Bins:
    """Remaining capacities in order: a treap of (room, bin), balanced by hashed priorities, so that put and take cost its depth."""

    def __init__(self) -> None:
        self.item: list[tuple[int, int]] = []
        self.rank: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.free: list[int] = []
        self.root = -1

    def _split(self, t: int, item: tuple[int, int]) -> tuple[int, int]:
        """The tree cut into what is less than the item, and the rest."""
        low, high, low_end, high_end = -1, -1, -1, -1
        while t >= 0:
            if self.item[t] < item:
                if low_end < 0:
                    low = t
                else:
                    self.right[low_end] = t
                low_end, t = t, self.right[t]
            else:
                if high_end < 0:
                    high = t
                else:
                    self.left[high_end] = t
                high_end, t = t, self.left[t]
        if low_end >= 0:
            self.right[low_end] = -1
        if high_end >= 0:
            self.left[high_end] = -1
        return low, high

    def _merge(self, a: int, b: int) -> int:
        """One tree of two, all of the first before the second."""
        root, end, side = -1, -1, self.right
        while a >= 0 and b >= 0:
            top = a if self.rank[a] > self.rank[b] else b
            if end < 0:
                root = top
            else:
                side[end] = top
            end = top
            if top == a:
                side, a = self.right, self.right[a]
            else:
                side, b = self.left, self.left[b]
        rest = a if a >= 0 else b
        if end < 0:
            return rest
        side[end] = rest
        return root

    def put(self, item: tuple[int, int]) -> None:
        t = self.free.pop() if self.free else len(self.item)
        if t == len(self.item):
            self.item.append(item)
            self.rank.append(0)
            self.left.append(-1)
            self.right.append(-1)
        self.item[t], self.left[t], self.right[t] = item, -1, -1
        self.rank[t] = (item[0] * 0x9E3779B97F4A7C15 + item[1] * 0xBF58476D1CE4E5B9) % (1 << 64) * 0x94D049BB133111EB >> 32 & 0xFFFFFFFF
        low, high = self._split(self.root, item)
        self.root = self._merge(self._merge(low, t), high)

    def take(self, room: int) -> tuple[int, int] | None:
        """Takes out the tightest bin with at least that room."""
        t, above, found, over = self.root, -1, -1, -1
        while t >= 0:
            if self.item[t][0] >= room:
                found, over = t, above
                above, t = t, self.left[t]
            else:
                above, t = t, self.right[t]
        if found < 0:
            return None
        rest = self._merge(self.left[found], self.right[found])
        if over < 0:
            self.root = rest
        elif self.left[over] == found:
            self.left[over] = rest
        else:
            self.right[over] = rest
        self.free.append(found)
        return self.item[found]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int, int]], int] | None:
    """Packs runs (size, count), sizes descending, into bins of the capacity.

    Returns (size, from, to, bin) pieces, ranks within the size, and the number of bins; None if over `most` are needed.
    """
    bins, made, pieces = _Bins(), 0, []
    for size, count in runs:
        done = 0
        while done < count:
            item = bins.take(size)
            if item is None:
                if made == most:
                    return None
                item, made = (max(capacity, size), made), made + 1
            k = min(count - done, item[0] // size)
            pieces.append((size, done, done + k, item[1]))
            done += k
            bins.put((item[0] - k * size, item[1]))
    return pieces, made


def pack(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Pieces over at most `shards` bins, near equal: a group larger than an even share of what is left has a bin to itself, the rest is packed at the least capacity for which best fit decreasing needs no more bins."""
    pieces, left, b = [], [list(r) for r in runs], shards
    total = sum(s * n for s, n in runs)
    taken: dict[int, int] = {}
    while b > 1 and left and left[0][0] * b > total:
        s = left[0][0]
        pieces.append((s, taken.get(s, 0), taken.get(s, 0) + 1, shards - b))
        taken[s] = taken.get(s, 0) + 1
        total, b = total - s, b - 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    rest = [(s, n) for s, n in left]
    if rest:
        lo, hi = max(rest[0][0], -(-total // b)), max(rest[0][0], -(-total // b)) + rest[0][0]
        best = best_fit_decreasing(rest, lo, b)
        while best is None and hi - lo > 1:
            mid = (lo + hi) // 2
            if (got := best_fit_decreasing(rest, mid, b)) is None:
                lo = mid
            else:
                hi = mid
                if hi - lo <= max(1, total // b // 100_000):
                    break
        best = best or best_fit_decreasing(rest, hi, b)
        pieces += [(s, lo_ + taken.get(s, 0), hi_ + taken.get(s, 0), k + shards - b) for s, lo_, hi_, k in best[0]]
    return pieces


def assign_shards(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, group_key, shard, slot for every row.

    A null text is empty (size 1, crc 0) and belongs with the empty texts. Repeated rows keep their repetitions. An
    empty table gives no rows. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("group_key")), "shard-rows")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"))
    order = [F.col("group_size").desc(), F.col("group_key")]
    groups = stored(ranked(groups, order, "shard-groups", within=None), "shard-ranks")
    hist = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).toPandas().sort_values("group_size", ascending=False)
    pieces = pack(list(zip(hist.group_size.tolist(), hist.n.tolist(), strict=True)), shards)
    first = dict(zip(hist.group_size.tolist(), hist["first"].tolist(), strict=True))
    import pandas as pd

    cuts = pd.DataFrame([(s, first[s] + a, first[s] + z, b) for s, a, z, b in pieces], columns=["group_size", "lo", "hi", "shard"]).astype({"group_size": "int64", "lo": "int64", "hi": "int64", "shard": "int32"})
    cuts = spark.createDataFrame(cuts, "group_size long, lo long, hi long, shard int")
    placed = groups.alias("g").join(cuts.alias("c"), (F.col("g.group_size") == F.col("c.group_size")) & (F.col("g.rank") >= F.col("c.lo")) & (F.col("g.rank") < F.col("c.hi")))
    placed = placed.select("g.group_key", "g.rank", "c.shard")
    full = rows.join(placed, "group_key").select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("group_rank"))
    return ranked(full, [F.col("shard"), F.col("group_rank"), F.col("doc_id"), F.col("text_crc32")], "shard-slots", within=["shard"], rank="slot")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
