"""Sharding: best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Workspace, mix64, table

N_SHARDS = 40
#: Sizes up to here have a class of their own; above, classes are 1/1024 of a power of two wide.
EXACT = 1 << 16
#: A group of copies that outgrows a shard is dealt out in so many pieces per shard.
PIECES = 8


class FreeSpace:
    """Bins in a balanced search tree (treap) by remaining capacity, then number."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, t: list | None, key: tuple) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _join(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        key = (room, number)
        node = [key, int(mix64(np.array([number * 2654435761 + room], np.uint64))[0]), None, None]
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, node), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room that holds `size`."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        t = right
        while t[2] is not None:
            t = t[2]
        _, rest = self._split(right, (t[0][0], t[0][1] + 1))
        self.root = self._join(left, rest)
        return t[0]


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Packs (size, how many) into bins of a capacity: (size, bin, how many) runs in order, and the bins used.

    Larger sizes first, each item into the tightest bin. Equal items follow one another
    into a bin as long as it holds them (after one, that bin is the tightest still), so a
    run is one step however many items it has. None if more than `most` bins are needed
    or an item exceeds the capacity.
    """
    tree, runs, used = FreeSpace(), [], 0
    for size, n in sorted(sizes, reverse=True):
        if size > capacity:
            return None
        while n:
            found = tree.take_tightest(size)
            if found is None:
                if used == most:
                    return None
                found, used = (capacity, used), used + 1
            room, number = found
            k = min(n, room // size) if size else n
            runs.append((size, number, k))
            n -= k
            tree.add(room - k * size, number)
    return runs, used


def smallest_capacity(sizes: list[tuple[int, int]], bins: int) -> tuple[list[tuple[int, int, int]], int]:
    """A packing into at most `bins` bins, its capacity within a thousandth of the least that fits.

    Slack over an even share doubles until the packing fits; bisection then narrows it.
    """
    total, largest = sum(s * n for s, n in sizes), max((s for s, _ in sizes), default=0)
    least = max(-(-total // bins), largest)
    low, high = least, least + max(1, least // 10_000)
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        low, high = high + 1, least + 2 * (high - least)
    while low < high and high - low > low // 1_000:
        mid = (low + high) // 2
        if (got := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            best, high = got, mid
    return best[0], high


def size_class(size):
    """A size rounded up so that at most 65,536 + 1,024 per doubling classes exist."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double"))) - 10)).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step) * step).cast("long")


def _positions(ws: Workspace, df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their 0-based place `_at` in a total order: a range sort, and offsets of its partitions.

    The offsets have one row for each partition, however many rows there are.
    """
    n = max(ws.spark.sparkContext.defaultParallelism, int(ws.spark.conf.get("spark.sql.shuffle.partitions")))
    done = ws.cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33)
    counts = {r[0]: r[1] for r in done.groupBy(part.alias("p")).count().collect()}
    parts = sorted(counts)
    offsets = np.cumsum([0, *(counts[p] for p in parts)])[:-1].tolist()
    small = ws.spark.createDataFrame(list(zip(parts, offsets, strict=True)) or [(0, 0)], "_p long, _o long")
    return done.withColumn("_p", part.cast("long")).join(F.broadcast(small), "_p").withColumn("_at", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_o", "_m")


def pack_shards(docs: DataFrame, n_shards: int = N_SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row, by the law `bytes`.

    Size: UTF-8 bytes of the text (null: none) plus 16. Rows of equal text (null equals
    empty) form a group that stays in one shard, and groups enter shards best fit
    decreasing, under the least capacity (to a thousandth) that holds all in `n_shards`. A group
    larger than an even share can't be whole and even at once: it alone is dealt by a
    hash of doc_id into pieces of about an eighth of a share. Slots number a shard's rows
    by doc_id (nulls first), gapless from 0; repeated rows each have their slot. No rows:
    no shards. Other columns are left out.

    The driver sees a histogram of size classes (bounded by `size_class`), row counts of
    partitions and the groups larger than a share (fewer than shards), never the groups.
    """
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    base = ws.cut(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("_key")), "base")
    total = base.agg(F.sum("size")).first()[0] or 0
    share = max(1, -(-total // n_shards))
    large = base.groupBy("_key").agg(F.sum("size").alias("b")).where(F.col("b") > share).collect()  # fewer than n_shards
    pieces = spark.createDataFrame([(bytes(r[0]), -(-r.b * PIECES // share)) for r in large] or [(b"", 1)], "_key binary, _n long")
    base = base.join(F.broadcast(pieces), "_key", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_n")), F.lit(0)).cast("long")).drop("_n")

    items = base.groupBy("_key", "_piece").agg(F.sum("size").alias("b")).select("_key", "_piece", size_class(F.col("b")).alias("_class"))
    placed = _positions(ws, items, [F.col("_class").desc(), F.col("_key"), F.col("_piece")], "items")
    histogram = [(int(r[0]), int(r[1])) for r in placed.groupBy("_class").count().collect()]
    runs, _ = smallest_capacity(histogram, n_shards)
    ends, shards = np.cumsum([k for *_, k in runs]), np.array([b for _, b, _ in runs], "int32")

    @F.pandas_udf("int")
    def shard_at(at: pd.Series) -> pd.Series:
        return pd.Series(shards[np.searchsorted(ends, at.to_numpy(), "right")])

    placed = placed.select("_key", "_piece", shard_at("_at").alias("shard"))
    sorted_ = _positions(ws, base.join(placed, ["_key", "_piece"]).select("doc_id", "size", "text_crc32", "shard"), [F.col("shard"), F.col("doc_id"), F.col("text_crc32")], "slots")
    ws.drop("base", "items")
    firsts = sorted_.groupBy("shard").agg(F.min("_at").alias("_first"))  # a row for each shard
    return sorted_.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
