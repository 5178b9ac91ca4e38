"""Connected components by alternating large and small stars: joins and aggregates only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the least node of its component.

    Loops and repeated edges do no harm; no edges, no rows. Each round links neighbours to
    the least node near them; rounds grow with the logarithm of the longest path. Minima
    are taken before the shuffle, and hubs are split by the skew handling of joins. Each
    round is written to the shared folder, the one before goes.
    """
    a, b = F.col("a"), F.col("b")
    now = ws.cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-0")
    state = _state(now)
    for k in count(1):
        if not state[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = ws.cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def blocks_apart(placed: DataFrame, most_rows: int, most_size: int) -> DataFrame:
    """(key, i, j, side, k, root) of buckets (key, k, root, n) whose members lie in several components so far.

    Members outside a bucket's largest component, dealt into blocks i, meet all members,
    dealt into blocks j: those of the largest component are never held against each
    other. A member is copied once for each block of the other side that it meets: side 0
    is the left one, 1 the right one, 2 both. A block has about `most_rows` rows and a sum
    of n of about `most_size` at most.
    """
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    whole = by_root.groupBy("key").agg(F.max(F.struct("c", "s", "root")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("roots")).where(F.col("roots") > 1)
    blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / most_rows), F.ceil(s / most_size)).cast("int")
    apart = whole.select("key", F.col("top.root").alias("main"), blocks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("of_i"), blocks(F.col("c"), F.col("s")).alias("of_j"))
    rest = placed.join(apart, "key").withColumn("i0", F.pmod(F.xxhash64("k"), "of_i").cast("int")).withColumn("j0", F.pmod(F.xxhash64(F.lit(1), "k"), "of_j").cast("int"))
    left = rest.where(F.col("root") != F.col("main")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of_j") - 1)))
    left = left.select("key", F.col("i0").alias("i"), "j", F.when(F.col("j") == F.col("j0"), 2).otherwise(0).alias("side"), "k", "root")
    right = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of_i") - 1))).where((F.col("root") == F.col("main")) | (F.col("i") != F.col("i0")))
    return left.union(right.select("key", "i", F.col("j0").alias("j"), F.lit(1).alias("side"), "k", "root"))
