"""Graphs as edge DataFrames: PageRank, bounded walks, paths, components, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where(F.col("src") != F.col("dst")).distinct()


def pagerank(edges: DataFrame, d: float = 0.85, rounds: int = 20, seeds: DataFrame | None = None, tolerance: float = 0.0, stable_top: int = 0, stable_rounds: int = 2) -> DataFrame:
    """(id, rank) of r = (1 - d) p + d * sum of r_src * w / outweight; r starts as p.

    edges: (src, dst, weight); weights of 0 and below count 1. Dangling mass isn't
    redistributed. p is uniform, or the normalised score of seeds (id, score) where they lie
    in the graph; seeds without weight there give the uniform one. It stops after `rounds`,
    once the ranks change by `tolerance` in all or less, or once the `stable_top` best
    ids have kept their order for `stable_rounds` rounds.
    """
    edges = edges.select("src", "dst", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("w"))
    share = cut(share.repartition("src")).persist()
    nodes = share.select(F.col("src").alias("id")).union(share.select("dst")).distinct()
    n = nodes.count()
    p = nodes.withColumn("p", F.lit(1.0 / max(1, n)))
    if seeds is not None:
        held = nodes.join(seeds.groupBy("id").agg(F.sum("score").alias("score")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
        total = held.agg(F.sum("score")).first()[0] or 0.0
        p = held.select("id", (F.col("score") / total).alias("p")) if total > 0 else p
    p = cut(p).persist()
    rank, best, kept = p.select("id", F.col("p").alias("rank")), None, 0
    for k in range(rounds):
        flow = rank.join(share, rank.id == share.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("in"))
        new = p.join(flow, p.id == flow.dst, "left").select("id", ((1 - d) * F.col("p") + d * F.coalesce("in", F.lit(0.0))).alias("rank"))
        new = cut(new) if k % 5 == 4 or tolerance or stable_top else new
        if tolerance:
            off = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (off or 0.0) <= tolerance:
                rank = new
                break
        if stable_top:
            now = [r.id for r in new.orderBy(F.col("rank").desc(), "id").limit(stable_top).collect()]
            kept, best = (kept + 1 if now == best else 0), now
            if kept >= stable_rounds:
                rank = new
                break
        rank = new
    rank = cut(rank)
    if rank.sparkSession.conf.get("spark.checkpoint.dir", None):
        share.unpersist()
        p.unpersist()
    return rank


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage in the checkpoint folder; in a local session without one, in memory."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, distance) for nodes within `depth` undirected hops: each frontier is anti-joined with what was seen."""
    both = undirected(edges)
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance"))
    front = seen
    for k in range(1, depth + 1):
        step = front.join(both, front.id == both.src).select("seed", F.col("dst").alias("id")).distinct()
        front = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(k))
        seen = seen.union(front)
    return seen


def directed_paths(edges: DataFrame, start, end, depth: int) -> DataFrame:
    """(path, hops): all directed walks from start to end of at most `depth` edges, no edge twice."""
    named = edges.select("src", "dst").distinct()
    walk = named.where(F.col("src") == F.lit(start)).select(F.array("src", "dst").alias("path"), F.array(F.struct("src", "dst")).alias("used"))
    found = walk.where(F.element_at("path", -1) == F.lit(end))
    for _ in range(depth - 1):
        edge = F.struct("src", "dst")
        walk = walk.join(named, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("used", edge)).select(F.concat("path", F.array("dst")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
        found = found.union(walk.where(F.element_at("path", -1) == F.lit(end)))
    return found.select("path", (F.size("path") - 1).alias("hops"))


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, until nothing changes. Rounds grow with the logarithm of the longest path.

    Each round hooks the neighbours of a node to the least node near it, first the greater
    ones, then all that are left (two kinds of stars in turn).
    """
    now = cut(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    mark = lambda x: tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    state = mark(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, mark(now)
        if state == before:
            break
    return nodes.join(now.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def co_occurrence(mentions: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(a, b, n, confidence): entities of at least `least` common chunks; confidence is min(0.7, 0.3 + 0.1 n).

    Of a chunk the `most` first entities count, as its own limit: a chunk that names
    everything says little and would make pairs with its square.
    """
    pairs = spread.pairs_within(mentions.where(F.col("chunk").isNotNull()), "chunk", "entity", most)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("confidence", F.least(F.lit(0.7), 0.3 + 0.1 * F.col("n")))


def valid_at(edges: DataFrame, at: Column) -> DataFrame:
    """Rows with valid_from (null: ever) <= at < valid_until (null: open)."""
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))
