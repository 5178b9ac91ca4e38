"""Upkeep of entities, edges, facts and their sources: audits, merges, rewrites and garbage, all as new DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: The least number of days that a tombstone stays.
RETENTION_FLOOR = 7


def embedding_stats(rows: DataFrame, by: str, vector: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(vector).isNotNull()).alias("embedded"))


def source_audit(sources: DataFrame) -> DataFrame:
    """One row over (id, chunk, dead): sources, dead ones, and the median, 90 %, 99 % and greatest length of a row's list."""
    per = sources.groupBy("id").agg(F.count("*").alias("n"), F.count_if("dead").alias("dead"))
    p = lambda q: F.percentile("n", F.lit(q))
    return per.agg(F.sum("n").alias("sources"), F.sum("dead").alias("dead"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("n").alias("longest"))


def source_gc(sources: DataFrame) -> DataFrame:
    """(id, kept, removed) over (id, place, chunk, dead): rows with a dead source, what is live in the old order."""
    live, dead = F.when(~F.col("dead"), F.struct("place", "chunk")), F.when(F.col("dead"), F.struct("place", "chunk"))
    out = sources.groupBy("id").agg(F.sort_array(F.collect_list(live)).alias("l"), F.sort_array(F.collect_list(dead)).alias("d"), F.bool_or("dead").alias("any"))
    return out.where("any").select("id", F.transform("l", lambda x: x["chunk"]).alias("kept"), F.transform("d", lambda x: x["chunk"]).alias("removed"))


def latest_sources(old: Column, new: Column, cap: int) -> Column:
    """Old and new ids as one list without repeats: each at its last place, the `cap` last."""
    both = F.concat(F.coalesce(old, F.array().cast("array<long>")), F.coalesce(new, F.array().cast("array<long>")))
    once = F.reverse(F.array_distinct(F.reverse(both)))
    return F.slice(once, F.greatest(F.lit(1), F.size(once) - cap + 1), F.lit(cap))


def tombstones(rows: DataFrame, by: str, dead: Column, invalidated: Column, ts: str, now: Column) -> DataFrame:
    """Active, dead and invalidated rows, the dead ones' share, oldest time, and the median and 90 % of their age in days."""
    age = F.when(dead, (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000.0)
    return rows.groupBy(by).agg(F.count_if(~dead).alias("active"), F.count_if(dead).alias("dead"), F.count_if(invalidated).alias("invalidated"), (F.count_if(dead) / F.count("*")).alias("share"), F.min(F.when(dead, F.col(ts))).alias("oldest"), F.percentile(age, F.lit(0.5)).alias("p50"), F.percentile(age, F.lit(0.9)).alias("p90"))


def drift(now: DataFrame, before: DataFrame, key: str, flagged: float = 0.5) -> DataFrame:
    """(key, before, now, change, flagged): how often each value occurs in either; a change of half and more is flagged, new values too."""
    count = lambda x, n: x.groupBy(key).agg(F.count("*").alias(n))
    both = count(before, "before").join(count(now, "now"), key, "full").select(key, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    change = F.when(F.col("before") == 0, F.lit(1.0)).otherwise(F.abs(F.col("now") - F.col("before")) / F.col("before"))
    return both.withColumn("change", change).withColumn("flagged", F.col("change") >= flagged)


def score_drift(rows: DataFrame, by: str, score: str, threshold: float, least: int) -> DataFrame:
    """(by, n, p10, p50, p90, low): the spread of samples, and the share below the threshold; groups of under `least` are left out."""
    p = lambda q: F.percentile(score, F.lit(q))
    return rows.groupBy(by).agg(F.count("*").alias("n"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), (F.count_if(F.col(score) < threshold) / F.count("*")).alias("low")).where(F.col("n") >= least)


def survivors(rows: DataFrame, by: list[str], id: str, order: list[Column]) -> DataFrame:
    """(id, survivor): every row and the first of its group in `order`."""
    return rows.select(F.col(id).alias("id"), F.first(id).over(Window.partitionBy(*by).orderBy(*order)).alias("survivor"))


def remap(edges: DataFrame, survivor: DataFrame) -> DataFrame:
    """Edges (src, dst) with each end replaced by its survivor; edges that become loops go."""
    for end in ("src", "dst"):
        to = survivor.select(F.col("id").alias(end), F.col("survivor").alias("_s"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_s", end)).drop("_s")
    return edges.where(F.col("src") != F.col("dst"))


def merge_groups(rows: DataFrame, by: list[str], sources: str, mentions: str) -> DataFrame:
    """Per group of repeats: how many, all their sources once, and the sum of their mentions."""
    flat = rows.select(*by, mentions, F.explode_outer(sources).alias("s"))
    lists = flat.groupBy(*by).agg(F.sort_array(F.collect_set("s")).alias("sources"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(mentions), F.lit(0)).alias("mentions")).where("n > 1").join(lists, by)


def chain_roots(rows: DataFrame, id: str, previous: str, most: int = 64) -> DataFrame:
    """(id, root, depth) of version chains: pointers are doubled, so that a chain of n links takes log n joins.

    `most` bounds the doublings; 64 reach any chain. A row whose predecessor is absent is a root.
    """
    p = rows.select(F.col(id).alias("id"), F.col(previous).alias("up"))
    p = p.alias("a").join(p.select(F.col("id").alias("k")).alias("b"), F.col("a.up") == F.col("b.k"), "left").select("id", F.coalesce("b.k", "id").alias("up"), F.when(F.col("b.k").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(most):
        up = p.select(F.col("id").alias("k"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = p.join(up, p.up == up.k).select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        new = cut(new)
        done = new.join(p.select("id", F.col("up").alias("u")), "id").where(F.col("up") != F.col("u")).isEmpty()
        p = new
        if done:
            break
    return p.withColumnRenamed("up", "root")


def backfill(rows: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with null columns filled from the parent of the same key; other rows stay as they are."""
    up = parents.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return rows.join(up, key, "left").select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def expire_sessions(rows: DataFrame, session: str, ts: str, cutoff: Column) -> DataFrame:
    """Rows of sessions whose last row isn't before the cutoff, and rows without a session."""
    old = rows.where(F.col(session).isNotNull()).groupBy(session).agg(F.max(ts).alias("_last")).where(F.col("_last") < cutoff)
    return rows.join(old.select(session), session, "left_anti")


def upsert_relationships(stored: DataFrame, new: DataFrame, cap: int = 100) -> DataFrame:
    """One row for each (src, dst, type): the longer description, the greater confidence and weight, the last `cap` sources of both."""
    longer = lambda a, b: F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)
    s, n, on = stored.alias("s"), new.alias("n"), ["src", "dst", "type"]
    both = s.join(n, on, "full")
    none = F.array().cast("array<long>")
    sources = F.concat(F.coalesce("s.sources", none), F.coalesce("n.sources", none))
    return both.select(*on, longer(F.col("s.description"), F.col("n.description")).alias("description"), F.greatest("s.confidence", "n.confidence").alias("confidence"), F.greatest("s.weight", "n.weight").alias("weight"), F.slice(sources, F.greatest(F.lit(1), F.size(sources) - cap + 1), F.lit(cap)).alias("sources"))


def merge_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By id: sources appended once, mentions added, old attributes and descriptions kept where there are any, the greater confidence."""
    s, n = stored.alias("s"), new.alias("n")
    none = F.array().cast("array<long>")
    sources = F.concat(F.coalesce("s.sources", none), F.array_except(F.coalesce("n.sources", none), F.coalesce("s.sources", none)))
    text = F.when(F.coalesce("s.description", F.lit("")) != "", F.col("s.description")).otherwise(F.col("n.description"))
    return s.join(n, "id", "full").select("id", sources.alias("sources"), (F.coalesce("s.mentions", F.lit(0)) + F.coalesce("n.mentions", F.lit(0))).alias("mentions"), text.alias("description"), F.greatest("s.confidence", "n.confidence").alias("confidence"))


def touch(rows: DataFrame, seen: DataFrame, id: str, ts: str) -> DataFrame:
    """Rows with last_accessed moved on to the last time in seen (id, ts); it never goes back."""
    last = seen.groupBy(id).agg(F.max(ts).alias("_t"))
    return rows.join(last, id, "left").withColumn("last_accessed", F.greatest("last_accessed", "_t")).drop("_t")


def claim_orphans(rows: DataFrame, pending_before: Column, processing_before: Column) -> DataFrame:
    """Rows that wait since before one time, or are in work since before another."""
    return rows.where(((F.col("status") == "PENDING") & (F.col("updated_at") < pending_before)) | ((F.col("status") == "PROCESSING") & (F.col("updated_at") < processing_before)))


def prune_edges(edges: DataFrame, live: DataFrame, threshold: float, now: Column) -> DataFrame:
    """Edges with valid_until set to now where the confidence is low, none is set, and no source (chunk) is live."""
    alive = edges.select("id", F.explode("sources").alias("chunk")).join(live.select("chunk"), "chunk", "left_semi").select("id").distinct().withColumn("_live", F.lit(True))
    gone = F.col("_live").isNull() & (F.col("confidence") < threshold) & F.col("valid_until").isNull()
    return edges.join(alive, "id", "left").withColumn("valid_until", F.when(gone, now).otherwise(F.col("valid_until"))).drop("_live")


def contradictions(facts: DataFrame, similar: float = 0.5) -> DataFrame:
    """(a, b) of live facts (id, src, dst, type, text) with equal ends and type whose texts are less alike than `similar`.

    Each fact is held against the next in its bucket by id, so that pairs grow with the facts, not with their square.
    """
    w = Window.partitionBy("src", "dst", "type").orderBy("id")
    near = facts.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), F.lower("text").alias("x"), F.lower(F.lead("text").over(w)).alias("y")).where(F.col("b").isNotNull())
    longest = F.greatest(F.length("x"), F.length("y"))
    return near.withColumn("similarity", F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("x", "y") / longest)).where(F.col("similarity") < similar).select("a", "b", "similarity")


def rename_types(rows: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return rows.withColumn(column, F.coalesce(F.element_at(names, F.col(column)), column))


def event_clusters(events: DataFrame, by: str, ts: str, id: str, days: float) -> DataFrame:
    """(id, cluster): within `by`, events that follow one another by at most `days` form a cluster, named by its first."""
    w = Window.partitionBy(by).orderBy(ts, id)
    far = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > days * 86_400_000_000
    marked = events.withColumn("_first", F.when(F.coalesce(far, F.lit(True)), F.col(id)))
    return marked.select(F.col(id).alias("id"), F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cluster"))


def compact(rows: DataFrame, dead: Column, ts: str, now: Column, days: int) -> DataFrame:
    """Rows but tombstones older than `days`, 7 at least."""
    keep = max(days, RETENTION_FLOOR)
    old = F.unix_micros(F.col(ts).cast("timestamp")) < F.unix_micros(now.cast("timestamp")) - keep * 86_400_000_000
    return rows.where(~(dead & old))


def usage(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.round(F.avg("latency"), 4).alias("latency"))


def document_stubs(*parts: DataFrame) -> DataFrame:
    """(doc_id, place): the documents of ranked results (doc_id, place), each at its first place over all parts in turn."""
    flat = None
    for k, p in enumerate(parts):
        row = p.select("doc_id", F.struct(F.lit(k).alias("part"), F.col("place")).alias("at"))
        flat = row if flat is None else flat.union(row)
    return flat.groupBy("doc_id").agg(F.min("at").alias("at")).select("doc_id", F.col("at.part").alias("part"), F.col("at.place").alias("place"))


def fold(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, dim, value): the mean of a group's vectors, a row for each dimension."""
    return vectors.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def unit(vector: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / length))


def replace_sources(entities: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, sources) after a document's chunks `old` (chunk) give way to those of `new` (id, chunk).

    What only the old chunks gave goes, what others gave too stays without them, and what
    the new extraction names has its chunks besides. A row whose list was empty before stays.
    """
    flat = entities.select("id", F.explode("sources").alias("chunk")).join(old.select("chunk").distinct(), "chunk", "left_anti").select("id", "chunk")
    empty = entities.where(F.coalesce(F.size("sources"), F.lit(0)) == 0).select("id", F.lit(None).cast("long").alias("chunk"))
    return flat.union(new.select("id", "chunk")).union(empty).groupBy("id").agg(F.sort_array(F.collect_set("chunk")).alias("sources"))
