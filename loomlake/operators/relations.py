"""Entities, their mentions in chunks, and relationships between them: reads, expansions and inference as joins.

Mentions are (entity, chunk, n, ts, channel), relationships (id, src, dst, type, confidence,
valid_from, valid_until). Seeds and stated id sets are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spread

#: How much a relationship type counts in an expansion; other types count 1.
TYPE_PRIOR = {"ASSOCIATED_WITH": 0.4, "RELATES_TO": 0.7}


def chunks_of(mentions: DataFrame, seeds: DataFrame, limit: int, after: Column | None = None, before: Column | None = None, newest: bool = False) -> DataFrame:
    """(chunk, entities, mentions, ts): chunks that mention seeds (entity), the most mentions first, or the newest.

    A null time passes both bounds; chunks of equal standing come by id.
    """
    found = mentions.join(seeds.select("entity").distinct(), "entity", "left_semi")
    if after is not None:
        found = found.where(F.col("ts").isNull() | (F.col("ts") >= after))
    if before is not None:
        found = found.where(F.col("ts").isNull() | (F.col("ts") <= before))
    out = found.groupBy("chunk").agg(F.sort_array(F.collect_set("entity")).alias("entities"), F.sum("n").alias("mentions"), F.max("ts").alias("ts"))
    order = [F.col("ts").desc_nulls_last()] if newest else []
    return out.orderBy(*order, F.col("mentions").desc(), "chunk").limit(limit)


def channels_of(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    return mentions.where(F.col("channel").isNotNull()).join(seeds.select("entity").distinct(), "entity", "left_semi").select("channel").distinct()


def between(relationships: DataFrame, ids: DataFrame, limit: int = 90) -> DataFrame:
    """Relationships with both ends among ids (entity), loops left out; plain associations last, then by confidence."""
    known = ids.select("entity").distinct()
    found = relationships.where(F.col("src") != F.col("dst"))
    for end in ("src", "dst"):
        found = found.join(known.select(F.col("entity").alias(end)), end, "left_semi")
    return found.orderBy((F.col("type") == "ASSOCIATED_WITH").cast("int"), F.col("confidence").desc(), "id").limit(limit)


def expansion_scores(distances: DataFrame) -> DataFrame:
    """(id, score): the best of 1 / (1 + distance) over all seeds that reach an entity."""
    return distances.groupBy("id").agg(F.max(1 / (1 + F.col("distance"))).alias("score"))


def typed_expansion(seeds: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, score): the best of seed score * confidence * prior of the type over direct relationships, either way."""
    prior = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_PRIOR.items() for x in kv]), F.col("type")), F.lit(1.0))
    arms = relationships.select(F.col("src").alias("entity"), F.col("dst").alias("id"), "type", "confidence")
    arms = arms.unionByName(relationships.select(F.col("dst").alias("entity"), F.col("src").alias("id"), "type", "confidence"))
    return arms.join(seeds, "entity").groupBy("id").agg(F.max(F.col("score") * F.col("confidence") * prior).alias("score"))


def chunk_scores(mentions: DataFrame, scores: DataFrame) -> DataFrame:
    """(chunk, score): mentions * (1 + 0.1 * further entities) * mean score of the entities that a chunk mentions."""
    found = mentions.join(scores.select(F.col("id").alias("entity"), "score"), "entity")
    n = F.countDistinct("entity")
    return found.groupBy("chunk").agg((F.sum("n") * (1 + 0.1 * (n - 1)) * F.avg("score")).alias("score"))


def edges_of(relationships: DataFrame, ids: DataFrame, direction: str = "both", live: bool = True) -> DataFrame:
    """Relationships that leave ids (out), reach them (in) or either; `live` keeps those without an end of validity."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction is out, in or both")
    known = ids.select("entity").distinct()
    rows = relationships.where(F.col("valid_until").isNull()) if live else relationships
    side = lambda end: rows.join(known.select(F.col("entity").alias(end)), end, "left_semi").select(*relationships.columns)
    if direction == "both":
        return side("src").union(side("dst")).distinct()
    return side("src" if direction == "out" else "dst")


def invalidate_conflicts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored relationships; one that overlaps a newer one of the same ends and type ends when the first such begins.

    Stored and new rows of the same ends and type are read once, from the latest on: each
    stored row takes the nearest new one from its own start on, and the next one of another
    id where the nearest is its own. Only new rows that end before or as they begin are joined.
    """
    by, start = ["src", "dst", "type"], F.col("valid_from").isNotNull()
    never = F.expr("TIMESTAMP_NTZ '9999-12-31'")
    n = new.select(*by, F.col("valid_from").alias("nf"), F.col("valid_until").alias("nu"), F.col("id").alias("ni")).where(F.col("nf").isNotNull() & F.col("ni").isNotNull())
    usual = n.where(F.coalesce("nu", never) > F.col("nf"))
    rows = usual.select(*by, F.col("nf").alias("at"), F.lit(1).alias("is_new"), F.col("ni").alias("key"), F.lit(None).cast(stored.schema["valid_until"].dataType).alias("until"))
    rows = rows.unionByName(stored.where(start & F.col("id").isNotNull()).select(*by, F.col("valid_from").alias("at"), F.lit(0).alias("is_new"), F.col("id").alias("key"), F.col("valid_until").alias("until")))
    rows = spread.wide(rows.dropna(subset=by), *by)
    late = Window.partitionBy(*by).orderBy(F.col("at").desc(), F.col("is_new").desc(), F.col("key").desc())
    seen = late.rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("is_new") == 1, F.struct("at", "key")), ignorenulls=True).over(seen)
    rows = rows.withColumn("near", near).withColumn("turn", F.when((F.col("is_new") == 1) & (F.col("near.key") != F.col("key")), F.col("near.at")))
    rows = rows.withColumn("other", F.last("turn", ignorenulls=True).over(seen)).where("is_new = 0")
    ends = rows.select(F.col("key").alias("id"), F.when(F.col("near.key") == F.col("key"), F.col("other")).otherwise(F.col("near.at")).alias("ends"), "until")
    ends = ends.where(F.coalesce("until", never) > F.col("ends")).select("id", "ends")
    empty = n.where(F.col("nu") <= F.col("nf"))
    held = (F.col("valid_from") < F.col("nu")) & (F.coalesce("valid_until", never) > F.col("nf")) & (F.col("id") != F.col("ni"))
    ends = ends.union(stored.join(empty, by).where(held).select("id", F.col("nf").alias("ends"))).groupBy("id").agg(F.min("ends").alias("ends"))
    rest = [c for c in stored.columns if c != "valid_until"]
    return stored.join(ends, "id", "left").select(*rest, F.coalesce(F.least("valid_until", "ends"), "valid_until", "ends").alias("valid_until"), F.col("ends").isNotNull().alias("invalidated"))


def entity_channel(entities: DataFrame, cosines: DataFrame | None, top: int = 10, gate: float = 0.3) -> DataFrame:
    """(chunk, score): of the `top` best entities (id, score, chunks) the best score for each source chunk.

    With cosines (chunk, cosine) chunks below the gate go and others count score * cosine;
    chunks without a vector count 0.3 of the score.
    """
    best = entities.orderBy(F.col("score").desc(), "id").limit(top)
    flat = best.select("score", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.max("score").alias("score"))
    if cosines is None:
        return flat.withColumn("score", 0.3 * F.col("score"))
    joined = flat.join(cosines, "chunk", "left").where(F.col("cosine").isNull() | (F.col("cosine") >= gate))
    return joined.select("chunk", F.when(F.col("cosine").isNull(), 0.3 * F.col("score")).otherwise(F.col("score") * F.col("cosine")).alias("score"))


def cross_session(found: DataFrame, others: DataFrame) -> DataFrame:
    """(query_id, id, score): found, and chunks of other sessions with 0.8 * mean of the best five * 0.95 ** place."""
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    mean = found.withColumn("r", F.row_number().over(best)).where("r <= 5").groupBy("query_id").agg(F.avg("score").alias("mean"))
    new = others.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("i", F.row_number().over(best) - 1)
    return found.select("query_id", "id", "score").union(new.join(mean, "query_id").select("query_id", "id", 0.8 * F.col("mean") * F.pow(F.lit(0.95), F.col("i"))))


def reverse_seeds(chunks: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(id, score): entities with a source among the chunks (chunk, score), the best chunk's score, `most` at most."""
    flat = entities.select("id", F.explode("chunks").alias("chunk"))
    return flat.join(chunks, "chunk").groupBy("id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "id").limit(most)


def latest_mentions(mentions: DataFrame, limit: int) -> DataFrame:
    """(entity, ts, chunk): each entity's last mention, the latest entities first."""
    last = mentions.groupBy("entity").agg(F.max(F.struct("ts", "chunk")).alias("m"))
    return last.select("entity", "m.ts", "m.chunk").orderBy(F.col("ts").desc_nulls_last(), "entity").limit(limit)


def shared_with_both(mentions: DataFrame, a, b) -> DataFrame:
    """(entity, n): entities in chunks that mention a and b, and in how many."""
    both = mentions.where(F.col("entity").isin(a, b)).groupBy("chunk").agg(F.countDistinct("entity").alias("k")).where("k = 2").select("chunk")
    return mentions.where(~F.col("entity").isin(a, b)).select("entity", "chunk").distinct().join(both, "chunk", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


def field_matches(rows: DataFrame, id: str, value: Column, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows with equal normalised values, as (id, least): each with the least of its value; empty values match nothing.

    Pairs of all with all aren't made: the pairs (least, id) join the same rows.
    """
    norm = rows.select(F.col(id).alias("id"), F.lower(F.trim(value)).alias("v")).where(F.col("v") != "")
    least = norm.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return norm.join(least.select("v", "least"), "v").select("id", "least"), least


def rule_chain(relationships: DataFrame, first: str, second: str, result: str, limit: int = 1000) -> DataFrame:
    """(src, dst, type, confidence): x -first-> y -second-> z gives x -result-> z, loops and known triples left out."""
    side = lambda t, a, b, c: relationships.where(F.col("type") == t).select(F.col("src").alias(a), F.col("dst").alias(b), F.col("confidence").alias(c))
    found = side(first, "src", "via", "c1").join(side(second, "via", "dst", "c2"), "via").where(F.col("src") != F.col("dst"))
    new = found.groupBy("src", "dst").agg(F.max(F.col("c1") * F.col("c2")).alias("confidence")).withColumn("type", F.lit(result))
    new = new.join(relationships.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return new.orderBy(F.col("confidence").desc(), "src", "dst").limit(limit).select("src", "dst", "type", "confidence")


def source_liveness(rows: DataFrame, id: str, sources: str, chunks: DataFrame) -> DataFrame:
    """(id, place, chunk, dead): every source of every row in order, dead where there is no such chunk (chunk)."""
    flat = rows.select(F.col(id).alias("id"), F.posexplode(sources).alias("place", "chunk"))
    return flat.join(chunks.select("chunk").distinct().withColumn("live", F.lit(True)), "chunk", "left").select("id", "place", "chunk", F.col("live").isNull().alias("dead"))


def co_keyword_edges(keywords: DataFrame, most: int) -> DataFrame:
    """(src, dst, keyword, weight): both ways between chunks of a keyword (keyword, chunk, idf) that at most `most` chunks have.

    A keyword of more chunks makes a ring of them instead of all pairs: its chunks stay
    connected and no group grows with its square.
    """
    order = Window.partitionBy("keyword").orderBy("chunk")
    n, after = F.count("*").over(Window.partitionBy("keyword")), F.coalesce(F.lead("chunk").over(order), F.first("chunk").over(order))
    placed = keywords.select("keyword", "chunk", "idf", n.alias("n"), after.alias("after"))
    ring = placed.where(F.col("n") > most).select("keyword", "idf", F.explode(F.array(F.struct(F.col("chunk").alias("src"), F.col("after").alias("dst")), F.struct(F.col("after").alias("src"), F.col("chunk").alias("dst")))).alias("e"))
    held = placed.where(F.col("n") <= most).groupBy("keyword").agg(F.first("idf").alias("idf"), F.collect_list("chunk").alias("held"))
    small = held.select("keyword", "idf", F.explode("held").alias("src"), "held").select("src", F.explode("held").alias("dst"), "keyword", "idf").where(F.col("src") != F.col("dst"))
    return small.union(ring.select("e.src", "e.dst", "keyword", "idf")).withColumnRenamed("idf", "weight")


def density(edges: DataFrame, components: DataFrame, generic: tuple[str, ...] = ("ASSOCIATED_WITH", "RELATES_TO")) -> DataFrame:
    """One row: nodes, mean, median and largest distinct-neighbour degree, components, the largest one's share, share of typed edges."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where(F.col("a") != F.col("b")).distinct()
    degree = ends.groupBy("a").agg(F.count("*").alias("k")).agg(F.count("*").alias("nodes"), F.avg("k").alias("mean_degree"), F.median("k").alias("median_degree"), F.max("k").alias("max_degree"))
    size = components.groupBy("component").agg(F.count("*").alias("c")).agg(F.count("*").alias("components"), (F.max("c") / F.sum("c")).alias("largest"))
    typed = edges.agg((F.count_if(~F.col("type").isin(*generic)) / F.count("*")).alias("typed"))
    return degree.crossJoin(size).crossJoin(typed)  # each has one row


def associations(mentions: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(src, dst, confidence): pairs of a chunk's first `most` entities, those known as (src, dst) either way left out."""
    pairs = spread.pairs_within(mentions.where(F.col("chunk").isNotNull()), "chunk", "entity", most).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pairs = spread.wide(pairs, "src", "dst").distinct()
    low = known.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pairs.join(low, ["src", "dst"], "left_anti").withColumn("confidence", F.lit(0.4))


def narrative(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, id, score): a result that shares entities with others gains min(0.2 * shared, 0.5) of its score, one alone keeps 0.85 of it."""
    held = rows.join(mentions.select(F.col("chunk").alias("id"), "entity").distinct(), "id")
    k = F.count("*").over(Window.partitionBy("query_id", "entity"))
    shared = spread.wide(held.select("query_id", "id", "entity").dropna(subset=["query_id", "entity"]), "query_id", "entity").withColumn("k", k).where("k > 1")
    shared = spread.wide(shared, "query_id", "id").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    factor = F.when(F.col("shared").isNull(), 0.85).otherwise(1 + F.least(F.lit(0.5), 0.2 * F.col("shared")))
    return rows.join(shared, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") * factor).alias("score"))


def keyword_overlap(keywords: DataFrame, asked: list[str], k: int) -> DataFrame:
    """(chunk, score): the sum of idf of the asked keywords that a chunk has, over the greatest such sum."""
    found = keywords.where(F.col("keyword").isin(*asked)).groupBy("chunk").agg(F.sum("idf").alias("s"))
    top = found.agg(F.max("s").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("chunk", (F.col("s") / F.col("top")).alias("score")).orderBy(F.col("score").desc(), "chunk").limit(k)  # top has one row


def core_chunks(ranks: DataFrame, ratio: float) -> DataFrame:
    """The max(1, int(n * ratio)) chunks (id, rank) of the greatest rank."""
    n = ranks.count()
    return ranks.orderBy(F.col("rank").desc(), "id").limit(max(1, int(n * ratio)))


def proper_noun_pairs(text: Column) -> Column:
    """All pairs of the distinct capitalised phrases of one or more words in a text, each in alphabetical order."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"), 1)))
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
