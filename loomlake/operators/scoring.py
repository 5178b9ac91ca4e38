"""Scores after retrieval: blends, boosts, penalties, quotas and signals, as columns and window plans.

Lists are (channel, id, score), or (query_id, id, score) where a query is named; windows
go by channel or query, never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import min_max

#: Words after which a bigram is judged, and words that may not follow an article.
ARTICLES = ["the", "a", "an", "this", "that", "these", "those"]
PREPOSITIONS = ["in", "of", "to", "for", "with", "on", "at", "by", "from", "about"]
LINKING = ["is", "are", "was", "were", "and", "or", "but", "not"]


def clip01(x: Column) -> Column:
    """Cut to 0..1; null stays null (greatest and least alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def by_score(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")


def hybrid_rrf(vector: DataFrame, keyword: DataFrame, alpha: float, k: int = 60, vector_only: bool = False) -> DataFrame:
    """(query_id, id, score): alpha / (k + vector rank) + (1 - alpha) / (k + keyword rank).

    A rank that is missing counts as the list's length and 100 more. With `vector_only`,
    ids that the keyword list alone has are left out.
    """
    placed = lambda x, n: x.select("query_id", "id", F.row_number().over(by_score("query_id")).alias(n))
    sizes = vector.groupBy("query_id").agg(F.count("*").alias("nv")).join(keyword.groupBy("query_id").agg(F.count("*").alias("nk")), "query_id", "full")
    both = placed(vector, "rv").join(placed(keyword, "rk"), ["query_id", "id"], "left" if vector_only else "full").join(sizes, "query_id")
    rank = lambda r, n: F.coalesce(F.col(r), F.coalesce(n, F.lit(0)) + 100)
    return both.select("query_id", "id", (alpha / (k + rank("rv", "nv")) + (1 - alpha) / (k + rank("rk", "nk"))).alias("score"))


def combine(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, score): sum of weight * score, with the weights scaled to a sum of 1; channels without a weight count 0."""
    total = sum(weights.values()) or 1.0
    known = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, w / total)])
    return lists.groupBy("id").agg(F.sum(F.coalesce(F.element_at(known, F.col("channel")), F.lit(0.0)) * F.col("score")).alias("score"))


def recency_boost(score: Column, recency: Column, weight: float = 0.2, floor: float = 0.5) -> Column:
    """score * max(recency, floor) ** (2 * weight); a null recency is the floor."""
    return score * F.pow(F.greatest(F.coalesce(recency, F.lit(floor)), F.lit(floor)), F.lit(2 * weight))


def linear_recency(ts: Column, now: Column, days: float) -> Column:
    """1 now, 0 after `days`; times ahead of now count as now."""
    return F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0) / days)


def temporal_proximity(ts: Column, start: Column | None, end: Column | None) -> Column:
    """1 within [start, end], else exp(-days outside / 7); one bound, or equal ones, is a focal date; null without a time."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    if start is None and end is None:
        return F.when(ts.isNotNull(), F.lit(0.5))
    low, high = us(start if start is not None else end), us(end if end is not None else start)
    off = F.greatest(F.lit(0), low - us(ts), us(ts) - high) / 86_400_000_000.0
    return F.when(ts.isNotNull(), F.exp(-off / 7))


def temporal_blend(rows: DataFrame, by: str, weight: float = 0.3, oldest_first: bool = False) -> DataFrame:
    """Adds `blended`: (1 - w) * score + w * (1 - place / (n - 1)) by time within `by`; rows without a time come last."""
    order = F.col("ts").asc_nulls_first() if oldest_first else F.col("ts").desc_nulls_last()
    place = F.row_number().over(Window.partitionBy(by).orderBy(order, "id")) - 1
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumn("blended", (1 - weight) * F.col("score") + weight * (1 - place / F.greatest(n - 1, F.lit(1))))


def version_penalty(version: Column, by: str, weight: float = 0.7) -> Column:
    """1 - w * (1 - version / latest version of the group)."""
    return 1 - weight * (1 - version / F.max(version).over(Window.partitionBy(by)))


def coherence(text: Column) -> Column:
    """Share of plausible word pairs after articles and prepositions; 1 for texts of under 6 words or without such pairs."""
    one = lambda xs: rf"(?:{'|'.join(xs)})"
    start, then = r"(?<![^ ])", lambda xs: rf"(?= (?!{one(xs)}(?![^ ])))"
    pairs = rf"{start}{one(ARTICLES + PREPOSITIONS)}(?= )"
    plausible = rf"{start}(?:{one(ARTICLES)}{then(ARTICLES + PREPOSITIONS + LINKING)}|{one(PREPOSITIONS)}{then(PREPOSITIONS)})"
    count = lambda x, p: F.size(F.regexp_extract_all(x, F.lit(p), 0))
    share = lambda x: F.when(x.rlike(r"^(?:[^ ]* ){5}"), F.coalesce(F.try_divide(count(x, plausible), count(x, pairs)), F.lit(1.0))).otherwise(F.lit(1.0))
    return F.transform(F.array(F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))), share)[0]  # as an array, so that the text is prepared once


def coherence_boost(score: Column, text: Column, weight: float = 0.1) -> Column:
    return (1 - weight) * score + weight * coherence(text)


def attach_relevance(fused: DataFrame, cosines: DataFrame) -> DataFrame:
    """Ranks by the fused score, then shows the cosine, clipped to 0..1, in its place where it is known."""
    ranked = fused.withColumn("rank", F.row_number().over(by_score("query_id")))
    return ranked.join(cosines.select("query_id", "id", "cosine"), ["query_id", "id"], "left").withColumn("score", F.coalesce(clip01(F.col("cosine")), "score")).drop("cosine")


def abstention(chunks: Column, top: Column, entities: Column, mode: str = "cosine_floor", min_chunks: int = 1, min_top: float = 0.3, threshold: float = 0.5) -> Column:
    """A struct of four flags, their weighted sum (0.3, 0.4, 0.3) and whether to abstain."""
    if mode not in ("cosine_floor", "weighted"):
        raise ValueError(f"unknown mode: {mode}")
    no_entities, no_chunks, few, low = entities == 0, chunks == 0, chunks < min_chunks, top < min_top
    total = 0.3 * no_entities.cast("double") + 0.4 * few.cast("double") + 0.3 * low.cast("double")
    stop = total >= threshold if mode == "weighted" else low | (no_chunks & no_entities)
    return F.struct(no_entities.alias("entities_empty"), no_chunks.alias("chunks_empty"), few.alias("chunks_below_min"), low.alias("top_score_low"), total.alias("combined_score"), stop.alias("should_abstain"))


def confidence(top: Column, gap: Column, mode: str = "legacy", target: float = 0.5, target_gap: float = 0.1) -> Column:
    return 0.8 * clip01(top if mode == "raw_cosine" else top / target) + 0.2 * clip01(gap / target_gap)


def rerank_blend(rows: DataFrame, by: str, weight: float = 0.7) -> DataFrame:
    """Adds `blended`: w * min-max of `rerank` within `by` (0.5 if all are equal) + (1 - w) * score; unranked rows keep their score."""
    norm = min_max(F.col("rerank"), by, 0.5)
    return rows.withColumn("blended", F.coalesce(weight * norm + (1 - weight) * F.col("score"), "score"))


def mmr_wanted(rows: DataFrame, by: str, least: int = 3, gap: float = 0.35) -> DataFrame:
    """(by, wanted): diversity pays with `least` candidates and more and a gap between the best two of `gap` at most."""
    top = rows.groupBy(by).agg(F.count("*").alias("n"), F.max("score").alias("a"))
    second = rows.withColumn("r", F.row_number().over(by_score(by))).where("r = 2").select(by, F.col("score").alias("b"))
    return top.join(second, by, "left").select(by, ((F.col("n") >= least) & (F.coalesce(F.col("a") - F.col("b"), F.lit(1.0)) <= gap)).alias("wanted"))


def rerank_window(lists: DataFrame, fused: DataFrame, n: int) -> DataFrame:
    """The ids (query_id, id) to rerank: floor(n / channels) of the best of each active channel, then the best fused up to n."""
    active = lists.groupBy("query_id").agg(F.countDistinct("channel").alias("active"))
    place = F.row_number().over(by_score("query_id", "channel"))
    held = lists.withColumn("r", place).join(active, "query_id").where(F.col("r") <= F.floor(F.lit(n) / F.col("active"))).select("query_id", "id").distinct().withColumn("held", F.lit(1))
    rest = fused.join(held, ["query_id", "id"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    best = Window.partitionBy("query_id").orderBy(F.col("held").desc(), F.col("score").desc(), "id")
    return rest.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n).select("query_id", "id")


def round_robin(seeds: DataFrame, most: int) -> DataFrame:
    """(query_id, id, place): each mention's best first, then its second and so on; an id counts once; `most` in all."""
    placed = seeds.withColumn("r", F.row_number().over(by_score("query_id", "mention")))
    once = placed.groupBy("query_id", "id").agg(F.min(F.struct("r", "mention")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "id", "place")


def merge_seeds(first: DataFrame, extra: DataFrame, most: int) -> DataFrame:
    """(query_id, id, added): the seeds, and at most `most` others, best first."""
    new = extra.join(first.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("r", F.row_number().over(by_score("query_id")))
    return first.select("query_id", "id", F.lit(False).alias("added")).union(new.where(F.col("r") <= most).select("query_id", "id", F.lit(True)))


def source_priority(rows: DataFrame, weights: dict[str, float], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Drops rows of some sources and scales the others' scores by 0.5 + 0.5 * weight (1 where none is given)."""
    known = F.create_map(*[F.lit(x) for c, w in weights.items() for x in (c, w)])
    kept = rows.where(~F.coalesce(F.col("source").isin(*dropped), F.lit(False))) if dropped else rows
    return kept.withColumn("score", F.col("score") * (0.5 + 0.5 * F.coalesce(F.element_at(known, F.col("source")), F.lit(1.0))))


def presence_penalty(score: Column, matched: Column, wanted: Column) -> Column:
    """score * max(0.5, matched / wanted); without wanted entities the score stays."""
    return F.when(wanted == 0, score).otherwise(score * F.greatest(F.lit(0.5), matched / wanted))


def attribute_boost(score: Column, hits: Column) -> Column:
    return score + F.least(F.lit(0.3), 0.1 * hits)


def importance(entities: Column, text: Column, position: Column, n: Column) -> Column:
    """0.35 entities (5 are full) + 0.25 distinct words' share + 0.2 place (the edges count most) + 0.2 length (200 words are full)."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    size = F.size(words)
    variety = F.when(size > 0, F.size(F.array_distinct(words)) / size).otherwise(0.0)
    edge = F.when(n <= 1, F.lit(1.0)).otherwise(F.abs(2 * position / (n - 1) - 1))
    return 0.35 * F.least(F.lit(1.0), entities / 5) + 0.25 * variety + 0.2 * edge + 0.2 * F.least(F.lit(1.0), size / 200)


def top_ratio(rows: DataFrame, by: str, ratio: float, least: float = 0.0) -> DataFrame:
    """Of each group the best max(1, int(n * ratio)) rows with a score of `least` and more."""
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumn("_n", n).withColumn("_r", F.row_number().over(by_score(by))).where((F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))) & (F.col("score") >= least)).drop("_n", "_r")


def session_fanout(rows: DataFrame, limit: int) -> DataFrame:
    """(query_id, id): the best max(3, limit // sessions) of each session, and the best `limit` of all."""
    sessions = rows.groupBy("query_id").agg(F.countDistinct("session").alias("sessions"))
    own = rows.withColumn("r", F.row_number().over(by_score("query_id", "session"))).join(sessions, "query_id")
    own = own.where(F.col("r") <= F.greatest(F.lit(3), F.floor(F.lit(limit) / F.col("sessions")))).select("query_id", "id")
    whole = rows.withColumn("r", F.row_number().over(by_score("query_id"))).where(F.col("r") <= limit).select("query_id", "id")
    return own.union(whole).distinct()


def first_seen(lists: DataFrame, priority: list[str]) -> DataFrame:
    """One row for each id: from the channel of the highest priority, there the best."""
    at = F.array_position(F.array(*map(F.lit, priority)), F.col("channel"))
    return lists.groupBy("id").agg(F.min_by(F.struct("channel", "score"), F.struct(at, -F.col("score"))).alias("x")).select("id", "x.*")


def narrow(low: Column, high: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """The common part of two windows; a null bound is open."""
    return F.greatest(low, lower), F.least(high, upper)


def rank_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(query_id, rho, overlap) of two orderings: Spearman's rho over common ids, and the Jaccard share of the best k of each."""
    placed = lambda x, n: x.select("query_id", "id", F.row_number().over(by_score("query_id")).alias(n))
    both = placed(a, "ra").join(placed(b, "rb"), ["query_id", "id"], "full")
    w = lambda c: F.row_number().over(Window.partitionBy("query_id", F.col("ra").isNotNull() & F.col("rb").isNotNull()).orderBy(c))
    known = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    again = both.withColumn("x", F.when(known, w("ra"))).withColumn("y", F.when(known, w("rb")))
    n, d2 = F.count_if(known), F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))
    top_a, top_b = F.coalesce(F.col("ra") <= k, F.lit(False)), F.coalesce(F.col("rb") <= k, F.lit(False))
    return again.groupBy("query_id").agg(F.when(n > 1, 1 - 6 * d2 / (n * (n * n - 1))).alias("rho"), (F.count_if(top_a & top_b) / F.count_if(top_a | top_b)).alias("overlap"))
