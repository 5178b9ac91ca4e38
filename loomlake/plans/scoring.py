"""Queries of the scoring operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources.readers import table
from .catalog import register, rounded

NOW = "TIMESTAMP '2024-06-30 00:00:00'"
SCORED = "s AS (SELECT user_id AS query_id, event_id AS id, value / 100 AS score, ts, event_type AS session, event_type AS source, event_type AS channel FROM events)"


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), "ts", F.col("event_type").alias("session"), F.col("event_type").alias("source"), F.col("event_type").alias("channel"))


def _q(name: str, sql: str):
    return register(name, f"WITH {SCORED}{sql}")


@_q("hybrid_store_rrf", """, v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk, count(*) OVER (PARTITION BY query_id) AS n FROM s WHERE channel IN ('click', 'view')),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT query_id, id, 1 - score AS score FROM s WHERE channel <> 'click')),
nv AS (SELECT query_id, count(*) AS nv FROM v GROUP BY ALL), nk AS (SELECT query_id, count(*) AS nk FROM k GROUP BY ALL)
SELECT query_id, id, round(0.7 / (60 + coalesce(v.rk, coalesce(nv, 0) + 100)) + (1 - 0.7) / (60 + coalesce(k.rk, coalesce(nk, 0) + 100)), 8) AS score
FROM v FULL JOIN k USING (query_id, id) LEFT JOIN nv USING (query_id) LEFT JOIN nk USING (query_id)""")
def hybrid_store_rrf(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    other = s.where("channel <> 'click'").select("query_id", "id", (1 - F.col("score")).alias("score"))
    return scoring.hybrid_rrf(s.where("channel IN ('click', 'view')"), other, 0.7).select("query_id", "id", _r("score", 8).alias("score"))


@_q("weighted_combine", " SELECT query_id AS id, round(sum(CASE channel WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'purchase' THEN 0.25 ELSE 0 END * score), 6) AS score FROM s GROUP BY query_id")
def weighted_combine(spark: SparkSession, d: str) -> DataFrame:
    lists = _scored(spark, d).select("channel", F.col("query_id").alias("id"), "score")
    return scoring.combine(lists, {"click": 2.0, "view": 1.0, "purchase": 1.0}).select("id", _r("score").alias("score"))


@_q("recency_boost", f", m AS (SELECT *, greatest(0, 1 - greatest(0, epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0 / 365) AS rec FROM s) SELECT id, round(score * power(greatest(rec, 0.3), 2 * 0.6), 6) AS score FROM m")
def recency_boost(spark: SparkSession, d: str) -> DataFrame:
    rec = scoring.linear_recency(F.col("ts"), F.expr(NOW), 365)
    return _scored(spark, d).select("id", _r(scoring.recency_boost(F.col("score"), rec, 0.6, 0.3)).alias("score"))


@_q("temporal_proximity", " SELECT id, round(exp(-greatest(0, epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts), epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 86400000000.0 / 7), 6) AS proximity, round(exp(-abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-12')) / 86400000000.0 / 7), 6) AS focal FROM s")
def temporal_proximity(spark: SparkSession, d: str) -> DataFrame:
    window = scoring.temporal_proximity(F.col("ts"), F.expr("TIMESTAMP '2024-01-10'"), F.expr("TIMESTAMP '2024-01-15'"))
    focal = scoring.temporal_proximity(F.col("ts"), F.expr("TIMESTAMP '2024-01-12'"), None)
    return _scored(spark, d).select("id", _r(window).alias("proximity"), _r(focal).alias("focal"))


@_q("temporal_rank_blend", " SELECT id, round((1 - 0.3) * score + 0.3 * (1 - (row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, id) - 1) / greatest(count(*) OVER (PARTITION BY query_id) - 1, 1)), 6) AS score FROM s")
def temporal_rank_blend(spark: SparkSession, d: str) -> DataFrame:
    return scoring.temporal_blend(_scored(spark, d), "query_id").select("id", rounded(F.col("blended")).alias("score"))


@register("version_penalty", "SELECT o_orderkey, round(1 - 0.7 * (1 - n / max(n) OVER (PARTITION BY o_custkey)), 6) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def version_penalty(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").withColumn("n", n).select("o_orderkey", _r(scoring.version_penalty(F.col("n"), "o_custkey")).alias("factor"))


@register("text_coherence", """WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) >= 6),
j AS (SELECT doc_id, a IN ('the', 'a', 'an', 'this', 'that', 'these', 'those') AS art, b IN ('in', 'of', 'to', 'for', 'with', 'on', 'at', 'by', 'from', 'about') AS prep,
  b IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'is', 'are', 'was', 'were', 'and', 'or', 'but', 'not') AS fn
  FROM p WHERE a IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'in', 'of', 'to', 'for', 'with', 'on', 'at', 'by', 'from', 'about')),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE CASE WHEN art THEN NOT (prep OR fn) ELSE NOT prep END) AS good FROM j GROUP BY doc_id)
SELECT doc_id, round(coalesce(good / n, 1.0), 6) AS coherence FROM w LEFT JOIN g USING (doc_id)""")
def text_coherence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", _r(scoring.coherence(F.col("text"))).alias("coherence"))


@_q("relevance_attach", ", f AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM s) SELECT f.query_id, f.id, rank, round(CASE WHEN f.id % 3 = 0 THEN f.score ELSE greatest(0, least(1, 2 * f.score - 0.5)) END, 6) AS score FROM f")
def relevance_attach(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("query_id", "id", "score")
    cosines = s.where("id % 3 <> 0").select("query_id", "id", (2 * F.col("score") - 0.5).alias("cosine"))
    return scoring.attach_relevance(s, cosines).select("query_id", "id", "rank", _r("score").alias("score"))


@_q("abstention_signals", """, g AS (SELECT query_id, count(*) AS n, max(score) AS top, count(*) FILTER (WHERE channel = 'purchase') AS e FROM s GROUP BY query_id)
SELECT query_id, e = 0 AS entities_empty, n = 0 AS chunks_empty, n < 5 AS chunks_below_min, top < 0.9 AS top_score_low, round(CAST(0.3 * CAST(e = 0 AS INT) + 0.4 * CAST(n < 5 AS INT) + 0.3 * CAST(top < 0.9 AS INT) AS DOUBLE), 6) AS combined_score,
  top < 0.9 OR (n = 0 AND e = 0) AS should_abstain, 0.3 * CAST(e = 0 AS INT) + 0.4 * CAST(n < 5 AS INT) + 0.3 * CAST(top < 0.9 AS INT) >= 0.5 AS weighted FROM g""")
def abstention_signals(spark: SparkSession, d: str) -> DataFrame:
    g = _scored(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.count_if(F.col("channel") == "purchase").alias("e"))
    x = lambda mode: scoring.abstention(F.col("n"), F.col("top"), F.col("e"), mode, 5, 0.9)
    return g.select("query_id", x("cosine_floor").alias("x"), x("weighted")["should_abstain"].alias("weighted")).select("query_id", "x.*", "weighted").withColumn("combined_score", _r("combined_score"))


@_q("confidence", ", t AS (SELECT query_id, max(score) FILTER (WHERE r = 1) AS a, coalesce(max(score) FILTER (WHERE r = 2), 0) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) GROUP BY query_id) SELECT query_id, round(0.8 * greatest(0, least(1, a / 0.5)) + 0.2 * greatest(0, least(1, (a - b) / 0.1)), 6) AS legacy, round(0.8 * greatest(0, least(1, a)) + 0.2 * greatest(0, least(1, (a - b) / 0.1)), 6) AS raw FROM t")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    best = F.sort_array(F.collect_list("score"), asc=False)
    top = _scored(spark, d).withColumn("r", F.row_number().over(scoring.by_score("query_id"))).where("r <= 2").groupBy("query_id").agg(best.alias("x"))
    a, b = F.col("x")[0], F.coalesce(F.get("x", F.lit(1)), F.lit(0.0))
    return top.select("query_id", _r(scoring.confidence(a, a - b)).alias("legacy"), _r(scoring.confidence(a, a - b, "raw_cosine")).alias("raw"))


@_q("rerank_blend", ", x AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE ((id * 37) % 101) / 100.0 END AS rr FROM s), y AS (SELECT *, min(rr) OVER w AS lo, max(rr) OVER w AS hi FROM x WINDOW w AS (PARTITION BY query_id)) SELECT id, round(coalesce(0.7 * CASE WHEN hi = lo THEN 0.5 ELSE (rr - lo) / (hi - lo) END + (1 - 0.7) * score, score), 6) AS score FROM (SELECT * FROM y WHERE rr IS NOT NULL OR hi IS NULL OR hi <> lo)")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    rr = F.when(F.col("id") % 5 != 0, (F.col("id") * 37) % 101 / 100.0)
    s = _scored(spark, d).withColumn("rerank", rr)
    w = Window.partitionBy("query_id")
    s = s.withColumn("lo", F.min("rerank").over(w)).withColumn("hi", F.max("rerank").over(w)).where("rerank IS NOT NULL OR hi IS NULL OR hi <> lo").drop("lo", "hi")
    return scoring.rerank_blend(s, "query_id").select("id", _r("blended").alias("score"))


@_q("mmr_gate", ", t AS (SELECT query_id, count(*) AS n, max(score) FILTER (WHERE r = 1) AS a, max(score) FILTER (WHERE r = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) GROUP BY query_id) SELECT query_id, n >= 3 AND coalesce(a - b, 1.0) <= 0.05 AS wanted FROM t")
def mmr_gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mmr_wanted(_scored(spark, d), "query_id", 3, 0.05)


@_q("rerank_window", """, a AS (SELECT query_id, count(DISTINCT channel) AS c FROM s GROUP BY query_id),
h AS (SELECT DISTINCT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS r FROM s) JOIN a USING (query_id) WHERE r <= 6 // c),
f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (h.id IS NOT NULL) DESC, score DESC, id) AS r FROM s LEFT JOIN h USING (query_id, id)) SELECT query_id, id FROM f WHERE r <= 6""")
def rerank_window(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return scoring.rerank_window(s.select("query_id", "channel", "id", "score"), s.select("query_id", "id", "score"), 6)


@_q("seed_round_robin", ", p AS (SELECT query_id, id % 50 AS id, channel AS mention, max(score) AS score FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, mention ORDER BY score DESC, id) AS r FROM p), o AS (SELECT query_id, id, min(struct_pack(r := r, m := mention)) AS x FROM r GROUP BY ALL) SELECT query_id, id, CAST(place AS INTEGER) AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS place FROM o) WHERE place <= 8")
def seed_round_robin(spark: SparkSession, d: str) -> DataFrame:
    p = _scored(spark, d).groupBy("query_id", (F.col("id") % 50).alias("id"), F.col("channel").alias("mention")).agg(F.max("score").alias("score"))
    return scoring.round_robin(p, 8)


@_q("seed_merge", ", f AS (SELECT query_id, id FROM s WHERE channel = 'click'), e AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE channel <> 'click') SELECT query_id, id, false AS added FROM f UNION ALL SELECT query_id, id, true FROM e WHERE r <= 2")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return scoring.merge_seeds(s.where("channel = 'click'"), s.select("query_id", "id", "score"), 2)


@_q("source_priority", " SELECT id, round(score * (0.5 + 0.5 * CASE source WHEN 'click' THEN 0.4 WHEN 'purchase' THEN 1.5 ELSE 1 END), 6) AS score FROM s WHERE source <> 'view'")
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    return scoring.source_priority(_scored(spark, d), {"click": 0.4, "purchase": 1.5}, ("view",)).select("id", _r("score").alias("score"))


@_q("presence_and_attributes", " SELECT id, round(CASE WHEN id % 4 = 0 THEN score ELSE score * greatest(0.5, (id % 3) / (id % 4)) END, 6) AS present, round(score + least(0.3, 0.1 * (id % 6)), 6) AS boosted FROM s")
def presence_and_attributes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return _scored(spark, d).select("id", _r(scoring.presence_penalty(F.col("score"), i % 3, i % 4)).alias("present"), _r(scoring.attribute_boost(F.col("score"), i % 6)).alias("boosted"))


@register("importance_selection", """WITH w AS (SELECT doc_id AS id, source, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL),
i AS (SELECT id, source, n, round(0.35 * least(1, (id % 7) / 5) + 0.25 * CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END + 0.2 * CASE WHEN n <= 1 THEN 1 ELSE abs(2 * p / (n - 1) - 1) END + 0.2 * least(1, len(w) / 200), 6) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS r FROM i) SELECT source, id, score FROM r WHERE r <= greatest(1, floor(n * 0.25)) AND score >= 0.5""")
def importance_selection(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("source")
    docs = table(spark, d, "documents").where("text IS NOT NULL").withColumn("p", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(w))
    score = scoring.importance(F.col("doc_id") % 7, F.col("text"), F.col("p"), F.col("n"))
    return scoring.top_ratio(docs.select("source", F.col("doc_id").alias("id"), _r(score).alias("score")), "source", 0.25, 0.5)


@_q("session_fanout", """, c AS (SELECT query_id, count(DISTINCT session) AS c FROM s GROUP BY query_id)
SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, session ORDER BY score DESC, id) AS r FROM s) JOIN c USING (query_id) WHERE r <= greatest(3, 10 // c)
UNION SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""")
def session_fanout(spark: SparkSession, d: str) -> DataFrame:
    return scoring.session_fanout(_scored(spark, d), 10)


@register("offset_page", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").offset(40).limit(20).select("event_id", "user_id")


@_q("candidate_pool", " SELECT query_id AS id, arg_min(channel, struct_pack(p := CASE channel WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 0 END, s := -score, c := channel)) AS channel, round(arg_min(score, struct_pack(p := CASE channel WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 0 END, s := -score, c := channel)), 6) AS score FROM s WHERE channel IN ('purchase', 'click', 'view') GROUP BY query_id")
def candidate_pool(spark: SparkSession, d: str) -> DataFrame:
    lists = _scored(spark, d).where("channel IN ('purchase', 'click', 'view')").select("channel", F.col("query_id").alias("id"), "score")
    return scoring.first_seen(lists, ["purchase", "click", "view"]).withColumn("score", _r("score"))


@_q("session_intersection", " SELECT query_id, channel FROM s WHERE score > 0.5 INTERSECT SELECT query_id, channel FROM s WHERE score < 0.2")
def session_intersection(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.where("score > 0.5").select("query_id", "channel").intersect(s.where("score < 0.2").select("query_id", "channel"))


@_q("deleted_sources", " SELECT query_id, channel FROM s WHERE score > 0.5 EXCEPT SELECT query_id, channel FROM s WHERE score < 0.2")
def deleted_sources(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.where("score > 0.5").select("query_id", "channel").subtract(s.where("score < 0.2").select("query_id", "channel"))


@register("walk_arms", "SELECT o_custkey AS a, o_orderkey AS b FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders")
def walk_arms(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    return o.unionByName(o.select(F.col("b").alias("a"), F.col("a").alias("b")))


@register("window_narrowing", "SELECT user_id, greatest(min(ts), TIMESTAMP '2024-01-05') AS low, least(max(ts), TIMESTAMP '2024-01-25') AS high FROM events GROUP BY user_id")
def window_narrowing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    low, high = scoring.narrow(F.col("a"), F.col("b"), F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-25'"))
    return e.select("user_id", low.alias("low"), high.alias("high"))


@register("window_frames", "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER w, 6) AS share, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.ntile(4).over(w).alias("quarter"), _r(F.percent_rank().over(w)).alias("share"), _r(F.avg("value").over(w.rowsBetween(-2, 0))).alias("moving"))


@_q("min_max_variants", " SELECT id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS one, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS half FROM s WINDOW w AS (PARTITION BY query_id, channel)")
def min_max_variants(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("g", F.concat_ws("/", "query_id", "channel"))
    return s.select("id", _r(scoring.min_max(F.col("score"), "g")).alias("one"), _r(scoring.min_max(F.col("score"), "g", 0.5)).alias("half"))


@_q("shadow_scoring", """, b AS (SELECT query_id, id, ((id * 37) % 101) / 100.0 AS score FROM s WHERE id % 5 <> 0),
x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS ra FROM s), y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rb FROM b),
z AS (SELECT * FROM x FULL JOIN y USING (query_id, id)), k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ra) - row_number() OVER (PARTITION BY query_id ORDER BY rb) AS d FROM z WHERE ra IS NOT NULL AND rb IS NOT NULL),
r AS (SELECT query_id, CASE WHEN count(*) > 1 THEN 1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)) END AS rho FROM k GROUP BY query_id)
SELECT query_id, round(any_value(rho), 6) AS rho, round(count(*) FILTER (WHERE coalesce(ra <= 5, false) AND coalesce(rb <= 5, false)) / count(*) FILTER (WHERE coalesce(ra <= 5, false) OR coalesce(rb <= 5, false)), 6) AS overlap FROM z LEFT JOIN r USING (query_id) GROUP BY query_id""")
def shadow_scoring(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("query_id", "id", "score")
    other = s.where("id % 5 <> 0").select("query_id", "id", ((F.col("id") * 37) % 101 / 100.0).alias("score"))
    return scoring.rank_agreement(s, other, 5).select("query_id", _r("rho").alias("rho"), _r("overlap").alias("overlap"))
