"""Queries over the test tables that exercise the operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import filters, graph, lexical, ranking, store, vectors
from ..sources.readers import table
from .catalog import register

NOW = "TIMESTAMP '2024-06-30 00:00:00'"
QUERY = ["tion", "there", "there", "thing"]


def _r(c, digits: int = 6):
    return F.round(c, digits)


# ---- lexical and vector search, fusion -------------------------------------------------

BM25_SQL = r"""
t AS (SELECT doc_id AS id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS w FROM documents) GROUP BY ALL),
l AS (SELECT id, sum(tf) AS len FROM t GROUP BY id), s AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q(term, times) AS (VALUES ('tion', 1), ('there', 2), ('thing', 1)),
h AS (SELECT * FROM t JOIN q USING (term)), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
  FROM h JOIN f USING (term) JOIN l USING (id), s GROUP BY id)"""


@register("bm25_search", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), "doc_id", lexical.words(F.col("text")), QUERY, 20).select("id", _r("score").alias("score"))


COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").first().embedding


@register("knn_vectors", f"SELECT id, score FROM (SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 20) WHERE score >= 0.1")
def knn_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 20, 0.1, "vec_id").select("id", _r("score").alias("score"))


@register("block_cosine_join", "WITH k AS (SELECT DISTINCT vec_id, unnest(list_transform(range(0, 8), lambda b: b || ':' || array_to_string(list_transform(embedding[b * 8 + 1 : b * 8 + 8], lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), ''))) AS k FROM embeddings), p AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM k a JOIN k b ON a.k = b.k AND a.vec_id < b.vec_id), s AS (SELECT a, b, " + COS + " AS score FROM p JOIN embeddings e ON e.vec_id = a JOIN embeddings q ON q.vec_id = b) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.3")
def block_cosine_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.block_pairs(e, vectors.sign_keys(F.col("embedding"), 8, 8), "vec_id", 0.3).select("a", "b", _r("score").alias("score"))


@register("knn_entities", f"SELECT id, score FROM (SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.label < 5) WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 15")
def knn_entities(spark: SparkSession, d: str) -> DataFrame:
    """The best of those above the floor, within a scope."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").first().embedding
    return vectors.nearest(e.where("label < 5"), q, 15, 0.2, "vec_id").select("id", _r("score").alias("score"))


RECENT = "r AS (SELECT vec_id, ts FROM embeddings JOIN events ON event_id = vec_id ORDER BY ts DESC, vec_id LIMIT 200)"


@register("recency_channel", f"WITH {RECENT} SELECT e.vec_id AS id, round({COS}, 6) AS score FROM r JOIN embeddings e USING (vec_id), embeddings q WHERE q.vec_id = 0 AND {COS} >= 0.1")
def recency_channel(spark: SparkSession, d: str) -> DataFrame:
    """The most recent rows, then those of them that are near enough."""
    e, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    recent = e.join(table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id").orderBy(F.col("ts").desc(), "vec_id").limit(200)
    asked = F.array(*[F.lit(float(x)) for x in q])
    return recent.select(F.col("vec_id").alias("id"), vectors.cosine(F.col("embedding"), asked).alias("score")).where("score >= 0.1").withColumn("score", _r("score"))


@register("label_centroids", "WITH f AS (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS v FROM f GROUP BY ALL) SELECT label, CAST(dim AS INTEGER) AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM m")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label").select("label", "dim", _r("value").alias("value"))


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Two channels over event types' users: total value and count of events."""
    e = table(spark, d, "events")
    a = e.groupBy(F.col("user_id").alias("id")).agg(F.round(F.sum("value"), 4).alias("score")).select(F.lit("value").alias("channel"), "id", "score")
    b = e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("double").alias("score")).select(F.lit("count").alias("channel"), "id", "score")
    return a.union(b)


LISTS = """
l AS (SELECT 'value' AS channel, user_id AS id, round(sum(value), 4) AS score FROM events GROUP BY user_id
  UNION ALL SELECT 'count', user_id, CAST(count(*) AS DOUBLE) FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS rank,
  CASE WHEN max(score) OVER (PARTITION BY channel) = min(score) OVER (PARTITION BY channel) THEN 1.0
    ELSE (score - min(score) OVER (PARTITION BY channel)) / (max(score) OVER (PARTITION BY channel) - min(score) OVER (PARTITION BY channel)) END AS norm,
  CASE channel WHEN 'value' THEN 0.6 ELSE 0.4 END AS w FROM l)"""
WEIGHTS = {"value": 0.6, "count": 0.4}


def _fused(name: str, f, expression: str) -> None:
    @register(name, f"WITH {LISTS} SELECT id, round({expression}, 6) AS score, count(*) AS channels FROM r GROUP BY id")
    def fused(spark: SparkSession, d: str) -> DataFrame:
        return f(_channels(spark, d)).select("id", _r("score").alias("score"), "channels")


_fused("rrf", ranking.rrf, "sum(1.0 / (60 + rank))")
_fused("rrf_weighted", lambda x: ranking.rrf(x, WEIGHTS), "sum(w / (60 + rank))")
_fused("rrf_normalised", lambda x: ranking.normalised_rrf(x, WEIGHTS), "sum(w / (60 + rank) + 0.01 * w * norm)")
_fused("calibrated_fusion", lambda x: ranking.calibrated(x, WEIGHTS), "sum(w * norm)")
_fused("comb_mnz", lambda x: ranking.comb_mnz(x, WEIGHTS), "count(*) * sum(w / (60 + rank))")


@register("best_rank_interleave", f"WITH {LISTS}, b AS (SELECT id, min(rank) AS best_rank, count(*) AS channels, min(struct_pack(r := rank, p := CASE channel WHEN 'value' THEN 0 ELSE 1 END, n := -norm)) AS x FROM r GROUP BY id) SELECT id, best_rank, channels, round(1.0 / (60 + row_number() OVER (ORDER BY best_rank, channels DESC, x.p, x.n, CAST(id AS VARCHAR))), 8) AS score FROM b")
def best_rank_interleave(spark: SparkSession, d: str) -> DataFrame:
    return ranking.interleave(_channels(spark, d), ["value", "count"]).select("id", F.col("best_rank").cast("long").alias("best_rank"), "channels", _r("score", 8).alias("score"))


@register("hybrid_recall", f"""WITH {BM25_SQL}, v AS (SELECT e.vec_id AS id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 50),
lx AS (SELECT id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, id LIMIT 50),
u AS (SELECT 'vector' AS c, * FROM v UNION ALL SELECT 'lexical', * FROM lx),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, id) AS rank FROM u)
SELECT id, round(sum(CASE c WHEN 'vector' THEN 0.6 ELSE 0.4 END / (60 + rank)), 8) AS score, count(*) AS channels FROM k GROUP BY id""")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    """Vector and lexical channels over documents (vec_id is taken as doc_id), fused by weighted rank."""
    v = vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 50, -1.0, "vec_id").select(F.lit("vector").alias("channel"), "id", _r("score").alias("score"))
    x = lexical.search(table(spark, d, "documents"), "doc_id", lexical.words(F.col("text")), QUERY, 50).select(F.lit("lexical").alias("channel"), "id", _r("score").alias("score"))
    return ranking.rrf(v.union(x), {"vector": 0.6, "lexical": 0.4}).select("id", _r("score", 8).alias("score"), "channels")


@register("mmr_diversity")
def mmr_diversity(spark: SparkSession, d: str) -> DataFrame:
    e, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    near = vectors.nearest(e, q, 100, -1.0, "vec_id")
    return ranking.mmr(near.join(e, near.id == e.vec_id).select(F.lit(0).alias("query_id"), "id", "score", "embedding"), 20)


# ---- filters ---------------------------------------------------------------------------


def _filter(name: str, document: dict, where: str) -> None:
    @register(name, f"SELECT event_id FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE {where}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        columns = {"occurred_at": F.col("ts"), "source_type": F.col("event_type")}
        return table(spark, d, "events").where(filters.compile_filter(document, columns, F.col("props"))).select("event_id")


_filter("filter_eq", {"source_type": "click"}, "coalesce(event_type = 'click', false)")
_filter("filter_ne", {"source_type": {"$ne": "click"}}, "NOT coalesce(event_type = 'click', false)")
_filter("filter_in", {"source_type": {"$in": ["click", "view"]}}, "coalesce(event_type IN ('click', 'view'), false)")
_filter("filter_nin", {"source_type": {"$nin": ["click", "view"]}}, "NOT coalesce(event_type IN ('click', 'view'), false)")
_filter("filter_date_range", {"occurred_at": {"$gte": "2024-01-05", "$lt": "2024-01-20"}}, "coalesce(ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20', false)")
_filter("filter_metadata_eq", {"metadata.k": 7}, "coalesce(k = 7, false)")
_filter("filter_metadata_range", {"metadata.k": {"$gt": 20, "$lte": 60}}, "coalesce(k > 20 AND k <= 60, false)")
_filter("filter_metadata_type_gate", {"$or": [{"metadata.k": {"$gt": "20"}}, {"metadata.k": {"$lt": 10}}]}, "coalesce(k < 10, false)")
_filter("filter_metadata_exists", {"metadata.k": {"$exists": True}, "$or": [{"metadata.missing": {"$exists": True}}, {"metadata.k": {"$gte": 50}}]}, "coalesce(k >= 50, false)")
_filter("filter_metadata_in", {"metadata.k": {"$in": [1, 2, 3]}}, "coalesce(k IN (1, 2, 3), false)")
_filter("filter_null", {"metadata.missing": None, "metadata.k": {"$ne": None, "$lt": 50}}, "coalesce(k < 50, false)")
_filter("filter_or_not", {"$or": [{"source_type": "click"}, {"metadata.k": {"$lt": 10}}], "$not": {"metadata.k": 5}}, "(coalesce(event_type = 'click', false) OR coalesce(k < 10, false)) AND NOT coalesce(k = 5, false)")
_filter("filter_nor", {"$nor": [{"source_type": "click"}, {"metadata.k": {"$gte": 50}}]}, "NOT (coalesce(event_type = 'click', false) OR coalesce(k >= 50, false))")
_filter("filter_field_not", {"metadata.k": {"$not": {"$gte": 10, "$lt": 90}}}, "NOT coalesce(k >= 10 AND k < 90, false)")
_filter("filter_exact_array", {"$or": [{"source_type": ["click"]}, {"source_type": "view"}]}, "event_type = 'view'")

_filter("filter_blob", {"metadata": {"k": 7}}, "coalesce(k = 7, false)")
_filter("filter_nested_groups", {"$or": [{"$or": [{"source_type": "click"}, {"$and": [{"metadata.k": {"$lt": 10}}]}]}, {"$nor": [{"metadata.k": {"$lt": 90}}]}]}, "coalesce(event_type = 'click' OR k < 10, false) OR NOT coalesce(k < 90, false)")


@register("filter_pushdown", "SELECT event_id FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type <> 'view' AND (k < 30 OR event_type = 'click')")
def filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Date bounds and the part of a filter on stored columns reach the scan, the rest is held against what it returns."""
    node = filters.parse({"occurred_at": {"$gte": "2024-01-05", "$lt": "2024-01-25"}, "source_type": {"$ne": "view"}, "$or": [{"metadata.k": {"$lt": 30}}, {"source_type": "click"}]})
    columns = {"occurred_at": F.col("ts"), "source_type": F.col("event_type")}
    low, high = filters.date_bounds(node, "occurred_at")
    pushed, rest = filters.split(node, {"occurred_at", "source_type"})
    rows = table(spark, d, "events").where((F.col("ts") >= F.lit(low.replace(tzinfo=None)).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(high.replace(tzinfo=None)).cast("timestamp_ntz")))
    return rows.where(filters.compile_filter(pushed, columns, F.col("props"))).where(filters.compile_filter(rest, columns, F.col("props"))).select("event_id")


# ---- time ------------------------------------------------------------------------------


@register("recency_decay", f"SELECT event_id, round(value * (0.7 + 0.3 * power(0.5, greatest(0, epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0 / 7)), 6) AS score FROM events")
def recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", _r(ranking.decay(F.col("value"), F.col("ts"), F.expr(NOW))).alias("score"))


@register("soft_temporal_score", """WITH o AS (SELECT event_id, value, greatest(0, epoch_us(TIMESTAMP '2024-01-10') - epoch_us(ts), epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15')) / 86400000000.0 AS d FROM events)
SELECT event_id, round(value * power(0.5, d / 7), 6) AS score FROM o WHERE d <= 30""")
def soft_temporal_score(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.soft_window(F.col("value"), F.col("ts"), F.expr("TIMESTAMP '2024-01-10'"), F.expr("TIMESTAMP '2024-01-15'"))
    return table(spark, d, "events").select("event_id", _r(s).alias("score")).where(F.col("score").isNotNull())


@register("session_gaps", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g")
def session_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sessionize(table(spark, d, "events"), "user_id", "ts", 1800).select("event_id", "user_id", F.col("session").cast("long").alias("session"))


@register("session_episodes", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS occurred_at, nullif((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000, 0) AS seconds, count(*) AS events FROM s GROUP BY ALL")
def session_episodes(spark: SparkSession, d: str) -> DataFrame:
    s = ranking.sessionize(table(spark, d, "events"), "user_id", "ts", 1800)
    span = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000)
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.min("ts").alias("occurred_at"), F.nullif(span, F.lit(0)).cast("long").alias("seconds"), F.count("*").alias("events"))


@register("time_hierarchy", "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def time_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("month", "ts").alias("month"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), _r(F.sum("value"), 4).alias("total"))


@register("version_as_of", "SELECT o_custkey, o_orderkey FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders) WHERE o_orderdate <= TIMESTAMP '1998-01-01' AND (until IS NULL OR until > TIMESTAMP '1998-01-01')")
def version_as_of(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    versions = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_until"))
    return graph.valid_at(versions, F.expr("TIMESTAMP '1998-01-01'")).select("o_custkey", "o_orderkey")


@register("version_history", "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS superseded_by, lead(o_orderkey) OVER w IS NULL AS is_active FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    return store.supersede(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "superseded_by", "is_active")


@register("latest_per_user", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return store.latest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id")


@register("version_decay", "SELECT o_orderkey, round(sqrt(n / max(n) OVER (PARTITION BY o_custkey)), 6) AS factor FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def version_decay(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").withColumn("n", n).select("o_orderkey", _r(ranking.version_decay(F.col("n"), "o_custkey")).alias("factor"))


@register("event_log_scan", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-01' ORDER BY ts DESC, event_id LIMIT 100")
def event_log_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-01'")
    return e.orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "event_type")


@register("keyset_page", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 500) ORDER BY ts DESC, event_id DESC LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    return store.page(table(spark, d, "events"), "ts", "event_id", 50, (datetime(2024, 1, 15), 500)).select("event_id")


# ---- graph -----------------------------------------------------------------------------

MENTIONS = "m AS (SELECT DISTINCT l_suppkey AS entity, l_orderkey AS chunk FROM lineitem)"
EDGES = f"{MENTIONS}, e AS (SELECT a.entity AS a, b.entity AS b, count(*) AS n FROM m a JOIN m b ON a.chunk = b.chunk AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("chunk"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence(_mentions(spark, d)).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))


@register("co_occurrence", f"WITH {EDGES} SELECT a, b, n, round(CAST(least(0.7, 0.3 + 0.1 * n) AS DOUBLE), 6) AS confidence FROM e")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_occurrence(_mentions(spark, d)).select("a", "b", "n", _r("confidence").alias("confidence"))


@register("degree_stats", f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id")
def degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


NATIONS = "g AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation), u AS (SELECT * FROM g UNION SELECT dst, src FROM g)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"), F.lit(1.0).alias("weight"))


@register("k_hop", f"WITH RECURSIVE {NATIONS}, w(id, k) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, k + 1 FROM w JOIN u ON src = id WHERE k < 3) SELECT CAST(0 AS BIGINT) AS seed, CAST(id AS BIGINT) AS id, min(k) AS distance FROM w GROUP BY ALL")
def k_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.hops(_nations(spark, d), spark.createDataFrame([(0,)], "id long"), 3)


@register("components", "SELECT o_orderkey AS id, o_orderkey // 200 * 200 AS component FROM orders")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Chains of 200 orders each: a long path must come together."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"))
    chain = o.join(o.select(F.col("src").alias("dst")), F.col("dst") == F.col("src") + 1, "left")
    return graph.connected(chain.select("src", F.when(F.col("src") % 200 != 199, F.col("dst")).alias("dst")).select("src", F.coalesce("dst", "src").alias("dst")))


def _rank_sql(rounds: int) -> str:
    """PageRank as one CTE for each round."""
    base = f"WITH {EDGES}, x AS (SELECT a AS src, b AS dst, n AS w FROM e UNION ALL SELECT b, a, n FROM e), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM x), p AS (SELECT DISTINCT src AS id, 1.0 / (SELECT count(DISTINCT src) FROM x) AS p FROM x), r0 AS (SELECT id, p AS r FROM p)"
    for k in range(rounds):
        base += f", r{k + 1} AS (SELECT p.id, 0.15 * any_value(p) + 0.85 * coalesce(sum(r * w), 0) AS r FROM p LEFT JOIN s ON s.dst = p.id LEFT JOIN r{k} ON r{k}.id = s.src GROUP BY p.id)"
    return base + f" SELECT id, round(r, 8) AS rank FROM r{rounds}"


@register("pagerank", _rank_sql(5))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    both = e.union(e.select("dst", "src", "weight"))
    return graph.pagerank(both, rounds=5).select("id", _r("rank", 8).alias("rank"))


def _personal_sql(rounds: int) -> str:
    base = _rank_sql(rounds)
    return base.replace("p AS (SELECT DISTINCT src AS id, 1.0 / (SELECT count(DISTINCT src) FROM x) AS p FROM x)", "p AS (SELECT id, CASE WHEN id < 5 THEN (id + 1) / (SELECT sum(id + 1) FROM (SELECT DISTINCT src AS id FROM x) WHERE id < 5) ELSE 0 END AS p FROM (SELECT DISTINCT src AS id FROM x))")


@register("personalised_pagerank", _personal_sql(4))
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    seeds = table(spark, d, "supplier").where("s_suppkey < 5").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1.0).alias("score"))
    return graph.pagerank(e.union(e.select("dst", "src", "weight")), rounds=4, seeds=seeds).select("id", _r("rank", 8).alias("rank"))


@register("directed_paths", "WITH RECURSIVE g AS (SELECT n_nationkey AS s, n_nationkey + k AS t FROM nation, (VALUES (1), (2), (5)) v(k)), w(path, at_) AS (SELECT [0, t], t FROM g WHERE s = 0 UNION ALL SELECT list_append(path, t), t FROM w JOIN g ON s = at_ WHERE len(path) < 6) SELECT path, CAST(len(path) - 1 AS INTEGER) AS hops FROM w WHERE at_ = 9")
def directed_paths(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    g = table(spark, d, "nation").select(n.alias("src"), F.explode(F.array(n + 1, n + 2, n + 5)).alias("dst"))
    return graph.directed_paths(g, 0, 9, 5).select(F.col("path").cast("array<int>").alias("path"), "hops")


@register("entity_chunk_mentions", "SELECT l_orderkey AS chunk, count(DISTINCT l_suppkey) AS entities, count(*) AS mentions FROM lineitem GROUP BY l_orderkey ORDER BY mentions DESC, chunk LIMIT 50")
def entity_chunk_mentions(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem")
    return m.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.countDistinct("l_suppkey").alias("entities"), F.count("*").alias("mentions")).orderBy(F.col("mentions").desc(), "chunk").limit(50)


@register("orphan_edges", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(live, "o_orderkey", "left_anti").select("o_orderkey")


@register("provenance_filter", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def provenance_filter(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(live, "o_orderkey", "left_semi").select("o_orderkey")


# ---- store and maintenance -------------------------------------------------------------


@register("ingest_dedup", "WITH s AS (SELECT sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE text || '!' END) AS x FROM documents WHERE text IS NOT NULL) SELECT min(doc_id) AS doc_id, sha256(text) AS checksum FROM documents WHERE sha256(text) NOT IN (FROM s) GROUP BY sha256(text)")
def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    stored = docs.select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN text ELSE concat(text, '!') END").alias("text"))
    return store.stage(docs, stored, "doc_id").select("doc_id", "checksum")


@register("detect_changes", "WITH b AS (SELECT doc_id * 2 AS doc_id, source AS y FROM documents) SELECT doc_id, CASE WHEN y IS NULL THEN 'new' WHEN source IS NULL THEN 'deleted' WHEN source = y THEN 'unchanged' ELSE 'updated' END AS change FROM documents FULL JOIN b USING (doc_id)")
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return store.detect_changes(docs, docs.select((F.col("doc_id") * 2).alias("doc_id"), "source"), "doc_id", "source")


@register("entity_upsert", "WITH s AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score FROM customer), i AS (SELECT c_custkey * 2 AS id, NULL::VARCHAR AS name, c_acctbal + 1 AS score FROM customer) SELECT id, coalesce(i.name, s.name) AS name, round(coalesce(i.score, s.score), 2) AS score FROM s FULL JOIN i USING (id)")
def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    stored = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    new = c.select((F.col("c_custkey") * 2).alias("id"), F.lit(None).cast("string").alias("name"), (F.col("c_acctbal") + 1).alias("score"))
    return store.merge(stored, new, ["id"]).select("id", "name", _r("score", 2).alias("score"))


@register("forget_cascade", "SELECT l_orderkey AS id, list_sort(list(l_linenumber)) AS sources FROM lineitem WHERE l_linenumber NOT IN (1, 2) GROUP BY l_orderkey")
def forget_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("sources"))
    return store.forget(rows, "sources", spark.range(1, 3).toDF("id")).select("id", "sources")


@register("count_and_latest", "SELECT event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY event_type")
def count_and_latest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@register("tombstone_audit", "SELECT event_type, count(*) FILTER (WHERE value < 20) AS dead, round(count(*) FILTER (WHERE value < 20) / count(*), 6) AS share, min(ts) FILTER (WHERE value < 20) AS oldest FROM events GROUP BY event_type")
def tombstone_audit(spark: SparkSession, d: str) -> DataFrame:
    dead = F.count_if(F.col("value") < 20)
    return table(spark, d, "events").groupBy("event_type").agg(dead.alias("dead"), _r(dead / F.count("*")).alias("share"), F.min(F.when(F.col("value") < 20, F.col("ts"))).alias("oldest"))


@register("score_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS low, max(value) AS high, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(_r(F.avg("value")).alias("mean"), _r(F.stddev_pop("value")).alias("deviation"), F.min("value").alias("low"), F.max("value").alias("high"), _r(F.median("value")).alias("middle"))


@register("score_entropy", "SELECT event_type, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT event_type, value / sum(value) OVER (PARTITION BY event_type) AS p FROM events WHERE value > 0) GROUP BY event_type")
def score_entropy(spark: SparkSession, d: str) -> DataFrame:
    # -sum p ln p = ln t - sum(v ln v) / t with t = sum v: one aggregate, no window
    t = F.sum("value")
    return table(spark, d, "events").where("value > 0").groupBy("event_type").agg(_r(F.log(t) - F.sum(F.col("value") * F.log("value")) / t).alias("entropy"))


@register("schema_drift", "SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS after FROM events GROUP BY event_type")
def schema_drift(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("ts") < F.expr("TIMESTAMP '2024-01-15'")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(old).alias("before"), F.count_if(~old).alias("after"))


@register("method_overlap", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view') SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS first_only, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either")
def method_overlap(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").where("event_type IN ('click', 'view')").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("a"), F.bool_or(F.col("event_type") == "view").alias("b"))
    return per.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"), F.count("*").alias("either"))


@register("fact_compaction", "SELECT event_id FROM events WHERE NOT (value < 20 AND ts < TIMESTAMP '2024-01-10')")
def fact_compaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("NOT (value < 20 AND ts < TIMESTAMP '2024-01-10')").select("event_id")


# ---- text ------------------------------------------------------------------------------


@register("line_chunks", "SELECT id, chunk_index, content FROM (SELECT doc_id AS id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS chunk_index, unnest(string_split(text, chr(10))) AS content FROM documents) WHERE trim(content) <> ''")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "documents"), "doc_id", "text")


@register("levenshtein_names", "SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)), 6) AS score FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def levenshtein_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    p = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").where("a < b")
    return p.select("a", "b", _r(text.levenshtein_similarity(F.col("a"), F.col("b"))).alias("score"))


@register("url_domains", r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://(www\.)?', ''), '[/?#].*$', '') AS domain FROM pages")
def url_domains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@register("checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", store.checksum(F.col("text")).alias("checksum"))


@register("keyword_idf", r"WITH k AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')) AS keyword FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT keyword, round(ln(any_value(n) / (1 + count(*))) + 1, 6) AS idf FROM k, n GROUP BY keyword")
def keyword_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    terms = lexical.tokens(docs, "doc_id", "text").groupBy(F.col("term").alias("keyword")).agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("keyword", _r(F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf"))


@register("recent_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(25).select("event_id")
