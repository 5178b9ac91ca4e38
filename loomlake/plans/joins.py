"""Queries over mentions and relationships, with equivalent SQL.

Suppliers are entities and orders chunks: a line mentions its supplier in its order.
A customer's orders give versions, nations and regions a small typed graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, relations, spread
from ..sources.readers import table
from .catalog import register, rounded

MENTIONS = "m AS (SELECT l_suppkey AS entity, l_orderkey AS chunk, count(*) AS n, any_value(o_orderdate) AS ts, any_value(o_orderpriority) AS channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
EDGES = """e AS (SELECT o_orderkey AS id, o_custkey AS src, l_suppkey AS dst, CASE o_orderstatus WHEN 'F' THEN 'ASSOCIATED_WITH' WHEN 'O' THEN 'RELATES_TO' ELSE 'WORKS_FOR' END AS type, round(l_discount + 0.5, 2) AS confidence, o_orderdate AS valid_from,
  CASE WHEN l_shipdate > TIMESTAMP '1998-01-01' THEN NULL ELSE greatest(l_shipdate, o_orderdate) END AS valid_until FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1)"""


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    lines = spread.wide(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_orderkey").alias("chunk")), "chunk").groupBy("entity", "chunk").agg(F.count("*").alias("n"))
    return lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("channel")), "chunk")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_discount", "l_shipdate")
    found = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "ASSOCIATED_WITH").when(F.col("o_orderstatus") == "O", "RELATES_TO").otherwise("WORKS_FOR")
    until = F.when(F.col("l_shipdate") > F.expr("TIMESTAMP_NTZ '1998-01-01'"), F.lit(None)).otherwise(F.greatest("l_shipdate", "o_orderdate"))
    return found.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), kind.alias("type"), _r(F.col("l_discount") + 0.5, 2).alias("confidence"), F.col("o_orderdate").alias("valid_from"), until.alias("valid_until"))


def _seeds(spark: SparkSession, d: str, where: str = "s_nationkey < 5") -> DataFrame:
    return table(spark, d, "supplier").where(where).select(F.col("s_suppkey").alias("entity"))


SEEDS = "q AS (SELECT s_suppkey AS entity FROM supplier WHERE s_nationkey < 5)"


@register("chunks_of_entities", f"WITH {MENTIONS}, {SEEDS} SELECT chunk, list_sort(list(entity)) AS entities, CAST(sum(n) AS BIGINT) AS mentions FROM m SEMI JOIN q USING (entity) GROUP BY chunk ORDER BY mentions DESC, chunk LIMIT 50")
def chunks_of_entities(spark: SparkSession, d: str) -> DataFrame:
    return relations.chunks_of(_mentions(spark, d), _seeds(spark, d), 50).select("chunk", "entities", "mentions")


@register("temporal_chunks_of_entities", f"WITH {MENTIONS}, {SEEDS} SELECT chunk, CAST(sum(n) AS BIGINT) AS mentions, max(ts) AS ts FROM m SEMI JOIN q USING (entity) WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01' GROUP BY chunk ORDER BY ts DESC, mentions DESC, chunk LIMIT 20")
def temporal_chunks_of_entities(spark: SparkSession, d: str) -> DataFrame:
    t = lambda x: F.expr(f"TIMESTAMP_NTZ '{x}'")
    return relations.chunks_of(_mentions(spark, d), _seeds(spark, d), 20, t("1996-01-01"), t("1999-01-01"), True).select("chunk", "mentions", "ts")


@register("entity_channels", f"WITH {MENTIONS} SELECT DISTINCT channel FROM m WHERE entity = 3")
def entity_channels(spark: SparkSession, d: str) -> DataFrame:
    return relations.channels_of(_mentions(spark, d), _seeds(spark, d, "s_suppkey = 3"))


@register("relationships_between", f"WITH {EDGES}, {SEEDS} SELECT id, src, dst, type, confidence FROM e WHERE src <> dst AND src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT s_suppkey FROM supplier) ORDER BY type = 'ASSOCIATED_WITH', confidence DESC, id LIMIT 90")
def relationships_between(spark: SparkSession, d: str) -> DataFrame:
    return relations.between(_edges(spark, d), _seeds(spark, d, "true")).select("id", "src", "dst", "type", "confidence")


G = "g AS (SELECT n_nationkey AS src, 100 + n_regionkey AS dst FROM nation), u AS (SELECT * FROM g UNION SELECT dst, src FROM g)"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey") + 100).cast("long").alias("dst"))


@register("expansion_scores", f"WITH RECURSIVE {G}, w(id, k) AS (SELECT CAST(x AS BIGINT), 0 FROM (VALUES (0), (7)) t(x) UNION SELECT dst, k + 1 FROM w JOIN u ON src = id WHERE k < 3) SELECT CAST(id AS BIGINT) AS id, round(max(1.0 / (1 + k)), 6) AS score FROM w GROUP BY id")
def expansion_scores(spark: SparkSession, d: str) -> DataFrame:
    far = graph.hops(_nations(spark, d), spark.createDataFrame([(0,), (7,)], "id long"), 3)
    return relations.expansion_scores(far).select("id", _r("score").alias("score"))


@register("typed_expansion", f"WITH {EDGES}, {SEEDS}, a AS (SELECT src AS entity, dst AS id, type, confidence FROM e UNION ALL SELECT dst, src, type, confidence FROM e) SELECT id, round(max((1.0 / (1 + entity)) * confidence * CASE type WHEN 'ASSOCIATED_WITH' THEN 0.4 WHEN 'RELATES_TO' THEN 0.7 ELSE 1.0 END), 6) AS score FROM a JOIN q USING (entity) GROUP BY id")
def typed_expansion(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d).withColumn("score", 1.0 / (1 + F.col("entity")))
    return relations.typed_expansion(seeds, _edges(spark, d)).select("id", _r("score").alias("score"))


@register("entity_chunk_scores", f"WITH {MENTIONS}, {SEEDS} SELECT chunk, round(sum(n) * (1 + 0.1 * (count(DISTINCT entity) - 1)) * avg(1.0 / (1 + entity)), 6) AS score FROM m JOIN q USING (entity) GROUP BY chunk")
def entity_chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = _seeds(spark, d).select(F.col("entity").alias("id"), (1.0 / (1 + F.col("entity"))).alias("score"))
    return relations.chunk_scores(_mentions(spark, d), scores).select("chunk", _r("score").alias("score"))


@register("edge_reads", f"WITH {EDGES}, {SEEDS} SELECT 'out' AS way, id FROM e WHERE valid_until IS NULL AND src IN (FROM q) UNION ALL SELECT 'in', id FROM e WHERE valid_until IS NULL AND dst IN (FROM q) UNION ALL SELECT 'any', id FROM e WHERE src IN (FROM q) OR dst IN (FROM q)")
def edge_reads(spark: SparkSession, d: str) -> DataFrame:
    e, q = _edges(spark, d), _seeds(spark, d)
    part = lambda way, rows: rows.select(F.lit(way).alias("way"), "id")
    return part("out", relations.edges_of(e, q, "out")).union(part("in", relations.edges_of(e, q, "in"))).union(part("any", relations.edges_of(e, q, "both", False)))


CONFLICTS = "c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 50 AS src, l_suppkey % 20 AS dst, l_returnflag AS type, l_shipdate AS valid_from, NULL::TIMESTAMP AS valid_until, l_linenumber FROM lineitem)"


@register("edge_conflicts", f"WITH {CONFLICTS}, s AS (SELECT * FROM c WHERE l_linenumber <= 3), n AS (SELECT * FROM c WHERE l_linenumber > 5), x AS (SELECT s.id, min(n.valid_from) AS ends FROM s JOIN n ON s.src = n.src AND s.dst = n.dst AND s.type = n.type AND s.valid_from <= n.valid_from GROUP BY s.id) SELECT id, ends AS valid_until, ends IS NOT NULL AS invalidated FROM s LEFT JOIN x USING (id)")
def edge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 20).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_shipdate").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), "l_linenumber")
    return relations.invalidate_conflicts(c.where("l_linenumber <= 3").drop("l_linenumber"), c.where("l_linenumber > 5")).select("id", "valid_until", "invalidated")


ENTITIES = f"{MENTIONS}, t AS (SELECT entity AS id, 1.0 / (1 + entity) AS score, list(chunk) AS chunks FROM m GROUP BY entity)"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(F.collect_list("chunk").alias("chunks")).select("id", (1.0 / (1 + F.col("id"))).alias("score"), "chunks")


@register("entity_channel", f"WITH {ENTITIES}, b AS (SELECT * FROM t ORDER BY score DESC, id LIMIT 10), f AS (SELECT chunk, max(score) AS score FROM (SELECT score, unnest(chunks) AS chunk FROM b) GROUP BY chunk), k AS (SELECT o_orderkey AS chunk, (o_orderkey * 37 % 101) / 100.0 AS cosine FROM orders WHERE o_orderkey % 4 <> 0) SELECT chunk, round(CAST(CASE WHEN cosine IS NULL THEN 0.3 * score ELSE score * cosine END AS DOUBLE), 6) AS score FROM f LEFT JOIN k USING (chunk) WHERE cosine IS NULL OR cosine >= 0.3")
def entity_channel(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") * 37 % 101 / 100.0).alias("cosine"))
    return relations.entity_channel(_entities(spark, d), k).select("chunk", _r("score").alias("score"))


@register("reverse_seeds", f"WITH {ENTITIES}, k AS (SELECT o_orderkey AS chunk, (o_orderkey * 37 % 101) / 100.0 AS score FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey < 400) SELECT id, round(CAST(max(k.score) AS DOUBLE), 6) AS score FROM (SELECT id, unnest(chunks) AS chunk FROM t) JOIN k USING (chunk) GROUP BY id ORDER BY max(k.score) DESC, id LIMIT 15")
def reverse_seeds(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").where("o_orderkey % 4 <> 0 AND o_orderkey < 400").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") * 37 % 101 / 100.0).alias("score"))
    return relations.reverse_seeds(k, _entities(spark, d), 15).select("id", _r("score").alias("score"))


@register("cross_session_expansion", """WITH s AS (SELECT user_id AS query_id, event_id AS id, value / 100 AS score, event_type FROM events), f AS (SELECT * FROM s WHERE event_type = 'click'),
a AS (SELECT query_id, avg(score) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM f) WHERE r <= 5 GROUP BY query_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS i FROM s WHERE event_type IN ('view', 'purchase'))
SELECT query_id, id, round(score, 6) AS score FROM f UNION ALL SELECT query_id, id, round(0.8 * mean * power(0.95, i), 6) FROM o JOIN a USING (query_id)""")
def cross_session_expansion(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("score"), "event_type")
    return relations.cross_session(s.where("event_type = 'click'").drop("event_type"), s.where("event_type IN ('click', 'view', 'purchase')").drop("event_type")).select("query_id", "id", _r("score").alias("score"))


@register("latest_mentions", f"WITH {MENTIONS} SELECT entity, max(ts) AS ts, max(struct_pack(t := ts, c := chunk)).c AS chunk FROM m GROUP BY entity ORDER BY ts DESC, entity LIMIT 30")
def latest_mentions(spark: SparkSession, d: str) -> DataFrame:
    return relations.latest_mentions(_mentions(spark, d), 30)


@register("shared_with_both", f"WITH {MENTIONS}, b AS (SELECT chunk FROM m WHERE entity IN (1, 2) GROUP BY chunk HAVING count(DISTINCT entity) = 2) SELECT entity, count(*) AS n FROM m SEMI JOIN b USING (chunk) WHERE entity NOT IN (1, 2) GROUP BY entity")
def shared_with_both(spark: SparkSession, d: str) -> DataFrame:
    return relations.shared_with_both(_mentions(spark, d), 1, 2)


@register("field_matches", "WITH n AS (SELECT p_partkey AS id, lower(trim(p_name)) AS v FROM part), k AS (SELECT v, min(id) AS least FROM n GROUP BY v HAVING count(*) > 1) SELECT id, least FROM n JOIN k USING (v)")
def field_matches(spark: SparkSession, d: str) -> DataFrame:
    return relations.field_matches(table(spark, d, "part"), "p_partkey", F.col("p_name"))[0]


@register("rule_chain", f"WITH {EDGES}, f AS (SELECT a.src, b.dst, max(a.confidence * b.confidence) AS confidence FROM e a JOIN e b ON a.dst = b.src WHERE a.type = 'WORKS_FOR' AND b.type = 'RELATES_TO' AND a.src <> b.dst GROUP BY ALL) SELECT src, dst, 'KNOWS' AS type, round(confidence, 6) AS confidence FROM f ORDER BY f.confidence DESC, src, dst LIMIT 1000")
def rule_chain(spark: SparkSession, d: str) -> DataFrame:
    return relations.rule_chain(_edges(spark, d), "WORKS_FOR", "RELATES_TO", "KNOWS").withColumn("confidence", _r("confidence"))


@register("source_liveness", f"WITH {MENTIONS}, t AS (SELECT entity AS id, list(chunk ORDER BY chunk) AS chunks FROM m GROUP BY entity), f AS (SELECT id, CAST(unnest(range(len(chunks))) AS INTEGER) AS place, unnest(chunks) AS chunk FROM t) SELECT id, place, chunk, chunk % 5 = 0 AS dead FROM f")
def source_liveness(spark: SparkSession, d: str) -> DataFrame:
    t = _mentions(spark, d).groupBy(F.col("entity").alias("id")).agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    return relations.source_liveness(t, "id", "chunks", table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("chunk")))


@register("bitemporal_edges", f"WITH {EDGES} SELECT id FROM e WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1997-06-01')")
def bitemporal_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.valid_at(_edges(spark, d), F.expr("TIMESTAMP_NTZ '1997-06-01'")).select("id")


KEYWORDS = r"k AS (SELECT doc_id AS chunk, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS keyword FROM documents), i AS (SELECT keyword, ln((SELECT count(*) FROM documents) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM k GROUP BY keyword), w AS (SELECT chunk, keyword, idf, df FROM k JOIN i USING (keyword) WHERE df > 1)"


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    k = docs.select(F.col("doc_id").alias("chunk"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), 1))).alias("keyword"))
    n = docs.agg(F.count("*").alias("n"))
    df = k.groupBy("keyword").agg(F.count("*").alias("df")).where("df > 1").crossJoin(F.broadcast(n))  # n has one row
    return k.join(df.select("keyword", (F.log(F.col("n") / (1 + F.col("df"))) + 1).alias("idf")), "keyword")


@register("co_keyword_edges", f"WITH {KEYWORDS}, s AS (SELECT a.chunk AS src, b.chunk AS dst, a.idf FROM w a JOIN w b USING (keyword) WHERE a.df <= 4 AND a.chunk <> b.chunk), p AS (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY chunk) AS at_ FROM w WHERE df > 4), r AS (SELECT a.chunk AS src, b.chunk AS dst, a.idf FROM p a JOIN p b ON a.keyword = b.keyword AND b.at_ = a.at_ % a.df + 1), x AS (SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT dst, src, idf FROM r) SELECT src, dst, count(*) AS n, round(sum(idf), 5) AS weight FROM x GROUP BY ALL")
def co_keyword_edges(spark: SparkSession, d: str) -> DataFrame:
    return relations.co_keyword_edges(_keywords(spark, d), 4).groupBy("src", "dst").agg(F.count("*").alias("n"), _r(F.sum("weight"), 5).alias("weight"))


@register("skeleton_search", f"WITH {KEYWORDS}, q AS (SELECT keyword FROM i WHERE df > 1 ORDER BY df DESC, keyword LIMIT 6), f AS (SELECT chunk, sum(idf) AS s FROM w WHERE keyword IN (FROM q) GROUP BY chunk) SELECT chunk, round(s / (SELECT max(s) FROM f), 6) AS score FROM f ORDER BY round(s / (SELECT max(s) FROM f), 9) DESC, chunk LIMIT 20")
def skeleton_search(spark: SparkSession, d: str) -> DataFrame:
    k = _keywords(spark, d)
    asked = [r.keyword for r in k.groupBy("keyword").count().orderBy(F.col("count").desc(), "keyword").limit(6).collect()]
    return relations.keyword_overlap(k, asked, 1 << 20).select("chunk", F.round("score", 9).alias("score")).orderBy(F.col("score").desc(), "chunk").limit(20).withColumn("score", _r("score"))


@register("graph_density", f"WITH RECURSIVE {G}, k AS (SELECT src, count(DISTINCT dst) AS k FROM u GROUP BY src), w(id, c) AS (SELECT src, src FROM u UNION SELECT dst, c FROM w JOIN u ON src = id), p AS (SELECT id, min(c) AS c FROM w GROUP BY id), z AS (SELECT count(*) AS s FROM p GROUP BY c) SELECT (SELECT count(*) FROM k) AS nodes, (SELECT round(avg(k), 6) FROM k) AS mean_degree, (SELECT median(k) FROM k) AS median_degree, (SELECT max(k) FROM k) AS max_degree, (SELECT count(*) FROM z) AS components, (SELECT round(max(s) / sum(s), 6) FROM z) AS largest, (SELECT round(count(*) FILTER (WHERE src % 2 = 0) / count(*), 6) FROM g) AS typed")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    g = _nations(spark, d).withColumn("type", F.when(F.col("src") % 2 == 0, "PART_OF").otherwise("RELATES_TO"))
    out = relations.density(g, graph.connected(g))
    return out.select("nodes", _r("mean_degree").alias("mean_degree"), "median_degree", "max_degree", "components", _r("largest").alias("largest"), _r("typed").alias("typed"))


@register("ingest_associations", f"WITH {MENTIONS}, f AS (SELECT entity, chunk FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY entity) AS r FROM m) WHERE r <= 4), p AS (SELECT DISTINCT a.entity AS src, b.entity AS dst FROM f a JOIN f b ON a.chunk = b.chunk AND a.entity < b.entity) SELECT src, dst, CAST(0.4 AS DOUBLE) AS confidence FROM p WHERE NOT (src % 3 = 0 AND dst % 3 = 0)")
def ingest_associations(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    none = m.limit(0).select(F.col("entity").alias("src"), F.col("entity").alias("dst"))
    known = relations.associations(m.where("entity % 3 = 0"), none, 1 << 20)
    return relations.associations(m, known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), 4)


@register("narrative_coherence", f"WITH {MENTIONS}, s AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice / 1000 AS score FROM orders), h AS (SELECT query_id, id, entity FROM s JOIN m ON chunk = id), c AS (SELECT query_id, entity FROM h GROUP BY ALL HAVING count(*) > 1), n AS (SELECT query_id, id, count(*) AS k FROM h JOIN c USING (query_id, entity) GROUP BY ALL) SELECT query_id, id, round(score * CASE WHEN k IS NULL THEN 0.85 ELSE 1 + least(0.5, 0.2 * k) END, 2) AS score FROM s LEFT JOIN n USING (query_id, id)")
def narrative_coherence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("score"))
    return relations.narrative(s, _mentions(spark, d)).select("query_id", "id", rounded(F.col("score"), 2).alias("score"))


@register("proper_noun_pairs", r"""WITH n AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '9', 'g'), '\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b', 1))) AS n FROM conversations), f AS (SELECT conv_id, turn, unnest(n) AS x FROM n) SELECT a.conv_id, a.turn, a.x AS a, b.x AS b FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.x < b.x""")
def proper_noun_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "conversations").select("conv_id", "turn", F.explode(relations.proper_noun_pairs(F.col("text"))).alias("p"))
    return found.select("conv_id", "turn", "p.a", "p.b")


@register("related_entities", f"WITH RECURSIVE {G}, w(id, k) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT dst, k + 1 FROM w JOIN u ON src = id WHERE k < 2) SELECT CAST(id AS BIGINT) AS id, min(k) AS distance, round(max(1.0 / (1 + k)), 6) AS score FROM w WHERE id <> 3 GROUP BY id")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    far = graph.hops(_nations(spark, d), spark.createDataFrame([(3,)], "id long"), 2).where("id <> 3")
    return far.groupBy("id").agg(F.min("distance").alias("distance"), _r(F.max(1 / (1 + F.col("distance")))).alias("score"))
