"""Queries of upkeep and scan operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..operators import scans
from ..sources.readers import table
from .catalog import register

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
LINES = "s AS (SELECT l_suppkey AS id, l_orderkey AS chunk, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS INTEGER) AS place, l_orderkey % 5 = 0 AS dead FROM lineitem)"


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _ntz(x: str):
    return F.expr(f"TIMESTAMP_NTZ '{x}'")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("chunk"), (F.row_number().over(w) - 1).alias("place"), (F.col("l_orderkey") % 5 == 0).alias("dead"))


@register("embedding_stats", "SELECT label, count(*) AS total, count(*) FILTER (WHERE vec_id % 3 <> 0) AS embedded FROM embeddings GROUP BY label")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return m.embedding_stats(rows, "label", "v")


@register("source_audit", f"WITH {LINES}, p AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE dead) AS k FROM s GROUP BY id) SELECT CAST(sum(n) AS BIGINT) AS sources, CAST(sum(k) AS BIGINT) AS dead, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.99), 4) AS p99, max(n) AS longest FROM p")
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    out = m.source_audit(_sources(spark, d))
    return out.select("sources", "dead", *(_r(c, 4).alias(c) for c in ("p50", "p90", "p99")), "longest")


@register("source_gc", f"WITH {LINES} SELECT id, list(chunk ORDER BY place) FILTER (WHERE NOT dead) AS kept, list(chunk ORDER BY place) FILTER (WHERE dead) AS removed FROM s GROUP BY id HAVING bool_or(dead)")
def source_gc(spark: SparkSession, d: str) -> DataFrame:
    return m.source_gc(_sources(spark, d))


@register("latest_sources", f"WITH {LINES}, f AS (SELECT id, chunk, max(place) AS at_ FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY at_ DESC) AS r FROM f) SELECT id, list(chunk ORDER BY at_) AS sources FROM r WHERE r <= 100 GROUP BY id")
def latest_sources(spark: SparkSession, d: str) -> DataFrame:
    per = _sources(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "chunk"))).alias("x"))
    ids = F.transform("x", lambda x: x["chunk"])
    half = F.floor(F.size("x") / 2).cast("int")
    return per.select("id", m.latest_sources(F.slice(ids, F.lit(1), half), F.slice(ids, half + 1, F.size("x")), 100).alias("sources"))


@register("tombstone_ages", f"WITH a AS (SELECT *, (epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0 AS age FROM events) SELECT event_type, count(*) FILTER (WHERE value >= 20) AS active, count(*) FILTER (WHERE value < 20) AS dead, count(*) FILTER (WHERE value < 5) AS invalidated, round(count(*) FILTER (WHERE value < 20) / count(*), 6) AS share, min(ts) FILTER (WHERE value < 20) AS oldest, round(quantile_cont(age, 0.5) FILTER (WHERE value < 20), 5) AS p50, round(quantile_cont(age, 0.9) FILTER (WHERE value < 20), 5) AS p90 FROM a GROUP BY event_type")
def tombstone_ages(spark: SparkSession, d: str) -> DataFrame:
    out = m.tombstones(table(spark, d, "events"), "event_type", F.col("value") < 20, F.col("value") < 5, "ts", F.expr(NOW))
    return out.withColumn("share", _r("share")).withColumn("p50", _r("p50", 5)).withColumn("p90", _r("p90", 5))


@register("type_drift", "WITH b AS (SELECT user_id, count(*) AS before FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 7 <> 0 GROUP BY user_id), n AS (SELECT user_id, count(*) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND user_id % 5 <> 0 GROUP BY user_id), x AS (SELECT user_id, coalesce(before, 0) AS before, coalesce(now, 0) AS now FROM b FULL JOIN n USING (user_id)) SELECT *, round(CASE WHEN before = 0 THEN 1.0 ELSE abs(now - before) / before END, 6) AS change, CASE WHEN before = 0 THEN true ELSE abs(now - before) / before >= 0.5 END AS flagged FROM x")
def type_drift(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    half = _ntz("2024-01-15")
    return m.drift(e.where((F.col("ts") >= half) & (F.col("user_id") % 5 != 0)), e.where((F.col("ts") < half) & (F.col("user_id") % 7 != 0)), "user_id").withColumn("change", _r("change"))


@register("score_drift", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(count(*) FILTER (WHERE value < 30) / count(*), 6) AS low FROM events GROUP BY event_type HAVING count(*) >= 20")
def score_drift(spark: SparkSession, d: str) -> DataFrame:
    out = m.score_drift(table(spark, d, "events"), "event_type", "value", 30, 20)
    return out.select("event_type", "n", *(_r(c, 4).alias(c) for c in ("p10", "p50", "p90")), _r("low").alias("low"))


@register("survivor_map", "SELECT p_partkey AS id, first_value(p_partkey) OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) AS survivor FROM part")
def survivor_map(spark: SparkSession, d: str) -> DataFrame:
    return m.survivors(table(spark, d, "part"), ["p_name", "p_type"], "p_partkey", [F.col("p_size").desc(), F.col("p_partkey")])


@register("remapped_edges", "WITH v AS (SELECT p_partkey AS id, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS s FROM part), x AS (SELECT l_orderkey AS k, coalesce(a.s, l_partkey) AS src, coalesce(b.s, l_suppkey) AS dst FROM lineitem LEFT JOIN v a ON a.id = l_partkey LEFT JOIN v b ON b.id = l_suppkey) SELECT k, src, dst FROM x WHERE src <> dst")
def remapped_edges(spark: SparkSession, d: str) -> DataFrame:
    v = m.survivors(table(spark, d, "part"), ["p_name"], "p_partkey", [F.col("p_size").desc(), F.col("p_partkey")])
    return m.remap(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), v).select("k", "src", "dst")


@register("repeats_deleted", "SELECT p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_type ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n > 1")
def repeats_deleted(spark: SparkSession, d: str) -> DataFrame:
    return m.survivors(table(spark, d, "part"), ["p_name", "p_type"], "p_partkey", [F.col("p_size").desc(), F.col("p_partkey")]).where("id <> survivor").select(F.col("id").alias("p_partkey"))


@register("duplicate_groups", "WITH f AS (SELECT p_name, p_partkey, p_size, unnest([p_partkey % 7, p_partkey % 3]) AS s FROM part) SELECT p_name, count(DISTINCT p_partkey) AS n, CAST(sum(p_size) // 2 AS BIGINT) AS mentions, list_sort(list(DISTINCT s)) AS sources FROM f GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("s", F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 3))
    return m.merge_groups(p, ["p_name"], "s", "p_size").select("p_name", "n", F.col("mentions").cast("long").alias("mentions"), "sources")


CHAIN = "v AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS root FROM orders)"


@register("chain_roots", f"WITH {CHAIN} SELECT id, root, CAST(n - 1 AS INTEGER) AS depth FROM v")
def chain_roots(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("up"))
    return m.chain_roots(rows, "id", "up").select("id", "root", "depth")


@register("stable_ids", f"WITH {CHAIN} SELECT root, arg_max(id, n) AS id, max(n) AS version FROM v GROUP BY root")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("up"))
    return m.chain_roots(rows, "id", "up").groupBy("root").agg(F.max_by("id", "depth").alias("id"), (F.max("depth") + 1).cast("long").alias("version"))


@register("previous_version", f"WITH {CHAIN} SELECT a.id, b.id AS previous FROM v a LEFT JOIN v b ON a.o_custkey = b.o_custkey AND b.n = a.n - 1")
def previous_version(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("n"))
    return v.join(v.select("o_custkey", F.col("id").alias("previous"), (F.col("n") + 1).alias("n")), ["o_custkey", "n"], "left").select("id", "previous")


@register("backfill", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END, o_orderstatus) AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("status"))
    return m.backfill(rows, table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status")), "l_orderkey", ["status"])


@register("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"type\":\"' || event_type || '\",\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS built FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("built"))


@register("safe_timestamps", "SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN 'not a time' WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts FROM events")
def safe_timestamps(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, "not a time").when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", said.alias("s")).select("event_id", F.expr("try_cast(s AS TIMESTAMP_NTZ)").alias("ts"))


@register("expired_sessions", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30')")
def expired_sessions(spark: SparkSession, d: str) -> DataFrame:
    return m.expire_sessions(table(spark, d, "events"), "user_id", "ts", _ntz("2024-01-30")).select("event_id")


@register("relationship_upsert", "WITH s AS (SELECT o_custkey AS src, o_orderkey AS dst, o_orderpriority AS description, o_totalprice AS confidence, [o_orderkey] AS sources FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey AS src, o_orderkey AS dst, o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN ' and a long note' ELSE '' END AS description, o_totalprice + o_orderkey % 7 - 3 AS confidence, [o_orderkey, 7] AS sources FROM orders WHERE o_orderkey % 5 <> 0) SELECT src, dst, CASE WHEN length(coalesce(n.description, '')) > length(coalesce(s.description, '')) THEN n.description ELSE s.description END AS description, round(greatest(s.confidence, n.confidence), 2) AS confidence, list_concat(coalesce(s.sources, []), coalesce(n.sources, [])) AS sources FROM s FULL JOIN n USING (src, dst)")
def relationship_upsert(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    base = lambda x, text, conf, src: x.select(F.col("o_custkey").alias("src"), k.alias("dst"), F.lit("ORDERED").alias("type"), text.alias("description"), conf.alias("confidence"), F.lit(1.0).alias("weight"), src.alias("sources"))
    s = base(o.where("o_orderkey % 3 <> 0"), F.col("o_orderpriority"), F.col("o_totalprice"), F.array(k))
    n = base(o.where("o_orderkey % 5 <> 0"), F.concat("o_orderstatus", F.when(k % 2 == 0, " and a long note").otherwise("")), F.col("o_totalprice") + k % 7 - 3, F.array(k, F.lit(7).cast("long")))
    return m.upsert_relationships(s, n).select("src", "dst", "description", _r("confidence", 2).alias("confidence"), "sources")


@register("entity_merge", "WITH s AS (SELECT c_custkey AS id, [c_custkey, 1] AS sources, 2 AS mentions, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS description, c_acctbal AS confidence FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, [1, c_custkey + 1] AS sources, 3 AS mentions, c_mktsegment AS description, c_acctbal + c_custkey % 5 - 2 AS confidence FROM customer WHERE c_custkey % 4 <> 0) SELECT id, list_concat(coalesce(s.sources, []), list_filter(coalesce(n.sources, []), lambda x: NOT list_contains(coalesce(s.sources, []), x))) AS sources, CAST(coalesce(s.mentions, 0) + coalesce(n.mentions, 0) AS INTEGER) AS mentions, CASE WHEN coalesce(s.description, '') <> '' THEN s.description ELSE n.description END AS description, round(greatest(s.confidence, n.confidence), 2) AS confidence FROM s FULL JOIN n USING (id) WHERE id > 1")
def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    c, k, one = table(spark, d, "customer"), F.col("c_custkey"), F.lit(1).cast("long")
    s = c.where("c_custkey % 3 <> 0").select(k.alias("id"), F.array(k, one).alias("sources"), F.lit(2).alias("mentions"), F.when(k % 2 == 0, F.col("c_name")).otherwise("").alias("description"), F.col("c_acctbal").alias("confidence"))
    n = c.where("c_custkey % 4 <> 0").select(k.alias("id"), F.array(one, k + 1).alias("sources"), F.lit(3).alias("mentions"), F.col("c_mktsegment").alias("description"), (F.col("c_acctbal") + k % 5 - 2).alias("confidence"))
    return m.merge_entities(s, n).where("id > 1").withColumn("confidence", _r("confidence", 2))


@register("reinforcement_touch", "WITH t AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT event_id, greatest(ts, t) AS last_accessed FROM events LEFT JOIN t USING (user_id)")
def reinforcement_touch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select("event_id", "user_id", F.col("ts").alias("last_accessed"))
    return m.touch(rows, e.where("event_type = 'click'").select("user_id", "ts"), "user_id", "ts").select("event_id", "last_accessed")


@register("orphan_claim", "SELECT event_id FROM events WHERE (event_type = 'click' AND ts < TIMESTAMP '2024-01-10') OR (event_type = 'view' AND ts < TIMESTAMP '2024-01-20')")
def orphan_claim(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "view", "PROCESSING").otherwise("COMPLETED")
    rows = table(spark, d, "events").select("event_id", status.alias("status"), F.col("ts").alias("updated_at"))
    return m.claim_orphans(rows, _ntz("2024-01-10"), _ntz("2024-01-20")).select("event_id")


@register("pruned_edges", "WITH l AS (SELECT l_orderkey AS id, bool_or(l_suppkey % 4 = 0) AS live FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS id, CASE WHEN NOT coalesce(live, false) AND o_totalprice < 100000 AND o_orderstatus <> 'F' THEN TIMESTAMP '2024-01-01' WHEN o_orderstatus = 'F' THEN o_orderdate END AS valid_until FROM orders LEFT JOIN l ON id = o_orderkey")
def pruned_edges(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("sources"))
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_until")).join(src, "id", "left")
    live = table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("chunk"))
    return m.prune_edges(e, live, 100000, _ntz("2024-01-01")).select("id", "valid_until")


@register("contradictions", "WITH n AS (SELECT p_partkey AS a, lead(p_partkey) OVER w AS b, lower(p_name) AS x, lower(lead(p_name) OVER w) AS y FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)), s AS (SELECT a, b, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS similarity FROM n WHERE b IS NOT NULL) SELECT a, b, round(similarity, 6) AS similarity FROM s WHERE similarity < 0.5")
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.lit("IS").alias("type"), F.col("p_name").alias("text"))
    return m.contradictions(p).withColumn("similarity", _r("similarity"))


@register("renamed_types", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look' ELSE event_type END AS event_type FROM events")
def renamed_types(spark: SparkSession, d: str) -> DataFrame:
    return m.rename_types(table(spark, d, "events"), "event_type", {"click": "tap", "view": "look"}).select("event_id", "event_type")


@register("event_clusters", "WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000, true) AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id AS id, last_value(CASE WHEN far THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cluster FROM g")
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    return m.event_clusters(table(spark, d, "events"), "user_id", "ts", "event_id", 0.5)


@register("retention_floor", "SELECT event_id FROM events WHERE NOT (value < 20 AND epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-30') - 7 * 86400000000)")
def retention_floor(spark: SparkSession, d: str) -> DataFrame:
    return m.compact(table(spark, d, "events"), F.col("value") < 20, "ts", F.expr("TIMESTAMP '2024-01-30'"), 3).select("event_id")


@register("usage_rollup", "SELECT event_type, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost, round(avg(value), 4) AS latency FROM events GROUP BY event_type")
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return m.usage(table(spark, d, "events").select("event_type", F.col("user_id").alias("tokens"), F.col("value").alias("cost"), F.col("value").alias("latency")), "event_type")


@register("document_stubs", "WITH a AS (SELECT o_orderkey % 97 AS doc_id, 0 AS part, o_orderkey AS place FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS doc_id, 1 AS part, o_orderkey AS place FROM orders WHERE o_orderkey % 2 = 1), m AS (SELECT doc_id, min(struct_pack(part := part, place := place)) AS x FROM (FROM a UNION ALL FROM b) GROUP BY doc_id) SELECT doc_id, CAST(x.part AS INTEGER) AS part, x.place AS place FROM m")
def document_stubs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") % 97).alias("doc_id"), F.col("o_orderkey").alias("place"))
    return m.document_stubs(a, o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("place")))


@register("folded_vectors", "WITH f AS (SELECT vec_id // 4 AS g, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT g, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM f GROUP BY ALL")
def folded_vectors(spark: SparkSession, d: str) -> DataFrame:
    return m.fold(table(spark, d, "embeddings").withColumn("g", F.expr("vec_id div 4")), "g", "embedding").withColumn("value", _r("value"))


@register("unit_vectors", "WITH f AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value FROM f")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(m.unit(F.col("embedding"))).alias("dim", "value")).withColumn("value", _r("value"))


@register("replaced_sources", "WITH e AS (SELECT l_suppkey AS id, l_orderkey AS chunk FROM lineitem WHERE l_orderkey % 9 <> 0 UNION SELECT s_suppkey, -1 - s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) SELECT id, list_sort(list(DISTINCT chunk)) AS sources FROM e GROUP BY id")
def replaced_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_list("l_orderkey").alias("sources"))
    old = table(spark, d, "lineitem").where("l_orderkey % 9 = 0").select(F.col("l_orderkey").alias("chunk"))
    return m.replace_sources(e, old, table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), (-1 - F.col("s_suppkey")).alias("chunk")))


# ---- scans -------------------------------------------------------------------------------


@register("namespace_counts", "SELECT o_orderstatus AS namespace, 'orders' AS kind, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT l_linestatus, 'lines', count(*) FROM lineitem GROUP BY ALL")
def namespace_counts(spark: SparkSession, d: str) -> DataFrame:
    return scans.counts({"orders": table(spark, d, "orders").withColumnRenamed("o_orderstatus", "namespace"), "lines": table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "namespace")})


@register("document_list", "SELECT event_id FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 30 OFFSET 10")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    return scans.listing(table(spark, d, "events"), "ts", "event_id", 30, 10, F.col("event_type") == "click", F.col("ts") < _ntz("2024-01-20")).select("event_id")


@register("batch_get", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT s_suppkey * 3 FROM supplier)")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("o_orderkey"))
    return scans.get(table(spark, d, "orders"), "o_orderkey", ids, F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")


@register("checksum_lookup", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 3) AND NOT (source = 'web' AND doc_id % 2 = 0)")
def checksum_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("checksum", F.sha2("text", 256))
    status = F.when((F.col("source") == "web") & (F.col("doc_id") % 2 == 0), "FAILED").otherwise("COMPLETED")
    asked = docs.where("doc_id % 10 = 3").select("checksum")
    return scans.by_checksum(docs.withColumn("status", status), asked).select("doc_id")


@register("overlapping_sources", "SELECT id FROM (SELECT l_suppkey AS id, list(l_orderkey) AS s FROM lineitem GROUP BY l_suppkey) WHERE list_has_any(s, [1, 2, 3, 10])")
def overlapping_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.collect_list("l_orderkey").alias("s"))
    return e.where(F.arrays_overlap("s", F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 10))))).select("id")


@register("subject_events", "SELECT event_id FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS rd FROM events) WHERE user_id = 3 AND (rd BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25') ORDER BY rd DESC NULLS LAST, event_id LIMIT 25")
def subject_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("rd", F.when(F.col("event_id") % 4 != 0, F.col("ts")))
    return scans.subject_events(e, F.col("user_id") == 3, "rd", "event_id", 25, _ntz("2024-01-05"), _ntz("2024-01-25")).select("event_id")


@register("active_facts", f"WITH {CHAIN} SELECT id FROM v WHERE o_custkey < 50 AND n = (SELECT max(n) FROM v w WHERE w.o_custkey = v.o_custkey)")
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).isNull().alias("is_active"))
    return v.where("is_active AND o_custkey < 50").select("id")


@register("namespace_versions", "SELECT p_name AS namespace, arg_max(p_partkey, p_partkey) AS id FROM part WHERE p_size > 10 GROUP BY p_name")
def namespace_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_name").alias("namespace"), F.col("p_partkey").alias("version"), F.col("p_partkey").alias("id"), (F.col("p_size") > 10).alias("is_active"))
    return scans.active_versions(rows).select("namespace", "id")


@register("source_types", "SELECT doc_id, CASE lower(trim(source)) WHEN 'web' THEN 'website' WHEN 'wiki' THEN 'encyclopedia' ELSE lower(trim(source)) END AS source_type FROM documents")
def source_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scans.canonical(F.col("source"), {"web": "website", "wiki": "encyclopedia"}).alias("source_type"))
