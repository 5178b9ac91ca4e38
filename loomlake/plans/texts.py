"""Queries of text, chunking, time and pattern operators, with equivalent SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, temporal, text
from ..operators import patterns, resolution
from ..sources.readers import table
from .catalog import register

NOW = datetime(2024, 6, 30, 12, 0)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- words -------------------------------------------------------------------------------

SPOKEN = "'Um, I don''t REALLY know what''s new so we''ll wait!!! They can''t ' || text"


def _expanded(x: str) -> str:
    for pattern, full in text.EXPANSIONS:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{full.replace('$1', chr(92) + '1')}', 'g')"
    return x


@register("query_normalised", f"WITH q AS (SELECT conv_id, turn, {_expanded(f'trim(lower({SPOKEN}))')} AS q FROM conversations), w AS (SELECT conv_id, turn, list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '' AND w NOT IN ({_sql_list(text.FILLERS)})) AS w FROM q) SELECT conv_id, turn, trim(regexp_replace(array_to_string(w, ' '), '([?!.]){{2,}}', '\\1', 'g')) AS q FROM w")
def query_normalised(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("Um, I don't REALLY know what's new so we'll wait!!! They can't "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.normalise_query(said).alias("q"))


def _stem_sql(w: str) -> str:
    return "CASE " + " ".join(f"WHEN ends_with({w}, '{x}') AND length({w}) > {len(x) + 2} THEN left({w}, length({w}) - {len(x)})" for x in text.SUFFIXES) + f" ELSE {w} END"


@register("search_terms", f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')) AS w FROM documents), s AS (SELECT doc_id, {_stem_sql('w')} AS t FROM w WHERE w NOT IN ({_sql_list(text.SEARCH_STOPS)})) SELECT doc_id, t AS term, count(*) AS tf FROM s WHERE length(t) > 2 GROUP BY ALL")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return text.search_counts(table(spark, d, "documents"), "doc_id", "text")


@register("keywords", f"WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(text), '[ß-ɏ]', '9', 'g'), '\\b([a-z]{{3,}})\\b', 1), lambda w: w NOT IN ({_sql_list(text.KEYWORD_STOPS)}))) AS w FROM conversations) SELECT conv_id, turn, list_sort(w) AS keywords FROM w")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_sort(text.keywords(F.col("text"))).alias("keywords"))


@register("entity_names", "SELECT c_custkey, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower('Dr.  ' || c_name || '  (' || c_mktsegment || ')!'), '^(?:mr\\.|mrs\\.|ms\\.|dr\\.|prof\\.|sir |lord |lady )', ''), '\\s+', ' ', 'g')), '^[.,;:!?\"''()\\[\\]{}-]+|[.,;:!?\"''()\\[\\]{}-]+$', '', 'g')) AS name FROM customer")
def entity_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", text.normalise_name(F.concat(F.lit("Dr.  "), "c_name", F.lit("  ("), "c_mktsegment", F.lit(")!"))).alias("name"))


@register("contact_keys", "SELECT c_custkey, lower(trim(' ' || c_name || '@Example.COM ')) AS email, regexp_replace(regexp_replace(regexp_replace(lower('HTTPS://WWW.' || c_mktsegment || '.com//'), '^https?://', ''), '^www\\.', ''), '/+$', '') AS site, array_to_string(list_transform(regexp_extract_all('say \"' || c_name || '\" - now', '([\\p{L}\\p{N}_]+)', 1), lambda w: '\"' || w || '\"'), ' OR ') AS fts, regexp_replace(upper(c_name), '[^A-Z0-9_]', '_', 'g') AS label FROM customer")
def contact_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_name")
    site = F.concat(F.lit("HTTPS://WWW."), "c_mktsegment", F.lit(".com//"))
    return table(spark, d, "customer").select("c_custkey", text.email(F.concat(F.lit(" "), name, F.lit("@Example.COM "))).alias("email"), text.site(site).alias("site"), text.fts_query(F.concat(F.lit('say "'), name, F.lit('" - now'))).alias("fts"), text.safe_label(name).alias("label"))


PAIRS = "p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y, a.p_type AS s, b.p_type AS t FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"


def _pairs(spark: SparkSession, d: str, scores, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_size", F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    return resolution.name_pairs(rows, ["p_brand", "p_size"], scores, carry)


@register("name_similarity", f"WITH {PAIRS} SELECT a, b, round(jaro_winkler_similarity(x, y), 6) AS jw, round(len(list_intersect(list_distinct(string_split(x, ' ')), list_distinct(string_split(y, ' ')))) / greatest(len(list_distinct(string_split(x, ' '))), len(list_distinct(string_split(y, ' ')))), 6) AS overlap FROM p")
def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, lambda x, y: [_r(text.jaro_winkler(x, y)).alias("jw"), _r(text.token_overlap(x, y)).alias("overlap")])


@register("type_matches", f"WITH {PAIRS}, q AS (SELECT a, b, CASE WHEN s = 'ECONOMY' THEN 'CONCEPT' ELSE s END AS s, t, x, split_part(y, ' ', 1) AS y FROM p) SELECT a, b, s = t OR s = 'CONCEPT' OR t = 'CONCEPT' AS fits, CASE WHEN s = t THEN 1.0::DOUBLE WHEN s = 'CONCEPT' THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS penalty, round(CASE WHEN contains(x, y) AND length(y) <= length(x) THEN length(y) / length(x) WHEN contains(y, x) THEN length(x) / length(y) ELSE 0 END, 6) AS held FROM q")
def type_matches(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d, lambda x, y: [_r(text.containment(x, F.substring_index(y, " ", 1))).alias("held")], ("type",))
    s, t = F.when(F.col("a_type") == "ECONOMY", "CONCEPT").otherwise(F.col("a_type")), F.col("b_type")
    return p.select("a", "b", text.types_compatible(s, t).alias("fits"), text.type_penalty(s, t).alias("penalty"), "held")


ENTITIES = """n AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'the ' || p_name ELSE p_name || 's' END AS name, p_type AS type FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, CASE WHEN p_partkey % 4 = 0 THEN 'the ' || p_name END AS alias FROM part WHERE p_partkey % 2 = 0)"""


@register("entity_resolution", f"""WITH {ENTITIES},
c AS (SELECT n.id, e.id AS entity, CASE WHEN lower(n.name) = lower(e.name) THEN 1.0 WHEN lower(n.name) = lower(e.alias) THEN 1.0 ELSE 0.6 * jaro_winkler_similarity(lower(n.name), lower(e.name)) + 0.4 * len(list_intersect(string_split(lower(n.name), ' '), string_split(lower(e.name), ' '))) / greatest(len(list_distinct(string_split(lower(n.name), ' '))), len(list_distinct(string_split(lower(e.name), ' ')))) END AS score,
  CASE WHEN lower(n.name) = lower(e.name) THEN 'exact' WHEN lower(n.name) = lower(e.alias) THEN 'alias' ELSE 'fuzzy' END AS kind FROM n JOIN e ON n.type = e.type),
r AS (SELECT id, entity, kind, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY CASE kind WHEN 'exact' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END, round(score, 9) DESC, entity) AS k FROM c WHERE kind <> 'fuzzy' OR score > 0.7) SELECT id, entity, kind, score FROM r WHERE k = 1""")
def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit("the "), "p_name")).otherwise(F.concat("p_name", F.lit("s")))
    new = p.where("p_partkey % 2 = 1").select(k.alias("id"), name.alias("name"), F.col("p_type").alias("type"))
    old = p.where("p_partkey % 2 = 0").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array_compact(F.array(F.when(k % 4 == 0, F.concat(F.lit("the "), "p_name")))).alias("aliases"))
    return resolution.resolve(new, old, 0.7).withColumn("score", _r("score"))


@register("blocked_pairs", """WITH k AS (SELECT DISTINCT p_partkey AS id, left(unnest(regexp_extract_all(lower(p_name), '[a-z0-9]{2,}')), 3) AS k FROM part), v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.k = b.k AND a.id < b.id WHERE a.id IN (SELECT id FROM v) AND b.id IN (SELECT id FROM v))
SELECT a, b, round(list_dot_product(x.e, y.e), 6) AS score FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE list_dot_product(x.e, y.e) >= 0.4""")
def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    rows = names.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")
    return resolution.blocked_pairs(rows, 0.4).withColumn("score", _r("score"))


# ---- chunks ------------------------------------------------------------------------------


@register("fixed_chunks", r"""WITH RECURSIVE c(doc_id, text, a, z) AS (
  SELECT doc_id, text, 0, CASE WHEN length(text) <= 2048 THEN length(text) ELSE (SELECT CASE WHEN s > 0 THEN 2048 - s ELSE 2048 END FROM (SELECT strpos(reverse(substr(text, 1025, 1024)), ' ') AS s)) END FROM documents WHERE trim(text, E' \t\n\r') <> ''
  UNION ALL
  SELECT doc_id, text, n, CASE WHEN n + 2048 >= length(text) THEN length(text) ELSE n + 2048 - greatest(0, strpos(reverse(substr(text, n + 1025, 1024)), ' ')) END FROM (SELECT doc_id, text, z - 200 AS n FROM c WHERE z < length(text))
), t AS (SELECT doc_id, a, trim(substr(text, a + 1, z - a), E' \t\n\r') AS content FROM c)
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, content FROM t WHERE content <> ''""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, "documents"), "doc_id", "text")


@register("recursive_chunks")
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents"), "doc_id", "text")


@register("conversation_chunks", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 15 * 60000000 THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) - 1) // 4 AS p FROM h),
k AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY s, p) - 1 AS k FROM p), r AS (SELECT user_id, k, count(*) AS n, min(ts) AS a, max(ts) AS b FROM k GROUP BY ALL),
o AS (SELECT *, k = 0 OR (n > 1 AND NOT (k = 1 AND lag(n) OVER (PARTITION BY user_id ORDER BY k) = 1)) AS o FROM r), c AS (SELECT *, CAST(sum(CAST(o AS INT)) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS chunk FROM o),
w AS (SELECT user_id, chunk, min(a) AS a, max(b) AS b FROM c GROUP BY ALL), f AS (SELECT *, coalesce(epoch_us(a) - epoch_us(lag(b) OVER (PARTITION BY user_id ORDER BY chunk)) > 30 * 60000000, false) AS f FROM w), z AS (SELECT *, CAST(sum(CAST(f AS INT)) OVER (PARTITION BY user_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)
SELECT user_id, event_id, chunk, session FROM k JOIN c USING (user_id, k) JOIN z USING (user_id, chunk)""")
def conversation_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.conversation_chunks(table(spark, d, "events"), "user_id", "ts", "event_id", most=4)


# ---- time --------------------------------------------------------------------------------

ASKED = "CASE turn % 7 WHEN 0 THEN 'what changed since last week' WHEN 1 THEN 'who is the lead right now' WHEN 2 THEN 'it may rain' WHEN 3 THEN 'what happened in may 2024-05' WHEN 4 THEN 'how often was it updated recently' WHEN 5 THEN 'unchanged' ELSE 'which came first' END"


def _category_sql() -> str:
    quote = lambda p: p.replace("'", "''")
    hits = ", ".join(" + ".join(f"CAST(regexp_matches(q, '{quote(p)}') AS INT)" for c, p in temporal.patterns() if c == k) + f" AS h{k}" for k in temporal.CATEGORIES)
    n = " + ".join(f"h{k}" for k in temporal.CATEGORIES)
    kinds = " + ".join(f"CAST(h{k} > 0 AS INT)" for k in temporal.CATEGORIES)
    best = "greatest(" + ", ".join(f"CASE WHEN h{k} > 0 THEN {k} ELSE 0 END" for k in temporal.CATEGORIES) + ")"
    return f"WITH a AS (SELECT conv_id, turn, lower({ASKED}) AS q FROM conversations), h AS (SELECT conv_id, turn, q, {hits} FROM a), s AS (SELECT conv_id, turn, q, {best} AS category, CASE WHEN {n} = 1 THEN 0.6 WHEN {n} = 2 AND {kinds} > 1 THEN 0.85 WHEN {n} = 2 THEN 0.8 ELSE 0.95 END AS c FROM h) SELECT conv_id, turn, category, round(CAST(CASE WHEN category = 0 THEN 0 WHEN regexp_matches(q, '{temporal.DATE}') THEN least(c + 0.1, 1) ELSE c END AS DOUBLE), 6) AS confidence FROM s"


@register("temporal_category", _category_sql())
def temporal_category(spark: SparkSession, d: str) -> DataFrame:
    q = F.expr(ASKED)
    return table(spark, d, "conversations").select("conv_id", "turn", temporal.category(q).alias("x")).select("conv_id", "turn", "x.category", _r("x.confidence").alias("confidence"))


@register("resolved_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-14 23:59:59' UNION ALL SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-03-31 23:59:59' AND event_type = 'click'")
def resolved_range(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first, _ = temporal.resolve_range("January 2024", NOW)
    a, b = temporal.resolve_range("q1 2024", NOW)
    low = temporal.in_range(F.col("ts"), "between", F.lit(first).cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ '2024-01-14 23:59:59'"))
    return e.where(low).select("event_id").union(e.where(temporal.in_range(F.col("ts"), "between", F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz")) & (F.col("event_type") == "click")).select("event_id"))


@register("valid_ranges", "WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS s, o_orderdate + to_days(CAST(o_orderkey % 2000 - 1000 AS INT)) AS e FROM orders), w AS (SELECT o_orderkey, CASE WHEN s IS NOT NULL AND s > e THEN e ELSE s END AS s, CASE WHEN s IS NOT NULL AND s > e THEN s ELSE e END AS e FROM v), x AS (SELECT o_orderkey, CASE WHEN s > TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' ELSE s END AS s, CASE WHEN e > TIMESTAMP '2000-06-01' THEN TIMESTAMP '2000-06-01' ELSE e END AS e FROM w) SELECT o_orderkey, CASE WHEN s >= TIMESTAMP '2000-06-01' - INTERVAL 3650 DAYS THEN s END AS low, CASE WHEN e >= TIMESTAMP '2000-06-01' - INTERVAL 3650 DAYS THEN e END AS high FROM x")
def valid_ranges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("s"), F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 2000 - 1000 AS INT))").alias("e"))
    low, high = temporal.valid_range(F.col("s"), F.col("e"), F.expr("TIMESTAMP_NTZ '2000-06-01'"))
    return o.select("o_orderkey", low.alias("low"), high.alias("high"))


@register("time_buckets", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u}" for u in ("day", "week", "month", "quarter", "year")) + " FROM events")
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").select("event_id", temporal.buckets(F.col("ts")).alias("b"))
    return b.select("event_id", *(F.col(f"b.{u}").alias(u) for u in ("day", "week", "month", "quarter", "year")))


@register("covering_buckets", "WITH u AS (SELECT user_id, min(ts) FILTER (WHERE event_id % 3 = 0) AS a, max(ts) FILTER (WHERE event_id % 3 = 0 AND value > 70) AS b FROM events GROUP BY user_id) SELECT user_id, " + "CASE " + " ".join(f"WHEN date_trunc('{u}', a) = date_trunc('{u}', b) THEN '{u}'" for u in ("day", "week", "month", "quarter", "year")) + " END AS unit FROM u")
def covering_buckets(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("event_id") % 3 == 0
    u = table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(third, F.col("ts"))).alias("a"), F.max(F.when(third & (F.col("value") > 70), F.col("ts"))).alias("b"))
    return u.select("user_id", temporal.covering(F.col("a"), F.col("b")).alias("unit"))


@register("event_times", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END) AS t FROM orders")
def event_times(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", temporal.event_time(F.when(k % 2 == 0, t), F.when(k % 3 == 0, t + F.expr("INTERVAL 1 DAY"))).alias("t"))


# ---- patterns, closed sets, arrays, bits ---------------------------------------------------


@register("event_patterns", "SELECT event_id, ((event_type = 'click' OR starts_with(event_type, 'pur')) AND value > 10 AND value <= 80) OR (regexp_matches(event_type, '^v.*w$') AND NOT user_id IN (1, 2)) AS hit, event_type NOT IN ('click', 'view') AS other, NOT starts_with(event_type, 'c') AS unlike FROM events")
def event_patterns(spark: SparkSession, d: str) -> DataFrame:
    c = {"type": F.col("event_type"), "value": F.col("value"), "user": F.col("user_id")}
    pattern = {"$or": [{"type": ["click", {"prefix": "pur"}], "value": [{"numeric": [">", 10, "<=", 80]}]}, {"type": [{"wildcard": "v*w"}], "user": [{"anything-but": [1, 2]}], "absent": [{"exists": False}]}]}
    x = lambda p: patterns.matches(p, c)
    return table(spark, d, "events").select("event_id", x(pattern).alias("hit"), x({"type": {"anything-but": ["click", "view"]}}).alias("other"), x({"type": [{"anything-but": {"prefix": "c"}}]}).alias("unlike"))


@register("open_items", "SELECT o_orderkey, NOT (o_orderstatus = 'F' AND coalesce(CASE o_orderkey % 3 WHEN 0 THEN 'Done' WHEN 1 THEN 'open' END IN ('Done'), false)) AS open FROM orders")
def open_items(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 3 == 0, "Done").when(F.col("o_orderkey") % 3 == 1, "open")
    return table(spark, d, "orders").select("o_orderkey", patterns.open_items(F.col("o_orderstatus"), status, ("F",)).alias("open"))


@register("chunk_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type = 'click' AND event_id % 2 = 0 AND event_id % 3 = 0")
def chunk_filter(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(*(F.when(F.col("event_id") % k == 0, F.lit(f"t{k}")) for k in (2, 3, 5))))
    c = {"occurred_at": F.col("ts"), "source": F.col("event_type"), "tags": tags}
    return table(spark, d, "events").where(patterns.chunk_filter(c, F.expr("TIMESTAMP_NTZ '2024-01-05'"), F.expr("TIMESTAMP_NTZ '2024-01-25'"), "click", tags=["t2", "t3"])).select("event_id")


@register("array_rules", "WITH l AS (SELECT l_orderkey AS id, list(DISTINCT l_linenumber) AS x, list(DISTINCT l_linenumber + 2) AS y FROM lineitem GROUP BY l_orderkey) SELECT id, list_has_any(x, y) AS overlap, list_has_all(y, [3, 4]) AS holds, list_sort(list_distinct(list_concat(x, y))) AS joined FROM l")
def array_rules(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_linenumber").alias("x"), F.collect_set(F.col("l_linenumber") + 2).alias("y"))
    return x.select("id", F.arrays_overlap("x", "y").alias("overlap"), (F.size(F.array_except(F.array(F.lit(3), F.lit(4)), "y")) == 0).alias("holds"), F.array_sort(F.array_union("x", "y")).alias("joined"))


@register("sign_bits", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x, unnest((SELECT e FROM q)) AS y FROM embeddings) SELECT vec_id, CAST(count(*) FILTER (WHERE (x >= 0) <> (y >= 0)) AS INTEGER) AS distance FROM d GROUP BY vec_id")
def sign_bits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(resolution.signs(F.col("embedding")).alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.bit_count(resolution.signs(F.col("embedding")).bitwiseXOR(F.col("q"))).alias("distance"))  # q has one row
