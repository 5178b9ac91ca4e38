"""Line dedup: MinHash over character shingles in DataFrame functions alone, no Python on the executors."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, table
from .components import blocks_apart, components

SHINGLE, SIMILARITY = 8, 0.8
#: A pair of similarity 0.8 shares none of 9 bands of 3 minima about once in 640, of 0.9 once in 140,000.
BANDS, ROWS = 9, 3
#: So many runs of a line are hashed and compared before the line's minima are looked up.
STRIDE = 4
#: A bucket with more than HOT of about SAMPLE sampled lines is dealt out over SALTS tasks.
SAMPLE, HOT, SALTS = 50_000, 200, 64
#: Members of a bucket that are still apart are compared in blocks of at most about so many members.
BLOCK_ROWS = 2048
#: A line's sketch has so many words of 64 bits.
WORDS = 16


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits for a row by id and text, nulls included."""
    parts = [doc_id.isNull(), doc_id, text]
    return [F.xxhash64(*parts).alias("r1"), F.xxhash64(F.lit(7), *parts).alias("r2")]


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, r1, r2, line (number from 0), h1, h2, body of each line that isn't blank; body is trimmed and in lower case."""
    split = docs.select(F.col(doc_id).alias("doc_id"), *row_key(F.col(doc_id), F.col(text)), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    split = split.withColumn("body", F.lower(F.trim("body"))).where(F.col("body") != "")
    return split.select("doc_id", "r1", "r2", "line", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(7), "body").alias("h2"), "body")


def shingle_count(body: Column) -> Column:
    return F.greatest(F.lit(1), F.length(body) - (SHINGLE - 1))


def shingle_set(body: Column) -> Column:
    """Distinct hashes of the runs of SHINGLE characters of a line in UTF-16; a shorter line is one run.

    The line is encoded once, as the element of a list of one: as a plain column it would
    be encoded anew for each run.
    """
    places = F.sequence(F.lit(1), shingle_count(body) * 2, F.lit(2))
    runs = lambda raw: F.array_distinct(F.transform(places, lambda p: F.xxhash64(F.substring(raw, p, F.lit(2 * SHINGLE)))))
    return F.transform(F.array(F.encode(body, "UTF-16BE")), runs)[0]


def _signatures(lines: DataFrame) -> DataFrame:
    """(key, k) for each band of each line. The rows of a line never leave its partition if that is by h1 and h2."""
    rng = random.Random(11)
    # encoded before the rows are exploded: in one select a line would be encoded anew for each position
    wide = lines.select("h1", "h2", "k", F.encode("body", "UTF-16BE").alias("raw"), (shingle_count(F.col("body")) - 1).alias("last"))
    places = wide.select("h1", "h2", "k", "raw", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STRIDE))).alias("p"))
    # beyond the end the last run counts again, which changes no minimum
    at = lambda j: F.least(F.col("p") + j, F.col("last")) * 2 + 1
    hashed = places.select("h1", "h2", "k", *(F.xxhash64(F.substring(F.col("raw"), at(j), F.lit(2 * SHINGLE))).alias(f"x0_{j}") for j in range(STRIDE)))
    for t in (1, 2):
        hashed = hashed.select("*", *(F.xxhash64(f"x{t - 1}_{j}").alias(f"x{t}_{j}") for j in range(STRIDE)))
    # the hash nearest to a random point, by exclusive or, is a random one of the union of two sets
    minima = []
    for i in range(BANDS * ROWS):
        point = F.lit(rng.getrandbits(63) - (1 << 62))
        minima.append(F.min(F.least(*(F.col(f"x{i % 3}_{j}").bitwiseXOR(point) for j in range(STRIDE)))).alias(f"m{i}"))
    signed = hashed.groupBy("h1", "h2", "k").agg(*minima)
    bands = [F.xxhash64(F.lit(b), *(f"m{b + BANDS * r}" for r in range(ROWS))) for b in range(BANDS)]
    return signed.select("k", F.explode(F.array(*bands)).alias("key"))


def _candidates(ws: Workspace, lines: DataFrame, n_lines: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of line numbers k within buckets, and (key, k) of all members of buckets of two and more.

    Each member is paired with its bucket's first and with the one before it. Each band
    orders its members by another hash, so firsts and neighbours differ from band to
    band. Pairs are at most twice the members. Hot buckets, known from a sample, are
    first dealt by salt; the salts' firsts then form one bucket. The sample decides on
    tasks only, not on which lines count.
    """
    sample = _signatures(lines.sample(min(1.0, SAMPLE / max(1, n_lines)), seed=3)).groupBy("key").count().where(F.col("count") > HOT)
    hot = sample.select("key", F.lit(SALTS).alias("salts")).collect()  # at most SAMPLE * BANDS / HOT rows
    keyed = _signatures(lines)

    def near(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.xxhash64("key", "k"), "k")
        # dealt out here, so that the hash to sort by is made after the shuffle
        return rows.repartition(*by).select(*by, "k", F.first("k").over(w).alias("first"), F.lag("k").over(w).alias("before"))

    def pairs(rows: DataFrame) -> DataFrame:
        both = rows.where(F.col("before").isNotNull()).select(F.explode(F.array_distinct(F.array("first", "before"))).alias("o"), "k")
        return both.select(F.least("o", "k").alias("a"), F.greatest("o", "k").alias("b"))

    if hot:
        keyed = keyed.join(F.broadcast(ws.spark.createDataFrame(hot, "key long, salts int")), "key", "left")
        keyed = keyed.select("key", "k", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("k"), "salts") + 1).cast("byte").alias("salt"))
    by = ("key", "salt") if hot else ("key",)
    local = ws.cut(near(keyed, *by).where(F.col("before").isNotNull() | (F.col("salt") > 0) if hot else F.col("before").isNotNull()), "near")
    members = local.select("key", "k").union(local.select("key", "first")).distinct()
    if not hot:
        return pairs(local).distinct(), members
    heads = local.where(F.col("before").isNull()).select("key", "k")
    return pairs(local).union(pairs(near(heads, "key"))).where(F.col("a") != F.col("b")).distinct(), members


def _links(lines: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of lines (k, body) whose whole sets are similar."""

    def body(side: str) -> DataFrame:
        return lines.select(F.col("k").alias(side), F.col("body").alias(f"body_{side}"))

    # bodies are shuffled in UTF-8, half as long, and encoded where they are taken apart
    met = pairs.select("a", "b").join(body("a"), "a").join(body("b"), "b")
    sets = met.select("a", "b", shingle_set(F.col("body_a")).alias("x"), shingle_set(F.col("body_b")).alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    return sets.where(same >= similarity * (F.size("x") + F.size("y") - same)).select("a", "b")


def _own(lines: DataFrame, members: DataFrame) -> DataFrame:
    """(k, body) of the lines of members. Bodies stay where they are until a member asks for them, and needn't be sorted."""
    asked = members.select("k").distinct().join(lines.select("k", "h1", "h2"), "k")
    return lines.select("h1", "h2", "body").join(asked.hint("shuffle_hash"), ["h1", "h2"]).select("k", "body")


def _sketches(lines: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """k, n, s of each line of members, or of all: the size of its set, and bits that are set if an odd number of its hashes fall there."""
    own = lines if members is None else _own(lines, members)
    hashed = own.repartition("k").select("k", F.explode(shingle_set(F.col("body"))).alias("x"))
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(x, 58) AS INT))")
    # word by word first: of a line's many hashes each then changes one sum, not WORDS
    by_word = hashed.groupBy("k", F.col("x").bitwiseAND(F.lit(WORDS - 1)).alias("word")).agg(F.count("*").alias("n"), F.bit_xor(bit).alias("bits"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("word") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"s{i}") for i in range(WORDS)]
    return by_word.groupBy("k").agg(F.sum("n").alias("n"), *words).select("k", "n", F.array(*(f"s{i}" for i in range(WORDS))).alias("s"))


def may_be_similar(similarity: float) -> Column:
    """False only for sketches (n_a, s_a), (n_b, s_b) of sets that are less similar.

    A bit differs only where one of the two sets has a hash that the other lacks, so sets
    differ in at least as many hashes as their sketches in bits.
    """
    differ = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(1, WORDS)), F.bit_count(F.col("s_a")[0].bitwiseXOR(F.col("s_b")[0])))
    near = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    return near & (differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6)


def _within(ws: Workspace, own: DataFrame, sketches: DataFrame, members: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members (key, k) of a bucket that lie in different components (node, root) so far.

    Members outside a bucket's largest component meet all members, in blocks, by their
    sketches; pairs that may be similar are verified on whole sets, once each.
    """
    placed = members.join(roots.withColumnRenamed("node", "k"), "k", "left").select("key", "k", F.coalesce("root", "k").alias("root"), F.lit(1).alias("n"))
    rest = ws.cut(blocks_apart(placed, BLOCK_ROWS, BLOCK_ROWS), "apart")
    rest = rest.join(sketches.select("k", "n", "s"), "k").repartition("key", "i", "j")

    def side(x: str, other: int) -> DataFrame:
        return rest.where(F.col("side") != other).select("key", "i", "j", F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "s")))

    met = side("a", 1).hint("merge").join(side("b", 0), ["key", "i", "j"]).where((F.col("root_a") != F.col("root_b")) & may_be_similar(similarity))
    met = ws.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    return _links(own, met, similarity)


def _line_roots(ws: Workspace, lines: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the numbers k of linked lines.

    First each line is held against the first of its candidates; of the other pairs
    only those whose lines are still in different components are left to verify. Then
    what is still apart within a bucket is compared in full, so that no two lines of
    one bucket in different components go unverified.
    """
    spark, conf = ws.spark, "spark.sql.codegen.aggregate.map.twolevel.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # with it the code of so many minima is too long to be compiled
    try:
        pairs, members = _candidates(ws, lines.select("h1", "h2", "k", "body"), lines.count())
        pairs = ws.cut(pairs, "candidates")
        own = ws.cut(_own(lines, members), "own")
        sketches = ws.cut(_sketches(own), "sketches")
    finally:
        spark.conf.set(conf, before)
    at = lambda x: sketches.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    plausible = pairs.join(at("a"), "a").join(at("b"), "b").where(may_be_similar(similarity))
    pairs = ws.cut(plausible.select("a", "b"), "pairs")
    ws.drop("candidates")
    once = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = ws.cut(_links(own, once, similarity), "links")
    roots = ws.cut(components(ws, links, "first"), "roots")
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    rest = pairs.join(once.select("b", F.col("a").alias("done")), "b").where(F.col("a") != F.col("done"))
    rest = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = ws.cut(_links(own, rest.select(pairs.columns), similarity), "more")
    second = ws.cut(components(ws, links.union(more), "lines"), "second")
    last = ws.cut(_within(ws, own, sketches, members, second, similarity), "last")
    ws.drop("near", "apart", "sketches", "met", "own")
    return components(ws, second.toDF("a", "b").union(last), "within")


def line_groups(ws: Workspace, docs: DataFrame, doc_id: str, text: str, similarity: float) -> DataFrame:
    """(r1, r2, gone): for each row that loses lines, the numbers of these."""
    spark = ws.spark
    first = F.struct("doc_id", "r1", "r2", "line")
    distinct = lines_of(docs, doc_id, text).groupBy("h1", "h2").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.min("body").alias("body"))
    distinct = distinct.withColumn("k", F.monotonically_increasing_id())
    # bucketed by the line's key: neither signing nor the look-up of bodies then moves a body again
    name = f"loomlake_lines_{uuid.uuid4().hex}"
    distinct.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "h1", "h2").option("path", f"{ws.root}/lines").saveAsTable(name)
    ws.release()
    lines = spark.table(name)
    roots = _line_roots(ws, lines, similarity)

    linked = lines.select("k", "first").join(roots.select(F.col("node").alias("k"), "root"), "k")
    keepers = linked.join(linked.groupBy("root").agg(F.min("first").alias("keep")), "root").select("k", "keep")
    known = lines.select("h1", "h2", "k", "first", "n").join(keepers, "k", "left").where((F.col("n") > 1) | F.col("keep").isNotNull())
    known = ws.cut(known.select("h1", "h2", F.coalesce("keep", "first").alias("keep")), "known")
    spark.sql(f"DROP TABLE {name}")
    ws.drop("lines", "pairs", "links", "roots", "more", "second", "last")
    found = lines_of(docs, doc_id, text).drop("body").join(known, ["h1", "h2"]).where(~F.struct("doc_id", "r1", "r2", "line").eqNullSafe(F.col("keep")))
    return found.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def mark_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Adds `gone` to each row: the numbers, from 0, of lines that copy or resemble one kept elsewhere.

    Lines end at "\\n" and are compared trimmed and in lower case; blank ones always stay.
    Two are linked if the sets of their runs of 8 characters (a shorter line is one run)
    have a Jaccard similarity of `similarity` or more, verified on whole sets; of each
    component of links one line stays, the first by doc_id (nulls first), then by a hash
    of the row, then by number. Candidates come from MinHash bands: a link between
    different lines may be missed, with the odds stated at BANDS, if they share no bucket,
    but none within a bucket that would join two components; equal lines never are.
    Rows equal in id and text count as one row and return alike. Null and empty texts
    lose nothing (`gone` is empty). Other columns stay; one named `gone` is replaced.
    """
    ws = Workspace(docs.sparkSession, "lines")
    gone = ws.cut(line_groups(ws, docs, doc_id, text, similarity), "gone")
    # whole rows travel as one column, so that no name of theirs can meet another
    keyed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns if c.lower() != "gone")).alias("row"), *row_key(F.col(doc_id), F.col(text)))
    return keyed.join(gone, ["r1", "r2"], "left").select("row.*", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def without_lines(text: Column, gone: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i)), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Texts without the lines that `mark_lines` marks; rows that lose all lines with words go. Columns stay."""
    rows = docs.select("doc_id", text, F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"))
    marked = mark_lines(rows, "doc_id", text, similarity)
    left = F.when(F.size("gone") == 0, F.col(text)).otherwise(without_lines(F.col(text), F.col("gone")))
    out = marked.select("row", "gone", left.alias("left")).where((F.size("gone") == 0) | (F.trim(F.translate("left", "\n\r\t", "")) != ""))
    return out.select(*(F.col("left").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_gone"), F.col("gone").alias("gone_lines"))


#: All pairs that share a run of 8 characters: for small tables.
ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, line, lower(trim(x, ' ')) AS b
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents) WHERE trim(x, ' ') <> ''
), d AS (SELECT b, row_number() OVER (ORDER BY b) AS k, min(struct_pack(d := doc_id, l := line)) AS f FROM l GROUP BY b),
s AS (SELECT DISTINCT k, substr(b, p, 8) AS g FROM (SELECT k, b, unnest(range(1, greatest(2, length(b) - 6))) AS p FROM d)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE c >= 0.8 * (x.n + y.n - c)),
u AS (FROM e UNION SELECT b, a FROM e),
r(k, c) AS (SELECT k, k FROM d UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.k),
m AS (SELECT k, min(c) AS c FROM r GROUP BY k),
f AS (SELECT c, min(f) AS f FROM m JOIN d USING (k) GROUP BY c),
g AS (SELECT l.doc_id, l.line FROM l JOIN d USING (b) JOIN m USING (k) JOIN f USING (c) WHERE f.f.d <> l.doc_id OR f.f.l <> l.line),
o AS (SELECT doc_id, list(CAST(line AS INTEGER) ORDER BY line) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_gone, coalesce(gone, []) AS gone_lines FROM documents LEFT JOIN o USING (doc_id)
"""
