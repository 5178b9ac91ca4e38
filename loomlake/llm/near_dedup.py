"""MinHash near-dedup with SetSketch registers: banding, joint likelihood, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import Workspace, byte_table, mix64, parts, table, text_bytes
from .components import blocks_apart, components

WORDS, PERCENT = 4, 80
#: A link of similarity 0.8 shares none of 30 bands of 6 registers once in 9,000 times, and others less often.
BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
#: Registers hold 1 - log_BASE of the least of exponential variables of rate RATE, cut to 0 .. TOP.
BASE, RATE, TOP = 1.02, 20.0, 65535
#: Pairs whose likeliest similarity lies more than this below the threshold aren't verified: 5 standard deviations.
MARGIN = 0.15
#: A bucket's members are compared in blocks of at most about so many members, and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
_A = (mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix64(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_C = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)
_P = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for p in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(n, p, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def word_hashes(raw: bytes, at: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (`kind` as in byte_table), and each text's first word."""
    data = np.frombuffer(raw.translate(byte_table(kind)), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True  # texts lie one after another without a blank
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    power, inverse = _powers(1 << max(16, int(len(data) + 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix64(h + (end - start).astype(np.uint64) * _C[63]), np.searchsorted(start, at)


def shingle_sets(raw: bytes, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its runs of `words` words; a shorter text is one run."""
    h, first = word_hashes(raw, at)
    n = max(0, len(h) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(words):
        mixed += h[j : j + n] * _C[j]
    mixed = mix64(mixed)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _C[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set; those of a union are the maxima of its parts' registers."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(h), 1024):
        t = np.multiply.outer(_A, h[a : a + 1024])
        t += _B[:, None]
        t ^= t >> np.uint32(16)
        t *= np.uint32(0x85EBCA6B)
        np.minimum(least, t.min(1), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def likely_jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """The similarity of greatest likelihood, for rows of registers and the sizes of both sets.

    What is observed: how many registers are larger in a, in b, and equal.
    """
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, steps)[None] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more * log(up) + less * log(down) + (a.shape[1] - more - less) * log(1 - up - down)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def _sketch(words: int):
    """Of each row: doc_id, mark (of its text), size, fingerprint and registers of its set."""

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts(batches):
            sets = shingle_sets(*text_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_print(s) for s in sets], pa.binary()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "mark", "n", "fp", "regs"])

    return sketch


def _print(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sets(words: int):
    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts(batches):
            found = shingle_sets(*text_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([pa.array([_print(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["fp", "items"])

    return sets


def _bands(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part in parts(batches, 4096):
        r = np.frombuffer(b"".join(part.column("regs").to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(r), 0)
        for j in range(ROWS):
            key = mix64(key * _C[60] + r[:, :, j] + np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("k").to_numpy(), BANDS))], names=["key", "k"])


def _likely(threshold: float):
    def likely(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts(batches, 2048):
            a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            j = likely_jaccard(a, b, part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float))
            yield part.select(["a", "b"]).filter(pa.array(j >= threshold))

    return likely


def _linked(x: int, nx: int, ny: int, percent: int) -> bool:
    return 100 * x >= percent * (nx + ny - x)


def _verify(percent: int):
    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts(batches, 512):
            good = []
            for x, y in zip(part.column("ia").to_pylist(), part.column("ib").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                good.append(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify


def _within(percent: int):
    def within(group):
        """Links between left (side 0, 2) and right (1, 2) members of a block in different components: a spanning forest."""
        import pyarrow as pa

        items = group.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        at = np.frombuffer(items.buffers()[1], np.int32)[items.offset : items.offset + len(items) + 1] // 8
        flat = np.frombuffer(items.buffers()[2], np.uint64)[at[0] : at[-1]]
        start, size = at[:-1] - at[0], np.diff(at)
        values, number = np.unique(flat, return_inverse=True)
        number = number.astype(np.int32)
        k, root, side = (group.column(c).to_numpy().copy() for c in ("k", "root", "side"))
        mark, edges = np.zeros(len(values), bool), []
        for x in np.flatnonzero(side != 1).tolist():
            own = number[start[x] : start[x] + size[x]]
            # sizes alone rule a pair out if they are too unlike
            fit = (root != root[x]) & (side != 0) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
            if not fit.any():
                continue
            mark[own] = True
            hits = np.add.reduceat(mark[number], start, dtype=np.int64)
            mark[own] = False
            for y in np.flatnonzero(fit & (100 * hits >= percent * (size + size[x] - hits))).tolist():
                if root[x] != root[y]:
                    edges.append((k[x], k[y]))
                    root[root == root[y]] = root[x]
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return within


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    A text's set holds its distinct runs of `words` words (ASCII white space parts words,
    A-Z lower-cased), a shorter text is one run; null, empty and blank texts have none
    and are linked with nothing. Texts are linked if 100 * intersection >= percent *
    union, on whole sets; component_id is the least doc_id reachable, kept says that it is
    the row's own. Rows that repeat, also under one id, each return; a null id is no
    least one unless all are null. Other columns are left out.

    Equal sets become one class at once (16-byte fingerprint). Classes that share a band
    of SetSketch registers are candidates. First each is held against the least of its
    bucket: by likelihood of the registers, then on whole sets. In buckets with members
    still apart, those outside the largest component are then held against all, in blocks
    of bounded size that return a spanning forest, never all pairs. So no candidate pair in different components goes
    unverified. Texts are shuffled once, for the members of buckets of two and more.
    """
    out = _classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, percent)
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, and every row without words; columns stay.

    Of a group the row of the least doc_id (nulls first), then of the least hash of its
    text, stays; of rows equal in both one stays. Links are those of near_duplicates.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = _classes(named, words, percent)
    alone = out.where(F.col("fp").isNull()).select("doc_id", "mark", F.lit(1).alias("n"))
    first = out.where(F.col("fp").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    # how many rows share the first one's id and text: of these but one go
    repeats = out.where(F.col("fp").isNotNull()).groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    first = first.select("first.*").alias("f").join(repeats.alias("r"), F.col("f.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("f.mark") == F.col("r.mark"))).select("f.doc_id", "f.mark", "r.n")
    stay = Workspace(docs.sparkSession, "stay").cut(first.union(alone.withColumn("n", F.lit(1).cast("long"))).distinct(), "rows")
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"))
    found = rows.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.mark") == F.col("s.mark"))).select("d.*", "s.n")
    once = found.where(F.col("n") > 1).groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    return found.where(F.col("n") == 1).select("row").union(once.select("row")).select("row.*")


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, mark, n, fp, root, component_id) of each row; fp is null without words."""
    spark = docs.sparkSession
    ship(spark)
    ws = Workspace(spark, "near")
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.withColumn("mark", F.coalesce(F.xxhash64("text"), F.lit(0)))
    sketches = ws.cut(marked.mapInArrow(_sketch(words), f"doc_id {kind}, mark long, n long, fp binary, regs binary"), "sketches")
    grouped = sketches.where(F.col("n") > 0).groupBy("fp").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.any_value("regs").alias("regs"))
    classes = ws.cut(grouped.withColumn("k", F.monotonically_increasing_id()), "classes")

    bands = ws.cut(classes.select("k", "regs").mapInArrow(_bands, "key long, k long"), "bands")
    shared = bands.groupBy("key").agg(F.min("k").alias("pivot"), F.count("*").alias("c")).where(F.col("c") > 1)
    buckets = ws.cut(bands.join(shared.select("key", "pivot"), "key"), "buckets")
    ws.drop("bands")

    pairs = buckets.where(F.col("k") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct()
    side = lambda x: classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent / 100 - MARGIN), "a long, b long")
    likely = ws.cut(likely, "likely")

    members = buckets.select("k").distinct().join(classes.select("k", "fp", "id"), "k")
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = docs.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    found = texts.mapInArrow(_sets(words), "fp binary, items binary").where(F.col("fp").isNotNull()).groupBy("fp").agg(F.any_value("items").alias("items"))
    sets = ws.cut(members.select("k", "fp").join(found, "fp").select("k", "items"), "sets")

    item = lambda x: sets.select(F.col("k").alias(x), F.col("items").alias(f"i{x}"))
    links = ws.cut(likely.join(item("a"), "a").join(item("b"), "b").mapInArrow(_verify(percent), "a long, b long"), "links")
    roots = ws.cut(components(ws, links, "first"), "roots")

    placed = buckets.join(roots.withColumnRenamed("node", "k"), "k", "left").select("key", "k", F.coalesce("root", "k").alias("root"))
    placed = placed.join(classes.select("k", "n"), "k")
    more = ws.cut(blocks_apart(placed, BLOCK_ROWS, BLOCK_SHINGLES).join(sets, "k").groupBy("key", "i", "j").applyInArrow(_within(percent), "a long, b long"), "more")
    final = components(ws, links.union(more), "last")

    ids = classes.select("fp", "k", "id").join(final.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    named = ids.join(least, "root").select("fp", "root", "component_id")
    return sketches.select("doc_id", "mark", "n", "fp").join(named, "fp", "left")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id AS doc_id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
