"""Vectors as array columns: similarity, nearest neighbours, blocked joins, centroids."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or differing dimensions."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, query: list[float], k: int, minimum: float = 0.0, id: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k most similar by cosine, then those of `minimum` or more. One pass, top-k in each task first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(id).alias("id"), cosine(F.col(embedding), q).alias("score")).orderBy(F.col("score").desc(), "id").limit(k).where(F.col("score") >= minimum)


#: Rows of one key that meet in one block, rows of a block that are multiplied at once.
BLOCK, STEP = 8192, 128


def _near(threshold: float, unit: bool):
    """Turns a block (keys, vectors) of rows into pairs: products of matrices leave out what can't reach the threshold, sums in the order of dimensions decide."""

    import pyarrow as pa

    def near(batches):
        import numpy as np

        table = pa.Table.from_batches(list(batches))
        one, two, own = table["i"][0].as_py(), table["j"][0].as_py(), table["key"][0].as_py()
        ids, block = table["id"], table["block"].to_numpy()
        order = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1].reshape(-1)
        keys = table["keys"].combine_chunks()
        codes = keys.flatten().dictionary_encode()
        words = np.array(codes.dictionary.to_pylist() or [own], dtype=object)
        rank = np.argsort(np.argsort(words))
        sizes, least = np.diff(keys.offsets.to_numpy()), int(rank[np.flatnonzero(words == own)[0]])
        held = np.full((len(sizes), max(1, int(sizes.max()))), -1, dtype="int32")
        held[np.arange(held.shape[1]) < sizes[:, None]] = rank[codes.indices.to_numpy()]
        held = np.where(held < least, held, -1)  # what comes before the key of this block
        vectors = table["embedding"].combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64"), np.concatenate(([0], np.cumsum(lengths)[:-1]))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            e = flat[starts[at][:, None] + np.arange(n)]
            length = np.sqrt(_summed(e.T, e.T))
            if unit:
                e = np.where(length[:, None] == 0, 0.0, e / np.where(length == 0, 1.0, length)[:, None])
            most = float(np.max(length)) if not unit else 1.0
            small = e.astype("float32" if np.isfinite(most) and most < 1e15 else "float64")
            floor, columns = threshold - (n + 8) * 2.0**-23 * max(1.0, most * most), np.ascontiguousarray(e.T)
            left, right = np.flatnonzero(block[at] == one), np.flatnonzero(block[at] == two)
            for s in range(0, len(left), STEP):
                part = left[s : s + STEP]
                x, y = np.nonzero(~(small[part] @ small[right].T < floor))
                x, y = part[x], right[y]
                apart = order[at[x]] != order[at[y]] if one != two else order[at[x]] < order[at[y]]
                x, y = x[apart], y[apart]
                p, q = held[at[x]], held[at[y]]
                first = np.ones(len(x), dtype=bool)
                for k in range(held.shape[1]):
                    first &= ~((p[:, k, None] >= 0) & (p[:, k, None] == q)).any(axis=1)
                x, y = x[first], y[first]
                score = _summed(columns, columns, x, y)
                kept = ~(score < threshold)
                x, y, score = at[x[kept]], at[y[kept]], score[kept]
                swap = order[x] > order[y]
                a, b = (ids.take(pa.array(v, pa.int64())).combine_chunks() for v in (np.where(swap, y, x), np.where(swap, x, y)))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(score, pa.float64())], names=["a", "b", "score"])

    near.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return near


def _summed(p, q, x=slice(None), y=slice(None)):
    """Dot products of columns x of p and y of q, added up dimension by dimension."""
    import numpy as np

    total = np.zeros(p[:1, x].shape[1])
    for a, b in zip(p, q, strict=True):
        total += a[x] * b[y]
    return total


def near_pairs(rows: DataFrame, threshold: float, unit: bool) -> DataFrame:
    """Pairs (a, b, score) with a < b of rows (id, keys, embedding) that share a key and whose dot product, of vectors scaled to length 1 if `unit`, reaches the threshold.

    Rows of a key meet in blocks of bounded size, any two of its blocks in one task; a pair
    comes out at the least key it shares, so that pairs are neither shuffled nor made
    distinct. Rows without a vector, vectors with nulls and ones of differing length have no pair.
    """
    known = rows.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()) & (F.size("embedding") > 0))
    keyed = known.select("id", F.array_sort(F.array_distinct(F.array_compact("keys"))).alias("keys"), "embedding").withColumn("key", F.explode("keys"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "keys", "embedding")
    kind = rows.schema["id"].dataType.simpleString()
    ship(rows.sparkSession)
    return spread.wide(met, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(_near(threshold, unit), f"a {kind}, b {kind}, score double")


def block_pairs(rows: DataFrame, keys: Column, id: str, threshold: float, embedding: str = "embedding") -> DataFrame:
    """Pairs (a, b, score) with a < b that share one of their blocking keys (an array) and have a cosine of `threshold` or more.

    Keys should be fine: work grows with the square of a key's rows.
    """
    return near_pairs(rows.select(F.col(id).alias("id"), keys.alias("keys"), F.col(embedding).alias("embedding")), threshold, True)


def sign_keys(vector: Column, bands: int, bits: int) -> Column:
    """Blocking keys of a vector without a name: the signs of `bits` values each, with the number of the band."""
    return F.array(*(F.concat(F.lit(f"{b}:"), F.array_join(F.transform(F.slice(vector, b * bits + 1, bits), lambda x: F.when(x >= 0, "1").otherwise("0")), "")) for b in range(bands)))


def centroids(vectors: DataFrame, by: str, embedding: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(by, dim, value): the weighted mean vector of each group, scaled to length 1, a row for each dimension."""
    w = F.lit(1.0) if weight is None else weight
    flat = vectors.select(by, w.alias("w"), F.posexplode(embedding).alias("dim", "x"))
    mean = flat.groupBy(by, "dim").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("value"))
    length = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(by)))
    return mean.select(by, "dim", F.when(length == 0, F.lit(0.0)).otherwise(F.col("value") / length).alias("value"))
