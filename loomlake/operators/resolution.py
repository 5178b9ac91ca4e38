"""Entity resolution: blocking keys, name scores, vector pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import spread, vectors


def blocking_keys(name: Column) -> Column:
    """The first three characters of each word of two letters or digits and more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]{2,})"), 1), lambda w: F.substring(w, 1, 3)))


def name_pairs(rows: DataFrame, by: list[str], scores: Callable[[Column, Column], list[Column]], carry: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, scores, carried columns as a_* and b_*) of all pairs a < b of rows (id, name, by, carry) that agree in `by`.

    Rows of one name in one block are a class: scores of two names are taken once for two
    classes, whatever their numbers of rows, and the rows come out of the classes last.
    """
    held = spread.classes(rows.select(*by, "name", "id", *carry), [*by, "name"], ["id", *carry])
    side = lambda c: held.select(*by, F.col("name").alias(f"name_{c}"), F.col("held").alias(f"held_{c}"))
    scored = spread.dealt_join(side("a"), side("b"), by, F.struct("name_a", F.col("held_a")[0]["id"])).select("held_a", "held_b", *scores(F.col("name_a"), F.col("name_b")))
    names = [c for c in scored.columns if not c.startswith("held_")]
    pairs = scored.select(F.explode("held_a").alias("p"), "held_b", *names).select("p", F.explode("held_b").alias("q"), *names).where(F.col("p.id") < F.col("q.id"))
    carried = [F.col(f"{p}.{c}").alias(f"{side}_{c}") for c in carry for side, p in (("a", "p"), ("b", "q"))]
    return pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), *names, *carried)


def resolve(new: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, entity, kind, score) of new (id, name, type) among known (id, name, type, aliases) of the same type.

    An equal name counts before an equal alias, and these (score 1) before names that share
    a blocking key with 0.6 * Jaro-Winkler + 0.4 * token overlap of over the threshold; the
    best wins, then the least id. Exact matches leave before the costly score is taken.
    All is found for a type and name once, by the least entity of each known one, and then
    given to the rows that have it.
    """
    n = new.select("id", F.lower("name").alias("name"), "type")
    k = known.select(F.col("id").alias("entity"), F.lower("name").alias("other"), "type", "aliases")
    asked, by = n.select("type", "name").distinct(), ["type", "name"]
    least = k.groupBy("type", "other").agg(F.min("entity").alias("entity"))
    first = lambda rows, kind: rows.select("type", "name", "entity", F.lit(kind).alias("kind"), F.lit(1.0).alias("score"))
    exact = first(asked.join(least.withColumnRenamed("other", "name"), by), "exact")
    rest = asked.join(exact.select(*by), by, "left_anti")
    aliases = k.select("entity", "type", F.explode("aliases").alias("a")).groupBy("type", F.lower("a").alias("name")).agg(F.min("entity").alias("entity"))
    alias = first(rest.join(aliases, by), "alias")
    rest = rest.join(alias.select(*by), by, "left_anti")
    keyed = lambda rows, c, keys: rows.withColumn(keys, blocking_keys(F.col(c))).withColumn("key", F.explode(keys))
    pairs = spread.dealt_join(keyed(rest, "name", "ka"), keyed(least, "other", "kb"), ["type", "key"], F.col("name"))
    pairs = pairs.where(F.col("key") == F.array_min(F.array_intersect("ka", "kb"))).select("type", "name", "entity", "other")  # once, at the least common key
    score = 0.6 * text.jaro_winkler(F.col("name"), F.col("other")) + 0.4 * text.token_overlap(F.col("name"), F.col("other"))
    best = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "entity")
    fuzzy = pairs.select("type", "name", "entity", score.alias("score")).where(F.col("score") > threshold).withColumn("r", F.row_number().over(best)).where("r = 1")
    found = exact.union(alias).union(fuzzy.select("type", "name", "entity", F.lit("fuzzy"), "score"))
    place = F.struct((F.when(F.col("kind") == "exact", 0).when(F.col("kind") == "alias", 1).otherwise(2)).alias("k"), (-F.round("score", 9)).alias("s"), "entity", "kind", "score")
    return n.join(found, by).groupBy("id").agg(F.min(place).alias("m")).select("id", "m.entity", "m.kind", "m.score")


def blocked_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) with a < b of rows (id, name, embedding) that share a blocking key and whose dot product reaches the threshold; vectors are taken as of length 1."""
    return vectors.near_pairs(rows.select("id", blocking_keys(F.col("name")).alias("keys"), "embedding"), threshold, False)


def signs(vector: Column) -> Column:
    """Up to 64 signs as the bits of a long: 1 where a value is 0 and above."""
    bits = F.transform(vector, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
