"""BM25 over whole texts: one scan makes a few numbers for each document, and only these are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def words(text: Column, least: int = 3) -> Column:
    """Words of `least` letters or digits and more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}]{{{least},}})"), 1)


def tokens(docs: DataFrame, id: str, text: str, least: int = 3) -> DataFrame:
    """(id, term, tf) of every word: for statistics of a whole vocabulary. A search doesn't need it."""
    return docs.select(F.col(id).alias("id"), F.explode(words(F.col(text), least)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def search(docs: DataFrame, id: str, text: Column, query: list[str], k: int, minimum: float = 0.0) -> DataFrame:
    """(id, score) of the k best with a score of over `minimum`; a query term given twice counts twice.

    `text` is an array of terms, such as words(). The terms are counted where a document
    lies; what is kept of it is its id, its length and a number for each query term. Rows
    without terms are no documents.
    """
    asked = list(dict.fromkeys(query))
    held = docs.select(F.col(id).alias("id"), text.alias("terms")).where(F.size("terms") > 0)
    times = lambda term: F.size(F.filter("terms", lambda w: w == term))
    counted = held.select("id", F.size("terms").alias("len"), F.array(*map(times, asked)).alias("tf")).persist()
    n, mean, *df = counted.agg(F.count("*"), F.avg("len"), *(F.count_if(F.col("tf")[i] > 0) for i in range(len(asked)))).first()
    score = F.lit(0.0)
    for i, t in enumerate(asked):
        tf = F.col("tf")[i]
        idf = F.log(F.lit(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))
        score = score + query.count(t) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / (mean or 1.0)))
    any_hit = F.exists("tf", lambda x: x > 0)
    return counted.where(any_hit).select("id", score.alias("score")).where(F.col("score") > minimum).orderBy(F.round("score", 6).desc(), "id").limit(k)
