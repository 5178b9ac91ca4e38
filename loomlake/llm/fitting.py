"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """Documents of a sample with their label `y`, and how many labelled rows there are of each label.

    Of rows that aren't held out, the `most[y]` of the least hash of their id, so that the
    choice doesn't depend on order or size. Null labels and ids aren't learnt from; an id
    with several labels counts with the largest. Only the sample's ids are broadcast, at
    most the sum of `most`.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit("sample"), "doc_id")
    ids = [(r.doc_id, r.y) for y, n in most.items() for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(n).collect()]
    small = spark.createDataFrame(ids, known.schema)
    return docs.select("doc_id", "text").join(F.broadcast(small), "doc_id"), counts
