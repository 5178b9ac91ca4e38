"""How rows are dealt over tasks where a step makes many rows out of few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts over which the rows of one key are dealt on one side of a join, rows of a class that are paired at once, bytes
#: of the files read for each partition of a stated number.
DEAL, CLASS, BYTES = 16, 512, 4 << 20


def wide(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rows dealt by columns to a stated number of partitions, which adaptive execution doesn't merge by their small size.

    The number grows with the files that the rows are read from, so that a task's share doesn't.
    """
    spark = rows.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(x for x in sizes if x < 1 << 50)  # what is larger isn't known
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism, min(10000, int(read / BYTES))), *by)


def pairs_within(rows: DataFrame, by: str, item: str, most: int) -> DataFrame:
    """(by, a, b) with a < b of the `most` first distinct items of each `by`, without a join."""
    ranked = wide(rows.select(by, item), by).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(item)))
    lists = ranked.where(F.col("_r") <= most).groupBy(by).agg(F.collect_list(item).alias("_l")).where(F.size("_l") > 1)
    return lists.select(by, F.explode("_l").alias("a"), "_l").select(by, "a", F.explode("_l").alias("b")).where(F.col("a") < F.col("b"))


def dealt_join(left: DataFrame, right: DataFrame, by: list[str], part: Column) -> DataFrame:
    """The inner join by columns; left rows of one key go to `DEAL` tasks by a hash of `part`, right rows to each of these."""
    a = wide(left.withColumn("_deal", F.pmod(F.xxhash64(part), F.lit(DEAL)).cast("int")), *by, "_deal")
    b = wide(right.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))), *by, "_deal")
    return a.join(b, [*by, "_deal"]).drop("_deal")


def classes(rows: DataFrame, by: list[str], held: list[str]) -> DataFrame:
    """(by, held: array of structs): rows of equal `by`, `CLASS` at most in one array."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(held[0]))
    return rows.withColumn("_block", F.floor((place - 1) / CLASS)).groupBy(*by, "_block").agg(F.collect_list(F.struct(*held)).alias("held"))
