"""Scores that lie on or next to a half of their last digit, exactly as SQL rounds them."""

import pytest
from pyspark.sql import functions as F

from loomlake.plans import catalog

DIR = "/root/testdata/sf0.01"


def test_rounded(spark):
    import duckdb

    for digits in (2, 6):
        want = duckdb.sql(f"SELECT i, round((2 * i + 1) / {2 * 10**digits}, {digits}) AS x FROM range(-5000, 5000) AS r(i)").fetchall()
        got = spark.range(-5000, 5000).select("id", catalog.rounded((2 * F.col("id") + 1) / (2 * 10**digits), digits).alias("x")).collect()
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["temporal_rank_blend", "narrative_coherence"])
def test_scores_as_in_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = catalog.queries()[name](spark, DIR)
    want = c.execute(catalog.oracle_sql()[name])
    assert [x[0] for x in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
