"""The queries of the package over the smallest tables, against SQL where SQL can say it, and the pipeline."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from loomlake.llm import queries  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    import duckdb

    rows = [r.asDict() for r in queries.queries()[name](spark, DIR).collect()]
    assert rows
    if name not in queries.oracle_sql():
        return
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in c.description]
    key = lambda r: tuple((k, round(v, 5) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v) for k, v in sorted(r.items()))
    want = [dict(zip(names, r, strict=True)) for r in c.fetchall()]
    assert sorted(map(repr, map(key, rows))) == sorted(map(repr, map(key, want)))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    left, ids = docs, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, DIR)
        assert out.columns == docs.columns
        left = spark.createDataFrame(out.collect(), docs.schema)
        kept = {r.doc_id for r in left.collect()}
        assert kept <= ids and kept
        ids = kept
    last = corpus_pipeline.STAGES[-1][1](spark, left, DIR)
    assert {r.doc_id for r in last.collect()} == ids
    assert sorted(map(repr, corpus_pipeline.run(spark, DIR).collect())) == sorted(map(repr, last.collect()))


def test_pipeline_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
