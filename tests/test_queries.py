"""Every query against its SQL, on the smallest tables."""

import math

import pytest

from loomlake.plans import catalog, reference  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DIR)
    rows, columns = got.collect(), sorted(got.columns)
    if name not in catalog.oracle_sql():
        return
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    c.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(k)] for k in columns) for r in c.fetchall()]
    key = lambda r: repr(tuple(map(plain, r)))
    assert sorted(key(tuple(r[k] for k in columns)) for r in rows) == sorted(map(key, want))
