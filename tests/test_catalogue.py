"""Every query that has SQL equals DuckDB's result on the smallest tables; the others run."""

import math

import duckdb
import pytest

from seqloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return int(v) if isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    if name not in catalogue.SQL:
        assert got.columns
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a, b = rows(got.columns, got.collect()), rows(columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float | int) and isinstance(q, float | int) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-4) for p, q in zip(x, y, strict=True)), (x, y)
