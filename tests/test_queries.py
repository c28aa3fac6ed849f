"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import math

import duckdb
import pytest

from lamella.plans import anchor_queries, audit_queries, count_queries, image_queries, job_queries, owner_queries, registry, sampling_queries, section_queries, source_queries, store_queries, stream_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck.execute(registry.ORACLE[name])
    want = rows([d[0] for d in con.description], con.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 2e-5) for x, y in zip(a, b, strict=True)), (a, b)
