"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import graphloom.named_queries  # noqa: F401  registers its queries
import graphloom.parsed_queries  # noqa: F401
from graphloom.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def norm(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cur = duck.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_partition_counts_change_nothing(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([[tuple(r) for r in QUERIES[q](spark, SMALL).collect()] for q in ("trace_nodes", "trace_edges", "rank_findings", "outline_members", "slowest_operations")])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]
