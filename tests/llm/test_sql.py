"""Queries of this subpackage against their SQL, and what the sample of op5 includes."""

import random

import duckdb
import pytest

from graphloom.llm import mix_sources as mx
from graphloom.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in ORACLES if n.split("_")[0] not in ("op11", "op12")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    text = lambda r: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(text(r) for r in got.select(*names).collect()) == sorted(text(r) for r in result.fetchall())


def test_documents_are_included_at_their_own_rates(spark):
    r = random.Random(9)
    rows = [(k, "w " * r.choice([0, 1, 3, 6, 14, 30, 62, 126]), "a" if k % 3 else "b") for k in range(24_000)]
    got = mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    seen = {}
    for x in got:
        certain = x.target // x.source_size
        n = seen.setdefault((x.source, x.size), [0, 0, x.p, x.target - certain * x.source_size])
        n[0] += 1
        n[1] += x.copies - certain
    for (source, size), (n, taken, p, gap) in seen.items():
        if size and gap > 0:
            assert abs(taken / n - p) < 0.05, (source, size, taken / n, p)
    for source in "ab":
        mine = {size: v for (s, size), v in seen.items() if s == source}
        gap = mine[1][3]
        assert abs(sum(size * n * p for size, (n, _, p, _) in mine.items()) - gap) < 1e-6 * max(gap, 1)
        if 0 < mine[1][2] < 1:
            assert mine[126][2] == pytest.approx(min(1, mine[1][2] * 7 / 2))  # by the bits of size + 1: 7 and 2
    # a certain copy where the probability would pass 1
    wide = mx.inclusion(spark.createDataFrame([("s", 1, 100, 190.0), ("s", 7, 100, 190.0), ("t", 3, 50, 0.0), ("u", 2, 10, 12.0)], "source string, m long, words long, gap double"))
    assert {(x.source, x.m): round(x.p, 6) for x in wide.collect()} == {("s", 1): 0.9, ("s", 7): 1.0, ("t", 3): 0.0, ("u", 2): 1.0}
