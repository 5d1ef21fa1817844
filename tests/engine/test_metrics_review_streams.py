import datetime as dt

import pytest

from graphloom.operators import metrics, review, tables
from graphloom.streaming import changes

T0 = dt.datetime(2024, 1, 1)


def test_percentiles_over_the_ring(spark):
    rows = [("a", i, float(i), "E" if i % 4 == 0 else None) for i in range(30)]
    got = metrics.duration_stats(spark.createDataFrame(rows, "name string, seq long, duration_ms double, error string"), ring=10).first()
    assert (got["count"], got.errors, got.p50_ms, got.p95_ms, got.min_ms) == (30, 8, 25.0, 29.0, 0.0) and got.error_rate == pytest.approx(8 / 38)


def test_error_patterns(spark):
    def calls(key, errors, step):
        return [(key, i, T0 + dt.timedelta(seconds=i * step), "E" if e else None) for i, e in enumerate(errors)]

    rows = calls("a", [1] * 4 + [0], 1) + calls("b", [0, 1, 1, 1], 100) + calls("c", [1] * 10 + [0], 6) + calls("d", [1] * 10 + [0], 7) + calls("e", [1] * 5, 100)
    got = {r.key: r for r in metrics.error_patterns(spark.createDataFrame(rows, "key string, seq long, ts timestamp, error string")).collect()}
    assert [(got[k].consecutive, got[k].warns, got[k].rapid, got[k].pattern) for k in "abcde"] == [(0, False, False, None), (3, True, False, None), (0, False, True, "rapid"), (0, False, False, None), (5, True, False, "high_consecutive")]


def test_findings(spark):
    f = [(1, "x", "deterministic_single", ["b", "a"], "One  Two"), (2, "y", "ambiguous", [], "z"), (3, "x", "deterministic_single", ["a", "b", "a"], " one two "), (4, "q", "no_signal", None, None)]
    df = spark.createDataFrame(f, "id long, axis string, grade string, handles array<string>, claim string")
    mag = spark.createDataFrame([("a", 2.0), ("b", 5.0)], "handle string, value double")
    assert [r.id for r in review.rank(review.blast(df, mag), {"x": "high"}, {"x": 0.5}).collect()] == [2, 1, 3, 4]
    assert [(r.id, r.origin) for r in review.merge(df.where("id = 1"), df.where("id > 1")).orderBy("origin", "id").collect()] == [(1, 0), (2, 1), (4, 1)]
    runs = spark.createDataFrame([(1, k, ["a", "b"], "deterministic_single", "ONE TWO") for k in range(3)] + [(3, 0, ["a", "b"], "deterministic_single", "one two")], "id long, run int, handles array<string>, grade string, claim string")
    assert {r.id: r.grade for r in review.reproduction_gate(df, runs).collect()} == {1: "deterministic_single", 2: "ambiguous", 3: "ambiguous", 4: "no_signal"}
    with pytest.raises(ValueError):
        review.reproduction_gate(df, runs, 0)
    g = {r.id: (r.grade, r.possible_extractor_bug) for r in review.cross_derivation_guard(df, spark.createDataFrame([(1,)], "id long")).collect()}
    assert g == {1: ("deterministic_single", None), 2: ("ambiguous", None), 3: ("ambiguous", True), 4: ("no_signal", None)}
    keys = {r.id: r.key for r in review.non_issues(df.where("id < 3")).collect()}
    assert review.suppress(df.where("id < 3"), spark.createDataFrame([(keys[1],)], "key string")).first().id == 2


def test_sessions(spark):
    rows = [("a", "main", None, T0, {"x": 2, "y": 1}, 1), ("b", None, "a", T0, {}, 0), ("c", "sub", "b", T0, {"x": 1}, 0)]
    df = spark.createDataFrame(rows, "session_id string, session_type string, parent_session string, start_time timestamp, mcp_operations map<string,long>, grep_operations long")
    assert [tuple(r) for r in metrics.session_tree(df).collect()] == [("a", ["b"])]
    assert tuple(metrics.session_rollup(df).first()) == (3, 4, 1, 0.8) and [tuple(r) for r in metrics.tool_usage(df, 1).collect()] == [("x", 3)]
    assert {tuple(r) for r in metrics.session_histogram(df, "type").collect()} == {("main", 1), ("unknown", 1), ("sub", 1)}
    assert tuple(metrics.session_rollup(df.limit(0)).first()) == (0, 0, 0, 0.0)


def test_fields(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.filter_fields(df, ["b", "a"]).columns == ["b", "a"] and tables.filter_fields(df, None).columns == ["a", "b"]
    with pytest.raises(ValueError, match=r"\['x', 'z'\]"):
        tables.filter_fields(df, ["z", "a", "x"])
    with pytest.raises(ValueError):
        tables.filter_fields(df, [])
    assert tables.filter_fields(df.limit(0), ["z"]).count() == 0


def test_bursts_in_batch_and_stream(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(milliseconds=s)
    rows = [(at(0), "a.py"), (at(300), "b.py"), (at(400), "a.py"), (at(2000), "a.py"), (at(2100), "x.txt"), (at(2100), "venv/c.py")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "ts timestamp, file string, project string")
    want = [["a.py", "b.py"], ["a.py"]]
    assert [r.files for r in changes.changes(df).orderBy("start").collect()] == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(at(60_000), "z.py", "p")], "ts timestamp, file string, project string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = changes.changes(s).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(60)
    assert [r.files for r in spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()] == want
    deps = spark.createDataFrame([("m", "a"), ("n", "b")], "from string, to string")
    assert {r.module for r in changes.refresh(spark.createDataFrame([("a",)], "module string"), deps).collect()} == {"a", "m"}
