"""Streams with state against the same events in one batch."""

import datetime as dt
import random

import pytest

from graphloom.operators import metrics
from graphloom.streaming import live

T0 = dt.datetime(2024, 1, 1)
EVENTS = "thread string, ts timestamp, seq long, event string, session_id string, session_type string, parent_session string, tool string, failed boolean, n long"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, rows, schema, tmp_path, of, mode, parts=3):
    """Rows in `parts` micro-batches, in order; what the stream wrote."""
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    seen = []
    q = of(s).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, i: seen.append([tuple(r) for r in df.collect()])).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return seen


def events():
    at = lambda s: T0 + dt.timedelta(seconds=s)
    r, rows, seq = random.Random(6), [], 0

    def add(thread, s, event, session=None, kind=None, parent=None, tool=None, failed=None, n=None):
        nonlocal seq
        seq += 1
        rows.append((thread, at(s), seq, event, session, kind, parent, tool, failed, n))

    add("a", 0, "call", tool="resolve")  # opens a session of its own
    add("a", 5, "grep")
    add("a", 9, "end")
    add("b", 10, "grep")  # no session: lost
    add("b", 11, "start", "s1", "main")
    add("b", 12, "start", "s2", "subagent", "s1")
    for k in range(30):
        add("b", 13 + k, "call", r.choice([None, "s1"]), tool=r.choice(["trace", "expand"]), failed=r.random() < 0.3)
    add("b", 50, "hit", n=3)
    add("b", 50, "miss", n=1)
    add("b", 51, "end")
    add("b", 52, "call", "s1", tool="late")
    add("b", 53, "call", "gone", tool="lost")
    add("c", 60, "start", None, "task")
    add("c", 5000, "call", tool="after a pause")  # the task has ended by then
    add("c", 5001, "end", "s1")  # of another thread: not open here
    add("z", 40_000, "call", tool="moves the watermark")
    add("z", 90_000, "call", tool="and again")
    return rows


def test_live_sessions_equal_the_batch(spark, rocks, tmp_path):
    rows = events()
    text = lambda r: tuple(str(x) for x in r)
    batch = {text(r) for r in live.live_sessions(spark.createDataFrame(rows, EVENTS)).collect()}
    stream = [text(r) for b in replay(spark, rows, EVENTS, tmp_path, live.live_sessions, "append") for r in b]
    open_yet = {f"auto_{(T0 + dt.timedelta(seconds=90_000)).isoformat()}"}  # nothing later moves the watermark past it
    assert len(stream) == len(set(stream)) and set(stream) == {r for r in batch if r[1] not in open_yet}
    by = {(r[0], r[2]): r for r in batch}
    assert by["a", "auto"][6] == "end" and by["b", "main"][6] == "idle" and by["c", "task"][6] == "idle" and by["c", "auto"][6] == "idle"
    assert live.live_sessions(spark.createDataFrame([], EVENTS)).count() == 0


def test_live_streaks_equal_the_batch(spark, rocks, tmp_path):
    r = random.Random(1)
    rows = [(f"k{r.randrange(6)}", k, T0 + dt.timedelta(seconds=k * r.choice([1, 20])), r.choice([None, "E", "E"])) for k in range(300)]
    rows += [("k0", 300 + k, T0 + dt.timedelta(days=1, seconds=k), "E") for k in range(12)] + [("k1", 400, T0 + dt.timedelta(days=1), None), (None, 401, T0, "E")]
    schema = "key string, seq long, ts timestamp, error string"
    df = spark.createDataFrame(rows, schema)
    want = {tuple(x) for x in metrics.error_patterns(df.where("key IS NOT NULL")).select("key", "errors", "consecutive", "warns", "rapid", "pattern").collect()}
    assert {tuple(x) for x in live.live_streaks(df).collect()} == want
    last = {row[0]: row for b in replay(spark, rows, schema, tmp_path, live.live_streaks, "update") for row in b}
    assert set(last.values()) == want
