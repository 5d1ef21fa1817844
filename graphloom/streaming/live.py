"""Live state by key: sessions that start, gather counts and end, and streaks of errors since the last success.

Each has one fold over events in order, which the stream (transformWithState, one state a key, timers in event time) and the
batch (rows sorted within partitions, one state held at a time) both use, so that replaying a stream's events in a batch
gives the same rows. A stream needs the RocksDB state store. Events of a key are taken in order of ts, then seq, within a
micro-batch; micro-batches must come in order of time, which the watermark (`late`) decides."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What ends a session that nobody ends: so much time without an event.
IDLE = 3600.0
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = (
    "thread string, session_id string, session_type string, parent_session string, start_time timestamp, end_time timestamp, ended_by string, mcp_operations map<string,long>, grep_operations long,"
    " total_operations long, errors long, cache_hits long, cache_misses long, duration_minutes double, adoption_rate double, error_rate double, cache_hit_rate double"
)
STREAK = "key string, errors long, consecutive long, warns boolean, rapid boolean, pattern string"
_EPOCH = dt.datetime(1970, 1, 1)


def _micros(ts) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _time(micros: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(microseconds=micros)


def _rate(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


# Sessions


def _started(state: dict, name: str | None, kind: str, parent: str | None, at: int) -> str:
    name = name or f"{kind}_{_time(at).isoformat()}"
    state["open"][name] = {"type": kind, "parent": parent, "start": at, "tools": {}, "grep": 0, "total": 0, "errors": 0, "hits": 0, "misses": 0}
    state["current"] = name
    return name


def _ended(thread: str, state: dict, name: str, at: int, by: str) -> tuple:
    s = state["open"].pop(name)
    if state["current"] == name:
        state["current"] = None
    mcp = sum(s["tools"].values())
    return (
        thread, name, s["type"], s["parent"], _time(s["start"]), _time(at), by, dict(sorted(s["tools"].items())), s["grep"], s["total"], s["errors"], s["hits"], s["misses"],
        (at - s["start"]) / 60e6, _rate(mcp, mcp + s["grep"]), _rate(s["errors"], s["total"]), _rate(s["hits"], s["hits"] + s["misses"]),
    )


def fold_session(thread: str, state: dict, e: dict, idle: float) -> list[tuple]:
    """Apply one event to a thread's state {current, open, last}; the sessions that end by it.

    start opens a session and makes it the thread's current one; call counts a tool of the named or current session, and
    opens one of type auto if there is none; grep and cache need a session; end closes the named or current one. Counts for
    sessions that aren't open are lost. A pause longer than `idle` seconds ends all that are open at its begin."""
    out, at = [], _micros(e["ts"])
    if state.get("last") is not None and at - state["last"] > idle * 1e6:
        out = expire_sessions(thread, state)
    state["last"] = at
    name = e["session_id"] or state["current"]
    what = e["event"]
    if what == "start":
        _started(state, e["session_id"], e["session_type"] or "main", e["parent_session"], at)
    elif what == "end":
        if name in state["open"]:
            out.append(_ended(thread, state, name, at, "end"))
    else:
        if what == "call" and not name:
            name = _started(state, None, "auto", None, at)
        s = state["open"].get(name)
        if s is None:
            return out
        n = int(e["n"])
        if what == "call":
            s["tools"][e["tool"]] = s["tools"].get(e["tool"], 0) + 1
            s["total"] += 1
            s["errors"] += bool(e["failed"])
        elif what == "grep":
            s["grep"] += 1
            s["total"] += 1
        elif what in ("hit", "miss"):
            s["hits" if what == "hit" else "misses"] += n
    return out


def expire_sessions(thread: str, state: dict) -> list[tuple]:
    """All open sessions end with the last event."""
    return [_ended(thread, state, name, state["last"], "idle") for name in sorted(state["open"])]


def _events(rows: pd.DataFrame) -> list[dict]:
    rows = rows.sort_values(["ts", "seq"], kind="stable").astype({"session_id": object, "session_type": object, "parent_session": object, "tool": object})
    return [{k: None if not isinstance(v, dict) and pd.isna(v) else v for k, v in r.items()} for r in rows.assign(n=rows["n"].fillna(0), failed=rows["failed"].fillna(False)).to_dict("records")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.replace("map<string,long>", "map").split(", ")]
    return pd.DataFrame(rows, columns=names)


# Streaks


def fold_streak(state: dict, ts, failed: bool, burst: int) -> None:
    """Errors in all, since the last success, and when the last `burst` were."""
    if failed:
        state["errors"] += 1
        state["consecutive"] += 1
        state["times"] = [*state["times"], _micros(ts)][-burst:]
    else:
        state["consecutive"] = 0


def streak_row(key: str, state: dict, burst: int, seconds: int) -> tuple:
    rapid = len(state["times"]) >= burst and state["times"][-1] - state["times"][0] < seconds * 1_000_000
    n = state["consecutive"]
    return key, state["errors"], n, n >= 3, rapid, "high_consecutive" if n >= 5 else "rapid" if rapid else None


# Streams


class _Sessions(StatefulProcessor):
    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("thread", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {"current": None, "open": {}, "last": None}
        out = []
        for e in _events(pd.concat(list(rows))):
            out += fold_session(key[0], state, e, self.idle)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state["open"]:
            self.handle.registerTimer(int(state["last"] // 1000 + self.idle * 1000) + 1)
        self.state.update((json.dumps(state),))
        yield _frame(out, SESSION)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0])
        out = expire_sessions(key[0], state)
        self.state.update((json.dumps(state),))
        yield _frame(out, SESSION)

    def close(self) -> None:
        pass


class _Streaks(StatefulProcessor):
    def __init__(self, burst: int, seconds: int):
        self.burst, self.seconds = burst, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("key", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else {"errors": 0, "consecutive": 0, "times": []}
        pdf = pd.concat(list(rows)).sort_values(["seq"], kind="stable")
        for ts, error in zip(pdf["ts"], pdf["error"]):
            fold_streak(state, ts, error is not None and error == error, self.burst)
        self.state.update((json.dumps(state),))
        yield _frame([streak_row(key[0], state, self.burst, self.seconds)], STREAK)

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, key: str, order: list[str], schema: str, begin: Callable, step: Callable, end: Callable) -> DataFrame:
    """A fold by key over rows sorted within partitions: one state is held at a time, whatever a key's number of rows."""

    def run(batches):
        at, state = None, None
        for pdf in batches:
            out = []
            for k, part in pdf.groupby(key, sort=False):
                if k != at:
                    if state is not None:
                        out += end(at, state)
                    at, state = k, begin()
                out += step(k, state, part)
            yield _frame(out, schema)
        if state is not None:
            yield _frame(end(at, state), schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def live_sessions(events: DataFrame, idle: float = IDLE, late: str = "10 minutes") -> DataFrame:
    """Finished sessions (SESSION) of events(thread, ts, seq, event, session_id, session_type, parent_session, tool, failed,
    n), event being start, call, grep, hit, miss or end. Of a batch, sessions still open end `idle` after their last event
    as in a stream whose watermark has passed that; rows without a thread are left out."""
    events = events.where(F.col("thread").isNotNull())
    if events.isStreaming:
        grouped = events.withWatermark("ts", late).groupBy("thread")
        return grouped.transformWithStateInPandas(_Sessions(idle), SESSION, "Append", "EventTime")

    def step(thread, state, part):
        return [row for e in _events(part) for row in fold_session(thread, state, e, idle)]

    return _in_order(events, "thread", ["ts", "seq"], SESSION, lambda: {"current": None, "open": {}, "last": None}, step, expire_sessions)


def live_streaks(calls: DataFrame, burst: int = 10, seconds: int = 60) -> DataFrame:
    """(key, errors, consecutive, warns, rapid, pattern) of calls(key, seq, ts, error: null for success): of a stream a row
    for each key that a micro-batch has calls of, as it stands then; of a batch as it stands at the end, which is what
    metrics.error_patterns gives."""
    calls = calls.where(F.col("key").isNotNull()).select(F.col("key").cast("string").alias("key"), "seq", "ts", "error")
    if calls.isStreaming:
        return calls.groupBy("key").transformWithStateInPandas(_Streaks(burst, seconds), STREAK, "Update", "None")

    def step(key, state, part):
        for ts, error in zip(part["ts"], part["error"]):
            fold_streak(state, ts, error is not None and error == error, burst)
        return []

    return _in_order(calls, "key", ["seq"], STREAK, lambda: {"errors": 0, "consecutive": 0, "times": []}, step, lambda k, s: [streak_row(k, s, burst, seconds)])
