"""Change streams: debounced file changes, and live counts of calls and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import IGNORED_DIRS

QUIET = "500 milliseconds"


def changes(events: DataFrame, quiet: str = QUIET, late: str = "10 seconds", key: str = "project") -> DataFrame:
    """Bursts of modifications, each ended by a quiet gap: start, end, files (all of the burst, sorted). events(ts, file);
    only Python files outside excluded directories count. For batches and streams; a stream drops what is later than
    `late`. key: the column by which bursts are apart, so that no group holds the events of all projects."""
    ok = F.endswith("file", F.lit(".py")) & ~F.exists(F.split("file", "/"), lambda p: p.isin(*IGNORED_DIRS))
    mine = events.where(ok)
    if events.isStreaming:
        mine = mine.withWatermark("ts", late)
    window = F.session_window("ts", quiet)
    g = mine.groupBy(window, key).agg(F.array_sort(F.collect_set("file")).alias("files"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "files")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key (key, ts): start, end, n."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def live_metrics(calls: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Calls, errors and durations of calls(name, ts, duration_ms, error) by tumbling window."""
    if calls.isStreaming:
        calls = calls.withWatermark("ts", late)
    g = calls.groupBy(F.window("ts", every), "name").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return g.select("name", F.col("window.start").alias("start"), "calls", "errors", "total_ms", "max_ms")


def refresh(changed: DataFrame, deps: DataFrame) -> DataFrame:
    """Modules to derive anew for changed(module): themselves and their direct dependents."""
    from ..operators.dependencies import affected_modules

    return affected_modules(deps, changed).select("module").distinct()
