"""Usage metrics: durations, reports, error patterns, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 1000


def _at(sorted_array: Column, p: int) -> Column:
    """The nearest-rank percentile of a sorted array: index min(floor(n * p / 100), n - 1); 0 if it is empty."""
    n = F.size(sorted_array)
    return F.when(n > 0, F.element_at(sorted_array, (F.least(F.floor(n * p / 100), n - 1) + 1).cast("int"))).otherwise(F.lit(0.0))


def duration_stats(metrics: DataFrame, ring: int = RING) -> DataFrame:
    """One row a name of metrics(name, seq, duration_ms, error): count, errors, error_rate, avg_ms, min_ms, max_ms, p50_ms,
    p95_ms, p99_ms.

    Percentiles are exact over the last `ring` values of a name (ranked with a limit before the shuffle); the rest are
    over all. A failing call counts as a call and as an error, and error_rate is errors / (count + errors)."""
    last = metrics.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("seq")))).where(F.col("_r") <= ring)
    tail = last.groupBy("name").agg(F.array_sort(F.collect_list("duration_ms")).alias("_d"))
    whole = metrics.groupBy("name").agg(
        F.count("*").alias("count"), F.count("error").alias("errors"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.sum("duration_ms").alias("total_ms")
    )
    out = whole.join(tail, "name")
    return out.select(
        "name", "count", "errors", (F.col("errors") / (F.col("count") + F.col("errors"))).alias("error_rate"), "avg_ms", "min_ms", "max_ms",
        *[_at(F.col("_d"), p).alias(f"p{p}_ms") for p in (50, 95, 99)], "total_ms",
    )


def category(name: Column) -> Column:
    """The report section a metric belongs to, by the first word that its name holds."""
    n = F.lower(name)
    has = lambda *w: F.greatest(*[F.contains(n, F.lit(x)) for x in w]) if len(w) > 1 else F.contains(n, F.lit(w[0]))
    return F.when(has("symbol", "find"), "symbol_search").when(has("cache"), "cache_operations").when(has("file", "read", "write"), "file_operations").otherwise("other")


def report(stats: DataFrame) -> DataFrame:
    """Sections with their totals: (section, metrics, operations, errors, total_ms)."""
    return stats.groupBy(category(F.col("name")).alias("section")).agg(F.count("*").alias("metrics"), F.sum("count").alias("operations"), F.sum("errors").alias("errors"), F.sum("total_ms").alias("total_ms"))


def summary(stats: DataFrame) -> DataFrame:
    """One row: totals, error_rate and avg_operation_ms, 0 where nothing was counted."""
    n = F.coalesce(F.sum("count"), F.lit(0))
    rate = lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0))
    return stats.agg(n.alias("total_operations"), F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"), rate(F.sum("errors")).alias("error_rate"), F.coalesce(F.sum("total_ms"), F.lit(0.0)).alias("total_time_ms"), rate(F.sum("total_ms")).alias("avg_operation_ms"))


def top(stats: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k largest by a column, ties by name."""
    return stats.orderBy(F.desc(column), "name").limit(k).select("name", column)


def as_json(stats: DataFrame) -> DataFrame:
    """(name, json): a metric as a JSON document."""
    return stats.select("name", F.to_json(F.struct(*[F.col(c) for c in stats.columns])).alias("json"))


def prometheus(stats: DataFrame, prefix: str = "graphloom") -> DataFrame:
    """(name, ord, line): four sample lines a metric in the text exposition format."""
    safe = F.translate("name", ".-", "__")
    lines = [F.concat(F.lit(f'{prefix}_operation_count{{operation="'), safe, F.lit('"} '), F.col("count").cast("string"))]
    for q, p in (("0.5", "p50_ms"), ("0.95", "p95_ms"), ("0.99", "p99_ms")):
        lines.append(F.concat(F.lit(f'{prefix}_operation_duration_ms{{operation="'), safe, F.lit(f'",quantile="{q}"}} '), F.col(p).cast("string")))
    return stats.select("name", F.posexplode(F.array(*lines)).alias("ord", "line"))


def error_summary(calls: DataFrame) -> DataFrame:
    """(error, n) of calls(seq, ts, error)."""
    return calls.where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def error_patterns(calls: DataFrame, by: str = "key", burst: int = 10, seconds: int = 60) -> DataFrame:
    """For each key its latest error: consecutive (errors since the last success), rapid (the last `burst` errors lie within
    less than `seconds`), pattern: high_consecutive at 5, which goes before rapid, else null; warns at 3.

    calls(key, seq, ts, error: null for success). Counts combine before the shuffle; only the last `burst` errors of a
    key are ranked."""
    latest = calls.groupBy(by).agg(F.max(F.when(F.col("error").isNull(), F.col("seq"))).alias("_ok"), F.count("error").alias("errors"))
    errors = calls.where("error IS NOT NULL")
    # the keys that end in a success have none; only the errors of the others are joined, to a row a key
    since = errors.join(latest.select(by, "_ok"), by).where(F.col("_ok").isNull() | (F.col("seq") > F.col("_ok"))).groupBy(by).agg(F.count("*").alias("consecutive"))
    last = errors.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("_r") <= burst)
    span = last.groupBy(by).agg(F.count("*").alias("_n"), (F.max(F.when(F.col("_r") == 1, F.unix_micros(F.to_timestamp("ts")))) - F.min(F.when(F.col("_r") == burst, F.unix_micros(F.to_timestamp("ts"))))).alias("_us"))
    out = latest.join(since, by, "left").join(span, by, "left")
    consecutive = F.coalesce("consecutive", F.lit(0)).cast("long")
    rapid = F.coalesce((F.col("_n") >= burst) & (F.col("_us") < seconds * 1_000_000), F.lit(False))
    return out.select(by, "errors", consecutive.alias("consecutive"), (consecutive >= 3).alias("warns"), rapid.alias("rapid"), F.when(consecutive >= 5, "high_consecutive").when(rapid, "rapid").alias("pattern"))


def session_rollup(sessions: DataFrame) -> DataFrame:
    """One row of sessions(session_type, start_time, mcp_operations map, grep_operations): totals and adoption_rate."""
    ops = F.aggregate(F.map_values("mcp_operations"), F.lit(0).cast("long"), lambda a, x: a + x)
    t = sessions.agg(F.count("*").alias("total_sessions"), F.coalesce(F.sum(ops), F.lit(0)).alias("total_mcp_operations"), F.coalesce(F.sum("grep_operations"), F.lit(0)).alias("total_grep_operations"))
    both = F.col("total_mcp_operations") + F.col("total_grep_operations")
    return t.withColumn("adoption_rate", F.when(both > 0, F.col("total_mcp_operations") / both).otherwise(F.lit(0.0)))


def session_histogram(sessions: DataFrame, what: str) -> DataFrame:
    """(bucket, n) by type, hour (HH) or day (yyyy-MM-dd)."""
    bucket = {"type": F.coalesce("session_type", F.lit("unknown")), "hour": F.date_format("start_time", "HH"), "day": F.date_format("start_time", "yyyy-MM-dd")}[what]
    return sessions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def tool_usage(sessions: DataFrame, k: int = 10) -> DataFrame:
    """The k tools used most, ties by name."""
    return sessions.select(F.explode("mcp_operations").alias("tool", "n")).groupBy("tool").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tool").limit(k)


def session_tree(sessions: DataFrame) -> DataFrame:
    """(session_id, children): root sessions with their direct children, sorted; children of other sessions are left out."""
    child = sessions.where("parent_session IS NOT NULL").groupBy(F.col("parent_session").alias("session_id")).agg(F.array_sort(F.collect_list(F.col("session_id").alias("_c"))).alias("children"))
    return sessions.where("parent_session IS NULL").select("session_id").join(child, "session_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def last_used(accesses: DataFrame, keep: int) -> DataFrame:
    """The `keep` keys used last (key, ts), ties by key: what a least-recently-used store would hold."""
    return accesses.groupBy("key").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "key").limit(keep)
