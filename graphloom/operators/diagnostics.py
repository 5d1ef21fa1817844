"""Histories of errors and connections: the latest rows of each key, and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY, RECENT = 100, 10


def error_history(calls: DataFrame, by: str = "key", most: int = HISTORY) -> DataFrame:
    """The latest `most` errors of each key of calls(key, seq, ts, error): (key, seq, ts, error, place), place 1 the latest.
    Ranked with a limit ahead of the shuffle, so a hot key sends no more than a task's share."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))
    return calls.where("error IS NOT NULL").select(by, "seq", "ts", "error").withColumn("place", place).where(F.col("place") <= most)


def error_report(calls: DataFrame, by: str = "key", most: int = HISTORY, recent: int = RECENT) -> DataFrame:
    """(key, held, kinds, recent_errors): how many errors a key's history holds, how many different ones, and the latest,
    oldest of them first."""
    history = error_history(calls, by, most)
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= recent, F.struct("seq", "error")))), lambda x: x["error"])
    return history.groupBy(by).agg(F.count("*").alias("held"), F.count_distinct("error").alias("kinds"), last.alias("recent_errors"))


def connection_summary(events: DataFrame, now: str | None = None, recent: int = RECENT) -> DataFrame:
    """One row a connection of events(connection, ts, event): start_time, uptime_seconds and idle_seconds until `now` (else
    until the last event of all), total_events, recent_events (the latest, oldest of them first), alive: the last event
    is no shutdown."""
    ends = events.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("_end")) if now else events.agg(F.max("ts").alias("_end"))
    place = F.row_number().over(Window.partitionBy("connection").orderBy(F.desc("ts"), F.desc("event")))
    last = events.withColumn("_p", place).where(F.col("_p") <= recent).groupBy("connection").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_p"), "event"))), lambda x: x["event"]).alias("recent_events"), F.max(F.when(F.col("_p") == 1, F.col("event"))).alias("_last")
    )
    whole = events.groupBy("connection").agg(F.min("ts").alias("start_time"), F.max("ts").alias("_latest"), F.count("*").alias("total_events"))
    out = whole.join(last, "connection").join(F.broadcast(ends))  # ends is one row
    seconds = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return out.select("connection", "start_time", seconds(F.to_timestamp("_end"), F.to_timestamp("start_time")).alias("uptime_seconds"), seconds(F.to_timestamp("_end"), F.to_timestamp("_latest")).alias("idle_seconds"), "total_events", "recent_events", (F.col("_last") != "shutdown").alias("alive"))
