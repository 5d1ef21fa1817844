"""Small relational helpers with fixed meaning: projection, first-seen dedupe, ordered distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_fields(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """The fields in the order asked for; None: all. No field, or an unknown one, is an error that names sorted fields; an
    empty table takes any."""
    if fields is None:
        return df
    if not fields:
        raise ValueError("fields must not be empty")
    bad = sorted(set(fields) - set(df.columns))
    if bad:
        if df.isEmpty():
            return df
        raise ValueError(f"unknown fields {bad}; known fields {sorted(df.columns)}")
    return df.select(*fields)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keys in the order of their first place."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)
