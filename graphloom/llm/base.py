"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Complement of a run of ASCII white space (space, tab to carriage return).
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column, separators: str) -> Column:
    """Words between runs of separators; null gives an empty array.

    A split is linear in the text, whereas extracting matches one by one copies the text for each of them.
    """
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def space_words(c: Column) -> Column:
    return split_words(c, SPACE_RUN)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, computes df once, survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """As written(): a reliable checkpoint would compute df twice."""
    return written(df, "cut")


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing is left to read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def beside(df: DataFrame, side: DataFrame, on, how: str = "left", **keys: Column) -> DataFrame:
    """df joined to side by on(keys of df, side), all columns of df whatever their names: they travel as one struct, so
    that no name of side or of a key can clash with them. With left_semi and left_anti the columns of df come back;
    with left the struct `whole` and the columns of side."""
    whole = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]).alias("whole"), *[v.alias(k) for k, v in keys.items()])
    out = whole.join(side, on(whole, side), how)
    if how == "left":
        return out
    return out.select(*[F.col("whole")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)])
