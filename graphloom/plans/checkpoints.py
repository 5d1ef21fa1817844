"""Reliable cuts of lineage: tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where none is named and the master is local does a temporary folder take
    its place; on a cluster that is an error, as executors would write where the driver can't read."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not at:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        at = f"file://{local}"
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame, name: str = "cut", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df computed once, as Parquet in the shared folder. Files stay until that folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys, for an aggregate of texts over keys that hold few rows each. Spark sorts for these, and would sort
    what a task reads once more before the shuffle, where a task's part grows with the input: nothing gets less there."""
    return df.repartition(*keys)
