"""The folder that driver and executors share, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL = "/tmp/checkpoints/tessella"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, below a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or LOCAL
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str, path: str | None = None) -> DataFrame:
    """``df`` as Parquet in the shared folder: what came before isn't computed again, and its size is known."""
    path = path or shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
