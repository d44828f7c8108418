"""The folder that driver and executors share, and results that are computed once by way of it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where a session on one machine names nothing, a temporary one is made and set, elsewhere that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="stacklight-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """df, written and read back: what reads it several times doesn't compute it again, and its rows stay the same."""
    path = f"{folder(df.sparkSession)}/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
