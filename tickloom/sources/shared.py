"""The folder that driver and executors share, and tables written there to cut a plan that is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one that the session names; where a local session names none (tests), in a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a written table: computed once, however often it is read, and there when an executor is lost."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
