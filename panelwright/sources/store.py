"""The folder that driver and executors share, and tables written there to cut a plan."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local run without one sets its own, a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join("/tmp", "checkpoints", uuid.uuid4().hex))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def settle(df: DataFrame, label: str = "part") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: what follows scans it, not its sources."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
