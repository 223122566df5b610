"""What the text operators share on the Spark side."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local run without one sets its own, a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join("/tmp", "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir() or where
    return where.rstrip("/")


def settle(df: DataFrame, label: str = "part") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in all rows."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def held_out(column: str = "doc_id"):
    """crc32 of the id's text modulo 3 is 1; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _summing(dtype: str):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), dtype)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.string()), "blob": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    return run


def partition_sums(parts: DataFrame, dtype: str, fan: int = 32) -> dict[str, np.ndarray]:
    """Sum of the arrays ``blob`` of each ``key``: streamed in two levels, so memory is one array a key."""
    rows = parts.repartition(fan).mapInArrow(_summing(dtype), "key string, blob binary").repartition(1).mapInArrow(_summing(dtype), "key string, blob binary").collect()
    return {r["key"]: np.frombuffer(r["blob"], dtype) for r in rows}


def tidy() -> None:
    """Hand freed memory back to the system: idle workers are kept, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(kernel):
    """A kernel of one group that tidies after it."""

    def run(group):
        try:
            return kernel(group)
        finally:
            tidy()

    return run


def tidied_pair(kernel):
    """A kernel of two groups with one key that tidies after them."""

    def run(left, right):
        try:
            return kernel(left, right)
        finally:
            tidy()

    return run


def tidied_batches(kernel):
    """A batch kernel that tidies when its partition ends."""

    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            tidy()

    return run
