"""Sources and sinks: typed scans and the checkpointed window store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_series_csv(spark: SparkSession, path: str, date: str = "date", value: str = "value") -> DataFrame:
    """(d, v): a two-column CSV; ``.`` and other non-numbers are null values, rows without a date go."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.expr(f"try_cast(`{date}` AS DATE)").alias("d"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("v")).filter("d IS NOT NULL")


def read_membership_csv(spark: SparkSession, path: str) -> DataFrame:
    """(d, tickers): one comma list per snapshot, normalised, sorted, distinct."""
    rows = spark.read.csv(path, header=True)
    tickers = F.array_sort(F.array_distinct(F.transform(F.split("tickers", ","), lambda t: F.regexp_replace(F.upper(F.trim(t)), r"\.", "-"))))
    return rows.select(F.to_date("date").alias("d"), tickers.alias("tickers"))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A pushed-down SQL query over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def pending_windows(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Windows not yet in the store: resume is an anti join."""
    return jobs.join(done.select("w").distinct(), "w", "left_anti")


def write_windows(edges: DataFrame, path: str) -> None:
    edges.write.mode("append").partitionBy("w").parquet(path)


def read_windows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of windows; one that holds none yet is empty."""
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
