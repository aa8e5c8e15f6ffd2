"""Result tables: appended, partitioned by date, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_results(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Append rows to a result table. Each append is its own set of files, so writers need no lock."""
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_dates(df: DataFrame, path: str, date: str = "date") -> None:
    """Write one partition per date, replacing only the dates present."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks without a result yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One table per named sheet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
